"""Personal data by weak supervision, in DataFrame functions only.

Candidates come from regular expressions: the base kinds, which always stay, and
looser forms.  Three labelers vote on each candidate: its strict pattern, a
gazetteer, and words of context before it.  Counts of vote patterns over the whole
corpus (a table bounded by kinds x votes x sizes) feed expectation-maximisation for
the labelers' reliabilities, kind by kind, from common priors; its posteriors train a small logistic span classifier,
which then decides, as a Column expression, which looser candidates become spans.

Positions: the text is split at the matches, and lengths of gaps and matches add up
to code points, block by block.  Patterns are written so that no text makes them backtrack far;
they match what the plain forms match.

Defined cases: a null text is empty; a null doc_id stays null; repeated rows give
equal rows; texts of any length are scanned whole; an empty table gives an empty
result and a classifier from priors; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stash, table

KINDS = ("email", "ip", "card", "phone", "ssn")
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
_CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_AT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++"
_LOCAL = r"(?<![0-9+)(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Cues before a candidate, and gazetteer entries inside it, by kind.
CUES = {"email": "mail|contact|write to|e-mail", "ip": r"\bip\b|address|host|server", "card": "card|visa|amex|credit|payment", "phone": "phone|tel|call|mobile|fax|cell", "ssn": "ssn|social|security|taxpayer"}
GAZETTEER = {"email": r"gmail|yahoo|outlook|hotmail|mail|example|\.(com|org|net|edu|de|fr|es)$", "ip": r"^(10|127|172|192)\.", "card": "^(3[47]|4|5[1-5]|6011)", "phone": r"^\+?(1|33|34|44|49|\()", "ssn": "^(?!000|666|9)"}


_BLOCK = 64


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def spans_of(text: Column, rule: str) -> Column:
    """array<struct<start, end, hit, before>> of the matches of a rule, in code points; before: the last of the gap before it.

    Places are sums of the gaps and matches before: sums of whole blocks of matches first,
    then a match adds those of its own block, so the cost stays about that of the text.
    """
    def add(xs):
        return F.aggregate(xs, F.lit(0).cast("long"), lambda a, b: a + b)

    hits = F.regexp_extract_all(text, F.lit(rule), F.lit(0))
    pairs = F.zip_with(hits, F.slice(F.split(text, rule, -1), F.lit(1), F.size(hits)), lambda m, g: F.struct(m.alias("hit"), F.length(g).cast("long").alias("gap"), (F.length(g) + F.length(m)).cast("long").alias("both"), F.substring(g, -24, 24).alias("before")))

    def placed(found):
        sizes = F.transform(found, lambda x: x["both"])

        def by_block(sizes):
            blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sizes) / _BLOCK).cast("int")), lambda b: add(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))))
            return let(blocks, lambda sums: let(F.transform(sums, lambda _, i: add(F.slice(sums, F.lit(1), i))), lambda firsts: rows(sizes, firsts)))

        def rows(sizes, firsts):
            def row(x, i):
                block = F.floor(i / _BLOCK).cast("int")
                start = F.get(firsts, block) + add(F.slice(sizes, block * _BLOCK + 1, i % _BLOCK)) + x["gap"]
                return let(start, lambda at: F.struct(at.alias("start"), (at + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), x["before"].alias("before")))

            return F.transform(found, row)

        return let(sizes, by_block)

    return let(pairs, placed)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, base, strict, gazetteer, context, size>>."""
    some = lambda when, rule: F.when(when, spans_of(text, rule)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,hit:string,before:string>>"))
    digits, at, plus = text.rlike("[0-9]"), F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    rules = (
        (0, at, _EMAIL, lambda x: F.lit(True), True),
        (1, digits, _IP, lambda x: x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), True),
        (2, digits, _CARD, lambda x: (F.length(_digits(x)) <= 19) & F.call_function("luhn_check", _digits(x)), None),
        (3, plus & digits, _PHONE, lambda x: F.length(_digits(x)).between(9, 15), True),
        (0, F.contains(text, F.lit("at]")) | F.contains(text, F.lit("at)")), _AT, lambda x: F.lit(False), False),
        (3, digits, _LOCAL, lambda x: F.lit(False), False),
        (4, digits, _SSN, lambda x: F.lit(False), False),
    )
    def row_of(kind, strict, base):
        name = KINDS[kind]

        def row(x):
            ok = F.coalesce(strict(x["hit"]), F.lit(False))
            before = F.lower(x["before"])
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (ok if base is not False else F.lit(False)).alias("base"), (ok if base is not False else F.lit(True)).cast("int").alias("strict"), x["hit"].rlike(GAZETTEER[name]).cast("int").alias("gazetteer"), before.rlike(CUES[name]).cast("int").alias("context"), F.least(F.lit(3).cast("bigint"), (x["end"] - x["start"] - 1) / 8).cast("int").alias("size"))

        return row

    parts = []
    for kind, when, rule, strict, base in rules:
        found = F.transform(some(when, rule), row_of(kind, strict, base))
        # A failing match of a base rule is no candidate, but a long number with a wrong check digit is.
        parts.append(F.filter(found, lambda x: x["base"]) if base else found)
    return F.concat(*parts)


def reliabilities(patterns: list[tuple[tuple[int, int, int], float]], rounds: int = 50) -> tuple[float, list[tuple[float, float]], dict]:
    """EM over (votes, count): prior, (hit rate, false alarm rate) of each labeler, posterior of each pattern."""
    prior, rates = 0.5, [(0.9, 0.3), (0.7, 0.4), (0.6, 0.1)]
    post: dict = {}
    for _ in range(rounds):
        for votes, _n in patterns:
            p = q = 1.0
            for v, (hit, alarm) in zip(votes, rates):
                p, q = p * (hit if v else 1 - hit), q * (alarm if v else 1 - alarm)
            post[votes] = prior * p / (prior * p + (1 - prior) * q)
        total = sum(n for _, n in patterns)
        if not total:
            break
        yes = sum(n * post[v] for v, n in patterns)
        prior = min(0.95, max(0.05, (yes + 1) / (total + 2)))
        rates = [
            (min(0.99, (sum(n * post[v] for v, n in patterns if v[i]) + 1 + rates[i][0]) / (yes + 3)), max(0.01, (sum(n * (1 - post[v]) for v, n in patterns if v[i]) + rates[i][1]) / (total - yes + 3)))
            for i in range(3)
        ]
    return prior, rates, post


def train(rows: list[tuple[tuple[float, ...], float, float]], steps: int = 300, rate: float = 0.5) -> list[float]:
    """Logistic weights, bias first, for (features, target probability, weight)."""
    width = len(rows[0][0]) if rows else 8
    w, total = [0.0] * (width + 1), sum(n for *_, n in rows) or 1.0
    for _ in range(steps):
        grad = [1e-3 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + sum(a * b for a, b in zip(w[1:], x))))))
            for i, v in enumerate((1.0, *x)):
                grad[i] += (p - y) * v * n / total
        w = [a - rate * g for a, g in zip(w, grad)]
    return w


def _features(kind, strict, gazetteer, context, size):
    return (strict, gazetteer, context, size == 0, size >= 3, *(kind == k for k in (2, 3, 4)))


def find_pii(docs: DataFrame, threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` with doc_id and spans, array<struct<kind, start, end, base>> by kind, then start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, candidates(text).alias("found")), "pii")
    one = found.filter("size(found) > 0").select(F.explode("found").alias("c")).select("c.*")
    counts = [tuple(r) for r in one.groupBy("kind", "strict", "gazetteer", "context", "size").agg(F.count(F.lit(1)).alias("n")).collect()]
    votes: dict[int, dict[tuple, float]] = {}
    for k, s, g, c, _, n in counts:
        own = votes.setdefault(k, {})
        own[(s, g, c)] = own.get((s, g, c), 0) + n
    post = {k: reliabilities(sorted(own.items()))[2] for k, own in votes.items()}
    w = train([(tuple(map(float, _features(k, s, g, c, z))), post[k][(s, g, c)], float(n)) for k, s, g, c, z, n in sorted(counts)])

    def likely(c):
        x = _features(c["kind"], c["strict"], c["gazetteer"], c["context"], c["size"])
        z = F.lit(w[0])
        for a, f in zip(w[1:], x):
            z = z + F.lit(a) * f.cast("double")
        return z >= math.log(threshold / (1 - threshold))

    base = F.filter("found", lambda c: c["base"])
    clear = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    more = F.filter("found", lambda c: ~c["base"] & likely(c) & clear(c))
    slim = lambda xs: F.transform(xs, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))
    return found.select("doc_id", *keep, F.array_sort(slim(F.concat(base, more))).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span (overlaps count once) replaced by its kind in brackets."""
    byplace = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc, s):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0).cast("long"), s["start"] - acc["at"]).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.element_at(names, s["kind"] + 1)).otherwise("")
        return F.struct(F.concat(acc["out"], gap, mark).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(byplace, start, step, rest)).otherwise(text)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = [count(k) for k in range(4)]
    return find_pii(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
