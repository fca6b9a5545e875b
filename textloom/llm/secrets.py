"""Secret scan with corpus-wide ownership frequency.

One scan finds candidate credentials in every text: the base kinds (assign, access,
hex) and formats of well-known issuers.  The hash of each candidate's value is then
aggregated over the corpus: a value seen in few repositories of one owner looks
like a live credential and adds a span of kind ``live`` over the value, unless it is
a placeholder or has few different characters; a value that many owners or
repositories hold is a copied example and adds a span of kind ``copied``.  Base spans
always stay.  Values never leave the scan, only hashes do.

Ownership counts are distinct counts in two steps, so a value that a third of all
rows hold is pre-aggregated by repository and owner first; the marks are written, so
that the join of values with them is split where a value is hot.  Where documents are
no part of repositories, each is one (``repo``).

Defined cases: a null text is empty; a null owner or repository counts as one
unknown; repeated rows count as one repository; texts of any length are scanned
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import blocks
from .shared import lean, stash, table

KINDS = ("assign", "access", "hex", "live", "copied")
_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
#: Formats of well-known issuers; the value is the whole match.
_ISSUED = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----")
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
#: Words of placeholders.
_PLAIN = re.compile(rb"(?i)example|changeme|placeholder|your[_-]|dummy|sample|redacted|xxxx")
_VALUE = pa.list_(pa.struct([("hash", pa.int64()), ("looks", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))


def matches(text: bytes):
    """(kind or None, start, end, value start, value end) in bytes."""
    for m in _ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 6:
            yield 0, m.start(), m.end(), m.start(1), m.end(1)
    for kind, rule in ((1, _ACCESS), (2, _HEX), (None, _ISSUED)):
        for m in rule.finditer(text):
            yield kind, m.start(), m.end(), m.start(), m.end()


def looks_live(value: bytes) -> bool:
    return len(set(value)) >= 5 and not _PLAIN.search(value)


def _scan(batches):
    for rows, data, offs in blocks(batches):
        # Documents one after another, a line end between them: no rule crosses line ends.
        raw, cuts = data.tobytes(), offs.tolist()
        joined = b"\n".join(raw[a:b] for a, b in zip(cuts, cuts[1:]))
        begins = [a + i for i, a in enumerate(cuts[:-1])]
        lead = np.append(0, np.cumsum(np.frombuffer(joined, np.uint8) & 0xC0 != 0x80))
        found: dict[int, list] = {}
        for hit in matches(joined):
            found.setdefault(bisect_right(begins, hit[1]) - 1, []).append(hit)
        spans, values, counts = [], [], ([], [], [])
        for i, a in enumerate(begins):
            hits = found.get(i, ())
            at = {b: int(lead[b] - lead[a]) for b in {x for h in hits for x in h[1:]}}
            spans.append(sorted({(at[h[1]], h[0], at[h[2]]) for h in hits if h[0] is not None}))
            values.append(sorted({(int.from_bytes(hashlib.blake2b(joined[h[3] : h[4]], digest_size=8).digest(), "little", signed=True), looks_live(joined[h[3] : h[4]]), at[h[3]], at[h[4]]) for h in hits}))
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in spans[-1]))
        sha = [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x).encode()).hexdigest() for x in spans]
        dicts = lambda xs, names: [[dict(zip(names, x)) for x in y] for y in xs]
        cols = [rows.column("doc_id"), rows.column("repo"), rows.column("owner"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha), pa.array(dicts(spans, ("start", "kind", "end")), _SPAN), pa.array(dicts(values, ("hash", "looks", "start", "end")), _VALUE)]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "base", "values"])


def scan_secrets(docs: DataFrame, repo: str = "doc_id", owner: str = "source", max_owners: int = 1, max_repos: int = 3) -> DataFrame:
    """doc_id, counts, base_sha256, and spans: array of (start, kind, end) in code points."""
    lean(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"))
    found = docs.mapInArrow(_scan, "doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:long,kind:int,end:long>>, values array<struct<hash:long,looks:boolean,start:long,end:long>>")
    found = stash(found.withColumn("uid", F.monotonically_increasing_id()), "secrets")
    values = found.select("uid", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner"), F.explode("values").alias("v")).select("uid", "repo", "owner", "v.*")
    held = values.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    few = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    marks = stash(held.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos")).select("hash", F.when(few, 3).otherwise(4).alias("kind")), "marks")
    marked = values.select("uid", "hash", "looks", "start", "end").join(marks.hint("merge"), "hash").filter("looks or kind = 4")
    more = marked.groupBy("uid").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    out = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    plain = found.filter("size(values) = 0").select(*out, F.col("base").alias("spans"))
    with_more = found.filter("size(values) > 0").join(more, "uid", "left").select(*out, F.sort_array(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:long,kind:int,end:long>>")))).alias("spans"))
    return plain.unionByName(with_more)


def spans_text(spans, kinds):
    """kind:start:end, comma-joined, of an array of spans in order."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).withColumn("spans", spans_text(F.col("spans"), KINDS))
