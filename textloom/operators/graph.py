"""Tiered resolution, database references, exploring, dangling edges (J4 without arity, J8-J10, T4, T5, T12, A4, A6, G2, G3, G8, X8)."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stash

SAME, NEAR, GLOBAL = 0.95, 0.90, 0.80
#: Confidences of database references: fixed values.
EXACT, LOGICAL, TOKEN = 1.0, 0.9, 0.8


#: Ids in a block, about.
BLOCK = 1000


def blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, block, members): the member column of each class in lists of about BLOCK, dealt by hash."""
    counts = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("of"))
    dealt = rows.join(counts, by).withColumn("block", F.pmod(F.xxhash64("member"), F.col("of")))
    return dealt.groupBy(*by, "block").agg(F.collect_list("member").alias("members"))


def tiles(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(*by, left, right): blocks of the same class side by side, spread evenly, to be exploded where they lie.

    Lists move, not pairs: a tile of up to BLOCK x BLOCK pairs holds 2 x BLOCK members, so a
    class of any size falls to many tasks.
    """
    both = left.select(*by, F.col("block").alias("i"), F.col("members").alias("left")).join(right.select(*by, F.col("block").alias("j"), F.col("members").alias("right")), by)
    return both.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "i", "j").drop("i", "j")


def resolve(calls: DataFrame, definitions: DataFrame, tier: Column, key: str = "name", most: int = 5) -> DataFrame:
    """J4 without the arity range: (source_id, target_id, confidence) of the strongest non-empty tier of each call.

    ``tier`` is 1 (same package), 2 (imported) or 3 (global) of a joined pair; more
    than ``most`` global candidates drop all of them.  Self edges go.  ``tier`` may use any
    column of either side but the ids: calls and definitions alike in all others are a
    class, tiers and counts are settled on pairs of classes, and pairs of ids are made
    last, in tiles that don't move.  Only what may come twice is grouped by pair.
    """
    of = lambda df, name, *ids: df.select(*ids, F.struct(key, *(c for c in df.columns if c not in (*ids, key))).alias(name))
    calls = of(calls.filter(F.col(key).isNotNull() & F.col("source_id").isNotNull()), "_asking", "call_id", "source_id")
    known = of(definitions.filter(F.col(key).isNotNull() & F.col("target_id").isNotNull()), "_asked", "target_id")
    sides = calls.select("_asking").distinct().select("_asking", "_asking.*").join(known.groupBy("_asked").agg(F.count(F.lit(1)).alias("_n")).select("_asked", "_n", "_asked.*"), key)
    links = stash(sides.select("_asking", "_asked", "_n", tier.alias("_tier")).filter("_tier is not null"), "links")

    counts = links.groupBy("_asking", "_tier").agg(F.sum("_n").alias("_n"))
    call = F.struct("call_id", "source_id", "_asking")  # null ids are equal inside
    rows = calls.groupBy(call.alias("_call")).agg(F.count(F.lit(1)).alias("_times")).select("_call", "_times", "_call._asking")
    own = calls.distinct().join(known, (F.col("source_id") == F.col("target_id")) & (F.col(f"_asking.{key}") == F.col(f"_asked.{key}"))).select(call.alias("_call"), "_asking.*", F.col("_asked"))
    own = own.select("_call", *(c for c in own.columns if c not in ("_call", "_asked", key)), "_asked.*").withColumn("_tier", tier).groupBy("_call", "_tier").agg(F.count(F.lit(1)).alias("_self"))
    rows = rows.join(counts, "_asking").join(own, ["_call", "_tier"], "left").withColumn("_n", (F.col("_n") - F.coalesce("_self", F.lit(0))) * F.col("_times")).filter("_n > 0").select("_call.*", "_tier", "_n")
    by_call = Window.partitionBy("call_id")
    best = rows.withColumn("_best", F.min("_tier").over(by_call)).filter("_tier = _best").withColumn("_all", F.sum("_n").over(by_call))
    kept = best.filter((F.col("_tier") < 3) | (F.col("_all") <= most)).select("source_id", "_asking", "_tier").distinct()
    kept = stash(kept.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy("source_id", f"_asking.{key}")) > 1), "kept")
    known = known.distinct()
    repeated = stash(known.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("target_id"), "repeated")

    def pairs(asking: DataFrame, asked: DataFrame) -> DataFrame:
        left = blocks(asking.select("_asking", "_tier", F.col("source_id").alias("member")), ["_asking", "_tier"]).join(links.drop("_n"), ["_asking", "_tier"])
        left = left.select("_asked", F.xxhash64("_asking", "_tier", "block").alias("block"), F.struct("_tier", "members").alias("members"))
        made = tiles(left, blocks(asked.select("_asked", F.col("target_id").alias("member")), ["_asked"]), ["_asked"])
        one = made.select("left.members", F.col("left._tier").alias("tier"), F.explode("right").alias("target_id"))
        confidence = F.when(F.col("tier") == 1, SAME).when(F.col("tier") == 2, NEAR).otherwise(GLOBAL)
        return one.select(F.explode("members").alias("source_id"), "target_id", confidence.alias("confidence")).filter("source_id != target_id")

    # A pair can come twice from a source that asks for a name in several ways, or a target that stands in several rows.
    several, again = not kept.filter("_many").isEmpty(), not repeated.isEmpty()
    out = pairs(kept.filter("not _many"), known.join(repeated, "target_id", "left_anti") if again else known)
    twice = ([pairs(kept.filter("_many"), known)] if several else []) + ([pairs(kept.filter("not _many"), known.join(repeated, "target_id", "left_semi"))] if again else [])
    if twice:
        out = out.unionByName((twice[0].unionByName(twice[1]) if len(twice) > 1 else twice[0]).groupBy("source_id", "target_id").agg(F.max("confidence").alias("confidence")))
    return out


def database_references(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """(source_id, target_id, type, confidence) of references among database objects.

    ``refs`` has source_id, source_kind, datasource, how and name; how is exact or logical
    (name is an id, which may dangle) or token (a word of a definition).  ``definitions``
    has id, name, kind and datasource.  A token names tables and views of its own
    datasource; one that nothing anywhere is called is looked up in capitals instead.
    The strongest of several references to a target stays, self references go.  Rows with
    a null name or source_id give nothing.
    """
    refs = refs.select("source_id", "source_kind", "datasource", "how", "name").filter("name is not null and source_id is not null")
    definitions = definitions.select("id", F.col("name").alias("called"), "kind", F.col("datasource").alias("home"))
    kinds = definitions.select(F.col("id").alias("name"), "kind").filter("name is not null").dropDuplicates(["name"])
    table = F.col("source_kind") == "table"
    routine = F.col("kind").isin("function", "procedure")
    exact = refs.filter("how = 'exact'").join(kinds, "name", "left")
    exact = exact.select("source_id", F.col("name").alias("target_id"), F.when(table, "foreign_key").when(routine, "call").otherwise("reference").alias("type"), F.lit(EXACT).alias("confidence"))
    logical = refs.filter("how = 'logical'").select("source_id", F.col("name").alias("target_id"), F.when(table, "foreign_key").otherwise("reference").alias("type"), F.lit(LOGICAL).alias("confidence"))
    # Distinct names decide which spelling to look up; the datasource is part of the join's key, so a common name makes no pairs across datasources.
    names = definitions.select(F.col("called").alias("name")).distinct().withColumn("known", F.lit(True))
    words = refs.filter("how = 'token'").select("source_id", "datasource", "name").distinct().join(names, "name", "left")
    words = words.select("source_id", F.col("datasource").alias("home"), F.when(F.col("known"), F.col("name")).otherwise(F.upper("name")).alias("called"))
    tokens = words.join(definitions.filter("kind in ('table', 'view')"), ["called", "home"])
    tokens = tokens.select("source_id", F.col("id").alias("target_id"), F.lit("reference").alias("type"), F.lit(TOKEN).alias("confidence"))
    every = exact.unionByName(logical).unionByName(tokens).filter("source_id != target_id")
    return every.groupBy("source_id", "target_id").agg(F.max_by("type", "confidence").alias("type"), F.max("confidence").alias("confidence"))


def snake(name: Column) -> Column:
    """A CamelCase name in snake_case: JobPosting is job_posting, HTTPRoute is http_route."""
    parted = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=.)(?=[A-Z][a-z])", "_")
    return F.translate(parted, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def code_to_tables(refs: DataFrame, definitions: DataFrame, missing: Column | None = None, most: int = 5) -> DataFrame:
    """(source_id, target_id, confidence) of code's references to tables and views.

    ``refs`` has source_id, how (explicit, client, sql or convention) and name;
    ``definitions`` has id, name, kind and datasource.  A name is looked up as it stands
    and in capitals, one by convention also in snake_case and small letters.  More than
    ``most`` targets drop the reference; targets in several datasources weaken it.
    ``missing`` is the id that an explicit name without a target gets (none: no edge).
    Rows with a null name or source_id give nothing.
    """
    refs = refs.select("source_id", "how", "name").filter("name is not null and source_id is not null").distinct()
    known = definitions.filter("kind in ('table', 'view') and name is not null").select(F.col("name").alias("called"), "id", F.col("datasource").alias("home")).distinct()
    # A name with too many targets settles its references by itself, so no reference meets more than ``most`` rows a spelling.
    counts = known.groupBy("called").agg(F.count_distinct("id").alias("n"))
    few = known.join(counts.filter(F.col("n") <= most), "called").select("called", "id", "home", F.lit(False).alias("many"))
    targets = few.unionByName(counts.filter(F.col("n") > most).select("called", F.lit(None).cast("string").alias("id"), F.lit(None).cast(known.schema["home"].dataType).alias("home"), F.lit(True).alias("many")))
    plain = F.array("name", F.upper("name"))
    spelt = F.when(F.col("how") == "convention", F.concat(plain, F.array(snake(F.col("name")), F.lower("name")))).otherwise(plain)
    met = refs.withColumn("called", F.explode(F.array_distinct(spelt))).join(targets, "called", "left")
    found = met.groupBy("source_id", "how", "name").agg(F.collect_set("id").alias("ids"), F.min("home").alias("a"), F.max("home").alias("b"), F.max("many").alias("many"))
    certain = F.when(F.col("how") == "explicit", EXACT).when(F.col("how").isin("client", "sql"), LOGICAL).otherwise(TOKEN)
    sure = found.filter(~F.coalesce("many", F.lit(False)) & (F.size("ids") <= most))
    edges = sure.select("source_id", F.explode("ids").alias("target_id"), F.when(F.col("a") == F.col("b"), certain).otherwise(TOKEN).alias("confidence"))
    if missing is not None:
        edges = edges.unionByName(sure.filter((F.size("ids") == 0) & (F.col("how") == "explicit")).select("source_id", missing.alias("target_id"), F.lit(EXACT).alias("confidence")))
    return edges.filter("source_id != target_id").groupBy("source_id", "target_id").agg(F.max("confidence").alias("confidence"))


def explore(edges: DataFrame, node: str, direction: str = "both", least: float = 0.85, page: int = 20, after: str | None = None, package: str = "") -> DataFrame:
    """One page of neighbours by section, confidence, own package first, id; keyset pagination."""
    uses = edges.filter(F.col("source_id") == node).select(F.lit(0).alias("section"), F.col("target_id").alias("id"), "type", "confidence")
    used = edges.filter(F.col("target_id") == node).select(F.lit(1).alias("section"), F.col("source_id").alias("id"), "type", "confidence")
    both = uses if direction == "uses" else used if direction == "used_by" else uses.unionByName(used)
    rows = both.filter(F.col("confidence") >= least).withColumn("foreign", F.when(F.startswith("id", F.lit(package)), 0).otherwise(1))
    if after:
        key = read_cursor(after)
        if key and key["node"] == node:
            place = F.struct("section", -F.col("confidence"), "foreign", "id")
            rows = rows.filter(place > F.struct(F.lit(key["section"]), F.lit(-key["confidence"]), F.lit(key["foreign"]), F.lit(key["id"])))
    return rows.orderBy("section", F.desc("confidence"), "foreign", "id").limit(page)


def cursor(node: str, row) -> str:
    """T5: where the next page begins."""
    return base64.urlsafe_b64encode(json.dumps({"node": node, "section": row["section"], "confidence": row["confidence"], "foreign": row["foreign"], "id": row["id"]}).encode()).decode()


def read_cursor(text: str) -> dict | None:
    try:
        key = json.loads(base64.urlsafe_b64decode(text))
        return key if {"node", "section", "confidence", "foreign", "id"} <= set(key) else None
    except (ValueError, TypeError):
        return None


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target doesn't exist."""
    return edges.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_anti")


def strongest(edges: DataFrame) -> DataFrame:
    """A4: the most confident edge of each (source, target); the first rule wins a tie."""
    w = Window.partitionBy("source_id", "target_id").orderBy(F.desc("confidence"), "rule_no")
    return edges.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def reverse_stats(edges: DataFrame) -> DataFrame:
    """Targets and edges by type."""
    return edges.groupBy("type").agg(F.count_distinct("target_id").alias("targets"), F.count(F.lit(1)).alias("edges"))


def redirects(hops: DataFrame) -> DataFrame:
    """(old_id, new_id, epoch) with chains followed to their end by doubling.

    Every round is written, so the plan stays small, and halves what is left of a chain;
    it ends when nothing moves.  Chains that run into a cycle have no end: after as many
    rounds as the longest possible chain needs they go, as do repeated hops of an id but
    the latest.
    """
    now = hops.groupBy("old_id").agg(F.max_by("new_id", F.struct("epoch", "new_id")).alias("new_id"), F.max("epoch").alias("epoch"))
    now = stash(now.filter("old_id != new_id"), "redirects")
    rounds = max(1, now.count()).bit_length()
    for _ in range(rounds + 1):
        nxt = now.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("further"), F.col("epoch").alias("later"))
        both = now.select("old_id", "new_id", "epoch").join(nxt, "new_id", "left")
        now = stash(both.select("old_id", F.coalesce("further", "new_id").alias("new_id"), F.greatest("epoch", F.coalesce("later", "epoch")).alias("epoch"), F.col("further").isNotNull().alias("moved")), "redirects")
        if now.filter("moved").isEmpty():
            break
    return now.filter("not moved").select("old_id", "new_id", "epoch")
