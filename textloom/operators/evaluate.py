"""Reading costs, exploration and its baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_identifier_shaped, strip, terms, truncate_bytes


def grep_full(files: DataFrame, query: str) -> DataFrame:
    """Files with any term of the query and their bytes."""
    hit = F.exists(terms(F.lit(query)), lambda t: F.contains(F.lower(F.col("content")), t))
    return files.filter(hit).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"))


def grep_lines(files: DataFrame, query: str, context: int = 20) -> DataFrame:
    """(path, line_no, line) of the lines within ``context`` of a match; overlaps count once."""
    hit = F.exists(terms(F.lit(query)), lambda t: F.contains(F.lower(F.col("line")), t))
    lines = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))
    near = Window.partitionBy("path").orderBy("line_no").rowsBetween(-context, context)
    return lines.withColumn("near", F.max(F.when(hit, 1).otherwise(0)).over(near)).filter("near = 1").drop("near")


def grep_regions(files: DataFrame, query: str, context: int = 20, most: int = 100) -> DataFrame:
    """(path, start, end, matches): merged regions, lines from 1, of files by their matching lines, then path."""
    lines = grep_lines(files, query, context)
    w = Window.partitionBy("path").orderBy("line_no")
    hit = F.exists(terms(F.lit(query)), lambda t: F.contains(F.lower(F.col("line")), t))
    group = lines.withColumn("g", F.col("line_no") - F.row_number().over(w)).withColumn("matches", F.count_if(hit).over(Window.partitionBy("path")))
    regions = group.groupBy("path", "g").agg((F.min("line_no") + 1).alias("start"), (F.max("line_no") + 1).alias("end"), F.first("matches").alias("matches"))
    return regions.drop("g").orderBy(F.desc("matches"), "path", "start").limit(most)


def savings(nav: DataFrame, base: DataFrame) -> DataFrame:
    """Percent of bytes saved and tokens at four bytes each; both have one row (bytes)."""
    both = nav.select(F.col("bytes").alias("nav")).crossJoin(F.broadcast(base.select(F.col("bytes").alias("base"))))
    return both.select("nav", "base", F.round(100 * (1 - F.try_divide("nav", "base")), 6).alias("saved"), F.floor(F.col("nav") / 4).alias("tokens"))


def derive_queries(issues: DataFrame, n: int = 3) -> DataFrame:
    """(issue_id, rank, query): the title, spans in backticks, then identifiers by frequency.

    The title is the first line that isn't empty, without heading marks.  Queries are cut at
    120 bytes (whole characters), distinct whatever their case, ``n`` at most.
    """
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: strip(F.ltrim(x, F.lit("# ")))), lambda x: x != "")
    title = issues.select("issue_id", F.lit(0).alias("tier"), F.lit(0).cast("long").alias("place"), F.get(lines, F.lit(0)).alias("query"))
    spans = issues.select("issue_id", F.lit(1).alias("tier"), F.posexplode(F.regexp_extract_all("text", F.lit("`([^`\n]{2,80})`"), F.lit(1))).alias("place", "query"))
    words = issues.select("issue_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1))).alias("query")).filter(is_identifier_shaped(F.col("query")))
    names = words.groupBy("issue_id", "query").agg((-F.count(F.lit(1))).alias("place")).select("issue_id", F.lit(2).alias("tier"), "place", "query")
    both = title.unionByName(spans).unionByName(names).withColumn("query", truncate_bytes(strip(F.col("query")), 120)).filter("query != ''")
    first = both.groupBy("issue_id", F.lower("query").alias("k")).agg(F.min(F.struct("tier", "place", "query")).alias("r"))
    w = Window.partitionBy("issue_id").orderBy("r")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("issue_id", "rank", F.col("r.query").alias("query"))


#: The settings of a sweep.
SWEEP_TOP, SWEEP_FUSION, SWEEP_LEAST = (5, 10, 20), (20, 60, 100), (0.75, 0.85, 0.95)


def sweep(spark: SparkSession) -> DataFrame:
    """(name, top_k, rrf_k, least) of every combination of settings."""
    rows = [(f"k{k}-rrf{r}-mc{round(100 * c)}", k, r, c) for k in SWEEP_TOP for r in SWEEP_FUSION for c in SWEEP_LEAST]
    return spark.createDataFrame(rows, "name string, top_k int, rrf_k int, least double")


def explored_regions(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, least: float = 0.85, page: int = 20, most_lines: int = 400, most: int = 100) -> DataFrame:
    """(task_id, rank, path, start, end): seeds, then one page of neighbours of each, as regions of files.

    seeds: (task_id, query_no, rank, node_id); nodes: (node_id, kind, package, path, start, end).  Whole files, regions of
    more than ``most_lines`` and repeated ones are left out; a task reports ``most``.
    """
    first = seeds.groupBy("task_id", "node_id").agg(F.min(F.struct("query_no", "rank")).alias("seed")).join(nodes.select("node_id", "package"), "node_id", "left")
    uses = first.join(edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("id"), "confidence"), "node_id").withColumn("section", F.lit(0))
    used = first.join(edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("id"), "confidence"), "node_id").withColumn("section", F.lit(1))
    foreign = ~F.startswith("id", F.coalesce("package", F.lit("")))
    place = F.row_number().over(Window.partitionBy("task_id", "node_id").orderBy("section", F.desc("confidence"), foreign, "id"))
    near = uses.unionByName(used).filter(F.col("confidence") >= least).withColumn("place", place).filter(F.col("place") <= page)
    at = lambda stage, place: F.struct(F.lit(stage).alias("stage"), "seed", place.alias("place")).alias("at")
    visits = first.select("task_id", "node_id", at(0, F.lit(0))).unionByName(near.select("task_id", F.col("id").alias("node_id"), at(1, F.col("place"))))
    visits = visits.groupBy("task_id", "node_id").agg(F.min("at").alias("at"))
    regions = visits.join(nodes.filter((F.col("kind") != "file") & (F.col("end") - F.col("start") < most_lines)).drop("package"), "node_id")
    regions = regions.groupBy("task_id", "path", "start", "end").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy("at"))
    return regions.withColumn("rank", rank).filter(F.col("rank") <= most).select("task_id", "rank", "path", "start", "end")
