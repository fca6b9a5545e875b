"""Results of a search: symbols named outright come first, then ranked ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import identifier_tokens, strip
from .lexical import ranked


def exact_hits(queries: DataFrame, symbols: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id, place): symbols (node_id, simple_name) that a query is, or that its words name.

    A query without white space that is an id or a name gives up to ``k``: the id first, then by id.  Only if
    there are none do its words that look like code count, in order, for half of ``k`` (1 at least).
    """
    whole = queries.select("query_id", F.lit(0).alias("tier"), F.lit(0).alias("word"), strip(F.col("query")).alias("name")).filter((F.col("name") != "") & ~F.col("name").rlike(r"[ \t\n]"))
    words = queries.select("query_id", F.lit(1).alias("tier"), F.posexplode(identifier_tokens(F.col("query"))).alias("word", "name"))
    names = symbols.select("node_id", F.col("node_id").cast("string").alias("name"), F.lit(0).alias("by_name")).unionByName(symbols.select("node_id", F.col("simple_name").alias("name"), F.lit(1).alias("by_name")))
    hits = whole.unionByName(words).join(names, "name").groupBy("query_id", "node_id").agg(F.min(F.struct("tier", "word", "by_name")).alias("at"))
    tiers = hits.groupBy("query_id").agg(F.min("at.tier").alias("tier"))
    hits = hits.join(tiers, "query_id").filter(F.col("at.tier") == F.col("tier"))
    return ranked(hits, "query_id", ["at", "node_id"], k).filter((F.col("tier") == 0) | (F.col("rank") <= max(1, k // 2))).select("query_id", "node_id", F.col("rank").alias("place"))


def pinned(queries: DataFrame, symbols: DataFrame, found: DataFrame, k: int, admitted: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, node_id, match): exact hits, then ``found`` (query_id, node_id, rank, match), each node once, ``k`` in all.

    ``admitted`` (node_id) restricts both streams before anything is counted.
    """
    if admitted is not None:
        only = admitted.select("node_id").distinct()
        symbols, found = symbols.join(only, "node_id", "left_semi"), found.join(only, "node_id", "left_semi")
    exact = exact_hits(queries, symbols, k).select("query_id", "node_id", F.struct(F.lit(0).alias("stream"), "place", F.lit("exact").alias("match")).alias("at"))
    rest = found.select("query_id", "node_id", F.struct(F.lit(1).alias("stream"), F.col("rank").alias("place"), "match").alias("at"))
    first = exact.unionByName(rest).groupBy("query_id", "node_id").agg(F.min("at").alias("at"))
    return ranked(first, "query_id", ["at", "node_id"], k).select("query_id", "rank", "node_id", F.col("at.match").alias("match"))
