"""The source behind a node: bytes, lines and what became of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newlines(content: Column) -> Column:
    """How many line ends a binary holds."""
    text = F.decode(content, "ISO-8859-1")
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def start_line(content: Column, start: Column) -> Column:
    """The line, from 1, of a byte."""
    return newlines(F.substring(content, F.lit(1), start)) + 1


def read_code(asked: DataFrame, nodes: DataFrame, files: DataFrame, reparse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node_id, state, path, start_line, end_line, code) of each asked node_id.

    ``nodes`` are (node_id, path, start_byte, end_byte, file_hash), ``files`` (path, content binary) as
    they are now.  Nodes that the index hasn't are not_found; those without a file, or outside it,
    gone.  Where a file's hash moved, ``reparse`` gives its nodes anew, with state reparsed, and those
    it hasn't are gone; without it they are stale.
    """
    now = files.select("path", "content", F.sha2("content", 256).alias("hash_now"))
    known = nodes.select("node_id", "path", "start_byte", "end_byte", "file_hash", F.lit(True).alias("known"))
    met = asked.select("node_id").distinct().join(known, "node_id", "left").join(now, "path", "left")
    moved = F.coalesce(F.col("file_hash") != F.col("hash_now"), F.lit(False))
    if reparse is None:
        met = met.withColumn("moved", moved).withColumn("found", ~moved)
    else:
        changed = met.filter(moved).select("path").distinct()
        fresh = reparse(files.join(changed, "path", "left_semi")).select("node_id", "path", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))
        met = met.withColumn("moved", moved).join(fresh, ["node_id", "path"], "left").withColumn("found", ~F.col("moved") | F.col("s").isNotNull())
        met = met.withColumn("start_byte", F.when(F.col("moved"), F.col("s")).otherwise(F.col("start_byte"))).withColumn("end_byte", F.when(F.col("moved"), F.col("e")).otherwise(F.col("end_byte")))
    outside = F.col("content").isNull() | (F.col("end_byte") > F.octet_length("content")) | (F.col("start_byte") > F.col("end_byte"))
    lost = F.lit("stale" if reparse is None else "gone")
    state = F.when(F.col("known").isNull(), "not_found").when(F.col("content").isNull(), "gone").when(~F.col("found"), lost).when(outside, "gone").when(F.col("moved"), "reparsed").otherwise("ok")
    met = met.withColumn("state", state).withColumn("slice", F.when(F.col("state").isin("ok", "reparsed"), F.substring("content", F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte"))))
    first = F.when(F.col("slice").isNotNull(), start_line(F.col("content"), F.col("start_byte")))
    return met.select("node_id", "state", "path", first.alias("start_line"), (first + newlines(F.col("slice"))).alias("end_line"), F.make_valid_utf8(F.col("slice").cast("string")).alias("code"))


def points(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, display, path, start_line, kind) of the asked nodes that exist."""
    return nodes.join(asked.select("node_id").distinct(), "node_id", "left_semi").select("node_id", "display", "path", "start_line", "kind")
