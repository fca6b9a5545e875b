"""Snapshots, diffs, change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Added, removed, changed or same for each key; a null value is a value."""
    a, b = (df.select(*keys, F.struct(F.col(value).alias("x")).alias(c)) for df, c in ((old, "before"), (new, "after")))
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before.x").eqNullSafe(F.col("after.x")), "same").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upserts and tombstones that turn the old edges of sources into the new ones; a null confidence is a value."""
    keys = ["source_id", "target_id", "type"]
    a, b = (df.select(*keys, F.struct("confidence").alias(c)) for df, c in ((old, "before"), (new, "after")))
    op = F.when(F.col("after").isNull(), "tombstone").when(~F.col("before.confidence").eqNullSafe(F.col("after.confidence")) | F.col("before").isNull(), "upsert")
    return a.join(b, keys, "full").select(*keys, op.alias("op"), F.col("after.confidence").alias("confidence")).filter("op is not null")


def renames(gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """Removed ids and the one new id of the same file with the same key; ambiguous keys match nothing."""
    once = lambda df, name: df.groupBy("file", "rename_key").agg(F.min("id").alias(name), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return once(gone, "old_id").join(once(fresh, "new_id"), ["file", "rename_key"])


def stale(current: DataFrame, header: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose hash is new or differs from the header's."""
    return current.join(header.select(key, F.col(value).alias("stored")), key, "left").filter(F.col("stored").isNull() | (F.col("stored") != F.col(value))).select(key)


def replay(log: DataFrame, keys: list[str], seq: str, op: str, tombstone: str) -> DataFrame:
    """The last write of each key; tombstones go.  One aggregate with partial maxima, no sort."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("last"))
    return last.select(*keys, "last.*").filter(F.col(op) != tombstone)


def needs_compaction(log: DataFrame, op: str, tombstone: str, size: Column, most_bytes: int = 10 << 20, share: float = 0.3) -> DataFrame:
    """Records, tombstones, and whether the log should be rewritten."""
    out = log.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col(op) == tombstone).alias("tombstones"), F.sum(size).alias("bytes"))
    return out.withColumn("compact", (F.col("bytes") > most_bytes) | (F.col("tombstones") > share * F.col("records")))


def root_hash(files: DataFrame) -> DataFrame:
    """Hash of sorted hashes of 4096 groups of paths, so no task holds all of them."""
    group = F.conv(F.substring(F.sha2("path", 256), 1, 3), 16, 10).cast("int")
    inner = files.groupBy(group.alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "path", "hash"))), ","), 256).alias("h"))
    return inner.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ","), 256).alias("root"))


def prune(log: DataFrame, ts: str, cutoff) -> DataFrame:
    """Rows kept, dropped and undated (dropped as well)."""
    t = F.col(ts)
    return log.agg(F.count_if(t >= cutoff).alias("kept"), F.count_if(t < cutoff).alias("dropped"), F.count_if(t.isNull()).alias("malformed"))


def two_tracks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node_id, track) of nodes (node_id, hash, start_byte, end_byte): removed, content for new or changed hashes, offsets where only places moved.

    Places are taken over always; edges, tokens and vectors are made anew for ``content`` alone.  Nodes that stay as they are give no row.
    """
    a, b = (df.select("node_id", F.struct("hash", "start_byte", "end_byte").alias(c)) for df, c in ((old, "before"), (new, "after")))
    track = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull() | ~F.col("before.hash").eqNullSafe(F.col("after.hash")), "content").when(F.col("before") != F.col("after"), "offsets")
    return a.join(b, "node_id", "full").select("node_id", track.alias("track")).filter("track is not null")


def rerouted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose route (path and any further columns) is new, gone or another."""
    rest = [c for c in old.columns if c != "path"]
    a, b = (df.select("path", F.struct(*rest).alias(c)) for df, c in ((old, "before"), (new.select("path", *rest), "after")))
    return a.join(b, "path", "full").filter(~F.col("before").eqNullSafe(F.col("after"))).select("path")


def files_to_resolve(hits: DataFrame, removed: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths of code whose edges into a schema may have moved: found for a changed name, or using a removed node.

    ``hits`` and ``removed`` are (node_id), ``edges`` (source_id, target_id), ``nodes`` (node_id, path, kind).  Each side meets by a semi-join on its id.
    """
    users = edges.join(removed.select(F.col("node_id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("node_id"))
    code = nodes.filter(F.col("kind").isin("class", "interface", "method", "function"))
    return code.join(hits.select("node_id").unionByName(users), "node_id", "left_semi").select("path").distinct()
