"""Judging and queueing of terms, manifests, drift through redirects, a stored index."""

from pyspark.sql import functions as F

from textloom.operators import knowledge, lexical
from textloom.sources import markdown


def test_judge_and_propose(spark):
    shape = "canonical string, aliases array<string>, evidence array<string>"
    terms = spark.createDataFrame([("order", ["po"], ["a#1", "a#2"]), ("parse", None, ["a", "b#x"]), ("old", [], None)], shape)
    word = spark.createDataFrame([("parse",), ("po",)], "word string")
    held = spark.createDataFrame([("old",), ("older",)], "canonical string")
    got = {r["canonical"]: (r["contexts"], r["findings"]) for r in knowledge.judge(terms, word, held, most=2).collect()}
    assert got == {"order": (1, ["cap", "evidence", "identifier"]), "parse": (2, ["cap", "identifier"]), "old": (0, ["evidence"])}
    assert {tuple(r["findings"]) for r in knowledge.judge(terms, None, held).collect()} == {("evidence",), ()}
    queue = spark.createDataFrame([("order", 2, ["a#1"], ["po"], "text")], "canonical string, seen long, evidence array<string>, aliases array<string>, body string")
    fresh = spark.createDataFrame([("order", ["b", "a#1"], [], ""), ("new", [], [], "n")], "canonical string, evidence array<string>, aliases array<string>, body string")
    out = knowledge.propose(queue, fresh)
    assert {tuple(map(str, r)) for r in out.collect()} == {("order", "3", "['a#1', 'b']", "['po']", "text"), ("new", "1", "[]", "[]", "n")}
    events = spark.createDataFrame([("matched", ["s"], None, None)] * 3 + [("drifted", ["t"], "n", None), ("miss", [], None, "what")], "kind string, sets array<string>, node_id string, task string")
    assert {tuple(r) for r in knowledge.queue_report(out, events).collect()} == {("awaiting", "order", 3), ("awaiting", "new", 1), ("unread", "s", 3), ("drifted", "n", 1), ("misses", "what", 1)}


def test_manifest(spark):
    text = "# S\nFirst. Second.\n- [a](a.md)\n## G\n- [b](b.md) x\n- [c](c.md)\n"
    sets = markdown.knowledge_sets(spark.createDataFrame([("k/s.md", text)], "path string, content string"))
    r = knowledge.manifest_sets(sets).first()
    assert (r["name"], r["node_id"], r["summary"], r["entries"], [tuple(g) for g in r["groups"]]) == ("s", "k/s.md", "First.", 3, [("G", "k/s.md#g", 2)])
    t = markdown.terms(spark.createDataFrame([("t.md", "One. Two.")], "path string, content string"))
    assert knowledge.manifest_terms(t).first()["definition"] == "One."


def test_drift_through_redirects(spark):
    entries = spark.createDataFrame([("s", x) for x in "abcde"], "set_name string, node_id string")
    pins = spark.createDataFrame([("s", "a", "1", "r"), ("s", "b", "1", "r"), ("s", "c", "1", ""), ("s", "e", "1", "r")], "set_name string, node_id string, hash string, rename_key string")
    now = spark.createDataFrame([("a", "1", "r"), ("b2", "2", "r"), ("c2", "2", ""), ("d", "1", "r")], "node_id string, hash string, rename_key string")
    moved = spark.createDataFrame([("b", "b2"), ("c", "c2")], "old_id string, new_id string")
    got = {r["node_id"]: (r["redirected_to"], r["state"]) for r in knowledge.entries_drift(entries, pins, now, moved).collect()}
    assert got == {"a": (None, "ok"), "b": ("b2", "ok"), "c": ("c2", "drift"), "d": (None, "unpinned"), "e": (None, "gone")}


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta gammaDelta"), (3, ""), (4, None), (5, "alpha")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "beta alpha"), (1, "gamma"), (2, "nothing")], "query_id long, query string")
    path = f"file://{tmp_path}/index"
    lexical.save_index(docs, path, buckets=4)
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "doc_id", "score").collect())
    assert rows(lexical.search_index(spark, path, asked, 2)) == rows(lexical.bm25(docs, asked, 2)) != []
    some = lexical.search_index(spark, path, asked, 2, allowed=docs.filter("doc_id <> 1"))
    assert rows(some) == rows(lexical.bm25(docs, asked, 2, where=F.col("doc_id") != 1))
    spark.read.parquet(f"{path}/totals").withColumn("version", F.lit(0)).write.parquet(f"file://{tmp_path}/old/totals")
    for part in ("postings", "terms"):
        (tmp_path / "old" / part).symlink_to(tmp_path / "index" / part)
    assert lexical.search_index(spark, f"file://{tmp_path}/old", asked, 2).count() == 0
    lexical.save_index(docs.limit(0), f"file://{tmp_path}/none", buckets=2)
    assert lexical.search_index(spark, f"file://{tmp_path}/none", asked, 2).count() == 0
