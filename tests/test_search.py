"""Pinned search, shell commands and knowledge sets, on cases told by hand."""

import pytest
from pyspark.sql import functions as F

from textloom.functions.shell import shell_search
from textloom.operators import evaluate, knowledge, search


def test_pinned(spark):
    symbols = spark.createDataFrame([("m.getUser", "getUser"), ("a.getUser", "getUser"), ("getUser", "x"), ("b.HEAD_REF", "HEAD_REF"), *((f"o{i}.runAll", "runAll") for i in range(6)), (None, None)], "node_id string, simple_name string")
    asked = spark.createDataFrame([(0, " getUser "), (1, "how does runAll, or HEAD_REF work?"), (2, "plain words"), (3, None), (4, "")], "query_id long, query string")
    found = spark.createDataFrame([(q, n, r, "lexical") for q in (0, 1, 2) for r, n in enumerate(("b.HEAD_REF", "a.getUser", "z", "o5.runAll"), 1)], "query_id long, node_id string, rank int, match string")
    tell = lambda df: {q: [(r.node_id, r.match) for r in sorted(df.collect(), key=lambda r: r.rank) if r.query_id == q] for q in range(5)}
    got = tell(search.pinned(asked, symbols, found, 4))
    assert got[0] == [("getUser", "exact"), ("a.getUser", "exact"), ("m.getUser", "exact"), ("b.HEAD_REF", "lexical")]
    assert got[1] == [("o0.runAll", "exact"), ("o1.runAll", "exact"), ("b.HEAD_REF", "lexical"), ("a.getUser", "lexical")]
    assert got[2] == [("b.HEAD_REF", "lexical"), ("a.getUser", "lexical"), ("z", "lexical"), ("o5.runAll", "lexical")]
    assert got[3] == got[4] == []
    some = spark.createDataFrame([("m.getUser",), ("z",)], "node_id string")
    assert tell(search.pinned(asked, symbols, found, 4, some))[0] == [("m.getUser", "exact"), ("z", "lexical")]
    assert tell(search.pinned(asked, symbols, found, 1))[1] == [("o0.runAll", "exact")]


COMMANDS = {
    "grep -rn 'two words' src": "two words", "cd x && rg -A 3 -t py foo": "foo", "git grep -e -x y": "-x", "git log": None, "find . -type f -iname '*.py' -name b": "*.py", "find . -name": "", "ls | /usr/bin/egrep -v \"a b\"c": "a bc",
    "cat a; sed x": None, "grep -e": "", "grep": "", "": None, "fd --glob '*.x'": "", "echo grep": None, "git": None, "a || ack \"open quote": "open quote", "grep '' z": "z", "true\nag q": "q", "find -name find -path": "find",
}


def test_shell_search(spark):
    got = {r.x: (r.s.pattern if r.s.search else None) for r in spark.createDataFrame([(c,) for c in (*COMMANDS, None)], "x string").select("x", shell_search(F.col("x")).alias("s")).collect()}
    assert got == COMMANDS | {None: None}


def test_sets(spark):
    sets = spark.createDataFrame([("release", "Release notes", "cut tag publish", ["QA"]), ("style", "Style", "colour font tag", []), ("base", None, "rules", ["ALL"]), ("none", "", None, None)], "set_id string, heading string, labels string, roles array<string>")
    tasks = spark.createDataFrame([(1, "qa", "choose a font and a colour"), (2, "dev", "a release"), (3, None, "one tag"), (4, "dev", None)], "task_id int, role string, text string")
    got = {(r.task_id, r.set_id): r.how for r in knowledge.select_sets(tasks, sets).collect()}
    assert got == {(1, "release"): "pushed", (1, "base"): "pushed", (1, "style"): "matched", (2, "base"): "pushed", (2, "release"): "matched", (4, "base"): "pushed"}


def test_nodes_drift(spark):
    asked = spark.createDataFrame([(x,) for x in "abcda"], "node_id string")
    pins = spark.createDataFrame([("s", "a", "1"), ("t", "a", "2"), ("s", "b", "9"), ("s", "d", "1")], "set_name string, node_id string, hash string")
    now = spark.createDataFrame([("a", "2"), ("b", "2"), ("c", "3")], "node_id string, hash string")
    assert {r.node_id: r.state for r in knowledge.nodes_drift(asked, pins, now).collect()} == {"a": "ok", "b": "drift", "c": "unpinned", "d": "gone"}


def test_explored_regions(spark):
    seeds = spark.createDataFrame([(1, 1, 1, "b"), (1, 0, 2, "a"), (1, 0, 3, "f"), (1, 1, 2, "a")], "task_id int, query_no int, rank int, node_id string")
    edges = spark.createDataFrame([("a", "c", 0.9), ("a", "d", 1.0), ("e", "a", 1.0), ("b", "a", 1.0), ("b", "g", 0.8)], "source_id string, target_id string, confidence double")
    at = {"a": (1, 9), "b": (20, 30), "c": (1, 9), "d": (40, 440), "e": (50, 449), "f": (1, 2), "g": (3, 4)}
    nodes = spark.createDataFrame([(n, "file" if n == "f" else "method", "", "p", s, e) for n, (s, e) in at.items()], "node_id string, kind string, package string, path string, start int, end int")
    rows = sorted(evaluate.explored_regions(seeds, edges, nodes).collect(), key=lambda r: r["rank"])
    assert [(r.start, r.end) for r in rows] == [(1, 9), (20, 30), (50, 449)]
