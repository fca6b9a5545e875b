"""Joins on pairs: whole results, and no more moved than the input."""

import random

from pyspark.sql import functions as F

from textloom.operators import graph, lexical, resolve


def moved(spark, make):
    """The rows of make() and how many records its stages shuffled."""
    sc = spark.sparkContext
    store = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store()
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    rows = make().collect()
    return rows, sum(n for k, n in written().items() if k not in before)


NODE = "id string, pkg string, file string, kind string, container string, imports array<string>, supers array<string>, contains array<string>, calls array<struct<name: string, args: long>>"
DEFINITION = "id string, pkg string, class_fqn string, name string, kind string, file string, arity_min int, arity_max int"


def test_edges_of_code_move_no_pairs(spark):
    nodes = spark.createDataFrame([(f"s{i}", "p", "x", "method", "K", None, None, None, [("f", 1)]) for i in range(200)], NODE)
    known = spark.createDataFrame([(f"p.K.f#{i}", "p", "p.K", "f", "method", "y", 1, 1) for i in range(200)], DEFINITION)
    rows, records = moved(spark, lambda: resolve.resolve_edges(nodes, known))
    assert len(set(map(tuple, rows))) == len(rows) == 40000 and {tuple(r)[2:] for r in rows} == {("call", 0.95)}
    assert records < 10000


def test_the_strongest_request_tells_an_edge(spark):
    nodes = [
        ("s", "p", "x", "class", "", ["q.*", "q.T", "gone.T", "q.U"], ["T", "V"], ["p.g", "nowhere", "s"], [("g", 0), ("g", 5), ("T", 1), ("h", 2), ("far", 0), ("get", 0), ("r", 1)]),
        ("t", "q", "y", "method", "K", None, ["T"], None, [("g", 0), ("T", 0), ("h", 1), ("d", 1), (None, 0)]), (None, "p", "x", "class", "", None, ["T"], ["p.g"], None), ("v", None, None, None, None, None, None, None, None),
    ]
    known = [
        ("p.g", "p", "p", "g", "function", "z", 0, -1), ("q.T", "q", "q.T", "T", "class", "y", 0, 0), ("q.U", "q", "q.U", "U", "interface", "y", 0, 0), ("r.V", "r", "r.V", "V", "interface", "w", 0, 0),
        ("q.K.h#1", "q", "q.K", "h", "method", "y", 1, 1), ("q.K.h#2", "q", "q.K", "h", "method", "y2", 2, 2), ("r.far", "r", "r", "far", "function", "w", 0, 0), ("r.get", "r", "r", "get", "function", "w", 0, 0),
        *((f"r{i}.r", "r", "r", "r", "function", "w", 1, 1) for i in range(6)), ("d", "q", "q", "d", "method", "y3", 1, 1), ("d", "q", "q", "d", "function", "y", 1, -1), (None, "q", "q", "T", "class", "y", 0, 0), ("n", "q", "q", None, "class", "y", 0, 0),
    ]
    got = sorted(map(tuple, resolve.resolve_edges(spark.createDataFrame(nodes, NODE), spark.createDataFrame(known, DEFINITION)).collect()))
    assert got == [
        ("s", "nowhere", "contains", 1.0), ("s", "p.g", "contains", 1.0), ("s", "q.K.h#2", "call", 0.9), ("s", "q.T", "extends", 1.0), ("s", "q.U", "import", 1.0), ("s", "r.V", "implements", 0.8), ("s", "r.far", "call", 0.8),
        ("t", "d", "call", 1.0), ("t", "p.g", "call", 0.8), ("t", "q.K.h#1", "call", 1.0), ("t", "q.T", "extends", 1.0),
    ]
    empty = resolve.resolve_edges(spark.createDataFrame([], NODE), spark.createDataFrame([], DEFINITION))
    assert empty.count() == 0


TIER = lambda: F.when(F.col("at") == F.col("home"), 1).when(F.col("r") == F.col("q"), 2).when(F.col("r") > 0, 3)


def plain(calls, known, most):
    """Tiered resolution told pair by pair."""
    tier = lambda c, d: None if None in (c[3], d[2]) and not (c[4] or 0) else 1 if c[3] == d[2] else 2 if c[4] == d[3] else 3 if (c[4] or 0) > 0 else None
    met = {}
    for c in calls:
        met.setdefault(c[0], []).extend((tier(c, d), c[1], d[0]) for d in known if None not in (c[2], c[1], d[0]) and c[2] == d[1] and c[1] != d[0])
    out = {}
    for rows in met.values():
        best = min((t for t, *_ in rows if t), default=None)
        rows = [r for r in rows if r[0] == best and best]
        if rows and (best < 3 or len(rows) <= most):
            for t, s, d in rows:
                out[s, d] = max(out.get((s, d), 0), {1: 0.95, 2: 0.9, 3: 0.8}[t])
    return {(*k, v) for k, v in out.items()}


def test_tiers_as_pair_by_pair(spark):
    pick = random.Random(7).choice
    calls = [(pick([*range(40), None]), pick(["a", "b", "c", "d", None]), pick(["f", "g", "h", None]), pick([1, 2, 3]), pick([0, 1, 2])) for _ in range(80)]
    known = [(pick(["a", "b", "x", "y", "z", "u", "v", "w", None]), pick(["f", "g", "h", None]), pick([1, 2, 3, 4]), pick([1, 2, 3])) for _ in range(30)]
    for n in (30, 6, 0):
        got = graph.resolve(spark.createDataFrame(calls, "call_id int, source_id string, name string, at int, r int"), spark.createDataFrame(known[:n], "target_id string, name string, home int, q int"), TIER()).collect()
        assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == plain(calls, known[:n], 5)


def test_tiers_move_no_pairs(spark):
    calls = spark.createDataFrame([(i, f"s{i}", "f", 1, 1) for i in range(200)], "call_id int, source_id string, name string, at int, r int")
    known = spark.createDataFrame([(f"t{i}", "f", 1 + i % 2, 1) for i in range(400)], "target_id string, name string, home int, q int")
    rows, records = moved(spark, lambda: graph.resolve(calls, known, TIER()))
    assert len(set(map(tuple, rows))) == len(rows) == 40000 and {r["confidence"] for r in rows} == {0.95}
    assert records < 10000


def common(spark):
    """Documents and queries that share all their words."""
    words = " ".join("a" * i for i in range(1, 21))
    return spark.createDataFrame([(i, words) for i in range(300)], "doc_id long, text string"), spark.createDataFrame([(q, words) for q in range(40)], "query_id long, query string")


def best(rows):
    return sorted((r["query_id"], r["rank"], r["doc_id"]) for r in rows)


def test_search_moves_no_scores(spark):
    docs, asked = common(spark)
    rows, records = moved(spark, lambda: lexical.bm25(docs, asked, 2))
    assert best(rows) == [(q, i + 1, i) for q in range(40) for i in range(2)] and records < 3000


def test_index_moves_lists_and_no_scores(spark, tmp_path):
    docs, asked = common(spark)
    path = f"file://{tmp_path}/index"
    _, records = moved(spark, lambda: lexical.save_index(docs.coalesce(1), path, buckets=2) or docs.limit(0))
    assert records < 1000
    rows, records = moved(spark, lambda: lexical.search_index(spark, path, asked, 2))
    assert best(rows) == [(q, i + 1, i) for q in range(40) for i in range(2)] and records < 8000


def test_odd_documents(spark, tmp_path, monkeypatch):
    rows = [("b", "x y"), ("a", "x y"), ("c", None), ("d", ""), ("e", "x"), ("e", "x z"), (None, "y y y")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    asked = spark.createDataFrame([("q", "x z"), ("r", "y"), ("s", "nothing"), (None, "x"), ("t", None), ("r", "y")], "query_id string, query string")
    monkeypatch.setattr(lexical, "PACKED", 2)
    path = f"file://{tmp_path}/index"
    lexical.save_index(docs, path, buckets=2)
    tell = lambda df: sorted(((r["query_id"], r["rank"], r["doc_id"]) for r in df.collect()), key=repr)
    want = sorted([("q", 1, "e"), ("q", 2, "a"), ("q", 3, "b"), ("r", 1, None), ("r", 2, "a"), ("r", 3, "b"), (None, 1, "e"), (None, 2, "a"), (None, 3, "b")], key=repr)
    assert tell(lexical.bm25(docs, asked, 3)) == tell(lexical.search_index(spark, path, asked, 3)) == want
    assert lexical.bm25(docs, asked.limit(0), 3).count() == lexical.bm25(docs.limit(0), asked, 3).count() == 0
