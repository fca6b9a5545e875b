"""Hand-built cases of the operators, and every query against its SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import changes, evaluate, graph, knowledge, lexical, usage, vector
from textloom.plans import queries
from textloom.sources import formats
from textloom.streaming import changes as live

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    if name not in queries.SQL:
        assert df.count() > 0
        return
    want = db.execute(queries.SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_text(spark):
    assert one(spark, T.split_identifier, "HTTPServer2Go", "snake_case-x") == [["http", "server", "2", "go"], ["snake", "case", "x"]]
    assert one(spark, T.tokenize, "parseJSON now") == [["parse", "json", "parsejson", "now"]]
    assert one(spark, T.usage_tokens, "HTTPServer the") == [["server"]]
    assert one(spark, T.snake_case, "OrderItem", "HTTPServer") == ["order_item", "http_server"]
    assert one(spark, T.simple_name, "a.b.C.run(int)", "m.f#2") == ["run", "f"]
    assert one(spark, T.pattern_shape, None, "getUser", "a.*b", "plain words") == ["none", "symbol", "regex", "literal"]
    assert one(spark, T.pattern_shape, "'getUser'", "class PublishBody", "three small words", "a.b", "MAX\\", "_", "Foo", "F", "") == ["symbol", "symbol", "literal", "literal", "symbol", "symbol", "symbol", "literal", "none"]
    assert one(spark, T.usage_tokens, "where is persistIndexesLocked, v2_ab") == [["indexes", "locked", "persist"]]
    assert one(spark, T.identifier_tokens, "the headRef, at `Foo` end. (x_y) 2A") == [["headRef", "Foo", "x_y"]]
    assert one(spark, T.terms, "cancelPayment now", "x") == [["cancelpayment now", "cancel", "payment", "cancelpayment", "now"], []]
    assert one(spark, T.word_keys, "漢字語 of ab", "cancelPayment x") == [["漢字語", "漢字", "字語", "of", "ab"], ["cancel", "payment", "cancelpayment"]]
    assert one(spark, T.first_sentence, "One two. Three", "Why? Yes. No", "Why? Yes", "é" * 100, "é" * 80) == ["One two.", "Why? Yes.", "Why?", "é" * 80 + "…", "é" * 80]
    assert one(spark, lambda x: T.truncate_bytes(x, 5), "aé€", "", "abcdef") == ["aé", "", "abcde"]
    assert one(spark, lambda x: T.tool_class(x, F.lit(False)), "mcp__a__b__read_code", "Bash", "MultiEdit", "Edit", "search_hybrid") == ["g_read", "other", "other", "action", "g_search"]
    assert one(spark, T.target, "db.a.t", "docs/x.md#y", "a.B", "") == ["db", "docs", "code", None]
    assert one(spark, formats.language, "a.min.mjs", "b.kts", "c/Makefile", "d.TXT", "e.txt", "f.tsx", "g") == [None, "kotlin", "plain", None, "plain", "tsx", None]


def test_bm25_ties_and_no_match(spark):
    docs = spark.createDataFrame([(2, "alpha beta"), (1, "alpha beta"), (3, "gamma")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "alpha alpha"), (1, "nothing")], "query_id long, query string")
    out = lexical.bm25(docs, asked, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in out] == [(0, 1), (0, 2)] and out[0]["score"] == out[1]["score"]


def test_nearest_neighbours_of_all_stated_queries(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    stated = {r["vec_id"] for r in rows.filter("vec_id % 50 = 0").select("vec_id").collect()}
    assert len(stated) > 1 and {r["query_id"] for r in queries.QUERIES["knn_topk"](spark, SF).select("query_id").distinct().collect()} == stated
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    every = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())
    ids, m = zip(*((r["vec_id"], r["embedding"]) for r in rows.collect()))
    m = np.array(m, float)
    m /= np.sqrt((m * m).sum(1))[:, None]
    near = [(q, *p) for q, v in zip(ids, m) for p in ((rank, i, s) for rank, (s, i) in enumerate(sorted(((round(float(s), 6), i) for i, s in zip(ids, m @ v)), key=lambda x: (-x[0], x[1]))[:4], 1))]
    assert [r[:3] for r in every(vector.knn(rows.repartition(3), asked, 4, block=15))] == [r[:3] for r in sorted(near)]
    odd = spark.createDataFrame([(3, [1.0, 0.0]), (2, [2.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in vector.knn(odd, odd.filter("vec_id = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 9).orderBy("rank").collect()] == [(1, 2), (2, 3), (3, 4)]
    assert vector.knn(odd.limit(0), asked.limit(0), 2).count() == 0


def test_fusion(spark):
    streams = spark.createDataFrame([("lexical", 1, 1), ("semantic", 1, 2), ("semantic", 2, 1)], "stream string, id long, rank int")
    out = lexical.fuse(streams, spark.createDataFrame([(60,)], "k int"), 5).orderBy("rank").collect()
    assert [(r["id"], r["match"]) for r in out] == [(1, "both"), (2, "semantic")]


def test_pages_cover_everything_once(spark):
    edges = spark.createDataFrame([("n", f"t{i:02d}", "call", 0.9 + 0.05 * (i % 2)) for i in range(45)], "source_id string, target_id string, type string, confidence double")
    seen, after = [], None
    while page := graph.explore(edges, "n", after=after).collect():
        seen += [r["id"] for r in page]
        after = graph.cursor("n", page[-1])
    assert sorted(seen) == sorted(set(seen)) and len(seen) == 45 and graph.read_cursor("no cursor") is None


def test_ambiguous_global_names_drop(spark):
    calls = spark.createDataFrame([(1, "s", "f"), (2, "s", "g")], "call_id long, source_id string, name string")
    known = spark.createDataFrame([(f"t{i}", "f") for i in range(6)] + [("u", "g"), ("s", "g")], "target_id string, name string")
    assert [tuple(r) for r in graph.resolve(calls, known, F.lit(3)).collect()] == [("s", "u", 0.8)]


def log(spark, *classes):
    return spark.createDataFrame([("s", "a", i, c, 1) for i, c in enumerate(classes)], "session string, agent string, seq long, class string, win_no long")


def test_outcomes(spark):
    rows = log(spark, "nav", "nav", "other", "search", "nav", "read", "nav", "other", "nav")
    assert [r["outcome"] for r in usage.nav_runs(rows).orderBy("seq").collect()] == ["fallback", "adoption", "merged", "inconclusive"]


def calls(spark, *rows):
    """Calls (element, class, query, pattern, node, results) of one window."""
    data = [("s", "", i, e, c, q, p, n, r, 1) for i, (e, c, q, p, n, r) in enumerate(rows)]
    return spark.createDataFrame(data, "session string, agent string, seq long, elem_no long, class string, query string, pattern string, node_id string, result_ids array<string>, win_no long").withColumn("ts", F.timestamp_seconds(F.col("seq")))


def test_outcomes_of_batches(spark):
    rows = calls(
        spark, (1, "g_search", "parse orders", None, None, ["a.B", "db.x"]), (1, "read", None, None, None, None), (2, "g_explore", None, None, "d.md#x", None), (3, "other", None, None, None, None),
        (4, "read", None, None, None, None), (4, "search", None, "no words", None, None), (4, "search", None, "parseOrder", None, None), (5, "g_read", None, None, "a.B", None),
    )
    runs = usage.nav_runs(rows).orderBy("seq").collect()
    assert [(r["outcome"], r["query"], r["pattern"], r["same_intent"], r["targets"]) for r in runs] == [("fallback", "parse orders", "parseOrder", True, ["code", "db", "docs"]), ("adoption", None, None, False, ["code"])]
    assert [tuple(r)[3:] for r in usage.window_metrics(rows).collect()] == [(1, 0, 1, True)]
    late = calls(spark, *[(i, "search", None, "fooBar", None, None) for i in range(3)])
    m = {r["grp"]: r for r in usage.group_metrics(late).collect()}
    assert set(m) == {"all", "main"} and m["main"]["discovery_failures"] == 1 and m["all"]["late_switches"] == 0


def test_funnel(spark):
    s, r = (lambda *ids: (1, "g_search", "q", None, None, list(ids))), (lambda n: (1, "g_read", None, None, n, None))
    out = usage.funnel(calls(spark, r("a"), s("a", "b"), s("a"), s(), r("a"), r("a"), r("a"), r("c"), s("c"), r("b"))).first()
    assert (out["searches"], out["used"]) == (3, 2)


def test_streams(spark):
    rows = spark.createDataFrame([("s", "a", 1, "x", "p", True), ("s", "a", 2, "x", "p", True), ("s", "a", 3, "y", "p", True), ("s", "a", 4, "", "q", False), ("s", "a", 5, "", "p", False)], "session string, agent string, seq long, tool_use_id string, prompt_id string, parallel boolean")
    out = usage.windows(usage.elements(usage.streams(rows))).orderBy("seq").collect()
    assert [(r["seq"], r["elem_no"], r["win_no"]) for r in out] == [(1, 1, 1), (3, 1, 1), (4, 2, 2), (5, 3, 3)]


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, h string")
    new = spark.createDataFrame([("b", "2"), ("c", "1")], "k string, h string")
    assert {tuple(r) for r in changes.diff(old, new, ["k"], "h").collect()} == {("a", "removed"), ("b", "changed"), ("c", "added")}
    chain = spark.createDataFrame([("a", "b", 1), ("b", "c", 5), ("x", "y", 2)], "old_id string, new_id string, epoch long")
    assert {tuple(r) for r in graph.redirects(chain).collect()} == {("a", "c", 5), ("b", "c", 5), ("x", "y", 2)}


def test_prerequisites_with_a_cycle(spark):
    needs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "name string, need string")
    assert {tuple(r) for r in knowledge.expand(spark.createDataFrame([("a",)], "name string"), needs).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_sql_and_snapshots(spark):
    assert one(spark, formats.sql_tables, "SELECT * FROM a.b JOIN c", "from here") == [["a.b", "c"], []]
    doc = '{"schemas":{"public":{"tables":{"t":{"columns":[{"name":"id","type":"int"}]}}}}}'
    out = formats.snapshot_tables(spark.createDataFrame([("p", doc), ("q", "broken")], "path string, content string")).collect()
    assert [tuple(r) for r in out] == [("p", "public", "t", "id", "int")]


def test_workspace_and_log(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name in ("a.py", "b.min.js", "node_modules/c.py", "go.sum", "d.bin"):
        (tmp_path / name).write_text("x = 1\n")
    assert [r["path"].rsplit("/", 1)[1] for r in formats.workspace(spark, str(tmp_path)).collect()] == ["a.py"]
    (tmp_path / "log.jsonl").write_text('{"v":1,"session_id":"s","tool":"Grep"}\n{"v":2,"session_id":"s","tool":"Grep"}\nbad\n')
    good, bad = formats.usage_log(spark, str(tmp_path / "log.jsonl"))
    assert (good.count(), bad.count()) == (1, 2)


def test_database_references(spark):
    known = spark.createDataFrame([("a.t", "t", "table", "a"), ("b.t", "t", "table", "b"), ("a.F", "F", "function", "a"), ("a.BIG", "BIG", "view", "a"), ("a.v", "v", "view", "a")], "id string, name string, kind string, datasource string")
    rows = [("a.v", "view", "a", h, n) for h, n in (("token", "t"), ("token", "big"), ("token", "f"), ("token", "v"), ("logical", "a.t"), ("exact", "gone"), ("exact", None))]
    rows += [("a.g", "trigger", "a", "exact", "a.F"), ("a.g", "trigger", "a", "logical", "a.F"), ("a.t", "table", "a", "logical", "b.t"), ("a.t", "table", "a", "exact", "a.t"), (None, "table", "a", "exact", "a.t")]
    refs = spark.createDataFrame(rows, "source_id string, source_kind string, datasource string, how string, name string")
    got = {tuple(r) for r in graph.database_references(refs, known).collect()}
    assert got == {("a.v", "a.t", "reference", 0.9), ("a.v", "a.BIG", "reference", 0.8), ("a.v", "gone", "reference", 1.0), ("a.g", "a.F", "call", 1.0), ("a.t", "b.t", "foreign_key", 0.9)}
    assert graph.database_references(refs.limit(0), known.limit(0)).count() == 0


def test_code_to_tables(spark):
    known = [("a.job_posting", "job_posting", "table", "a"), ("a.USERS", "USERS", "view", "a"), ("a.log", "log", "table", "a"), ("b.log", "log", "table", "b"), ("a.f", "f", "function", "a")]
    known = spark.createDataFrame(known + [(f"a{i}.x", "x", "table", "a") for i in range(6)] + [("a.X", "X", "table", "a")], "id string, name string, kind string, datasource string")
    rows = [("c", "convention", "JobPosting"), ("c", "sql", "users"), ("c", "explicit", "log"), ("c", "explicit", "gone"), ("c", "sql", "gone2"), ("c", "sql", "x"), ("c", "client", "f"), ("c", "explicit", None)]
    refs = spark.createDataFrame(rows, "source_id string, how string, name string")
    got = {tuple(r) for r in graph.code_to_tables(refs, known, F.concat(F.lit("a."), F.col("name"))).collect()}
    assert got == {("c", "a.job_posting", 0.8), ("c", "a.USERS", 0.9), ("c", "a.log", 0.8), ("c", "b.log", 0.8), ("c", "a.gone", 1.0)}
    assert graph.code_to_tables(refs, known.limit(0)).count() == 0
    names = spark.createDataFrame([("HTTPRoute",), ("jobID2Go",), ("",)], "n string")
    assert [r[0] for r in names.select(graph.snake(F.col("n"))).collect()] == ["http_route", "job_id2_go", ""]


def test_grep_regions_merge(spark):
    files = spark.createDataFrame([("f", "\n".join(["hit"] + ["x"] * 3 + ["hit"] + ["x"] * 9))], "path string, content string")
    assert [(r["start"], r["end"], r["matches"]) for r in evaluate.grep_regions(files, "hit", 2).collect()] == [(1, 7, 2)]


def test_derived_queries(spark):
    issue = spark.createDataFrame([(1, "\n## Title `a_b`\nfooBar my_x my_x `A_B` and " + "`" + "é" * 70 + "`"), (2, ""), (3, None)], "issue_id long, text string")
    got = [(r["issue_id"], r["query"]) for r in evaluate.derive_queries(issue, 9).orderBy("issue_id", "rank").collect()]
    assert got == [(1, "Title `a_b`"), (1, "a_b"), (1, "é" * 60), (1, "my_x"), (1, "fooBar")]


def test_redirects_and_prerequisites(spark):
    hops = spark.createDataFrame([(i, i + 1, i) for i in range(40)] + [(100, 101, 1), (101, 100, 2), (102, 100, 3), (200, 200, 4)], "old_id long, new_id long, epoch long")
    got = {r["old_id"]: (r["new_id"], r["epoch"]) for r in graph.redirects(hops).collect()}
    assert got == {i: (40, 39) for i in range(40)}
    needs = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n40", "n3")], "name string, need string")
    out = knowledge.expand(spark.createDataFrame([("n0",)], "name string"), needs)
    assert {r["name"]: r["depth"] for r in out.collect()} == {f"n{i}": i for i in range(41)}
    assert [r["name"] for r in knowledge.missing(out, needs).collect()] == [] and knowledge.missing(out, needs.filter("name != 'n7'")).count() == 1
    terms = spark.createDataFrame([("a", "2024-01-01"), ("b", ""), ("c", None), ("d", "2999-01-01")], "term string, stale_after string")
    assert [r["term"] for r in knowledge.stale(terms, "2024-01-01").collect()] == ["a"]


def test_null_values_are_values(spark):
    a, b = (spark.createDataFrame(r, "k long, v long") for r in ([(1, None), (2, None), (3, 1)], [(1, None), (3, None), (4, None)]))
    assert {r["k"]: r["state"] for r in changes.diff(a, b, ["k"], "v").collect()} == {1: "same", 2: "removed", 3: "changed", 4: "added"}


def test_debounced_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", 1, "w"), ("a", 2, "d"), ("b", 3, "w")], "path string, seq long, op string").coalesce(1).write.json(str(tmp_path / "in"), mode="append")
    got = []
    stream = spark.readStream.schema("path string, seq long, op string").json(str(tmp_path / "in"))
    q = live.debounced(stream, "path", "seq", lambda df, i: got.extend(map(tuple, df.select("path", "op").collect())), str(tmp_path / "c"), "0 seconds")
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [("a", "d"), ("b", "w")]
