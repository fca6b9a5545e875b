"""Subword ids, pooling, payloads of tool calls and incremental changes."""

import json
import math

import pytest
from pyspark.sql import functions as F

from textloom.functions.payload import payload, result_ids
from textloom.operators import changes, encode


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    folder = tmp_path_factory.mktemp("vocabulary")
    words = ["[UNK]", "[CLS]", "[SEP]", "play", "##ing", "##s", "cafe", ",", "中", "p", "##l"]
    t = Tokenizer(models.WordPiece({w: i for i, w in enumerate(words)}, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer, t.pre_tokenizer = normalizers.BertNormalizer(), pre_tokenizers.BertPreTokenizer()
    t.save(str(folder / "word.json"))
    pieces = [("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0), ("▁", -3.0), ("▁ab", -1.0), ("a", -2.0), ("b", -2.0), ("▁a", -1.5), ("c", -4.0), ("bc", -5.0)]
    t = Tokenizer(models.Unigram(pieces, unk_id=0))
    t.normalizer, t.pre_tokenizer = normalizers.NFKC(), pre_tokenizers.Metaspace()
    t.save(str(folder / "unigram.json"))
    Tokenizer(models.BPE()).save(str(folder / "bpe.json"))
    return folder, dict((p, (i, s)) for i, (p, s) in enumerate(pieces))


def test_word_pieces(spark, files):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["Playing, Café", "plx", "中playS", "", None, "x" * 101, "play " * 600])], "i int, text string")
    ids = [r["ids"] for r in encode.encode(df, str(files[0] / "word.json")).orderBy("i").collect()]
    assert ids[:6] == [[1, 3, 4, 7, 6, 2], [1, 0, 2], [1, 8, 3, 5, 2], [1, 2], None, [1, 0, 2]]
    assert len(ids[6]) == 512 and ids[6][-1] == 2
    with pytest.raises(ValueError, match="BPE"):
        encode.tokenizer(str(files[0] / "bpe.json"))


def test_unigram(spark, files):
    pieces = files[1]

    def best(word):  # every segmentation by brute force, unknown characters ten below the least score
        found = []

        def go(at, score, ids):
            if at == len(word):
                found.append((score, ids))
            for end in range(at + 1, len(word) + 1):
                if word[at:end] in pieces:
                    i, s = pieces[word[at:end]]
                    go(end, score + s, ids + [i])
            if word[at : at + 1]:
                go(at + 1, score + min(s for _, s in pieces.values()) - 10, ids if ids[-1:] == [0] else ids + [0])

        go(0, 0.0, [])
        return max(found)[1]

    texts = ["abc", "ab ac", "zzb", "ａb"]
    got = encode.encode(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string"), str(files[0] / "unigram.json")).orderBy("i").collect()
    want = [best("▁abc"), best("▁ab") + best("▁ac"), best("▁zzb"), best("▁ab")]
    assert [r["ids"] for r in got] == [[1, *w, 2] for w in want]


def test_pooling_and_vectors(spark):
    df = spark.createDataFrame([(1, [[3.0, 0.0], [3.0, 8.0], [9.0, 9.0]], [1, 1, 0]), (2, [[1.0, 1.0]], [0]), (3, [[1.0], [-1.0]], [1, 1])], "i int, t array<array<double>>, m array<int>")
    out = [r["v"] for r in df.select("i", encode.pooled(F.col("t"), F.col("m")).alias("v")).orderBy("i").collect()]
    assert all(math.isclose(a, b) for a, b in zip(out[0], [0.6, 0.8])) and out[1:] == [[0.0, 0.0], [0.0]]
    vec = lambda *rows: spark.createDataFrame(list(rows), "vec_id long, embedding array<double>")
    got = encode.upsert(vec((1, [1.0]), (2, [2.0]), (3, [3.0])), vec((2, [9.0]), (4, [4.0])), vec((3, None), (4, None))).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == [(1, [1.0]), (2, [9.0]), (4, [4.0])]
    head = spark.createDataFrame([("m", 3), ("m", 4), (None, 3)], "model string, width int")
    assert [r["usable"] for r in encode.usable(head, "m", 3).collect()] == [True, False, False]
    assert df.select(encode.prefixed("query", F.lit("x"))).first()[0] == "query: x"


def test_payloads(spark):
    xml = "<results><node id=\"a.b\"/><node id=\"c\"/></results>"
    deep = json.dumps([[[[[xml]]]]])
    rows = [
        (0, "mcp__x__search_hybrid", {"query": "é" * 200, "top_k": 7, "other": "secret"}, json.dumps({"<results": 1, "content": [{"text": "no"}, {"text": xml}]})),
        (1, "Grep", {"pattern": "p", "path": "/w/src/a", "glob": ""}, "{}"), (2, "Bash", {"command": "cd x && rg -n 'foo bar' src"}, None), (3, "Bash", {"command": "ls"}, None),
        (4, "Read", {"file_path": "/other/f"}, None), (5, "Strange", {"query": "q"}, None), (6, "search_hybrid", {"query": "q"}, deep), (7, "search_hybrid", {}, "broken" + xml), (8, "bootstrap_workspace", {}, None),
    ]
    df = spark.createDataFrame([(i, t, json.dumps(x), r) for i, t, x, r in rows], "i int, tool string, given string, response string")
    p = [r["p"] for r in df.select("i", payload(F.col("tool"), F.col("given"), F.col("response"), F.lit("/w")).alias("p")).orderBy("i").collect()]
    assert p[0]["query"] == "é" * 150 and p[0]["top_k"] == 7 and p[0]["result_ids"] == ["a.b", "c"] and p[0]["result_count"] == 2
    assert (p[1]["pattern"], p[1]["path"], p[1]["glob"], p[1]["query"]) == ("p", "src/a", None, None)
    assert p[2]["search"] and p[2]["pattern"] == "foo bar" and p[3]["search"] is False and p[3]["pattern"] is None
    assert p[4]["file_path"] == "/other/f" and p[5] is None and p[6]["result_ids"] is None and p[7]["result_count"] is None and p[8]["search"] is None
    escaped = json.dumps(xml).replace("<", "\\u003c")
    assert [r[0] for r in spark.createDataFrame([(escaped,), (json.dumps([[[[xml]]]]),), (json.dumps(['say \\ "x"\\' * 40000, xml]),), (None,)], "r string").select(result_ids(F.col("r"))).collect()] == [["a.b", "c"]] * 3 + [None]


def test_incremental_changes(spark):
    nodes = lambda *rows: spark.createDataFrame(list(rows), "node_id string, hash string, start_byte long, end_byte long")
    out = changes.two_tracks(nodes(("a", "1", 0, 5), ("b", "1", 5, 9), ("c", "1", 9, 10), ("d", None, 0, 1)), nodes(("a", "1", 0, 5), ("b", "1", 6, 10), ("c", "2", 10, 11), ("e", "1", 1, 2), ("d", None, 0, 1)))
    assert {tuple(r) for r in out.collect()} == {("b", "offsets"), ("c", "content"), ("e", "content")}
    routes = lambda *rows: spark.createDataFrame(list(rows), "path string, datasource string, format string")
    moved = changes.rerouted(routes(("a", "x", "sql"), ("b", "x", "sql"), ("c", "x", None)), routes(("a", "x", "sql"), ("b", "y", "sql"), ("c", "x", None), ("d", "x", "json")))
    assert {r["path"] for r in moved.collect()} == {"b", "d"}
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "node_id string")
    edges = spark.createDataFrame([("m", "db.a"), ("n", "db.b"), ("db.t", "db.a")], "source_id string, target_id string")
    known = spark.createDataFrame([("m", "f1", "method"), ("n", "f2", "method"), ("h", "f3", "class"), ("db.t", "s", "trigger")], "node_id string, path string, kind string")
    assert {r["path"] for r in changes.files_to_resolve(ids("h"), ids("db.a"), edges, known).collect()} == {"f1", "f3"}
