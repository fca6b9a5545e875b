"""Readers of sources, ignore rules and slices, on cases told by hand."""

import pytest
from pyspark.sql import functions as F

from textloom.sources import formats, ignore, python_code, slices, snapshots

IGNORE = [
    (".gitignore", "# comment\n*.log\n!keep.log\n/top.txt\nout*/\ndocs/**/tmp\n[bad\n\\!odd\n?.c\n[^a-c]x\n"),
    ("sub/.gitignore", "!a.log\nlocal/\nb/c\n"),
    (".textloom/ignore", "secret\n*.log\n"),
    ("README.md", "*\n"),
]
PATHS = {
    ("a.log", False): True, ("keep.log", False): False, ("sub/a.log", False): False, ("sub/deep/a.log", False): False, ("x/a.log", False): True, ("top.txt", False): True, ("x/top.txt", False): False,
    ("outer/f", False): True, ("outer", False): False, ("outer", True): True, ("docs/tmp", True): True, ("docs/a/b/tmp", False): True, ("docs/a/b/tmp/keep.log", False): True, ("x/docs/tmp", False): False, ("[bad", False): False,
    ("!odd", False): True, ("q.c", False): True, ("qq.c", False): False, ("dx", False): True, ("ax", False): False, ("sub/local/z", False): True, ("local/z", False): False, ("sub/b/c", False): True, ("sub/q/b/c", False): False,
    ("x/secret/y", False): True, ("", False): False, ("docs", True): False,
}


def test_ignored(spark):
    rules = ignore.rules(spark.createDataFrame(IGNORE, "path string, content string"))
    paths = spark.createDataFrame([*PATHS, (None, False)], "path string, is_dir boolean")
    got = {(r.path, r.is_dir): r.ignored for r in ignore.ignored(paths, rules).collect()}
    assert got == PATHS | {(None, False): False}
    none = ignore.rules(spark.createDataFrame([], "path string, content string"))
    assert not any(r.ignored for r in ignore.ignored(paths, none).collect())


CODE = '''import os, numpy as np
from a.b import c, d as e
from . import util
from __future__ import annotations

class Order(Base, db.Model, metaclass=M):
    """Text."""
    __tablename__ = "orders"

    class Meta:
        db_table = "é_orders"

    @property
    def total(self, tax=0, *, cut, **kw):
        def inner(x: int, *args: int):
            return x
        return self.lines.sum(inner(1), *[2]) + f(a, b=c)

    async def total(cls): pass

def run(q, /, n=1):
    q.execute("SELECT * FROM shop.Orders o JOIN lines, orders" " WHERE x")
    q.execute(f"update stock set a = {n}")
    if n:
        def hidden(): pass
'''


def test_python_nodes(spark):
    files = spark.createDataFrame([("shop/order.py", CODE), ("pkg/__init__.py", "def a(): pass\n\ndef (:\n\n@x\ndef b(*r): return a()\n"), ("empty.py", ""), (None, "x = 1"), ("null.py", None)], "path string, content string")
    rows = {r.node_id: r for r in python_code.python_nodes(files).collect()}
    shop = "shop.order."
    assert set(rows) == {shop + x for x in ("Order", "Order.Meta", "Order.total", "Order.total.inner", "Order.total#2", "run")} | {"pkg.a", "pkg.b"}
    order, total, run = rows[shop + "Order"], rows[shop + "Order.total"], rows[shop + "run"]
    assert (order.kind, order.supers, [tuple(x) for x in order.db_refs]) == ("class", ["Base", "db.Model"], [("orders", "explicit"), ("é_orders", "explicit")])
    assert order.imports == ["os", "numpy as np", "a.b.c", "..util"] and not order.partial
    assert rows[shop + "Order.total.inner"].display == "total.inner"
    assert (total.kind, total.arity_min, total.arity_max, total.container) == ("method", 1, -1, "Order")
    assert [tuple(c) for c in total.calls] == [("sum", "self.lines", 2), ("inner", "", 1), ("f", "", 2)]
    assert (rows[shop + "Order.total.inner"].arity_min, rows[shop + "Order.total.inner"].arity_max) == (2, 2)
    assert (rows[shop + "Order.total#2"].arity_min, run.arity_min, run.arity_max) == (0, 1, 2)
    assert [tuple(x) for x in run.db_refs] == [("Orders", "sql"), ("lines", "sql"), ("stock", "sql")]
    assert rows["pkg.a"].partial and rows["pkg.b"].arity_max == -1 and rows["pkg.b"].start_line == 6
    data = CODE.encode()
    assert data[total.start_byte : total.end_byte].startswith(b"def total(self") and data[total.start_byte : total.end_byte].endswith(b"f(a, b=c)")


def test_read_code(spark):
    files = spark.createDataFrame([("m.py", bytearray(b"# \xc3\xa9\ndef f():\n    pass\n\ndef g(): pass\n")), ("bad.bin", bytearray(b"\xff\n\xfe"))], "path string, content binary")
    as_text = lambda df: df.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    first = python_code.python_nodes(as_text(files))
    hashes = files.select("path", F.sha2("content", 256).alias("file_hash"))
    nodes = first.join(hashes, "path").select("node_id", "path", "start_byte", "end_byte", "file_hash").unionByName(hashes.filter("path = 'bad.bin'").selectExpr("'b' as node_id", "path", "1L as start_byte", "3L as end_byte", "file_hash"))
    nodes = nodes.unionByName(spark.createDataFrame([("lost", "none.py", 0, 1, "h"), ("far", "bad.bin", 0, 9, None)], nodes.schema))
    asked = spark.createDataFrame([(x,) for x in ("m.f", "m.g", "b", "lost", "far", "nothing", "m.f")], "node_id string")
    tell = lambda df: {r.node_id: (r.state, r.start_line, r.end_line, r.code) for r in df.collect()}
    got = tell(slices.read_code(asked, nodes, files))
    assert got == {
        "m.f": ("ok", 2, 3, "def f():\n    pass"), "m.g": ("ok", 5, 5, "def g(): pass"), "b": ("ok", 1, 2, "\n�"),
        "lost": ("gone", None, None, None), "far": ("gone", None, None, None), "nothing": ("not_found", None, None, None),
    }
    moved = spark.createDataFrame([("m.py", bytearray(b"x = 1\ndef g(): pass\n"))], "path string, content binary")
    assert tell(slices.read_code(asked, nodes, moved))["m.g"][0] == "stale"
    again = tell(slices.read_code(asked, nodes, moved, lambda df: python_code.python_nodes(as_text(df))))
    assert again["m.g"] == ("reparsed", 2, 2, "def g(): pass") and again["m.f"][0] == "gone"


@pytest.mark.parametrize(
    "text, names",
    [
        ("select * from a.b join C c", ["b", "C"]), ("from x", []), ("INSERT INTO t values", ["t"]), ("update u where", []), ("update u set x", ["u"]), ("delete from select", []),
        ("create table z", []), ("select 1 from Orders, orders join orders", ["Orders"]), ("selected from x", []), ("select from s.", []), (None, None),
    ],
)
def test_referenced_tables(spark, text, names):
    got = spark.createDataFrame([(text,)], "x string").select(formats.referenced_tables(F.col("x"))).first()[0]
    assert (got or None) == (names or None)


SNAPSHOTS = [
    ("db/shop.schema.json", '{"_meta": {"datasource": "main"}, "schemas": {"s": {"tables": {"a": {"columns": [{"name": "id", "type": "int"}, {"name": "x"}], "foreign_keys": [{"references": "s.b.id"}, {"references": "db.o.t.c.id", "enforced": false}, {"references": "b"}]}, "b": {}}, "views": {"v": {"definition": "SELECT n1 FROM a JOIN orders2"}, "w": {"references": ["s.a"]}}}, "empty": {}}}'),
    ("shop.functions.schema.json", '{"schemas": {"s": {"functions": {"f": {"args": "i int", "definition": "select of orders, orders"}}, "procedures": {"p": {"references": ["s.a"]}}}}}'),
    ("shop.rls.schema.json", '{"schemas": {"s": {"a": {"enabled": true}, "b": {"enabled": false}, "c": {"policies": [{"name": "own", "command": "ALL"}]}}}}'),
    ("shop.triggers.schema.json", '{"schemas": {"s": {"a": [{"name": "t", "function": "s.f"}, {"name": ""}], "b": null}}}'),
    ("x/bad.schema.json", '{"schemas": '), ("none.schema.json", "{}"), ("list.schema.json", '{"schemas": {"s": {"tables": {"a": {"columns": 3}}}}}'), ("null.schema.json", None), (None, "{}"),
]


def test_snapshot_nodes(spark):
    rows = {r.node_id: r for r in snapshots.snapshot_nodes(spark.createDataFrame(SNAPSHOTS, "path string, content string")).collect()}
    bad = {"x/bad.schema.json", "none.schema.json", "list.schema.json", "null.schema.json"}
    assert set(rows) == bad | {"db." + x for x in ("main.s.a", "main.s.b", "main.s.v", "main.s.w", "shop.s.f", "shop.s.p", "shop.s.a.rls", "shop.s.c.rls", "shop.s.a.t")}
    a = rows["db.main.s.a"]
    assert (a.kind, a.params, a.supers, a.logical_refs, a.container) == ("table", ["id int", "x"], ["db.main.s.b"], ["db.o.t.c"], "s")
    assert (rows["db.main.s.v"].calls, rows["db.main.s.w"].supers, rows["db.main.s.w"].calls) == (["orders2"], ["db.main.s.a"], [])
    assert (rows["db.shop.s.f"].params, rows["db.shop.s.f"].calls, rows["db.shop.s.p"].kind) == (["i int"], ["orders"], "procedure")
    assert (rows["db.shop.s.c.rls"].params, rows["db.shop.s.c.rls"].container, rows["db.shop.s.a.rls"].supers) == (["own ALL"], "s.c", ["db.shop.s.a"])
    assert (rows["db.shop.s.a.t"].supers, rows["db.shop.s.a.t"].display) == (["db.shop.s.a", "db.shop.s.f"], "shop.s.a.t")
    assert all(rows[b].partial and rows[b].kind == "file" for b in bad)
    plain = snapshots.plain_nodes(spark.createDataFrame([("a/b/c.txt", "é"), ("top.md", None)], "path string, content string")).collect()
    assert [(r.display, r.package, r.end_byte) for r in plain] == [("c.txt", "a.b", 2), ("top.md", "", None)]
