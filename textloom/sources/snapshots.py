"""Nodes of database snapshots and of plain files (S12, F13, F14; S13 without byte spans and hashes)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

_TABLE = "struct<columns: array<struct<name: string, type: string>>, foreign_keys: array<struct<`references`: string, enforced: boolean>>>"
_VIEW = "struct<definition: string, `references`: array<string>>"
_ROUTINE = "struct<args: string, definition: string, `references`: array<string>>"
_SHAPES = {
    "": f"struct<tables: map<string, {_TABLE}>, views: map<string, {_VIEW}>>",
    "functions": f"struct<functions: map<string, {_ROUTINE}>, procedures: map<string, {_ROUTINE}>>",
    "rls": "map<string, struct<enabled: boolean, policies: array<struct<name: string, command: string>>>>",
    "triggers": "map<string, array<struct<name: string, function: string>>>",
}
#: Words of SQL that name nothing, and how many names of a definition count.
SQL_WORDS = """select from where and not null insert update delete set into values join left right inner outer full cross using
group order having limit offset distinct union all exists between like ilike case when then else end begin declare return returns
returning new old for each row execute function procedure trigger language security definer invoker create replace alter drop table
view index primary key foreign references constraint unique check default cascade restrict count sum avg min max coalesce nullif now
true false with recursive integer bigint boolean text varchar date timestamptz timestamp interval""".split()
MOST_NAMES = 32
_NONE = "array<string>"


def table_id(datasource: Column, ref: Column) -> Column:
    """the node a reference means: [db.datasource.]schema.name, whatever column follows; null for others."""
    full = lambda s: F.when(F.size(s) >= 4, F.array_join(F.slice(s, 1, 4), "."))
    short = lambda s: F.when((F.size(s) >= 2) & (s[0] != ""), F.concat(F.lit("db."), datasource, F.lit("."), s[0], F.lit("."), s[1]))
    return let(F.split(F.trim(ref), r"\."), lambda s: F.when(s[0] == "db", full(s)).otherwise(short(s)))


def definition_names(definition: Column) -> Column:
    """the first distinct names, three letters or more and no words of SQL, in a definition."""
    names = F.regexp_extract_all(F.lower(F.coalesce(definition, F.lit(""))), F.lit("([a-z_][a-z0-9_]*)"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(names, lambda n: (F.length(n) >= 3) & ~n.isin(*SQL_WORDS))), 1, MOST_NAMES)


def _each(items: Column, f) -> Column:
    return F.transform(F.coalesce(items, F.slice(items, 1, 0)), f)


def _all(*parts: Column) -> Column:
    return F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull()))


def _strings(xs: Column | None) -> Column:
    return F.array().cast(_NONE) if xs is None else F.coalesce(xs, F.array().cast(_NONE))


def _node(kind: str, ds: Column, names: list[Column], container: Column, simple: Column, params=None, supers=None, logical=None, calls=None) -> Column:
    display = F.concat_ws(".", ds, *names)
    return F.struct(
        F.concat(F.lit("db."), display).alias("node_id"), display.alias("display"), simple.alias("simple_name"), F.lit(kind).alias("kind"), container.alias("container"),
        _strings(params).alias("params"), _strings(supers).alias("supers"), _strings(logical).alias("logical_refs"), _strings(calls).alias("calls"),
    )


def _pair(a: Column, b: Column) -> Column:
    return F.trim(F.concat(F.coalesce(a, F.lit("")), F.lit(" "), F.coalesce(b, F.lit(""))))


def _ids(ds: Column, refs: Column) -> Column:
    return F.filter(F.transform(refs, lambda r: table_id(ds, r)), lambda r: r.isNotNull())


def _named(kind: str, ds: Column, schema: Column, items: Column) -> Column:
    """Views and routines: what they refer to, else the names in their definition."""

    def one(e):
        v, told = e["value"], F.coalesce(F.size(e["value"]["references"]), F.lit(0)) > 0
        args = F.when(v["args"] != "", F.array(v["args"])) if kind != "view" else None
        return _node(kind, ds, [schema, e["key"]], schema, e["key"], args, F.when(told, _ids(ds, v["references"])), None, F.when(~told, definition_names(v["definition"])))

    return F.transform(F.map_entries(items), one)


def _main(ds: Column, s: Column) -> Column:
    schema = s["key"]

    def table(e):
        keys = e["value"]["foreign_keys"]
        enforced = lambda k: F.coalesce(k["enforced"], F.lit(True))
        to = lambda xs: _ids(ds, F.transform(xs, lambda k: k["references"]))
        return _node("table", ds, [schema, e["key"]], schema, e["key"], F.transform(e["value"]["columns"], lambda c: _pair(c["name"], c["type"])), to(F.filter(keys, enforced)), to(F.filter(keys, lambda k: ~enforced(k))))

    return _all(F.transform(F.map_entries(s["value"]["tables"]), table), _named("view", ds, schema, s["value"]["views"]))


def _functions(ds: Column, s: Column) -> Column:
    return _all(_named("db_function", ds, s["key"], s["value"]["functions"]), _named("procedure", ds, s["key"], s["value"]["procedures"]))


def _inside(ds: Column, schema: Column, table: Column) -> tuple[Column, Column]:
    return F.concat_ws(".", schema, table), F.concat(F.lit("db."), F.concat_ws(".", ds, schema, table))


def _rls(ds: Column, s: Column) -> Column:
    def table(e):
        container, over = _inside(ds, s["key"], e["key"])
        return _node("rls_policy", ds, [s["key"], e["key"], F.lit("rls")], container, e["key"], F.transform(e["value"]["policies"], lambda p: _pair(p["name"], p["command"])), F.array(over))

    some = lambda e: F.coalesce(e["value"]["enabled"], F.lit(False)) | (F.coalesce(F.size(e["value"]["policies"]), F.lit(0)) > 0)
    return F.transform(F.filter(F.map_entries(s["value"]), some), table)


def _triggers(ds: Column, s: Column) -> Column:
    def table(e):
        container, over = _inside(ds, s["key"], e["key"])
        named = F.filter(e["value"], lambda t: F.coalesce(t["name"], F.lit("")) != "")
        return F.transform(named, lambda t: _node("trigger", ds, [s["key"], e["key"], t["name"]], container, t["name"], None, F.array_compact(F.array(over, table_id(ds, t["function"])))))

    return F.flatten(F.filter(F.transform(F.map_entries(s["value"]), table), lambda x: x.isNotNull()))


def snapshot_nodes(files: DataFrame, suffix: str = ".schema.json") -> DataFrame:
    """(path, node_id, display, simple_name, kind, container, params, supers, logical_refs, calls, partial) of snapshots (path, content).

    ``name.schema.json`` holds tables and views; ``name.functions``, ``name.rls`` and ``name.triggers`` the rest; the
    file names its datasource, else its own name does.  A file that isn't of its shape gives one plain node, marked
    partial.  Nodes come straight from the scan, without a shuffle.
    """
    files = files.filter("path is not null").select("path", F.coalesce("content", F.lit("")).alias("content"))
    name = F.regexp_replace(F.substring_index("path", "/", -1), F.lit(suffix.replace(".", r"\.") + "$"), F.lit(""))
    section = F.regexp_extract(name, r"\.(functions|rls|triggers)$", 1)
    files = files.withColumn("section", section).withColumn("stem", F.regexp_replace(name, r"\.(functions|rls|triggers)$", ""))
    build = {"": _main, "functions": _functions, "rls": _rls, "triggers": _triggers}
    nodes = None
    for part, shape in _SHAPES.items():
        doc = F.from_json("content", f"_meta struct<datasource: string>, schemas map<string, {shape}>, _wrong string", {"columnNameOfCorruptRecord": "_wrong"})
        stem = F.when(F.col("stem") == "", "unknown").otherwise(F.col("stem"))
        ds = F.coalesce(F.nullif(F.col("d._meta.datasource"), F.lit("")), stem)
        rows = files.filter(F.col("section") == part).withColumn("d", doc).withColumn("ds", ds)
        good = F.col("d._wrong").isNull() & F.col("d.schemas").isNotNull()
        some = rows.filter(good).select("path", F.explode(F.flatten(F.transform(F.map_entries("d.schemas"), partial(build[part], F.col("ds"))))).alias("n")).select("path", "n.*", F.lit(False).alias("partial"))
        bad = plain_nodes(rows.filter(~F.coalesce(good, F.lit(False))), True).select(*some.columns)
        both = some.unionByName(bad)
        nodes = both if nodes is None else nodes.unionByName(both)
    return nodes


def plain_nodes(files: DataFrame, broken: bool = False) -> DataFrame:
    """One node for each file (path, content), in the package of its folder."""
    base = F.substring_index("path", "/", -1)
    package = F.when(F.contains("path", F.lit("/")), F.replace(F.regexp_replace("path", "/[^/]*$", ""), F.lit("/"), F.lit("."))).otherwise("")
    none = F.array().cast(_NONE)
    return files.select(
        "path", F.col("path").alias("node_id"), base.alias("display"), base.alias("simple_name"), F.lit("file").alias("kind"), F.lit("").alias("container"), package.alias("package"),
        *(none.alias(c) for c in ("params", "supers", "logical_refs", "calls")), F.lit(0).cast("long").alias("start_byte"), F.octet_length("content").cast("long").alias("end_byte"), F.sha2("content", 256).alias("hash"), F.lit(broken).alias("partial"),
    )
