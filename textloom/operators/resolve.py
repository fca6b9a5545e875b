"""Edges of code: containment, supertypes, imports and calls.

``nodes`` has id, pkg, file, kind, container, imports, supers, contains (arrays of text)
and calls (array of struct name, args; args below 0: unknown).  ``definitions`` has id,
pkg, class_fqn, name, kind, file, arity_min and arity_max (-1: open).

Names are never joined alone where a scope can tell: a definition stands under every
scope from which it can be seen (its package, class, and the dotted ancestors of its
id), a call asks for its own package and its imports, and both meet on (name, scope).
So a name that everything defines makes no pairs across packages.  Global candidates
come from counts by name and arity, which list no more ids than may be used.

Tiers are settled on distinct scopes, kinds and arities.  What is left of a call or
supertype are requests (source, name, scope, kind, args), all in proportion to the input.
Pairs are made last, out of blocks of sources and of definitions, and are never moved:
a pair that several requests of a source make is told by the strongest of them alone.
Only definitions that share an id with another row have their pairs grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import simple_type_name
from ..sources.stored import stash
from .graph import GLOBAL, NEAR, SAME, blocks, tiles

CERTAIN, MOST_GLOBAL = 1.0, 5
_TYPES = ("class", "interface")
#: Sorts of definitions, in rising order of preference for a call.
_OTHER, _TYPE, _CALLABLE = 0, 1, 2
#: Names too common to be matched anywhere, in small letters.
STOPPED = """process get set info run main init handle execute update create delete add remove close open start stop
read write call apply invoke next size len str repr tostring equals hashcode __init__ print println log debug error
warn format of valueof build then catch finally map filter foreach reduce push pop slice splice concat join split find
includes indexof keys values entries assign stringify parse require resolve reject fetch on off emit send test render
settimeout setinterval""".split()


def stopped(name: Column) -> Column:
    """P15."""
    return F.lower(name).isin(*STOPPED)


def accepts(args: Column, low: Column, high: Column) -> Column:
    """Whether so many arguments fit."""
    return (args < 0) | ((args >= low) & ((high == -1) | (args <= high)))


def _ancestors(x: Column) -> Column:
    """The proper dotted prefixes of an id."""
    parts = F.split(x, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def _scopes() -> Column:
    """Every scope from which a definition can be seen, with its file, its id and everywhere."""
    has = lambda x: F.when(F.instr(x, ".") > 0, _ancestors(x)).otherwise(F.array().cast("array<string>"))
    mark = lambda m, xs: F.transform(xs, lambda x: F.concat(F.lit(m), x))
    scopes = F.concat(
        mark("p:", F.array("pkg")), mark("c:", F.array("class_fqn")), mark("m:", has(F.col("id"))), mark("w:", F.array_append(has(F.col("class_fqn")), F.col("pkg"))),
        mark("f:", F.array("file")), mark("i:", F.array("id")), F.array(F.lit("*")),
    )
    return F.array_distinct(F.array_compact(scopes))


def _asks(name: Column) -> Column:
    """array<struct<scope, tier>>: P14 and P16 as scopes: own package, class, member and package imports."""
    dot = F.concat(F.lit("."), name)
    member = lambda i: F.endswith(i, dot)
    whole = F.transform("imports", lambda i: F.concat(F.lit("c:"), i))
    members = F.transform(F.filter("imports", member), lambda i: F.concat(F.lit("m:"), F.substring(i, F.lit(1), F.length(i) - F.length(dot))))
    packages = F.transform(F.filter("imports", lambda i: F.endswith(i, F.lit(".*"))), lambda i: F.concat(F.lit("w:"), F.substring(i, F.lit(1), F.length(i) - 2)))
    imported = F.transform(F.concat(whole, members, packages), lambda s: F.struct(s.alias("scope"), F.lit(2).alias("tier")))
    return F.array_append(imported, F.struct(F.concat(F.lit("p:"), F.col("pkg")).alias("scope"), F.lit(1).alias("tier")))


def _confidence(tier: Column) -> Column:
    return F.when(tier == 1, SAME).when(tier == 2, NEAR).otherwise(GLOBAL)


def _nearest(found: DataFrame, key: list[str]) -> DataFrame:
    """The scopes of the best tier of each key, out of (*key, scope, tier)."""
    at = found.groupBy(*key).agg(F.collect_set(F.struct("tier", "scope")).alias("at"))
    return at.select(*key, F.explode(F.filter("at", lambda x: x["tier"] == F.array_min("at")["tier"])).alias("x")).select(*key, "x.*")


def _fits(args: Column, sort: Column, low: Column, high: Column) -> Column:
    return F.when(sort == _CALLABLE, accepts(args, low, high)).otherwise(True)


def _pairs(requests: DataFrame, defs: DataFrame) -> DataFrame:
    """Edges (source_id, target_id, type, confidence, rule) of requests: each definition row is told once to a source."""
    wanted = requests.select("name", "scope").distinct()
    seen = defs.select("*", F.explode(_scopes()).alias("scope")).join(wanted, ["name", "scope"], "left_semi")
    seen = seen.select(F.struct("name", "scope", "sort", "low", "high").alias("class"), F.struct("id", "kind", "pkg", "class_fqn", "file").alias("member"))
    classes = seen.select("class").distinct().select("class", "class.*")
    met = requests.join(classes, ["name", "scope", "sort"]).filter(_fits(F.col("args"), F.col("sort"), F.col("low"), F.col("high")))
    # Only requests that fit definitions of this class can stand before; one of the same scope always does.
    before = F.filter("before", lambda b: (b["sort"] == F.col("sort")) & _fits(b["args"], b["sort"], F.col("low"), F.col("high")))
    met = met.withColumn("before", before).filter(~F.exists("before", lambda b: b["scope"] == F.col("scope")))
    asking = met.select("class", F.struct("source_id", "rule", "confidence", F.transform("before", lambda b: b["scope"]).alias("before")).alias("member"))
    made = tiles(blocks(asking, ["class"]), blocks(seen, ["class"]), ["class"])
    one = made.select("left", F.col("class.sort").alias("sort"), F.explode("right").alias("d")).select("left", "sort", "d.*").withColumn("scopes", _scopes())
    pair = one.select("id", "kind", "sort", "scopes", F.explode("left").alias("s")).select("id", "kind", "sort", "scopes", "s.*")
    told = pair.filter(F.col("source_id") != F.col("id")).filter((F.size("before") == 0) | ~F.arrays_overlap("before", "scopes"))
    parent = F.when(F.col("kind") == "interface", "implements").otherwise("extends")
    kind = F.when(F.col("rule") == 0, "contains").when(F.col("rule") == 1, parent).when(F.col("rule") == 2, "import").when(F.col("sort") == _CALLABLE, "call").otherwise("reference")
    return told.select("source_id", F.col("id").alias("target_id"), kind.alias("type"), "confidence", "rule")


def resolve_edges(nodes: DataFrame, definitions: DataFrame) -> DataFrame:
    """(source_id, target_id, type, confidence): the strongest edge of each pair; of equal ones the first of contains, supertypes, imports, calls."""
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    nodes = nodes.select(F.col("id").alias("source_id"), "pkg", F.col("file"), "kind", F.coalesce("container", F.lit("")).alias("container"), empty("imports"), empty("supers"), empty("contains"), "calls").filter("source_id is not null")
    callable_ = F.col("kind").isin("method", "function")
    arity = lambda c: F.when(callable_, F.col(c).cast("long"))
    defs = definitions.select("id", "pkg", "class_fqn", "name", "kind", "file", F.when(callable_, _CALLABLE).when(F.col("kind").isin(*_TYPES), _TYPE).otherwise(_OTHER).alias("sort"), arity("arity_min").alias("low"), arity("arity_max").alias("high"))
    request = lambda df, rule, scope, sort, args, c: df.select("source_id", "name", scope.alias("scope"), sort.alias("sort"), args.cast("long").alias("args"), c.alias("confidence"), F.lit(rule).alias("rule"))
    any_ = F.lit(-1)
    heads = defs.select("name", "sort", "low", "high", F.explode(_scopes()).alias("scope")).filter(~F.substring("scope", 1, 2).isin("i:", "f:", "*")).distinct()

    # Targets by id: all but those that nothing defines are requests too, so that each pair is made in one place.
    top = nodes.filter((F.col("container") == "") & F.col("kind").isin(*_TYPES)).select("source_id", F.explode("imports").alias("target_id"))
    imports = top.join(defs.filter(F.col("sort") == _TYPE).select(F.col("id").alias("target_id")), "target_id", "left_semi")
    stated = nodes.select("source_id", F.explode("contains").alias("target_id"), F.lit(0).alias("rule")).unionByName(imports.select("source_id", "target_id", F.lit(2).alias("rule"))).filter("target_id is not null").distinct()
    ids = defs.filter("name is not null").select(F.col("id").alias("target_id"), "name", "sort").distinct()
    named = stated.join(ids, "target_id", "left")
    by_id = lambda df, rule, c: request(df, rule, F.concat(F.lit("i:"), F.col("target_id")), F.col("sort"), any_, c)
    direct = named.filter("name is null and source_id != target_id").groupBy("source_id", "target_id").agg(F.min("rule").alias("rule"))
    direct = direct.select("source_id", "target_id", F.when(F.col("rule") == 0, "contains").otherwise("import").alias("type"), F.lit(CERTAIN).alias("confidence"))
    by_name = named.filter("name is not null")
    asked = [by_id(by_name.filter(F.col("rule") == n), n, F.lit(CERTAIN)) for n in (0, 2)]

    # Supertypes: the tier is settled before the kind.
    supers = nodes.select("source_id", "pkg", "imports", F.explode("supers").alias("super")).withColumn("name", simple_type_name(F.col("super"))).drop("super").distinct()
    asks = supers.select("source_id", "name", F.explode(_asks(F.col("name"))).alias("a")).select("source_id", "name", "a.*")
    near = _nearest(asks.join(heads.select("name", "scope").distinct(), ["name", "scope"]), ["source_id", "name"])
    asked.append(request(near, 1, F.col("scope"), F.lit(_TYPE), any_, F.lit(CERTAIN)))
    far = supers.select("source_id", "name").distinct().join(near.select("source_id", "name").distinct(), ["source_id", "name"], "left_anti")
    asked.append(request(far, 1, F.lit("*"), F.lit(_TYPE), any_, F.lit(GLOBAL)))

    calls = nodes.select("source_id", "pkg", "file", "imports", F.explode("calls").alias("call")).select("source_id", "pkg", "file", "imports", "call.name", "call.args").distinct()
    key = ["source_id", "name", "args"]
    callables = defs.filter(F.col("sort") == _CALLABLE)
    own = calls.select(*key, "file").join(callables.select("name", "file", "low", "high").distinct(), ["name", "file"]).filter(accepts(F.col("args"), F.col("low"), F.col("high"))).select(*key, "file").distinct()
    asked.append(request(own, 3, F.concat(F.lit("f:"), F.col("file")), F.lit(_CALLABLE), F.col("args"), F.lit(CERTAIN)))
    rest = calls.join(own.select(*key).distinct(), key, "left_anti")
    # By name, what could be meant anywhere: counts, and ids where they are few enough.
    group = ["name", "sort", "low", "high"]
    counted = defs.filter(F.col("sort") != _OTHER).select(F.struct(*group).alias("g"), "id")
    counts = counted.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    few = counted.join(counts.filter(F.col("n") <= MOST_GLOBAL).select("g"), "g").groupBy("g").agg(F.collect_list("id").alias("ids"))
    every = counts.join(few, "g", "left").select("g.*", "n", "ids")
    meant = rest.select(*key).distinct().join(every, "name").filter(_fits(F.col("args"), F.col("sort"), F.col("low"), F.col("high")))
    meant = meant.groupBy(*key, "sort").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("ids")).alias("ids"))
    kinds = meant.groupBy(*key).agg(F.max("sort").alias("sort"))  # callables first, else types
    meant = meant.join(kinds, [*key, "sort"])
    asks = rest.select(*key, F.explode(_asks(F.col("name"))).alias("a")).select(*key, "a.*").join(kinds, key)
    inside = _nearest(asks.join(heads, ["name", "scope", "sort"]).filter(_fits(F.col("args"), F.col("sort"), F.col("low"), F.col("high"))), [*key, "sort"])
    asked.append(request(inside, 3, F.col("scope"), F.col("sort"), F.col("args"), _confidence(F.col("tier"))))
    outside = meant.join(inside.select(*key).distinct(), key, "left_anti").filter((F.col("n") <= MOST_GLOBAL) & ~stopped(F.col("name"))).select(*key, F.explode("ids").alias("target_id"), "sort")
    asked.append(by_id(outside, 3, F.lit(GLOBAL)))

    requests = asked[0]
    for more in asked[1:]:
        requests = requests.unionByName(more)
    whole = F.sort_array(F.collect_set(F.struct((-F.col("confidence")).alias("weak"), "rule", "scope", "sort", "args")))
    of_name = requests.filter("name is not null").groupBy("source_id", "name").agg(whole.alias("r"))
    each = of_name.select("source_id", "name", "r", F.posexplode("r").alias("at", "x"))
    requests = stash(each.select("source_id", "name", "x.*", (-F.col("x.weak")).alias("confidence"), F.transform(F.slice("r", F.lit(1), F.col("at")), lambda b: F.struct(b["scope"], b["sort"], b["args"])).alias("before")), "requests")

    rows = defs.filter("id is not null and name is not null").distinct()
    repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    once = _pairs(requests, rows.join(repeated, "id", "left_anti")).drop("rule")
    twice = _pairs(requests, rows.join(repeated, "id", "left_semi")).groupBy("source_id", "target_id").agg(F.min_by("type", F.struct(-F.col("confidence"), "rule")).alias("type"), F.max("confidence").alias("confidence"))
    return once.unionByName(twice).unionByName(direct)
