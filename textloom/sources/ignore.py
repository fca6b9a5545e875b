"""Ignore files in gitignore's syntax."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = "(?!)"


def glob_regex(glob: str) -> str:
    """The regular expression of a glob for one folder or file name; malformed globs match nothing."""
    out, i = "", 0

    def char():
        nonlocal i
        if i < len(glob) and glob[i] == "\\":
            i += 1
        if i >= len(glob):
            raise ValueError(glob)
        i += 1
        return glob[i - 1]

    try:
        while i < len(glob):
            if glob[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif glob[i] == "?":
                out, i = out + "[^/]", i + 1
            elif glob[i] == "[":
                i += 1
                negated = glob[i : i + 1] == "^"
                i += negated
                ranges = []
                while not ranges or glob[i : i + 1] != "]":
                    if glob[i : i + 1] in ("", "-", "]"):
                        raise ValueError(glob)
                    low = high = char()
                    if glob[i : i + 1] == "-":
                        i += 1
                        if glob[i : i + 1] in ("", "-", "]"):
                            raise ValueError(glob)
                        high = char()
                    ranges.append((ord(low), ord(high)))
                i += 1
                members = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges if a <= b)
                out += f"(?!/)[{'^' * negated}{members}]" if members else "[^/]" if negated else NEVER
            else:
                out += re.escape(char())
    except ValueError:
        return NEVER
    return out


def rule_regex(base: str, pattern: str) -> str:
    """The expression for paths (each name followed by a slash) below ``base``; patterns with a slash inside hang on it."""
    names = pattern.removeprefix("/").split("/")
    names = names if "/" in pattern else ["**", *names]
    below = "".join("(?:[^/]+/)*" if n == "**" else glob_regex(n) + "/" for n in names)
    return "^" + (re.escape(base) + "/" if base else "") + below + r"\z"


def _regex(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for bases, patterns in columns:
        yield pd.Series([rule_regex(b, p) for b, p in zip(bases, patterns)], dtype=object)


def rules(files: DataFrame, own: str = ".textloom/ignore") -> DataFrame:
    """(base, place, negate, dir_only, regex) of the lines of ignore files (path, content); paths are relative to the root.

    ``place`` is the order of the rules above a path: ``own`` first, then from the root down, each file by line.
    """
    path = F.ltrim(F.col("path"), F.lit("/"))
    is_own = path == own
    base = F.when(is_own | ~F.contains(path, F.lit("/")), "").otherwise(F.regexp_replace(path, "/[^/]*$", ""))
    files = files.filter(is_own | (F.substring_index(path, "/", -1) == ".gitignore")).select(base.alias("base"), F.when(is_own, -1).when(base == "", 0).otherwise(F.size(F.split(base, "/"))).alias("depth"), "content")
    lines = files.select("base", "depth", F.posexplode(F.split("content", "\n", -1)).alias("no", "line")).withColumn("line", F.rtrim(F.col("line"), F.lit(" \t\r"))).filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    negate = F.startswith("line", F.lit("!"))
    bare = F.when(negate, F.substring("line", F.lit(2), F.length("line"))).otherwise(F.col("line"))
    lines = lines.select("base", F.struct("depth", "no").alias("place"), negate.alias("negate"), bare.alias("bare"))
    lines = lines.withColumn("dir_only", F.endswith("bare", F.lit("/"))).withColumn("pattern", F.regexp_replace("bare", "/$", "")).filter("pattern not in ('', '/')")
    return lines.select("base", "place", "negate", "dir_only", F.pandas_udf(_regex, "string")("base", "pattern").alias("regex"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths (path, is_dir) with ``ignored``: the last rule that matches wins, and nothing in an ignored folder comes back.

    A path meets only the rules of the ignore files above it. Those of the root are
    one row, broadcast: as much as its ignore files hold. Null and empty paths aren't ignored.
    """
    names = F.filter(F.split("path", "/"), lambda n: n != "")
    prefix = lambda i: F.array_join(F.slice(F.col("names"), F.lit(1), i), "/")
    by_base = rules.groupBy("base").agg(F.collect_list(F.struct("place", "negate", "dir_only", "regex")).alias("rules"))
    asked = paths.select("path", "is_dir").filter("path is not null").distinct().withColumn("names", names).filter(F.size("names") > 0)
    folders = F.when(F.size("names") > 1, F.transform(F.sequence(F.lit(1), F.size("names") - 1), prefix)).otherwise(F.array().cast("array<string>"))
    near = asked.select("path", "is_dir", F.explode(folders).alias("base")).join(by_base.filter("base != ''"), "base").groupBy("path", "is_dir").agg(F.flatten(F.collect_list("rules")).alias("near"))
    root = by_base.filter("base = ''").agg(F.flatten(F.collect_list("rules")).alias("root"))
    met = asked.join(near, ["path", "is_dir"], "left").crossJoin(F.broadcast(root))
    met = met.withColumn("rules", F.array_sort(F.concat("root", F.coalesce("near", F.slice("root", F.lit(1), F.lit(0))))))
    steps = F.transform(F.sequence(F.lit(1), F.size("names")), lambda i: F.struct(F.concat(prefix(i), F.lit("/")).alias("p"), (F.col("is_dir") | (i < F.size("names"))).alias("dir")))
    last = lambda s: F.aggregate("rules", F.lit(False), lambda acc, r: F.when((~r["dir_only"] | s["dir"]) & F.rlike(s["p"], r["regex"]), ~r["negate"]).otherwise(acc))
    found = met.select("path", "is_dir", F.exists(steps, last).alias("ignored"))
    return paths.join(found, ["path", "is_dir"], "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))
