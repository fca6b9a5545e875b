"""What a tool log keeps of a call: a few short fields and ids of results; no code and no command lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shell import shell_search
from .text import let, truncate_bytes

#: Bytes of a kept string, ids of results that are kept, how deep a response is read, and fields kept by tool.
MOST_BYTES, MOST_IDS, DEPTH = 300, 5, 4
FIELDS = {"search_hybrid": ("query",), "explore_graph": ("node_id", "direction"), "read_code": ("node_id",), "Grep": ("pattern", "path", "glob"), "Glob": ("pattern",), "Read": ("file_path",), "Edit": ("file_path",), "Write": ("file_path",)}
STRINGS = ("query", "node_id", "direction", "pattern", "path", "glob", "file_path")
_INPUT = ", ".join(f"{c} string" for c in (*STRINGS, "command")) + ", top_k double"
_LITERAL = r'"[^"]*"'
#: Escapes as control characters, which no JSON holds, so that a string is what stands between two quotes.
_ESCAPES = (("\\\\", "\x01"), ('\\"', "\x02"))


def result_ids(response: Column) -> Column:
    """Ids in the first string of a JSON response, four levels deep at most, that holds results; null for none."""

    def swap(x, back=False):
        for pair in _ESCAPES[::-1] if back else _ESCAPES:
            x = F.replace(x, *map(F.lit, pair[::-1] if back else pair))
        return x

    def read(plain):
        def judge(literal):
            before = F.regexp_replace(F.call_function("substring_index", plain, literal, F.lit(1)), _LITERAL, "")
            depth = F.length(F.regexp_replace(before, r"[^\[{]", "")) - F.length(F.regexp_replace(before, r"[^\]}]", ""))
            return F.when(depth <= DEPTH, F.from_json(F.concat(F.lit("["), swap(literal, back=True), F.lit("]")), "array<string>")[0])

        # Keys are matched with their colon, so that their quotes open nothing.
        literals = F.filter(F.regexp_extract_all(plain, F.lit(rf"({_LITERAL}(?:\s*:)?)"), F.lit(1)), lambda x: F.endswith(x, F.lit('"')) & x.rlike(r"(?:<|\\u003[cC])results"))
        return F.get(F.filter(F.transform(literals, judge), lambda t: F.contains(t, F.lit("<results"))), F.lit(0))

    ids = let(let(swap(response), read), lambda text: F.regexp_extract_all(text, F.lit('<node id="([^"]+)"'), F.lit(1)))
    return F.when(F.try_parse_json(response).isNotNull(), F.nullif(ids, F.array().cast("array<string>")))


def payload(tool: Column, given: Column, response: Column, root: Column) -> Column:
    """P10: the kept fields of a call, from its input and response as JSON and the folder it ran in; null for other tools.

    Paths below the folder are made relative.  Of a command only whether it searches, and for what, is kept.
    """
    name = F.regexp_replace(tool, "^mcp__.+__([a-zA-Z0-9_]+)$", "$1")
    short = lambda x: truncate_bytes(F.coalesce(x, F.lit("")), MOST_BYTES)
    inside = F.concat(F.rtrim(F.coalesce(root, F.lit("")), F.lit("/")), F.lit("/"))
    relative = lambda p: F.when(F.startswith(p, inside) & (F.length(inside) > 1), F.substring(p, F.length(inside) + 1, F.length(p))).otherwise(p)

    def fields(d):
        ran, ids = shell_search(d["command"]), result_ids(response)

        def one(c):
            value = relative(short(d[c])) if c in ("path", "file_path") else short(d[c])
            kept = F.when(name.isin(*[t for t, fs in FIELDS.items() if c in fs]), F.nullif(value, F.lit("")) if c in ("path", "glob") else value)
            return kept.when((name == "Bash") & ran["search"], F.nullif(short(ran["pattern"]), F.lit(""))) if c == "pattern" else kept

        search = name == "search_hybrid"
        return F.struct(
            *(one(c).alias(c) for c in STRINGS), F.when(search, d["top_k"].cast("int")).alias("top_k"), F.when(search, F.size(ids)).alias("result_count"),
            F.when(search, F.slice(ids, 1, MOST_IDS)).alias("result_ids"), F.when(name == "Bash", ran["search"]).alias("search"),
        )

    known = (*FIELDS, "bootstrap_workspace", "run_local_benchmark", "Bash")
    read = F.coalesce(F.from_json(given, _INPUT), F.from_json(F.lit("{}"), _INPUT))
    return F.when(name.isin(*known), let(read, fields))
