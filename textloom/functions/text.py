"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD_CUT = r"[^\p{L}\p{Nd}_\-]+"
_PART_CUT = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|[^\p{L}\p{Nd}]+"
#: White space in the sense of Unicode, in a form that all regular expressions here read alike.
WS = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Words that carry no intent in queries and patterns.
STOPWORDS = ("the", "and", "for", "where", "what", "how", "code", "file", "function", "class", "def", "func", "implementation", "find")
#: Tools by class.
TOOLS = {"search_hybrid": "g_search", "explore_graph": "g_explore", "read_code": "g_read", "bootstrap_workspace": "g_boot", "run_local_benchmark": "g_bench", "Grep": "search", "Glob": "search", "Read": "read", "Edit": "action", "Write": "action", "NotebookEdit": "action"}


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def fields(x: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(x, f"{WS}+", -1), lambda w: w != "")


def truncate_bytes(x: Column, most: int) -> Column:
    """The longest prefix of whole characters in ``most`` bytes."""
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(x, "UTF-8"), 1, most).cast("string")), "\\x{FFFD}+$", "")
    return F.when(F.octet_length(x) <= most, x).otherwise(cut)


def split_identifier(x: Column) -> Column:
    """the lower-cased parts of an identifier."""
    return F.transform(F.filter(F.split(x, _PART_CUT, -1), lambda p: p != ""), F.lower)


def tokenize(x: Column) -> Column:
    """parts of each word, and the joined form of words with several parts."""
    words = F.filter(F.split(x, _WORD_CUT, -1), lambda w: w != "")

    def both(w):
        several = let(split_identifier(w), lambda parts: F.when(F.size(parts) > 1, F.array_append(parts, F.array_join(parts, ""))).otherwise(parts))
        # Plain words have one part: the costly cut, which looks around, is for the others.
        return F.when(w.rlike(r"^\p{Lu}?\p{Ll}+$"), F.array(F.lower(w))).otherwise(several)

    return F.flatten(F.transform(words, both))


def tokenize_capped(x: Column, most: int) -> Column:
    """the first ``most`` tokens."""
    return F.slice(tokenize(x), 1, most)


def doc_tokens(simple: Column, node_id: Column, signature: Column, body: Column, most: int = 256) -> Column:
    """Tokens of the name, the name itself, parts and joined form of the id's segments, the signature and the capped body."""
    segments = F.filter(F.split(node_id, r"[.(), ]", -1), lambda x: x != "")
    joined = lambda x: let(split_identifier(x), lambda parts: F.when(F.size(parts) > 1, F.array_append(parts, F.array_join(parts, ""))).otherwise(parts))
    return F.concat(tokenize(simple), F.array(F.lower(simple)), F.flatten(F.transform(segments, joined)), tokenize(signature), tokenize_capped(body, most))


def usage_tokens(x: Column) -> Column:
    """distinct tokens of a query or pattern; every ASCII capital begins one, three letters or more."""
    found = F.transform(F.regexp_extract_all(x, F.lit("([A-Z][a-z0-9]*|[a-z0-9]+)"), F.lit(1)), F.lower)
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS))))


def is_identifier_shaped(x: Column) -> Column:
    """three characters or more, with an underscore or a capital after the first."""
    return x.rlike("^[A-Za-z_][A-Za-z0-9_]{2,}$") & x.rlike("^.+[_A-Z]")


def strong_identifier(x: Column) -> Column:
    """ASCII letters, digits and underscores, no digit first; an underscore, or a capital and a second character."""
    return x.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & (x.rlike("_") | (x.rlike("[A-Z]") & (F.length(x) >= 2)))


def identifier_tokens(x: Column) -> Column:
    """the words of a sentence that look like code, two characters or more, without punctuation around them."""
    words = F.transform(fields(x), lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]{}\"'`]+|[.,;:!?()\[\]{}\"'`]+$", ""))
    return F.filter(words, lambda w: strong_identifier(w) & (F.length(w) >= 2))


def normalize_pattern(x: Column) -> Column:
    """without backslashes at the end and one pair of quotes around it."""
    bare = strip(F.regexp_replace(strip(x), r"\\+$", ""))
    return let(bare, lambda p: F.when(p.rlike(r"""^(?s:(['"]).*\1)$"""), strip(F.substring(p, F.lit(2), F.length(p) - 2))).otherwise(p))


def pattern_shape(x: Column) -> Column:
    """None, regex, symbol (one or two words, one of them an identifier that prose hasn't) or literal."""
    few = lambda p: let(fields(p), lambda w: (F.size(w) <= 2) & F.exists(w, strong_identifier))
    return let(normalize_pattern(F.coalesce(x, F.lit(""))), lambda p: F.when(p == "", "none").when(p.rlike(r"[\^$*+?\[\]{}()|\\]"), "regex").when(few(p), "symbol").otherwise("literal"))


def snake_case(x: Column) -> Column:
    """F9."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def simple_type_name(x: Column) -> Column:
    """the last segment of a type, without type arguments, array marks or nullability."""
    return F.regexp_replace(F.regexp_replace(x, r"(<.*|\[\].*|\?$)", ""), r"^.*[.:]", "")


def simple_name(node_id: Column) -> Column:
    """cut at a parenthesis, then a hash, then take the last segment."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(node_id, r"\(.*", ""), "#.*", ""), r"^.*\.", "")


def terms(query: Column) -> Column:
    """the whole query and its tokens, lower-cased and distinct, two bytes or more."""
    every = F.concat(F.array(query), tokenize(query))
    return F.array_distinct(F.filter(F.transform(every, lambda t: F.lower(strip(t))), lambda t: F.octet_length(t) >= 2))


def word_keys(x: Column) -> Column:
    """distinct tokens of words of two characters or more; words with CJK characters give their bigrams as well."""
    words = F.filter(F.split(x, _WORD_CUT, -1), lambda w: F.length(w) >= 2)
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(w.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"), F.concat(tokenize(w), grams(w))).otherwise(tokenize(w)))))


def first_sentence(x: Column, most: int = 160) -> Column:
    """up to the first full stop, else question mark, else exclamation mark before a space, else ``most`` bytes."""

    def cut(s):
        out = F.when(F.octet_length(s) <= most, s).otherwise(F.concat(strip(truncate_bytes(s, most)), F.lit("…")))
        for end in ("! ", "? ", ". "):
            out = F.when(F.instr(s, end) > 0, strip(F.substring(s, F.lit(1), F.instr(s, end)))).otherwise(out)
        return out

    return let(strip(x), cut)


def target(node_id: Column) -> Column:
    """The population a node id belongs to: db, docs or code; null for an empty one."""
    docs = F.substring_index(node_id, "#", 1).rlike(r"\.(md|markdown)$")
    return F.when(node_id == "", None).when(F.startswith(node_id, F.lit("db.")), "db").when(docs, "docs").when(node_id.isNotNull(), "code")


def population(kind: Column, node_id: Column) -> Column:
    """The target population of a node: code, docs, db, text, or empty (never matches)."""
    docs = F.lower(node_id).rlike(r"\.(md|markdown)$")
    return (
        F.when(kind.isin("table", "view", "routine", "trigger", "policy"), "db").when(kind == "section", "docs").when((kind == "file") & docs, "docs").when(kind == "file", "text").when(kind.isin("class", "interface", "method", "function"), "code").otherwise("")
    )


def tool_class(tool: Column, search: Column) -> Column:
    """Class of a tool call, whatever server offers it; Bash only searches or is nothing."""
    name = F.regexp_replace(tool, "^mcp__.+__([a-zA-Z0-9_]+)$", "$1")
    known = F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv])
    return F.when((name == "Bash") & F.coalesce(search, F.lit(False)), "search").otherwise(F.coalesce(F.try_element_at(known, name), F.lit("other")))
