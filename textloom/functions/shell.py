"""Shell commands that search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Commands that search, flags of find that name files, flags whose value is the pattern, and flags with another value.
SEARCHES = ("grep", "rg", "egrep", "fgrep", "ag", "ack", "fd", "find")
FIND_NAMES = ("-name", "-iname", "-path")
PATTERN_FLAGS = ("-e", "--regexp")
VALUE_FLAGS = ("-A", "-B", "-C", "-m", "-g", "--glob", "-t", "--type", "-f", "--file")


def shell_words(segment: Column) -> Column:
    """Words between blanks; quotes group and fall away, an open one reaches to the end."""
    quoted = F.regexp_extract_all(segment, F.lit(r"""((?:'[^']*(?:'|\z)|"[^"]*(?:"|\z)|[^ \t'"]++)+)"""), F.lit(1))
    return F.filter(F.transform(quoted, lambda w: F.regexp_replace(w, r"""'([^']*)(?:'|\z)|"([^"]*)(?:"|\z)""", "$1$2")), lambda w: w != "")


def _operand(words: Column) -> Column:
    """The first word that is no flag nor the value of one."""
    state = lambda now, word: F.struct(F.lit(now).alias("now"), word.alias("pattern"))
    nothing = F.lit("")

    def step(acc, w):
        flag = F.when(w.isin(*PATTERN_FLAGS), state("take", nothing)).when(w.isin(*VALUE_FLAGS), state("skip", nothing)).otherwise(state("scan", nothing))
        scan = F.when(F.startswith(w, F.lit("-")), flag).otherwise(state("done", w))
        return F.when(acc["now"] == "done", acc).when(acc["now"] == "skip", state("scan", nothing)).when(acc["now"] == "take", state("done", w)).otherwise(scan)

    return F.aggregate(words, state("scan", nothing), step)["pattern"]


def _after_name(words: Column) -> Column:
    """The word after the first of find's flags for names that has one."""
    followed = F.filter(words, lambda w, i: (i > 0) & F.get(words, i - 1).isin(*FIND_NAMES))
    return F.coalesce(F.get(followed, F.lit(0)), F.lit(""))


def shell_search(command: Column) -> Column:
    """(search, pattern) of a command line: its first segment that searches; null commands search for nothing."""

    def judge(segment):
        def program(words):
            name = F.coalesce(F.substring_index(F.rtrim(F.get(words, F.lit(0)), F.lit("/")), "/", -1), F.lit(""))
            git = (name == "git") & (F.coalesce(F.get(words, F.lit(1)), F.lit("")) == "grep")
            rest = F.slice(words, F.when(git, 3).otherwise(2), F.size(words) + 1)
            return let(rest, lambda r: F.struct((git | name.isin(*SEARCHES)).alias("search"), F.when(~git & (name == "find"), _after_name(r)).otherwise(_operand(r)).alias("pattern")))

        return let(shell_words(segment), program)

    judged = F.filter(F.transform(F.split(command, r"&&|\|\||\||;|\n"), judge), lambda s: s["search"])
    return F.coalesce(F.get(judged, F.lit(0)), F.struct(F.lit(False).alias("search"), F.lit("").alias("pattern")))
