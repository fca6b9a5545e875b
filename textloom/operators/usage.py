"""Tool-call logs: streams, elements, windows, runs, outcomes.

A row of a log has session, agent (empty: the main loop), seq, ts, prompt_id,
tool_use_id, parallel, class, query, pattern, node_id and result_ids; an operator
takes columns that a log lacks for null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pattern_shape, target, usage_tokens

STREAM = ["session", "agent"]
#: Classes of navigation; "nav" stands for any that isn't told apart.
NAV = ("g_search", "g_explore", "g_read", "nav")
_COLUMNS = {"elem_no": "long", "ts": "timestamp", "query": "string", "pattern": "string", "node_id": "string", "result_ids": "array<string>"}


def streams(events: DataFrame) -> DataFrame:
    """Rows in append order of each stream, the first of each tool_use_id."""
    w = Window.partitionBy(*STREAM, "tool_use_id").orderBy("seq")
    return events.withColumn("rn", F.row_number().over(w)).filter("rn = 1 or tool_use_id is null or tool_use_id = ''").drop("rn")


def elements(rows: DataFrame) -> DataFrame:
    """elem_no; consecutive parallel calls of one prompt are one element."""
    w = Window.partitionBy(*STREAM).orderBy("seq")
    joins = F.col("parallel") & F.coalesce(F.lag("parallel").over(w), F.lit(False)) & F.col("prompt_id").eqNullSafe(F.lag("prompt_id").over(w))
    return rows.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("elem_no", F.sum("new").over(w)).drop("new")


def windows(rows: DataFrame) -> DataFrame:
    """win_no; runs of one prompt_id (which may come again as a new window)."""
    w = Window.partitionBy(*STREAM).orderBy("seq")
    starts = F.when(F.col("prompt_id").eqNullSafe(F.lag("prompt_id").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("new", starts).withColumn("win_no", F.sum("new").over(w)).drop("new")


def batches(rows: DataFrame) -> DataFrame:
    """A row for each element of a window: what its calls are, in order."""
    for name, kind in _COLUMNS.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.col("seq") if name == "elem_no" else F.lit(None).cast(kind))
    nav, search = F.col("class").isin(*NAV), F.col("class") == "search"
    asked = F.col("class").isin("g_search", "nav") & (F.coalesce("query", F.lit("")) != "")
    shown = F.when(F.col("class") == "g_search", F.col("result_ids")).when(F.col("class").isin("g_explore", "g_read"), F.array("node_id"))
    return rows.groupBy(*STREAM, "win_no", "elem_no").agg(
        F.max("seq").alias("seq"),
        F.min_by("ts", "seq").alias("ts"),
        F.bool_or(nav).alias("nav"),
        F.bool_or(search).alias("search"),
        F.bool_or(F.col("class").isin("read", "action")).alias("use"),
        F.bool_or(search & (pattern_shape(F.col("pattern")) == "symbol")).alias("symbol"),
        F.array_sort(F.collect_list(F.when(search & (F.coalesce("pattern", F.lit("")) != ""), F.struct("seq", "pattern")))).alias("patterns"),
        F.max_by("class", F.when(nav, F.col("seq"))).alias("last_nav"),
        F.max_by(F.struct("query", "ts"), F.when(asked, F.col("seq"))).alias("asked"),
        F.array_distinct(F.flatten(F.collect_list(F.transform(F.coalesce(shown, F.array().cast("array<string>")), target)))).alias("targets"),
    )


def nav_runs(rows: DataFrame) -> DataFrame:
    """A row for each maximal run of nav-bearing elements of a window, with its outcome.

    The first decisive element after the run decides: search (which beats others in a
    batch) is a fallback, read or action an adoption, nav means the run merged into the
    next; at the window's end it is an adoption if its last navigation read code, else
    inconclusive.  A fallback has the run's last query and the first pattern that shares
    a token with it (same_intent), else the first pattern.
    """
    win = Window.partitionBy(*STREAM, "win_no").orderBy("elem_no")
    kind = F.when(F.col("search"), "search").when(F.col("use"), "use").when(F.col("nav"), "nav")
    nxt = F.first(F.when(kind.isNotNull(), F.struct(kind.alias("kind"), "patterns")), ignorenulls=True).over(win.rowsBetween(1, Window.unboundedFollowing))
    first = F.col("nav") & ~F.coalesce(F.lag("nav").over(win), F.lit(False))
    marked = batches(rows).withColumn("next", nxt).withColumn("run_no", F.sum(F.when(first, 1).otherwise(0)).over(win)).filter("nav")
    runs = marked.groupBy(*STREAM, "win_no", "run_no").agg(
        F.max("seq").alias("seq"),
        F.min_by("ts", "elem_no").alias("ts"),
        F.max_by("next", "elem_no").alias("next"),
        F.max_by("last_nav", "elem_no").alias("last_nav"),
        F.max_by("asked", F.when(F.col("asked").isNotNull(), F.col("elem_no"))).alias("asked"),
        F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_list("targets"))))).alias("targets"),
    )
    after = F.col("next.kind")
    outcome = F.when(after == "search", "fallback").when(after == "use", "adoption").when(after == "nav", "merged").when(F.col("last_nav") == "g_read", "adoption").otherwise("inconclusive")
    meant = F.filter("next.patterns", lambda p: F.arrays_overlap(usage_tokens(p["pattern"]), usage_tokens(F.col("asked.query"))))
    fallback = (F.col("outcome") == "fallback") & F.col("asked").isNotNull()
    out = runs.withColumn("outcome", outcome).withColumn("meant", F.when(fallback, meant))
    return out.select(*STREAM, "win_no", "run_no", "seq", "ts", "outcome", "targets", F.col("asked.query").alias("query"), F.col("asked.ts").alias("query_ts"), F.when(fallback, F.coalesce(F.get("meant", F.lit(0)), F.get("next.patterns", F.lit(0)))["pattern"]).alias("pattern"), F.coalesce(F.size("meant") > 0, F.lit(False)).alias("same_intent"))


def window_metrics(rows: DataFrame) -> DataFrame:
    """A row for each window: elements that search, before the first nav, and for symbols; whether it navigates."""
    win = Window.partitionBy(*STREAM, "win_no").orderBy("elem_no")
    seen = F.coalesce(F.bool_or("nav").over(win.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return batches(rows).withColumn("seen", seen).groupBy(*STREAM, "win_no").agg(F.count_if("search").alias("searches"), F.count_if(F.col("search") & ~F.col("seen")).alias("early"), F.count_if("symbol").alias("symbols"), F.bool_or("nav").alias("nav"))


def _groups() -> Column:
    return F.explode(F.array(F.lit("all"), F.when(F.coalesce("agent", F.lit("")) == "", "main").otherwise("subagent"))).alias("grp")


def group_metrics(rows: DataFrame) -> DataFrame:
    """Windows and run outcomes of all, main and subagent streams."""
    per = window_metrics(rows).select(_groups(), "*").groupBy("grp").agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("searches") > 0).alias("with_search"),
        F.count_if(F.col("symbols") > 0).alias("with_symbol_search"),
        F.count_if("nav").alias("with_nav"),
        F.count_if(F.col("nav") & (F.col("early") >= 2)).alias("late_switches"),
        F.count_if(~F.col("nav") & (F.col("symbols") >= 3)).alias("discovery_failures"),
    )
    runs = outcomes(nav_runs(rows).select(_groups(), "*"), "grp")
    return per.join(runs, "grp", "left").na.fill(0)


def outcomes(runs: DataFrame, by: str) -> DataFrame:
    """Counts of outcomes by a column of the runs."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    return runs.groupBy(by).agg(count("adoption").alias("adoption"), count("fallback").alias("fallback"), F.count_if("same_intent").alias("same_intent"), count("inconclusive").alias("inconclusive"))


def target_metrics(rows: DataFrame) -> DataFrame:
    """Outcomes by target population; a run counts in each that its results and nodes belong to."""
    runs = nav_runs(rows).filter("outcome <> 'merged'").select(F.explode("targets").alias("target"), "outcome", "same_intent")
    return outcomes(runs, "target")


def daily_trend(rows: DataFrame) -> DataFrame:
    """Adoptions and fallbacks by the day on which a run begins."""
    out = outcomes(nav_runs(rows).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day")
    return out.select("day", "adoption", "fallback")


def shapes(rows: DataFrame) -> DataFrame:
    """Searches by the shape of their pattern."""
    return rows.filter("class = 'search'").groupBy(pattern_shape(F.col("pattern")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def fallback_pairs(rows: DataFrame, n: int = 20) -> DataFrame:
    """The latest fallbacks of runs that asked something."""
    return nav_runs(rows).filter("outcome = 'fallback' and query is not null").select("session", "seq", "query_ts", "query", "pattern", "same_intent").orderBy(F.desc("query_ts"), "session", "seq").limit(n)


def first_nav_median(events: DataFrame) -> DataFrame:
    """A10: sessions, those with nav, and the upper median of calls before the first nav (-1 if none)."""
    w = Window.partitionBy("session").orderBy("seq")
    nth = events.withColumn("before", F.row_number().over(w) - 1)
    per = nth.groupBy("session").agg(F.min(F.when(F.col("class").isin(*NAV), F.col("before"))).alias("before"))
    return per.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count("before").alias("with_nav"),
        # The value at place n div 2 of the sorted values; a percentile of a histogram, not a gathered list.
        F.coalesce(F.expr("percentile_disc(0.5) within group (order by before desc)"), F.lit(-1)).cast("long").alias("upper_median"),
    )


def bigrams(rows: DataFrame) -> DataFrame:
    """Transitions between classes of consecutive elements of a window (cross product of class sets)."""
    per = rows.groupBy(*STREAM, "win_no", "elem_no").agg(F.collect_set("class").alias("classes"))
    w = Window.partitionBy(*STREAM, "win_no").orderBy("elem_no")
    pairs = per.withColumn("next", F.lead("classes").over(w)).filter("next is not null")
    return pairs.select(F.explode("classes").alias("a"), "next").select("a", F.explode("next").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def funnel(rows: DataFrame) -> DataFrame:
    """By window, searches with results and those that a later explore or read of one of their nodes follows.

    A use takes the most recent search that has its node and wasn't taken.  That is sequential,
    hence a pandas group; a window is one prompt, and only its navigation is sent.
    """

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        open_, total, used = [], 0, 0
        for c, ids, node in pdf.sort_values("seq")[["class", "result_ids", "node_id"]].itertuples(index=False):
            if c == "g_search" and ids is not None and len(ids):
                total += 1
                open_.append(set(ids))
            elif c != "g_search" and node:
                at = next((k for k in range(len(open_) - 1, -1, -1) if node in open_[k]), None)
                if at is not None:
                    del open_[at]
                    used += 1
        head = pdf.iloc[0]
        return pd.DataFrame([(head["session"], head["agent"], head["win_no"], total, used)], columns=["session", "agent", "win_no", "searches", "used"])

    nav = rows.filter(F.col("class").isin("g_search", "g_explore", "g_read")).select(*STREAM, "win_no", "seq", "class", "result_ids", "node_id")
    return nav.groupBy(*STREAM, "win_no").applyInPandas(match, "session string, agent string, win_no long, searches long, used long")
