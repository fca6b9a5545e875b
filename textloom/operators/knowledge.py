"""Knowledge sets: roles, task matching, drift, prerequisites, budgets (J17-J20, P20, P21, A19, A20, T10, K1-K3, K5, K10; the counts of K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_sentence, word_keys
from ..sources.stored import stash


def task_match(tasks: DataFrame, sets: DataFrame, least: int = 2) -> DataFrame:
    """(task_id, set_id, words): sets that share ``least`` distinct words with a task."""
    a = tasks.select("task_id", F.explode(word_keys(F.col("text"))).alias("word"))
    b = sets.select("set_id", F.explode(word_keys(F.col("text"))).alias("word")).distinct()
    return a.join(b, "word").groupBy("task_id", "set_id").agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") >= least)


def drift(entries: DataFrame, pins: DataFrame, current: DataFrame) -> DataFrame:
    """Ok, drift, unpinned or gone for each (set_name, node_id)."""
    both = entries.join(pins.withColumnRenamed("hash", "pinned"), ["set_name", "node_id"], "left").join(current, "node_id", "left")
    state = F.when(F.col("hash").isNull(), "gone").when(F.col("pinned").isNull(), "unpinned").when(F.col("pinned") != F.col("hash"), "drift").otherwise("ok")
    return both.select("set_name", "node_id", state.alias("state"))


def repin(old: DataFrame, new: DataFrame) -> DataFrame:
    """How many pins a repin adds, updates and drops."""
    both = old.withColumnRenamed("hash", "a").join(new.withColumnRenamed("hash", "b"), ["set_name", "node_id"], "full")
    return both.agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("a") != F.col("b")).alias("updated"), F.count_if(F.col("b").isNull()).alias("dropped"))


def expand(wanted: DataFrame, needs: DataFrame) -> DataFrame:
    """(name, depth): the names and all their prerequisites, each at its least depth; cycles end.

    Every frontier is written, so a round reads the last one only.
    """
    seen = frontier = stash(wanted.select("name", F.lit(0).alias("depth")).distinct(), "frontier")
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        frontier = stash(frontier.join(needs, "name").select(F.col("need").alias("name")).distinct().join(seen.select("name"), "name", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def missing(expanded: DataFrame, known: DataFrame) -> DataFrame:
    """Names that are needed and don't exist."""
    return expanded.join(known.select("name"), "name", "left_anti").select("name")


def stale(terms: DataFrame, today: str) -> DataFrame:
    """Terms whose ``stale_after`` has come; dates compare as texts."""
    return terms.filter((F.coalesce("stale_after", F.lit("")) != "") & (F.lit(today) >= F.col("stale_after")))


def friction(events: DataFrame) -> DataFrame:
    """Matched, resolved and drifted counts of each set; unread: matched three times, never resolved."""
    each = events.select("kind", F.explode("sets").alias("set_name"))
    out = each.groupBy("set_name").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("matched", "resolved", "drifted")))
    return out.withColumn("unread", (F.col("matched") >= 3) & (F.col("resolved") == 0))


def evidence(citations: DataFrame, least: int = 2) -> DataFrame:
    """Terms cited from ``least`` distinct files (the part of a citation before #)."""
    file = F.split("citation", "#").getItem(0)
    return citations.groupBy("term").agg(F.count_distinct(file).alias("files")).filter(F.col("files") >= least)


def budget_prefix(blocks: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """The blocks of each request, in order, whose running size stays in the budget; the rest are omitted."""
    total = F.sum(size).over(Window.partitionBy(by).orderBy(order))
    return blocks.withColumn("running", total).withColumn("kept", F.col("running") <= budget)


def tagged(rows: DataFrame, tags: str, asked: DataFrame) -> DataFrame:
    """P20: rows with the roles of ``asked`` (role) that their tags name, whatever their case; ``all`` names every role."""
    keys = asked.select("role", F.explode(F.array(F.lower("role"), F.lit("all"))).alias("key"))
    return rows.withColumn("key", F.explode(F.array_distinct(F.transform(tags, F.lower)))).join(keys, "key").drop("key").distinct()


def select_sets(tasks: DataFrame, sets: DataFrame, least: int = 2) -> DataFrame:
    """K1: (task_id, set_id, how): sets for the role of a task, then sets its words match.

    tasks: (task_id, role, text); sets: (set_id, heading, labels, roles).  One word of the
    heading or ``least`` of heading and labels match.  ``expand`` adds prerequisites.
    """
    pushed = tagged(sets.select("set_id", "roles"), "roles", tasks.select("role").filter("role is not null").distinct()).select("role", "set_id").distinct()
    pushed = tasks.join(pushed, "role").select("task_id", "set_id", F.lit("pushed").alias("how"))
    words = tasks.select("task_id", F.explode(word_keys(F.col("text"))).alias("word"))
    keys = sets.select("set_id", F.explode(word_keys(F.concat_ws(" ", "heading", "labels"))).alias("word"), word_keys(F.coalesce("heading", F.lit(""))).alias("own")).select("set_id", "word", F.array_contains("own", F.col("word")).alias("heading"))
    met = words.join(keys, "word").groupBy("task_id", "set_id").agg(F.count(F.lit(1)).alias("words"), F.bool_or("heading").alias("heading"))
    matched = met.filter(F.col("heading") | (F.col("words") >= least)).select("task_id", "set_id", F.lit("matched").alias("how"))
    return pushed.unionByName(matched).groupBy("task_id", "set_id").agg(F.max("how").alias("how"))


def skill_items(roles: DataFrame, terms: DataFrame, sets: DataFrame, budget: int = 12) -> DataFrame:
    """(role, place, kind, name, kept): what a role's block holds: terms (name, scope, status) that are no drafts, then sets (name, roles), each by name."""
    some = tagged(terms.filter("status is null or status != 'draft'").select("name", "scope"), "scope", roles).select("role", F.lit("term").alias("kind"), "name")
    every = some.unionByName(tagged(sets.select("name", "roles"), "roles", roles).select("role", F.lit("set").alias("kind"), "name")).distinct()
    place = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("kind"), "name"))
    return every.withColumn("place", place).withColumn("kept", F.col("place") <= budget).select("role", "place", "kind", "name", "kept")


def nodes_drift(asked: DataFrame, pins: DataFrame, current: DataFrame) -> DataFrame:
    """K3: (node_id, state): nodes asked by id: ok if any set's pin still holds, drift if none does, unpinned, or gone."""
    now = asked.select("node_id").distinct().join(current, "node_id", "left").join(pins.select("node_id", F.col("hash").alias("pinned")), "node_id", "left")
    each = now.groupBy("node_id").agg(F.max("hash").alias("hash"), F.count("pinned").alias("pins"), F.bool_or(F.col("pinned") == F.col("hash")).alias("holds"))
    state = F.when(F.col("hash").isNull(), "gone").when(F.col("pins") == 0, "unpinned").when(F.col("holds"), "ok").otherwise("drift")
    return each.select("node_id", state.alias("state"))


def entries_drift(entries: DataFrame, pins: DataFrame, current: DataFrame, redirects: DataFrame) -> DataFrame:
    """K3: (set_name, node_id, redirected_to, state) of set entries: ok, drift, unpinned or gone.

    ``pins`` are (set_name, node_id, hash, rename_key) by the id the set recorded, ``current`` (node_id, hash, rename_key)
    and ``redirects`` (old_id, new_id), each id at most once and chains followed.  A section that only got another title is ok.
    """
    now = current.select(F.col("node_id").alias("at"), F.col("hash").alias("h"), F.col("rename_key").alias("r"))
    moved = entries.select("set_name", "node_id").join(redirects.select(F.col("old_id").alias("node_id"), "new_id"), "node_id", "left").withColumn("at", F.coalesce("new_id", "node_id"))
    known = pins.select("set_name", "node_id", "hash", "rename_key", F.lit(True).alias("pinned"))
    met = moved.join(known, ["set_name", "node_id"], "left").join(now, "at", "left")
    away = F.col("at") != F.col("node_id")
    retitled = away & (F.coalesce("rename_key", F.lit("")) != "") & (F.col("rename_key") == F.col("r"))
    state = F.when(F.col("h").isNull(), "gone").when(F.col("pinned").isNull(), "unpinned").when((F.col("hash") == F.col("h")) | retitled, "ok").otherwise("drift")
    return met.select("set_name", "node_id", F.when(away, F.col("at")).alias("redirected_to"), state.alias("state"))


#: How many terms a glossary holds.
MOST_TERMS = 30


def judge(terms: DataFrame, defined: DataFrame | None, glossary: DataFrame, least: int = 2, most: int = MOST_TERMS) -> DataFrame:
    """K5: (canonical, contexts, findings): candidates (canonical, aliases, evidence) and the rules they break.

    ``cap``: the glossary (canonical) is full and lacks the term; ``evidence``: cited in fewer than ``least``
    files; ``identifier``: the term or an alias is a name that code defines (word).  Without an index (None) the last isn't judged.
    """
    files = F.array_distinct(F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: F.substring_index(e, "#", 1)))
    each = terms.withColumn("contexts", F.size(files).cast("long"))
    full = glossary.agg((F.count(F.lit(1)) >= most).alias("full"))
    each = each.join(glossary.select("canonical").distinct().withColumn("held", F.lit(True)), "canonical", "left").crossJoin(F.broadcast(full))
    if defined is not None:
        words = terms.select("canonical", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("word"))
        hit = words.join(defined.select("word"), "word", "left_semi").select("canonical").distinct().withColumn("named", F.lit(True))
        each = each.join(hit, "canonical", "left")
    named = F.col("named").isNotNull() if defined is not None else F.lit(False)
    found = F.array(F.when(F.col("full") & F.col("held").isNull(), "cap"), F.when(F.col("contexts") < least, "evidence"), F.when(named, "identifier"))
    return each.select("canonical", "contexts", F.array_compact(found).alias("findings"))


def propose(queue: DataFrame, fresh: DataFrame) -> DataFrame:
    """K5: the queue (canonical, seen, evidence, aliases, body) with fresh candidates (no ``seen``): evidence and aliases add up, a new text replaces the old."""
    every = queue.select("canonical", "seen", "evidence", "aliases", "body", F.lit(0).alias("new")).unionByName(fresh.select("canonical", F.lit(1).alias("seen"), "evidence", "aliases", "body", F.lit(1).alias("new")))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    body = F.max(F.when(F.coalesce("body", F.lit("")) != "", F.struct("new", "body")))["body"]
    return every.groupBy("canonical").agg(F.sum("seen").alias("seen"), union("evidence"), union("aliases"), F.coalesce(body, F.lit("")).alias("body"))


def manifest_sets(sets: DataFrame) -> DataFrame:
    """K2: (name, node_id, summary, entries, groups) of sets as ``knowledge_sets`` reads them; groups with a title only."""
    size = lambda g: F.size(g["entries"])
    groups = F.transform(F.filter("groups", lambda g: g["title"] != ""), lambda g: F.struct(g["title"].alias("title"), g["node_id"].alias("node_id"), size(g).alias("entries")))
    summary = F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise(F.col("intro"))
    return sets.select("name", F.col("path").alias("node_id"), first_sentence(summary).alias("summary"), F.aggregate("groups", F.lit(0), lambda n, g: n + size(g)).alias("entries"), groups.alias("groups"))


def manifest_terms(terms: DataFrame) -> DataFrame:
    """K2: (canonical, aliases, definition, confusions) of terms as ``terms`` reads them."""
    return terms.select("canonical", "aliases", first_sentence(F.col("body")).alias("definition"), "confusions")


def queue_report(proposals: DataFrame, events: DataFrame) -> DataFrame:
    """K7: (section, name, n): awaiting proposals by how often they were seen, sets offered and never read, nodes served after a drift, and tasks nothing matched.

    ``events`` are (kind, sets, node_id, task).
    """
    by = lambda kind, c: events.filter(F.col("kind") == kind).groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("name is not null")
    unread = friction(events).filter("unread").select(F.col("set_name").alias("name"), F.col("matched").alias("n"))
    parts = {"awaiting": proposals.select(F.col("canonical").alias("name"), F.col("seen").cast("long").alias("n")), "unread": unread, "drifted": by("drifted", "node_id"), "misses": by("miss", "task")}
    out = None
    for section, rows in parts.items():
        rows = rows.select(F.lit(section).alias("section"), "name", "n")
        out = rows if out is None else out.unionByName(rows)
    return out
