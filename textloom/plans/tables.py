"""The driver's tables seen as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = ("parse order lines", "the shipDate", "user_id of a customer", "find the code")
PATTERNS = ("parseOrder", "^ship.*", "no such order here", "user_id", "")
NODES = ("shop.Order.parse", "db.main.orders", "docs/ship.md#dates")


def tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a tool-call log: a stream for each user (every third one a subagent), a prompt for each month."""
    kind, n = F.col("event_type"), F.col("event_id")
    nav = F.when(n % 5 < 3, "g_search").when(n % 5 == 3, "g_explore").otherwise("g_read")
    cls = F.when(kind.isin("view", "signup"), nav).when(kind == "error", "search").when(kind == "click", "read").when((kind == "purchase") & (n % 2 == 0), "action").otherwise("other")
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (by % len(xs) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session"), F.when(F.col("user_id") % 3 == 0, "sub").otherwise("").alias("agent"), n.alias("seq"), F.date_format("ts", "yyyy-MM").alias("prompt_id"),
        F.lit("").alias("tool_use_id"), (n % 3 > 0).alias("parallel"), cls.alias("class"), "ts", "value", F.col("event_type"),
    )
    k = F.col("seq")
    return rows.select(
        "*", F.when(F.col("class") == "g_search", pick(QUERIES, k)).alias("query"), F.when(F.col("class") == "search", pick(PATTERNS, k)).alias("pattern"),
        F.when(F.col("class").isin("g_explore", "g_read"), pick(NODES, k)).alias("node_id"),
        F.when(F.col("class") == "g_search", F.array(pick(NODES, k), pick(NODES, F.floor(k / 7)))).alias("result_ids"),
    )


def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as a dependency graph."""
    t = lambda n: table(spark, sf_dir, n)
    edge = lambda df, a, x, b, y, c: df.select(F.concat(F.lit(f"{a}."), F.col(x).cast("string")).alias("source_id"), F.concat(F.lit(f"{b}."), F.col(y).cast("string")).alias("target_id"), F.lit(f"{a}_{b}").alias("type"), F.lit(c).alias("confidence"))
    return (
        edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", 1.0)
        .unionByName(edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", 0.95))
        .unionByName(edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", 0.9))
        .unionByName(edge(t("orders"), "orders", "o_orderkey", "customer", "o_custkey", 0.85))
    )


_PICK = lambda xs, by: "(['" + "', '".join(xs) + f"'])[({by}) % {len(xs)} + 1]"
EVENTS_SQL = f"""ev as (
  select *, case class when 'g_search' then {_PICK(QUERIES, "seq")} end as query, case class when 'search' then {_PICK(PATTERNS, "seq")} end as pattern,
         case when class in ('g_explore', 'g_read') then {_PICK(NODES, "seq")} end as node_id, case class when 'g_search' then [{_PICK(NODES, "seq")}, {_PICK(NODES, "seq // 7")}] end as result_ids,
         class in ('g_search', 'g_explore', 'g_read') as is_nav
  from (select user_id::varchar as session, case when user_id % 3 = 0 then 'sub' else '' end as agent, event_id as seq, strftime(ts, '%Y-%m') as prompt_id, event_id % 3 > 0 as parallel,
               case when event_type in ('view', 'signup') then case when event_id % 5 < 3 then 'g_search' when event_id % 5 = 3 then 'g_explore' else 'g_read' end
                    when event_type = 'error' then 'search' when event_type = 'click' then 'read' when event_type = 'purchase' and event_id % 2 = 0 then 'action' else 'other' end as class, ts, value, event_type
        from events)
)"""
WINDOWS_SQL = EVENTS_SQL + """, wn as (
  select *, sum(case when prompt_id is not distinct from before and rn > 1 then 0 else 1 end) over (partition by session, agent order by seq) as win_no,
         sum(case when parallel and coalesce(p, false) and prompt_id is not distinct from before then 0 else 1 end) over (partition by session, agent order by seq) as elem_no
  from (select *, lag(parallel) over w as p, lag(prompt_id) over w as before, row_number() over w as rn from ev window w as (partition by session, agent order by seq))
)"""


def shape_sql(x: str) -> str:
    """The shape of a pattern, from the rule: strip, metacharacters, then at most two words with an identifier."""
    bare = f"trim(regexp_replace(trim(coalesce({x}, ''), chr(9) || chr(10) || ' '), '[\\\\]+$', ''))"
    bare = f"(case when regexp_full_match({bare}, '(?s)\\x27.*\\x27|\".*\"') and length({bare}) >= 2 then trim(substr({bare}, 2, length({bare}) - 2)) else {bare} end)"
    words = f"list_filter(regexp_split_to_array({bare}, '\\s+'), lambda w: w <> '')"
    strong = "regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*') and (contains(w, '_') or (regexp_matches(w, '[A-Z]') and length(w) >= 2))"
    return f"(case when {bare} = '' then 'none' when regexp_matches({bare}, '[\\^$*+?\\[\\]{{}}()|\\\\]') then 'regex' when len({words}) <= 2 and len(list_filter({words}, lambda w: {strong})) > 0 then 'symbol' else 'literal' end)"


def tokens_sql(x: str) -> str:
    """Tokens that carry intent: each ASCII capital begins one; three letters or more, no stop words."""
    stop = "', '".join("the and for where what how code file function class def func implementation find".split())
    return f"list_filter(list_transform(regexp_extract_all({x}, '[A-Z][a-z0-9]*|[a-z0-9]+'), lambda t: lower(t)), lambda t: length(t) >= 3 and t not in ('{stop}'))"


RUNS_SQL = WINDOWS_SQL + f""", el as (
  select session, agent, win_no, elem_no, max(seq) as seq, arg_min(ts, seq) as ts, bool_or(is_nav) as nav, bool_or(class = 'search') as search, bool_or(class in ('read', 'action')) as use,
         bool_or(class = 'search' and {shape_sql("pattern")} = 'symbol') as symbol, coalesce(list(pattern order by seq) filter (class = 'search' and pattern <> ''), []) as patterns,
         arg_max(class, seq) filter (is_nav) as last_nav, max(seq) filter (query <> '') as asked
  from wn group by all
), fo as (
  select *, first_value(case when search or use or nav then {{'kind': case when search then 'search' when use then 'use' else 'nav' end, 'patterns': patterns}} end ignore nulls) over (w rows between 1 following and unbounded following) as nxt,
         sum(case when nav and not coalesce(before, false) then 1 else 0 end) over (w rows unbounded preceding) as run_no
  from (select *, lag(nav) over (partition by session, agent, win_no order by elem_no) as before from el) window w as (partition by session, agent, win_no order by elem_no)
), ru as (
  select session, agent, win_no, run_no, max(seq) as seq, arg_min(ts, elem_no) as ts, arg_max(nxt, elem_no) as nxt, arg_max(last_nav, elem_no) as last_nav, max(asked) as asked, min(elem_no) as e0, max(elem_no) as e1,
         arg_max(nxt is null, elem_no) as ended from fo where nav group by all
), runs as (
  select r.*, q.query, q.ts as query_ts, case when ended then case when last_nav = 'g_read' then 'adoption' else 'inconclusive' end when nxt.kind = 'search' then 'fallback' when nxt.kind = 'use' then 'adoption' else 'merged' end as outcome,
         case when nxt.kind = 'search' and not ended and query is not null then list_filter(nxt.patterns, lambda p: list_has_any({tokens_sql("p")}, {tokens_sql("query")})) end as meant
  from ru r left join ev q on q.session = r.session and q.seq = r.asked
), judged as (select *, coalesce(len(meant) > 0, false) as same_intent, coalesce(meant[1], nxt.patterns[1]) as pattern from runs)"""
EDGES_SQL = """edges as (
  select 'nation.' || n_nationkey as source_id, 'region.' || n_regionkey as target_id, 'nation_region' as type, 1.0::double as confidence from nation
  union all select 'customer.' || c_custkey, 'nation.' || c_nationkey, 'customer_nation', 0.95::double from customer
  union all select 'supplier.' || s_suppkey, 'nation.' || s_nationkey, 'supplier_nation', 0.9::double from supplier
  union all select 'orders.' || o_orderkey, 'customer.' || o_custkey, 'orders_customer', 0.85::double from orders
)"""
TOKENS_SQL = r"""words as (
  select doc_id, unnest(list_filter(regexp_split_to_array(text, '[^\p{L}\p{Nd}_\-]+'), lambda w: w <> '')) as w from documents
), parts as (
  select doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{L})(\p{Nd})', '\1 \2', 'g'), '(\p{Nd})(\p{L})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')), '[^\p{L}\p{Nd}]+'), lambda p: p <> '') as p from words
), toks as (
  select doc_id, unnest(case when len(p) > 1 then list_append(p, array_to_string(p, '')) else p end) as term from parts
)"""
