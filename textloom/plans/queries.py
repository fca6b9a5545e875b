"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes, evaluate, graph, knowledge, lexical, resolve, search, usage, vector
from ..sources import markdown, schemas, stored
from .tables import EDGES_SQL, EVENTS_SQL, RUNS_SQL, TOKENS_SQL, WINDOWS_SQL, fk_edges, shape_sql, table, tool_log

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ask(spark, *rows) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q in enumerate(rows)], "query_id long, query string")


WORDS = ("the anthat heron", "nation of eration", "la reau ment")


@query(f"with {TOKENS_SQL} select doc_id, term, count(*)::bigint as tf from toks group by 1, 2")
def postings(spark, d):
    return lexical.postings(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "term", "tf")


@query(f"with {TOKENS_SQL}, s as (select doc_id, count(*) as dl from toks group by 1) select count(*)::bigint as n, round(avg(coalesce(dl, 0)), 6) as avgdl from documents left join s using (doc_id)")
def corpus_stats(spark, d):
    return lexical.doc_stats(table(spark, d, "documents"), "doc_id", "text").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))


def _bm25_sql(asked: str, k: int, where: str = "true") -> str:
    return f"""with {TOKENS_SQL}, tf as (select doc_id, term, count(*) as tf from toks group by 1, 2), dl as (select doc_id, sum(tf) as dl from tf group by 1),
    corpus as (select count(*) as n, avg(coalesce(dl, 0)) as avgdl from documents left join dl using (doc_id)), df as (select term, count(*) as df from tf group by 1), asked as ({asked}),
    s as (select query_id, tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
          from asked join tf using (term) join df using (term) join dl using (doc_id) join documents d using (doc_id), corpus where {where} group by 1, 2)
    select query_id, rank, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from s) where rank <= {k}"""


_ASKED = "select distinct query_id, unnest(string_split(q, ' ')) as term from (values " + ", ".join(f"({i}::bigint, '{q}')" for i, q in enumerate(WORDS)) + ") t(query_id, q)"


@query(_bm25_sql(_ASKED, 10))
def bm25_topk(spark, d):
    return lexical.bm25(table(spark, d, "documents"), _ask(spark, *WORDS), 10).select("query_id", "rank", "doc_id", "score")


@query(_bm25_sql("select distinct item_id as query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda w: w <> '')) as term from benchmark", 5))
def bm25_batch(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("query"))
    return lexical.bm25(table(spark, d, "documents"), asked, 5).select("query_id", "rank", "doc_id", "score")


_ITEMS = "select distinct item_id as query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda w: w <> '')) as term from benchmark"


@query(_bm25_sql(_ITEMS, 5))
def bm25_indexed(spark, d):
    path = f"{stored.shared_dir(spark)}/index-{uuid.uuid4().hex}"
    lexical.save_index(table(spark, d, "documents"), path, buckets=16)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("query"))
    return lexical.search_index(spark, path, asked, 5).select("query_id", "rank", "doc_id", "score")


@query(_bm25_sql(_ASKED, 10, "d.lang = 'en'"))
def filtered_search(spark, d):
    return lexical.bm25(table(spark, d, "documents"), _ask(spark, *WORDS), 10, where=F.col("lang") == "en").select("query_id", "rank", "doc_id", "score")


@query("select distinct query_id, p_partkey as node_id from (select 0::bigint as query_id, '7' as q union all select 1, min(p_name) from part) a join part on q = p_partkey::varchar or q = p_name")
def exact_lookup(spark, d):
    part = table(spark, d, "part")
    asked = part.agg(F.min("p_name").alias("query")).select(F.lit(1).cast("long").alias("query_id"), "query").unionByName(spark.createDataFrame([(0, "7")], "query_id long, query string"))
    return lexical.exact_tier(part.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("simple_name")), asked)


_TRIM = r"""[.,;:!?()\[\]{}"\x27`]+"""


@query(rf"select doc_id, t as token from (select doc_id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '{T.WS}+'), lambda w: regexp_replace(regexp_replace(w, '^{_TRIM}', ''), '{_TRIM}$', '')), lambda t: length(t) >= 2 and regexp_matches(t, '^[A-Za-z_][A-Za-z0-9_]*$') and regexp_matches(t, '[_A-Z]')))) as t from documents)")
def ident_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.identifier_tokens(F.col("text")))).alias("token"))


_KNN = """q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 50 = 0),
s as (select query_id, vec_id, round(list_dot_product(embedding::double[], q) / sqrt(list_dot_product(embedding::double[], embedding::double[]) * list_dot_product(q, q)), 6) as score from embeddings, q),
knn as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)"""


def _nearest(spark, d, k):
    v = table(spark, d, "embeddings")
    return vector.knn(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), k)


@query(f"with {_KNN} select * from knn where rank <= 10")
def knn_topk(spark, d):
    return _nearest(spark, d, 10).select("query_id", "rank", "vec_id", "score")


_LEX = _bm25_sql("select 0::bigint as query_id, unnest(['the', 'of', 'nation']) as term", 30)


@query(f"""with lex as ({_LEX}), {_KNN}, streams as (select q.query_id, 'lexical' as stream, doc_id as id, rank from lex, q union all select query_id, 'semantic', vec_id, rank from knn where rank <= 30),
ks as (select unnest([20, 60, 100])::int as k), fused as (select query_id, k, id, round(sum(1.0::double / (k + rank)), 9) as score, bool_or(stream = 'lexical') as l, bool_or(stream = 'semantic') as m from streams, ks group by 1, 2, 3)
select query_id, k, id, score, case when l and m then 'both' when l then 'lexical' else 'semantic' end as match, rank from (select *, row_number() over (partition by query_id, k order by score desc, id)::int as rank from fused) where rank <= 10""")
def rrf_k_sweep(spark, d):
    lex = lexical.bm25(table(spark, d, "documents"), _ask(spark, "the of nation"), lexical.pool_size(10, False)).select(F.lit("lexical").alias("stream"), F.col("doc_id").alias("id"), "rank")
    asked = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    sem = _nearest(spark, d, lexical.pool_size(10, False)).select("query_id", F.lit("semantic").alias("stream"), F.col("vec_id").alias("id"), "rank")
    # pool_size rows meet the stated queries.
    streams = asked.crossJoin(F.broadcast(lex)).unionByName(sem)
    return lexical.fuse(streams, spark.createDataFrame([(20,), (60,), (100,)], "k int"), 10, by=("query_id",))


@query(f"with {EDGES_SQL} select type, count(distinct target_id)::bigint as targets, count(*)::bigint as edges from edges group by 1")
def reverse_stats(spark, d):
    return graph.reverse_stats(fk_edges(spark, d))


_PAGE = f"""with {EDGES_SQL}, r as (select 0 as section, target_id as id, type, confidence from edges where source_id = 'nation.3' union all select 1, source_id, type, confidence from edges where target_id = 'nation.3'),
o as (select *, case when starts_with(id, 'supplier') then 0 else 1 end as "foreign" from r where confidence >= 0.85),
p as (select *, row_number() over (order by section, confidence desc, "foreign", id) as rn from o) select section, id, type, confidence, "foreign" from p where rn """


@query(_PAGE + "<= 20")
def explore_page(spark, d):
    return graph.explore(fk_edges(spark, d), "nation.3", package="supplier")


@query(_PAGE + "between 21 and 40")
def explore_next(spark, d):
    last = graph.explore(fk_edges(spark, d), "nation.3", package="supplier").collect()
    return graph.explore(fk_edges(spark, d), "nation.3", package="supplier", after=graph.cursor("nation.3", last[-1]) if last else None)


@query(f"with {EDGES_SQL} select type, count(*)::bigint as n from edges where target_id not in (select 'customer.' || c_custkey from customer where c_acctbal > 0) and type = 'orders_customer' group by 1")
def dangling_edges(spark, d):
    edges = fk_edges(spark, d).filter("type = 'orders_customer'")
    known = table(spark, d, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("customer."), F.col("c_custkey").cast("string")).alias("id"))
    return graph.dangling(edges, known).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("""with c as (select s_suppkey as call_id, 's' || s_suppkey as source_id, s_nationkey, n_regionkey as r, s_suppkey % 50 as name from supplier join nation on n_nationkey = s_nationkey),
t as (select 'c' || c_custkey as target_id, c_nationkey, n_regionkey as q, c_custkey % 50 as name from customer join nation on n_nationkey = c_nationkey),
p as (select *, case when s_nationkey = c_nationkey then 1 when r = q then 2 else 3 end as tier from c join t using (name)),
b as (select *, min(tier) over (partition by call_id) as best from p), k as (select *, count(*) over (partition by call_id) as n from b where tier = best)
select source_id, target_id, max(case tier when 1 then 0.95::double when 2 then 0.9::double else 0.8::double end) as confidence from k where tier < 3 or n <= 5 group by 1, 2""")
def tiered_resolve(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    calls = table(spark, d, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("call_id"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("source_id"), "s_nationkey", F.col("n_regionkey").alias("r"), (F.col("s_suppkey") % 50).alias("name"))
    known = table(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat(F.lit("c"), F.col("c_custkey")).alias("target_id"), "c_nationkey", F.col("n_regionkey").alias("q"), (F.col("c_custkey") % 50).alias("name"))
    return graph.resolve(calls, known, F.when(F.col("s_nationkey") == F.col("c_nationkey"), 1).when(F.col("r") == F.col("q"), 2).otherwise(3))


_NAMES = [*(f"f{i}" for i in range(36)), "get", "Parse", "OrderItem", "find"]
_STOP = "', '".join(resolve.STOPPED)
_FIT = "(args < 0 or (args >= arity_min and (arity_max = -1 or args <= arity_max)))"
_SEEN = "(list_contains(imports, class_fqn) or len(list_filter(imports, lambda i: ends_with(i, '.' || d.name) and starts_with(d.id, substr(i, 1, length(i) - length(d.name))))) > 0 or len(list_filter(imports, lambda i: ends_with(i, '.*') and (starts_with(class_fqn, substr(i, 1, length(i) - 1)) or d.pkg = substr(i, 1, length(i) - 2)))) > 0)"


@query(f"""with names as (select ['{"', '".join(_NAMES)}'] as n),
d as (select case when k % 7 < 2 then pkg || '.K' || k else pkg || '.K' || k % 5 || '.' || name || '#' || k end as id, pkg, case when k % 7 < 2 then pkg || '.K' || k else pkg || '.K' || k % 5 end as class_fqn, name,
             case k % 7 when 0 then 'class' when 1 then 'interface' when 2 then 'function' else 'method' end as kind, 'f' || k % 400 as file, k % 3 as arity_min, case when k % 4 = 0 then -1 else k % 3 + k % 2 end as arity_max
      from (select c_custkey as k, 'p' || c_nationkey as pkg, n[c_custkey % 40 + 1] as name from customer, names)),
s as (select 's.N' || k as source_id, 'p' || c as pkg, 'f' || k % 400 as file, case when k % 2 = 0 then 'class' else 'method' end as kind, case when k % 3 = 0 then 'x' else '' end as container,
             ['p' || (c + 1) % 25 || '.*', 'p' || (c + 2) % 25 || '.K3', 'p' || (c + 3) % 25 || '.K1.' || n[k % 40 + 1], 'p' || c || '.K' || k] as imports, [n[k % 40 + 1], 'x.' || n[(k + 7) % 40 + 1] || '<T>'] as supers, ['s.N' || (k + 1)] as contains,
             [{{'name': n[k % 40 + 1], 'args': k % 4 - 1}}, {{'name': n[k * 3 % 40 + 1], 'args': 1}}, {{'name': n[k * 7 % 40 + 1], 'args': 2}}, {{'name': 'get', 'args': 0}}] as calls
      from (select s_suppkey as k, s_nationkey as c, n from supplier, names)),
cont as (select source_id, unnest(contains) as target_id, 'contains' as type, 1.0::double as confidence, 0 as rule from s),
su as (select source_id, pkg, imports, regexp_replace(replace(unnest(supers), 'x.', ''), '<.*', '') as name from s),
sp as (select source_id, d.id, d.kind, case when d.pkg = su.pkg then 1 when {_SEEN} then 2 else 3 end as tier, su.name from su join d on d.name = su.name),
sb as (select *, min(tier) over (partition by source_id, name) as best from sp),
sup as (select source_id, id as target_id, case kind when 'interface' then 'implements' else 'extends' end as type, case when tier = 3 then 0.8::double else 1.0::double end as confidence, 1 as rule from sb where tier = best and kind in ('class', 'interface')),
imp as (select source_id, id as target_id, 'import' as type, 1.0::double as confidence, 2 as rule from (select source_id, unnest(imports) as i from s where container = '' and kind = 'class') join d on id = i and d.kind in ('class', 'interface')),
ca as (select distinct source_id, pkg, file, imports, c.name as name, c.args as args from (select source_id, pkg, file, imports, unnest(calls) as c from s)),
cp as (select source_id, ca.name, args, d.id, d.kind in ('method', 'function') as callable, d.file = ca.file as own, case when d.pkg = ca.pkg then 1 when {_SEEN} then 2 else 3 end as tier from ca join d on d.name = ca.name where d.kind in ('class', 'interface') or (d.kind in ('method', 'function') and {_FIT})),
cs as (select *, bool_or(callable and own) over w as selfish, bool_or(callable) over w as calls from cp window w as (partition by source_id, name, args)),
ck as (select *, min(tier) over w as best, count(*) over w as n from cs where callable = calls window w as (partition by source_id, name, args)),
us as (select source_id, id as target_id, case when callable then 'call' else 'reference' end as type, case when selfish then 1.0::double when tier = 1 then 0.95::double when tier = 2 then 0.9::double else 0.8::double end as confidence, 3 as rule
       from ck where case when selfish then own and callable else tier = best and (tier < 3 or (n <= 5 and lower(name) not in ('{_STOP}'))) end),
al as (select * from cont union all select * from sup union all select * from imp union all select * from us)
select source_id, target_id, arg_min(type, (-confidence, rule)) as type, max(confidence) as confidence from al where source_id <> target_id group by 1, 2""")
def resolve_edges(spark, d):
    k, c = F.col("k"), F.col("c")
    names = F.array(*map(F.lit, _NAMES))
    name = lambda i: F.element_at(names, (i % 40 + 1).cast("int"))
    cat = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), cat("p", F.col("c_nationkey")).alias("pkg"), name(F.col("c_custkey")).alias("name"))
    rows = rows.withColumn("class_fqn", F.when(k % 7 < 2, cat(F.col("pkg"), ".K", k)).otherwise(cat(F.col("pkg"), ".K", k % 5)))
    known = rows.select(
        F.when(k % 7 < 2, F.col("class_fqn")).otherwise(cat(F.col("class_fqn"), ".", F.col("name"), "#", k)).alias("id"), "pkg", "class_fqn", "name",
        F.when(k % 7 == 0, "class").when(k % 7 == 1, "interface").when(k % 7 == 2, "function").otherwise("method").alias("kind"), cat("f", k % 400).alias("file"), (k % 3).alias("arity_min"), F.when(k % 4 == 0, -1).otherwise(k % 3 + k % 2).alias("arity_max"),
    )
    call = lambda n, a: F.struct(n.alias("name"), a.cast("long").alias("args"))
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("c")).select(
        cat("s.N", k).alias("id"), cat("p", c).alias("pkg"), cat("f", k % 400).alias("file"), F.when(k % 2 == 0, "class").otherwise("method").alias("kind"), F.when(k % 3 == 0, "x").otherwise("").alias("container"),
        F.array(cat("p", (c + 1) % 25, ".*"), cat("p", (c + 2) % 25, ".K3"), cat("p", (c + 3) % 25, ".K1.", name(k)), cat("p", c, ".K", k)).alias("imports"), F.array(name(k), cat("x.", name(k + 7), "<T>")).alias("supers"), F.array(cat("s.N", k + 1)).alias("contains"),
        F.array(call(name(k), k % 4 - 1), call(name(k * 3), F.lit(1)), call(name(k * 7), F.lit(2)), call(F.lit("get"), F.lit(0))).alias("calls"),
    )
    return resolve.resolve_edges(nodes, known)


@query("""with d as (select 'n' || n_nationkey as id, n_name as name, case n_nationkey % 3 when 0 then 'table' when 1 then 'view' else 'function' end as kind, n_regionkey as datasource from nation),
r as (select 's' || s_suppkey as source_id, case when s_suppkey % 2 = 0 then 'table' else 'trigger' end as source_kind, s_suppkey % 5 as datasource, s_nationkey + case when s_suppkey % 7 = 0 then 100 else 0 end as k, s_nationkey from supplier),
e as (select source_id, 'n' || k as target_id, case when source_kind = 'table' then 'foreign_key' when kind = 'function' then 'call' else 'reference' end as type, 1.0::double as confidence from r left join d on id = 'n' || k
union all select source_id, 'n' || ((k + 1) % 25), case when source_kind = 'table' then 'foreign_key' else 'reference' end, 0.9::double from r
union all select source_id, id, 'reference', 0.8::double from r join nation n on n.n_nationkey = r.s_nationkey join d on d.name = n.n_name and d.datasource = r.datasource where d.kind in ('table', 'view'))
select source_id, target_id, max_by(type, confidence) as type, max(confidence) as confidence from e group by 1, 2""")
def database_references(spark, d):
    nation = table(spark, d, "nation")
    kind = F.when(F.col("n_nationkey") % 3 == 0, "table").when(F.col("n_nationkey") % 3 == 1, "view").otherwise("function")
    known = nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), kind.alias("kind"), F.col("n_regionkey").alias("datasource"))
    k = F.col("s_nationkey") + F.when(F.col("s_suppkey") % 7 == 0, 100).otherwise(0)
    named = table(spark, d, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    refs = named.select(
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("source_id"),
        F.when(F.col("s_suppkey") % 2 == 0, "table").otherwise("trigger").alias("source_kind"),
        (F.col("s_suppkey") % 5).alias("datasource"),
        F.inline(F.array(F.struct(F.lit("exact").alias("how"), F.concat(F.lit("n"), k).alias("name")), F.struct(F.lit("logical").alias("how"), F.concat(F.lit("n"), (k + 1) % 25).alias("name")), F.struct(F.lit("token").alias("how"), F.lower("n_name").alias("name")))),
    )
    return graph.database_references(refs, known)


@query("""with d as (select 't' || n_nationkey as id, n_name as name, n_regionkey as home from nation union all select 'u' || n_nationkey, n_name, n_regionkey + 1 from nation where n_nationkey % 4 = 0),
r as (select distinct 'c' || s_suppkey as source_id, case s_suppkey % 3 when 0 then 'explicit' when 1 then 'sql' else 'convention' end as how, n_name as name from supplier join nation on n_nationkey = s_nationkey),
m as (select source_id, how, r.name, id, home from r join d on d.name = r.name),
k as (select *, min(home) over (partition by source_id, how, name) = max(home) over (partition by source_id, how, name) as one from m)
select source_id, id as target_id, max(case when one and how = 'explicit' then 1.0::double when one and how = 'sql' then 0.9::double else 0.8::double end) as confidence from k group by 1, 2""")
def code_to_tables(spark, d):
    nation = table(spark, d, "nation")
    at = lambda p, k: nation.select(F.concat(F.lit(p), F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), F.lit("table").alias("kind"), (F.col("n_regionkey") + k).alias("datasource"), "n_nationkey")
    known = at("t", 0).unionByName(at("u", 1).filter("n_nationkey % 4 = 0"))
    how = F.when(F.col("s_suppkey") % 3 == 0, "explicit").when(F.col("s_suppkey") % 3 == 1, "sql").otherwise("convention")
    refs = table(spark, d, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.concat(F.lit("c"), F.col("s_suppkey")).alias("source_id"), how.alias("how"), F.lower("n_name").alias("name"))
    return graph.code_to_tables(refs, known)


@query(f"with {EDGES_SQL}, s as (select 'nation.' || n_nationkey as id, n_nationkey as rank from nation) select rank, target_id, type from s join edges on source_id = id union all select rank, source_id, type from s join edges on target_id = id")
def one_hop_expand(spark, d):
    seeds = table(spark, d, "nation").select(F.concat(F.lit("nation."), F.col("n_nationkey")).alias("id"), F.col("n_nationkey").alias("rank"))
    e = fk_edges(spark, d)
    out = lambda a, b: e.join(seeds, F.col(a) == F.col("id")).select("rank", F.col(b).alias("target_id"), "type")
    return out("source_id", "target_id").unionByName(out("target_id", "source_id"))


@query("""with a as (select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 10 < 9), b as (select o_orderkey as k, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as v from orders where o_orderkey % 10 > 0)
select case when a.v is null then 'added' when b.v is null then 'removed' when a.v <> b.v then 'changed' else 'same' end as state, count(*)::bigint as n from a full join b using (k) group by 1""")
def snapshot_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    new = o.filter("k % 10 > 0").withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return changes.diff(o.filter("k % 10 < 9"), new, ["k"], "v").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {EDGES_SQL}, a as (select * from edges where type = 'customer_nation'), b as (select source_id, case when source_id like '%7' then 'nation.0' else target_id end as target_id, type, case when source_id like '%3' then 0.5::double else confidence end as confidence from a)
select source_id, target_id, type, case when b.confidence is null then 'tombstone' else 'upsert' end as op, b.confidence as confidence from a full join b using (source_id, target_id, type) where b.confidence is null or a.confidence is null or a.confidence <> b.confidence""")
def edge_diff(spark, d):
    a = fk_edges(spark, d).filter("type = 'customer_nation'")
    b = a.withColumn("target_id", F.when(F.endswith("source_id", F.lit("7")), "nation.0").otherwise(F.col("target_id"))).withColumn("confidence", F.when(F.endswith("source_id", F.lit("3")), 0.5).otherwise(F.col("confidence")))
    return changes.edge_changes(a, b)


@query("with a as (select lang as file, sha256(text) as k, doc_id as id from documents where doc_id % 2 = 0), b as (select lang as file, sha256(text) as k, doc_id as id from documents where doc_id % 2 = 1), x as (select file, k, min(id) as old_id from a group by all having count(*) = 1), y as (select file, k, min(id) as new_id from b group by all having count(*) = 1) select file, k as rename_key, old_id, new_id from x join y using (file, k)")
def rename_match(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("file"), F.sha2("text", 256).alias("rename_key"), F.col("doc_id").alias("id"))
    return changes.renames(docs.filter("id % 2 = 0"), docs.filter("id % 2 = 1"))


@query("select vec_id from embeddings left join (select doc_id as vec_id, n_chars as stored from documents where doc_id % 5 > 0) h using (vec_id) where stored is null or stored <> label")
def stale_vectors(spark, d):
    return changes.stale(table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("h")), table(spark, d, "documents").filter("doc_id % 5 > 0").select(F.col("doc_id").alias("vec_id"), F.col("n_chars").alias("h")), "vec_id", "h")


@query("select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1 and event_type <> 'error'")
def lww_replay(spark, d):
    return changes.replay(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id"], "event_id", "event_type", "error")


@query("select count(*)::bigint as records, count(*) filter (event_type = 'error')::bigint as tombstones, sum(strlen(props))::bigint as bytes, sum(strlen(props)) > 10485760 or count(*) filter (event_type = 'error') > 0.3 * count(*) as compact from events")
def compaction_trigger(spark, d):
    return changes.needs_compaction(table(spark, d, "events"), "event_type", "error", F.octet_length("props"))


@query("with recursive h as (select n_nationkey as old_id, n_nationkey // 2 as new_id, (n_nationkey * 10)::bigint as epoch from nation where n_nationkey > 1), r as (select old_id, new_id, epoch from h union all select r.old_id, h.new_id, greatest(r.epoch, h.epoch) from r join h on r.new_id = h.old_id) select old_id::bigint as old_id, min(new_id)::bigint as new_id, max(epoch)::bigint as epoch from r group by 1")
def redirect_resolve(spark, d):
    k = F.col("n_nationkey").cast("long")
    return graph.redirects(table(spark, d, "nation").filter("n_nationkey > 1").select(k.alias("old_id"), F.floor(k / 2).alias("new_id"), (k * 10).alias("epoch")))


def _windows(spark, d):
    return usage.windows(usage.elements(usage.streams(tool_log(spark, d))))


@query(f"with {WINDOWS_SQL} select session, agent, count(*)::bigint as events, max(win_no)::bigint as windows from wn group by 1, 2")
def prompt_windows(spark, d):
    return usage.windows(tool_log(spark, d)).groupBy("session", "agent").agg(F.count(F.lit(1)).alias("events"), F.max("win_no").alias("windows"))


@query(f"with {WINDOWS_SQL} select session, max(elem_no)::bigint as elements from wn group by 1")
def elements(spark, d):
    return usage.elements(usage.streams(tool_log(spark, d))).groupBy("session").agg(F.max("elem_no").alias("elements"))


_COUNTS = "count(*) filter (outcome = 'adoption')::bigint as adoption, count(*) filter (outcome = 'fallback')::bigint as fallback, count(*) filter (outcome = 'fallback' and same_intent)::bigint as same_intent, count(*) filter (outcome = 'inconclusive')::bigint as inconclusive"


@query(f"with {RUNS_SQL} select outcome, count(*)::bigint as runs from judged group by 1")
def run_outcomes(spark, d):
    return usage.nav_runs(_windows(spark, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("runs"))


@query(f"with {RUNS_SQL} select session, win_no::bigint as win_no, run_no::bigint as run_no, seq, outcome, query, case when outcome = 'fallback' and query is not null then pattern end as pattern, outcome = 'fallback' and same_intent as same_intent from judged")
def nav_runs(spark, d):
    return usage.nav_runs(_windows(spark, d)).select("session", "win_no", "run_no", "seq", "outcome", "query", "pattern", "same_intent")


@query(f"""with {RUNS_SQL}, g as (select unnest(['all', case agent when '' then 'main' else 'subagent' end]) as grp, * from judged), r as (select grp, {_COUNTS} from g group by 1),
st as (select *, coalesce(bool_or(nav) over (partition by session, agent, win_no order by elem_no rows between unbounded preceding and 1 preceding), false) as seen from el),
pw as (select session, agent, win_no, count(*) filter (search) as searches, count(*) filter (search and not seen) as early, count(*) filter (symbol) as symbols, bool_or(nav) as nav from st group by all),
gw as (select unnest(['all', case agent when '' then 'main' else 'subagent' end]) as grp, * from pw)
select grp, count(*)::bigint as windows, count(*) filter (searches > 0)::bigint as with_search, count(*) filter (symbols > 0)::bigint as with_symbol_search, count(*) filter (nav)::bigint as with_nav, count(*) filter (nav and early >= 2)::bigint as late_switches,
       count(*) filter (not nav and symbols >= 3)::bigint as discovery_failures, any_value(adoption) as adoption, any_value(fallback) as fallback, any_value(same_intent) as same_intent, any_value(inconclusive) as inconclusive from gw left join r using (grp) group by 1""")
def group_metrics(spark, d):
    return usage.group_metrics(_windows(spark, d))


@query(f"""with {RUNS_SQL}, ids as (select session, agent, win_no, elem_no, unnest(case class when 'g_search' then result_ids else [node_id] end) as id from wn where is_nav),
t as (select distinct r.session, r.agent, r.win_no, r.run_no, case when starts_with(id, 'db.') then 'db' when regexp_matches(split_part(id, '#', 1), '\\.(md|markdown)$') then 'docs' else 'code' end as target
      from judged r join ids i on i.session = r.session and i.agent = r.agent and i.win_no = r.win_no and i.elem_no between r.e0 and r.e1 where id <> '')
select target, {_COUNTS} from judged join t using (session, agent, win_no, run_no) where outcome <> 'merged' group by 1""")
def target_metrics(spark, d):
    return usage.target_metrics(_windows(spark, d))


@query(f"""with {RUNS_SQL}, st as (select *, coalesce(bool_or(nav) over (partition by session, agent, win_no order by elem_no rows between unbounded preceding and 1 preceding), false) as seen from el)
select session, agent, win_no::bigint as win_no, count(*) filter (search)::bigint as searches, count(*) filter (search and not seen)::bigint as early, count(*) filter (symbol)::bigint as symbols, bool_or(nav) as nav from st group by all""")
def window_metrics(spark, d):
    return usage.window_metrics(_windows(spark, d))


@query(f"with {EVENTS_SQL}, p as (select session, min(case when is_nav then rn end) as b from (select *, row_number() over (partition by session order by seq) - 1 as rn from ev) group by 1), v as (select list_sort(list(b) filter (b is not null)) as l, count(*) as n, count(b) as m from p) select n::bigint as sessions, m::bigint as with_nav, coalesce(l[m // 2 + 1], -1)::bigint as upper_median from v")
def session_first_nav_median(spark, d):
    return usage.first_nav_median(tool_log(spark, d))


@query(f"with {WINDOWS_SQL}, c as (select distinct session, agent, win_no, elem_no, class from wn), o as (select distinct session, agent, win_no, elem_no, lead(elem_no) over (partition by session, agent, win_no order by elem_no) as nxt from (select distinct session, agent, win_no, elem_no from wn)) select a.class as a, b.class as b, count(*)::bigint as n from o join c a using (session, agent, win_no, elem_no) join c b on b.session = o.session and b.agent = o.agent and b.win_no = o.win_no and b.elem_no = o.nxt group by 1, 2")
def bigrams(spark, d):
    return usage.bigrams(_windows(spark, d))


@query(f"with {RUNS_SQL} select strftime(ts, '%Y-%m-%d') as day, count(*) filter (outcome = 'adoption')::bigint as adoption, count(*) filter (outcome = 'fallback')::bigint as fallback from judged group by 1")
def daily_trend(spark, d):
    return usage.daily_trend(_windows(spark, d))


@query(f"with w as (select unnest(string_split(text, ' ')) as p from documents union all select unnest(['class PublishBody', '\"getUser\"', 'a.b', 'three small words', 'HTTP \\', '', '*.go', '_x'])) select {shape_sql('p')} as shape, count(*)::bigint as n from w group by 1")
def shape_histogram(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ", -1)).alias("pattern"))
    odd = spark.createDataFrame([(x,) for x in ("class PublishBody", '"getUser"', "a.b", "three small words", "HTTP \\", "", "*.go", "_x")], "pattern string")
    return usage.shapes(words.unionByName(odd).withColumn("class", F.lit("search")))


@query(f"with {RUNS_SQL} select session, seq, query_ts, query, pattern, same_intent from judged where outcome = 'fallback' and query is not null order by query_ts desc, session, seq limit 20")
def fallback_pairs(spark, d):
    return usage.fallback_pairs(_windows(spark, d))


@query(None)
def funnel_adherence(spark, d):
    return usage.funnel(_windows(spark, d)).agg(F.sum("searches").alias("searches"), F.sum("used").alias("used"))


@query("with c as (select max(ts) - interval 7 day as c from events) select count(*) filter (ts >= c)::bigint as kept, count(*) filter (ts < c)::bigint as dropped, count(*) filter (ts is null)::bigint as malformed from events, c")
def prune_counts(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last")).first()["last"]
    return changes.prune(e, "ts", F.lit(last).cast("timestamp_ntz") - F.expr("interval 7 days"))


_SPLIT = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{L})(\p{Nd})', '\1 \2', 'g'), '(\p{Nd})(\p{L})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')), '[^\p{L}\p{Nd}]+'), lambda p: p <> '')"
_TOKENS = f"(case when len({_SPLIT}) > 1 then list_append({_SPLIT}, array_to_string({_SPLIT}, '')) else {_SPLIT} end)"
_CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"
_KEYS = rf"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{Nd}}_\-]+'), lambda w: length(w) >= 2), lambda w: list_concat({_TOKENS}, case when regexp_matches(w, '{_CJK}') then list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) else [] end))))"


@query(f"with a as (select item_id as task_id, unnest({_KEYS}) as word from benchmark), b as (select distinct conv_id as set_id, unnest({_KEYS}) as word from conversations) select task_id, set_id, count(*)::bigint as words from a join b using (word) group by 1, 2 having count(*) >= 2")
def task_match(spark, d):
    return knowledge.task_match(table(spark, d, "benchmark").select(F.col("item_id").alias("task_id"), "text"), table(spark, d, "conversations").select(F.col("conv_id").alias("set_id"), "text"))


@query("select case when h.hash is null then 'gone' when p.pinned is null then 'unpinned' when p.pinned <> h.hash then 'drift' else 'ok' end as state, count(*)::bigint as n from documents e left join (select doc_id, quality as pinned from labels) p using (doc_id) left join (select doc_id, (n_chars % 2) as hash from documents where doc_id % 9 > 0) h using (doc_id) group by 1")
def drift_status(spark, d):
    docs = table(spark, d, "documents")
    entries = docs.select(F.col("source").alias("set_name"), F.col("doc_id").alias("node_id"))
    pins = table(spark, d, "labels").select(F.col("doc_id").alias("node_id"), F.col("quality").cast("long").alias("hash")).join(entries, "node_id")
    now = docs.filter("doc_id % 9 > 0").select(F.col("doc_id").alias("node_id"), (F.col("n_chars") % 2).alias("hash"))
    return knowledge.drift(entries, pins, now).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("with a as (select doc_id, quality as h from labels where doc_id % 4 > 0), b as (select doc_id, toxic as h from labels where doc_id % 4 < 3) select count(*) filter (a.h is null)::bigint as added, count(*) filter (a.h <> b.h)::bigint as updated, count(*) filter (b.h is null)::bigint as dropped from a full join b using (doc_id)")
def repin_diff(spark, d):
    side = lambda c, w: table(spark, d, "labels").filter(w).select(F.lit("s").alias("set_name"), F.col("doc_id").alias("node_id"), F.col(c).alias("hash"))
    return knowledge.repin(side("quality", "doc_id % 4 > 0"), side("toxic", "doc_id % 4 < 3"))


@query("with recursive n as (select 'nation' || n_nationkey as name, 'region' || n_regionkey as need from nation union all select 'customer' || c_custkey, 'nation' || c_nationkey from customer), r as (select 'customer' || c_custkey as name, 0 as depth from customer union select need, depth + 1 from r join n using (name)) select name, min(depth)::int as depth from r group by 1")
def prereq_expand(spark, d):
    needs = table(spark, d, "nation").select(F.concat(F.lit("nation"), "n_nationkey").alias("name"), F.concat(F.lit("region"), "n_regionkey").alias("need")).unionByName(table(spark, d, "customer").select(F.concat(F.lit("customer"), "c_custkey").alias("name"), F.concat(F.lit("nation"), "c_nationkey").alias("need")))
    return knowledge.expand(table(spark, d, "customer").select(F.concat(F.lit("customer"), "c_custkey").alias("name")), needs)


@query("with e as (select user_id % 50 as set_name, event_type from events) select set_name, count(*) filter (event_type = 'view')::bigint as matched, count(*) filter (event_type = 'purchase')::bigint as resolved, count(*) filter (event_type = 'error')::bigint as drifted, count(*) filter (event_type = 'view') >= 3 and count(*) filter (event_type = 'purchase') = 0 as unread from e group by 1")
def friction_unread(spark, d):
    kind = F.when(F.col("event_type") == "view", "matched").when(F.col("event_type") == "purchase", "resolved").when(F.col("event_type") == "error", "drifted")
    return knowledge.friction(table(spark, d, "events").select(kind.alias("kind"), F.array(F.col("user_id") % 50).alias("sets")))


@query("select lang as term, count(distinct source)::bigint as files from documents group by 1 having count(distinct source) >= 2")
def evidence_rule(spark, d):
    return knowledge.evidence(table(spark, d, "documents").select(F.col("lang").alias("term"), F.concat_ws("#", "source", F.col("doc_id").cast("string")).alias("citation")))


@query("select source, count(*) filter (r <= 12288)::bigint as kept, count(*) filter (r > 12288)::bigint as omitted from (select source, sum(n_chars) over (partition by source order by doc_id) as r from documents) group by 1")
def budget_prefix(spark, d):
    out = knowledge.budget_prefix(table(spark, d, "documents"), "source", "doc_id", "n_chars", 12 << 10)
    return out.groupBy("source").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("omitted"))


ASK = "nation heron table"


def _pages(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))


_HIT = "(contains(lower({0}), 'nation heron table') or contains(lower({0}), 'nation') or contains(lower({0}), 'heron') or contains(lower({0}), 'table'))"
_NEAR = f"l as (select page_id::varchar as path, unnest(string_split(html, chr(10))) as line, generate_subscripts(string_split(html, chr(10)), 1) - 1 as line_no from pages), n as (select *, max(case when {_HIT.format('line')} then 1 else 0 end) over (partition by path order by line_no rows between 3 preceding and 3 following) as near from l)"


@query(f"select count(*)::bigint as files, coalesce(sum(strlen(html)), 0)::bigint as bytes from pages where {_HIT.format('html')}")
def grep_full_bytes(spark, d):
    return evaluate.grep_full(_pages(spark, d), ASK)


@query(f"with {_NEAR} select count(*)::bigint as lines, sum(strlen(line) + 1)::bigint as bytes from n where near = 1")
def grep_context_bytes(spark, d):
    return evaluate.grep_lines(_pages(spark, d), ASK, 3).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("line") + 1).cast("long").alias("bytes"))


@query(f"""with {_NEAR}, m as (select path, count(*) filter ({_HIT.format('line')})::bigint as matches from l group by 1), g as (select *, line_no - row_number() over (partition by path order by line_no) as g from n where near = 1),
r as (select path, (min(line_no) + 1)::int as start, (max(line_no) + 1)::int as "end", any_value(matches) as matches from g join m using (path) group by path, g) select * from r order by matches desc, path, start limit 100""")
def grep_regions(spark, d):
    return evaluate.grep_regions(_pages(spark, d), ASK, 3)


@query(f"with {_NEAR}, x as (select sum(strlen(line))::bigint as nav from n where near = 1), y as (select sum(strlen(html))::bigint as base from pages where {_HIT.format('html')}) select nav, base, round(100 * (1 - nav / base), 6) as saved, floor(nav / 4)::bigint as tokens from x, y")
def bench_savings(spark, d):
    nav = evaluate.grep_lines(_pages(spark, d), ASK, 3).agg(F.sum(F.octet_length("line")).alias("bytes"))
    return evaluate.savings(nav, evaluate.grep_full(_pages(spark, d), ASK))


_CUT = "list_last(list_filter(list_transform(range(0, 121), lambda k: substr({0}, 1, k)), lambda c: strlen(c) <= 120))"


@query(rf"""with b as (select item_id as issue_id, text || chr(10) || '`a_b` and `doc_' || item_id % 3 || '` fooBar fooBar my_name' as text from benchmark),
l as (select issue_id, trim(ltrim(line, '# ')) as q, generate_subscripts(lines, 1) as i from (select issue_id, string_split(text, chr(10)) as lines, unnest(string_split(text, chr(10))) as line from b)),
t as (select issue_id, 0 as tier, 0::bigint as place, arg_min(q, i) as q from l where q <> '' group by 1),
p as (select issue_id, 1 as tier, unnest(range(1, len(x) + 1)) as place, unnest(x) as q from (select issue_id, regexp_extract_all(text, '`([^`\n]{{2,80}})`', 1) as x from b)),
w as (select issue_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) as q from b), i as (select issue_id, 2 as tier, -count(*) as place, q from w where regexp_matches(q, '^.+[_A-Z]') group by 1, 4),
u as (select issue_id, tier, place, trim(q) as q from t union all select issue_id, tier, place, trim(q) from p union all select issue_id, tier, place, q from i),
c as (select issue_id, tier, place, {_CUT.format('q')} as q from u),
f as (select *, row_number() over (partition by issue_id, lower(q) order by tier, place, q) as o from c where q <> ''),
r as (select *, row_number() over (partition by issue_id order by tier, place, q)::int as rank from f where o = 1) select issue_id, rank, q as query from r where rank <= 5""")
def derive_queries(spark, d):
    issue = F.concat("text", F.lit("\n`a_b` and `doc_"), (F.col("item_id") % 3).cast("string"), F.lit("` fooBar fooBar my_name"))
    return evaluate.derive_queries(table(spark, d, "benchmark").select(F.col("item_id").alias("issue_id"), issue.alias("text")), 5)


@query("select event_id, (props->>'k')::int as k from events where (props->>'k') is not null")
def json_explode(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")).filter("k is not null")


@query("select p_partkey, lower(replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), ' ', '_')) as snake, concat_ws(' ', 'part', p_name, p_brand, p_type) as summary from part")
def passage_summary(spark, d):
    return table(spark, d, "part").select("p_partkey", F.replace(T.snake_case(F.col("p_name")), F.lit(" "), F.lit("_")).alias("snake"), F.concat_ws(" ", F.lit("part"), "p_name", "p_brand", "p_type").alias("summary"))


@query("with f as (select doc_id::varchar as path, sha256(text) as hash from documents), g as (select ('0x' || substr(sha256(path), 1, 3))::int as g, sha256(string_agg(path || ':' || hash, ',' order by path || ':' || hash)) as h from f group by 1) select sha256(string_agg(h, ',' order by g)) as root from g")
def root_hash(spark, d):
    return changes.root_hash(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash")))


_MD = r"""with lines as (select path, no, line from (select doc_id::varchar as path, string_split('# Doc' || chr(10) || '## Text' || chr(10) || text || chr(10) || '## Text' || chr(10) || '```' || chr(10) || '# no' || chr(10) || '```' || chr(10), chr(10)) as l from documents), unnest(l) with ordinality as t(line, no)),
marked as (select *, sum(case when regexp_matches(line, '^ {0,3}(```|~~~)') then 1 else 0 end) over (partition by path order by no) % 2 as fenced from lines),
heads as (select path, no, length(regexp_extract(line, '^ {0,3}(#{1,6})([ \t]|$)', 1))::int as level, trim(rtrim(trim(regexp_replace(line, '^ {0,3}#+', '')), '#')) as title from marked where fenced = 0 and regexp_matches(line, '^ {0,3}#{1,6}([ \t]|$)')),
slugs as (select *, coalesce(nullif(replace(regexp_replace(lower(title), '[^\p{L}\p{Nd} _\-]', '', 'g'), ' ', '-'), ''), 'section') as slug from heads),
named as (select *, row_number() over (partition by path order by no)::int as ordinal, slug || case when row_number() over same > 1 then '-' || (row_number() over same - 1) else '' end as anchor from slugs window same as (partition by path, slug order by no))
select path, ordinal, level, title, anchor, no::int as start_line, coalesce((select arg_max(anchor, p.no) from named p where p.path = h.path and p.no < h.no and p.level < h.level), '') as parent from named h"""


@query(_MD)
def md_sections(spark, d):
    return markdown.markdown_sections(table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("# Doc\n## Text\n"), "text", F.lit("\n## Text\n```\n# no\n```\n")).alias("content")))


_DDL = "'create table app.s' || s_suppkey || ' (id bigint not null, ' || 'nation int references n' || s_nationkey || '(id)); create view v' || s_suppkey || ' as select * from s' || s_suppkey"


@query("""select 'db.shop.app.s' || s_suppkey as node_id, 'table' as kind, 'id bigint,nation int' as params, 'db.shop.public.n' || s_nationkey as supers from supplier
union all select 'db.shop.public.v' || s_suppkey, 'view', '', '' from supplier""")
def ddl_nodes(spark, d):
    files = table(spark, d, "supplier").select(F.lit("app.sql").alias("path"), F.expr(_DDL).alias("content"))
    routed, _ = schemas.routes('{"datasources": {"shop": {"engine": "postgres", "sources": [{"path": "app.sql"}]}}}')
    return schemas.schema_nodes(files, routed).select("node_id", "kind", F.array_join("params", ",").alias("params"), F.array_join("supers", ",").alias("supers"))


@query("""with now as (select c_custkey as id, c_acctbal as h from customer where c_custkey % 7 > 0), pin as (select o_custkey as set_name, o_custkey as id, case when o_orderkey % 2 = 0 then c_acctbal else 0 end as h, o_orderkey from orders join customer on o_custkey = c_custkey qualify row_number() over (partition by o_custkey order by o_orderkey) = 1),
e as (select c_custkey as id, case when c_custkey % 5 = 0 then c_custkey + 1 else c_custkey end as at from customer)
select case when now.h is null then 'gone' when pin.id is null then 'unpinned' when pin.h = now.h or (e.at <> e.id and pin.h = 0) then 'ok' else 'drift' end as state, count(*)::bigint as n from e left join now on e.at = now.id left join pin on e.id = pin.id group by 1""")
def entries_drift(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("hash"))
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(F.min("o_orderkey").alias("o"))
    pins = first.join(c, "node_id").select(F.col("node_id").alias("set_name"), "node_id", F.when(F.col("o") % 2 == 0, F.col("hash")).otherwise(0).alias("hash"))
    pins = pins.withColumn("rename_key", F.when(F.col("hash") == 0, "same").otherwise("other"))
    moved = c.filter("node_id % 5 = 0").select(F.col("node_id").alias("old_id"), (F.col("node_id") + 1).alias("new_id"))
    entries = c.select(F.col("node_id").alias("set_name"), "node_id")
    return knowledge.entries_drift(entries, pins, c.filter("node_id % 7 > 0").withColumn("rename_key", F.lit("same")), moved).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""with e as (select s_nationkey, count(distinct s_suppkey % 4) as contexts from supplier group by 1)
select n_name as canonical, coalesce(contexts, 0)::bigint as contexts, concat_ws(',', case when n_nationkey % 6 = 0 then 'cap' end, case when coalesce(contexts, 0) < 2 then 'evidence' end, case when n_regionkey::varchar in (select r_regionkey::varchar from region where r_regionkey > 2) then 'identifier' end) as findings
from nation left join e on n_nationkey = s_nationkey""")
def judge_terms(spark, d):
    n = table(spark, d, "nation")
    cited = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list(F.concat(F.lit("f"), F.col("s_suppkey") % 4, F.lit("#"), F.col("s_suppkey"))).alias("evidence"))
    terms = n.join(cited, "n_nationkey", "left").select(F.col("n_name").alias("canonical"), F.array(F.col("n_regionkey").cast("string")).alias("aliases"), "evidence")
    defined = table(spark, d, "region").filter("r_regionkey > 2").select(F.col("r_regionkey").cast("string").alias("word"))
    glossary = n.filter("n_nationkey % 6 > 0").select(F.col("n_name").alias("canonical"))
    return knowledge.judge(terms, defined, glossary, most=2).select("canonical", "contexts", F.array_join("findings", ",").alias("findings"))


_PIN_ASKED = "select distinct query_id, unnest(string_split(q, ' ')) as term from (values (0::bigint, '7'), (1::bigint, 'where is doc 7 doc7 or 9 doc9'), (2::bigint, 'the of nation')) t(query_id, q)"


@query(f"""with bm as ({_bm25_sql(_PIN_ASKED, 10)}), ask as (select * from (values (0::bigint, 0, '7'), (1::bigint, 0, 'Doc_7'), (1::bigint, 1, 'Doc_9')) t(query_id, word, name)),
sym as (select doc_id as node_id, doc_id::varchar as name, 0 as by_name from documents union all select doc_id, 'Doc_' || (n_chars % 50), 1 from documents),
hits as (select query_id, node_id, row_number() over (partition by query_id order by word, by_name, node_id) as place from ask join sym using (name) qualify place <= case query_id when 0 then 10 else 5 end),
every as (select query_id, node_id, 0 as stream, place, 'exact' as match from hits union all select query_id, doc_id, 1, rank, 'lexical' from bm),
once as (select * from every qualify row_number() over (partition by query_id, node_id order by stream, place) = 1)
select query_id, rank, node_id, match from (select *, row_number() over (partition by query_id order by stream, place)::int as rank from once) where rank <= 10""")
def pinned_search(spark, d):
    docs, asked = table(spark, d, "documents"), _ask(spark, "7", "where is Doc_7, or Doc_9?", "the of nation")
    symbols = docs.select(F.col("doc_id").alias("node_id"), F.concat(F.lit("Doc_"), (F.col("n_chars") % 50).cast("string")).alias("simple_name"))
    found = lexical.bm25(docs, asked, 10).select("query_id", F.col("doc_id").alias("node_id"), "rank", F.lit("lexical").alias("match"))
    return search.pinned(asked, symbols, found, 10)


@query("select 'k' || k || '-rrf' || r || '-mc' || (100 * c)::int as name, k as top_k, r as rrf_k, c as least from (select unnest([5, 10, 20])::int as k), (select unnest([20, 60, 100])::int as r), (select unnest([0.75, 0.85, 0.95])::double as c)")
def sweep_configs(spark, d):
    return evaluate.sweep(spark)


@query(f"""with {EDGES_SQL}, keys as (select 'nation.' || n_nationkey as node_id, n_nationkey as k from nation union all select 'region.' || r_regionkey, r_regionkey from region union all select 'customer.' || c_custkey, c_custkey from customer union all select 'supplier.' || s_suppkey, s_suppkey from supplier),
seeds as (select n_regionkey as task_id, 'nation.' || n_nationkey as node_id, row_number() over (partition by n_regionkey order by n_nationkey) as seed from nation),
hops as (select task_id, seed, 0 as section, target_id as id, confidence from seeds join edges on source_id = node_id union all select task_id, seed, 1, source_id, confidence from seeds join edges on target_id = node_id),
near as (select *, row_number() over (partition by task_id, seed order by section, confidence desc, not starts_with(id, 'supplier'), id) as place from hops where confidence >= 0.85),
visits as (select task_id, node_id, 0 as stage, seed, 0 as place from seeds union all select task_id, id, 1, seed, place from near where place <= 20),
regions as (select task_id, 'p' || (k % 7) as path, k % 100 * 10 as start, k % 100 * 10 + k % 500 as "end", stage, seed, place from visits join keys using (node_id) where k % 11 <> 5 and k % 500 < 400),
once as (select * from regions qualify row_number() over (partition by task_id, path, start, "end" order by stage, seed, place) = 1)
select task_id, rank, path, start, "end" from (select *, row_number() over (partition by task_id order by stage, seed, place)::int as rank from once) where rank <= 100""")
def exploration_regions(spark, d):
    key = lambda t, k: table(spark, d, t).select(F.concat(F.lit(f"{t}."), F.col(k).cast("string")).alias("node_id"), F.col(k).cast("long").alias("k"))
    keys = key("nation", "n_nationkey").unionByName(key("region", "r_regionkey")).unionByName(key("customer", "c_custkey")).unionByName(key("supplier", "s_suppkey"))
    k, start = F.col("k"), F.col("k") % 100 * 10
    nodes = keys.select("node_id", F.when(k % 11 == 5, "file").otherwise("method").alias("kind"), F.lit("supplier").alias("package"), F.concat(F.lit("p"), (k % 7).cast("string")).alias("path"), start.alias("start"), (start + k % 500).alias("end"))
    seeds = table(spark, d, "nation").select(F.col("n_regionkey").alias("task_id"), F.lit(0).alias("query_no"), F.col("n_nationkey").alias("rank"), F.concat(F.lit("nation."), F.col("n_nationkey").cast("string")).alias("node_id"))
    return evaluate.explored_regions(seeds, fk_edges(spark, d), nodes)


@query("""with roles as (select distinct event_type as role from events), terms as (select distinct lang || source as name, case when doc_id % 3 = 0 then 'all' else 'View' end as tag from documents where doc_id % 5 > 0),
sets as (select distinct 's' || o_orderkey % 40 as name, case when o_orderkey % 2 = 0 then 'error' else 'CLICK' end as tag from orders),
items as (select role, 'term' as kind, name from roles join terms on lower(tag) in (role, 'all') union select role, 'set', name from roles join sets on lower(tag) = role)
select role, place, kind, name, place <= 12 as kept from (select *, row_number() over (partition by role order by kind desc, name)::int as place from items)""")
def skill_budget(spark, d):
    docs, orders = table(spark, d, "documents"), table(spark, d, "orders")
    terms = docs.select(F.concat("lang", "source").alias("name"), F.array(F.when(F.col("doc_id") % 3 == 0, "all").otherwise("View")).alias("scope"), F.when(F.col("doc_id") % 5 == 0, "draft").alias("status"))
    sets = orders.select(F.concat(F.lit("s"), (F.col("o_orderkey") % 40).cast("string")).alias("name"), F.array(F.when(F.col("o_orderkey") % 2 == 0, "error").otherwise("CLICK")).alias("roles"))
    return knowledge.skill_items(table(spark, d, "events").select(F.col("event_type").alias("role")).distinct(), terms.distinct(), sets.distinct())
