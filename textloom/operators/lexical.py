"""Inverted index, BM25, exact tier, candidate pools and rank fusion."""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokenize
from ..sources.stored import stash

K1, B = 1.2, 0.75


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, doc_id, tf); term frequencies add up before the shuffle."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokenize(F.col(text))).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, dl), straight from the scan."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.size(tokenize(F.col(text))).cast("long").alias("dl"))


def _lean(spark: SparkSession) -> None:
    """Bounds Arrow batches: texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def _tallied(batch, codes, width):
    """(row, code, count) of a batch's tokens t, given a code or -1 for each."""
    row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column("t")), 0).to_numpy())
    at, tf = np.unique(row[codes >= 0] * width + codes[codes >= 0], return_counts=True)
    return at // width, at % width, tf


def _counted(batches, wanted):
    """Each document with its wanted terms, as places in ``wanted``, and their frequencies."""
    terms = pa.array(wanted, pa.string())
    for batch in batches:
        t = batch.column("t")
        row, code, tf = _tallied(batch, pc.fill_null(pc.index_in(t.flatten(), value_set=terms), -1).to_numpy(), max(1, len(wanted)))
        cuts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (code, tf)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ok"), pc.list_value_length(t).cast(pa.int64()), *lists], names=["doc_id", "ok", "dl", "codes", "tfs"])


#: Tokens that a task counts at a time when it packs postings.
PACKED = 1 << 21


def _gathered(batches):
    """Batches (doc_id, t) joined to runs of about PACKED tokens."""
    held, tokens = [], 0
    for batch in batches:
        held.append(batch)
        tokens += len(batch.column("t").flatten())
        if tokens >= PACKED:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, tokens = [], 0
    if tokens:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _postings(batches):
    """(term, doc_ids, dls, tfs) of the terms of a run of documents, counted where they lie; lists keep terms from moving once a document."""
    for batch in _gathered(batches):
        t = batch.column("t")
        coded = t.flatten().dictionary_encode()
        row, code, tf = _tallied(batch, coded.indices.to_numpy(), len(coded.dictionary))
        order = np.argsort(code, kind="stable")
        cuts = pa.array(np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1)), pa.int32())
        row = pa.array(row[order])
        columns = batch.column("doc_id").take(row), pc.list_value_length(t).take(row), pa.array(tf[order], pa.int32())
        yield pa.RecordBatch.from_arrays([coded.dictionary, *(pa.ListArray.from_arrays(cuts, x) for x in columns)], names=["term", "doc_ids", "dls", "tfs"])


def _best(batches, ids, blocks, idf, avgdl, k, types):
    """Each task's k best documents of every query, told by the rounded score, then the smaller id; scores are not yet rounded."""
    best = [[] for _ in ids]
    for batch in batches:
        docs, dl = batch.column("doc_id").to_pylist(), batch.column("dl").to_numpy(zero_copy_only=False).astype(float)
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("codes")).to_numpy())
        codes, tfs = (batch.column(c).flatten().to_numpy() for c in ("codes", "tfs"))
        for places, terms, asks in blocks:
            at = np.searchsorted(terms, codes).clip(max=len(terms) - 1)
            here = terms[at] == codes
            r, c, n = row[here], at[here], tfs[here]
            for lo in range(0, batch.num_rows, step := max(1, (1 << 21) // max(asks.shape))):
                cut = slice(*np.searchsorted(r, (lo, lo + step)))
                tf = np.zeros((min(step, batch.num_rows - lo), len(terms)))
                np.add.at(tf, (r[cut] - lo, c[cut]), n[cut])
                part = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[lo : lo + step, None] / avgdl))
                scores = part @ asks
                keys = np.floor(scores * 1e6 + 0.5)
                hit = scores > 0
                for j, q in enumerate(places):
                    least = best[q][-1][0] if len(best[q]) == k else 0
                    some = np.flatnonzero(hit[:, j] & (keys[:, j] >= -least))
                    if len(some) > k:
                        some = some[keys[some, j] >= np.partition(keys[some, j], -k)[-k]]
                    if len(some):
                        rows = [(-keys[i, j], docs[lo + i] is not None, docs[lo + i], scores[i, j]) for i in some]
                        best[q] = heapq.nsmallest(k, best[q] + rows)
    flat = [(ids[q], x[2], float(x[3])) for q, rows in enumerate(best) for x in rows]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], kind) for i, kind in enumerate((*types, pa.float64()))], names=["query_id", "doc_id", "score"])


def _asked(queries: DataFrame) -> list[tuple]:
    """The distinct (query_id, term), a stated set that is sent to every task."""
    return sorted({tuple(r) for r in queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query"))))).collect()}, key=repr)


def _searched(hits: DataFrame, asked: list[tuple], wanted: list[str], df: np.ndarray, n: int, avgdl: float, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """Hits (doc_id, dl, codes, tfs), a row a document, are scored where they lie; a task sends its k best rows of a query."""
    ids = list(dict.fromkeys(q for q, _ in asked))
    place, code = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(wanted)}
    pairs = np.array([(place[q], code[t]) for q, t in asked], np.int64).reshape(-1, 2)
    blocks = []
    for lo in range(0, len(ids), block):
        own = pairs[(pairs[:, 0] >= lo) & (pairs[:, 0] < lo + block)]
        terms, at = np.unique(own[:, 1], return_inverse=True)
        asks = np.zeros((len(terms), min(block, len(ids) - lo)))
        asks[at, own[:, 0] - lo] = 1
        blocks.append((range(lo, lo + asks.shape[1]), terms, asks))
    kinds = [queries.schema["query_id"].dataType, hits.schema["doc_id"].dataType]
    scored = hits.select("doc_id", "dl", "codes", "tfs").mapInArrow(partial(_best, ids=ids, blocks=blocks, idf=np.log(1 + (n - df + 0.5) / (df + 0.5)), avgdl=avgdl, k=k, types=[to_arrow_type(x) for x in kinds]), f"query_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score double")
    return ranked(scored.withColumn("score", F.round("score", 6)), "query_id", [F.desc("score"), F.asc("doc_id")], k)


def _frequencies(rows: list, width: int) -> np.ndarray:
    df = np.zeros(width)
    for code, n in rows:
        df[code] = n
    return df


def _repeated(docs: DataFrame, doc_id: str) -> bool:
    return not docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def bm25(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text", where: Column | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query (query_id, query).

    Each distinct query term counts once.  Each text is tokenised once; its query terms (a
    stated set, sent to every task) are counted where it lies and stored, a row a document,
    and scored where that lies once frequencies are known.  Rows of one document count together.
    """
    spark = docs.sparkSession
    _lean(spark)
    asked = _asked(queries)
    wanted = sorted({t for _, t in asked})
    kind = docs.schema[doc_id].dataType.simpleString()
    words = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(where if where is not None else F.lit(True), F.lit(False)).alias("ok"), tokenize(F.col(text)).alias("t"))
    rows = stash(words.mapInArrow(partial(_counted, wanted=wanted), f"doc_id {kind}, ok boolean, dl long, codes array<int>, tfs array<int>"), "hits")
    n, avgdl = rows.agg(F.count(F.lit(1)), F.avg("dl")).first()
    hits = rows.filter(F.size("codes") > 0)
    if _repeated(rows, "doc_id"):
        hits = hits.groupBy("doc_id", "ok").agg(F.sum("dl").alias("dl"), F.flatten(F.collect_list("codes")).alias("codes"), F.flatten(F.collect_list("tfs")).alias("tfs"))
    df = _frequencies(hits.select(F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).collect(), len(wanted))
    return _searched(hits.filter("ok"), asked, wanted, df, n, avgdl or 1.0, queries, k)


INDEX_VERSION = 2


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def save_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", buckets: int = 64) -> None:
    """Store postings (term, and lists of doc_id, dl, tf), document frequencies and totals, so that searches read no text.

    Postings lie in folders by hash of the term, sorted by term inside, so a search reads the folders and row groups of its
    terms.  Each text is tokenised once.  The totals are written last: without them there is no index.
    """
    spark = docs.sparkSession
    _lean(spark)
    words = docs.select(F.col(doc_id).alias("doc_id"), tokenize(F.col(text)).alias("t"))
    kind = docs.schema[doc_id].dataType.simpleString()
    if _repeated(docs, doc_id):  # rows of one document count together
        again = docs.groupBy(F.col(doc_id).alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
        same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
        merged = words.alias("a").join(again.alias("b"), same, "left_semi").groupBy("doc_id").agg(F.flatten(F.collect_list("t")).alias("t"))
        words = words.alias("a").join(again.alias("b"), same, "left_anti").unionByName(merged)
    packed = words.mapInArrow(_postings, f"term string, doc_ids array<{kind}>, dls array<int>, tfs array<int>").withColumn("bucket", _bucket(buckets))
    # A hot term's rows spread over the tasks of its bucket.  Lists move and are sorted, a row a term and batch.
    spread = packed.repartition("bucket", F.pmod(F.xxhash64("doc_ids"), F.lit(8))).sortWithinPartitions("bucket", "term")
    spread.write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = _stored(spark, path, "postings", kind)
    stored.groupBy("bucket", "term").agg(F.sum(F.size("doc_ids")).alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    # Texts that hold no word have no postings, yet count.
    held = stored.agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    totals = docs.agg(F.count(F.lit(1)).alias("n"), F.count(text).alias("known")).crossJoin(held)
    totals.select("n", F.coalesce(F.nullif(F.col("total") / F.col("known"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"), F.lit(INDEX_VERSION).alias("version"), F.lit(buckets).alias("buckets"), F.lit(kind).alias("id_type")).write.parquet(f"{path}/totals")


def _stored(spark: SparkSession, path: str, name: str, id_type: str) -> DataFrame:
    shape = f"term string, doc_ids array<{id_type}>, dls array<int>, tfs array<int>, bucket int" if name == "postings" else "term string, df long, bucket int"
    return spark.read.schema(shape).parquet(f"{path}/{name}")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score) as ``bm25`` gives, from a stored index; ``allowed`` (doc_id) filters documents, not frequencies.

    An index of another version finds nothing.
    """
    totals = spark.read.parquet(f"{path}/totals").filter(F.col("version") == INDEX_VERSION)
    row = totals.first()
    if row is None:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id string, score double, rank int")
    _lean(spark)
    asked = _asked(queries)
    terms = sorted({t for _, t in asked})
    wanted = F.broadcast(spark.createDataFrame(list(enumerate(terms)), "code int, term string").withColumn("bucket", _bucket(row["buckets"])))
    hits, df = (_stored(spark, path, name, row["id_type"]).join(wanted, ["bucket", "term"]).drop("bucket", "term") for name in ("postings", "terms"))
    hits = hits.select("code", F.explode(F.arrays_zip("doc_ids", "dls", "tfs")).alias("x")).select("code", F.col("x.doc_ids").alias("doc_id"), F.col("x.dls").alias("dl"), F.col("x.tfs").alias("tf"))
    if allowed is not None:
        hits = hits.join(allowed.select("doc_id"), "doc_id", "left_semi")
    # Only codes and counts move, to meet by document.
    hits = hits.repartition("doc_id").groupBy("doc_id").agg(F.max("dl").cast("long").alias("dl"), F.collect_list(F.struct("code", "tf")).alias("x"))
    hits = hits.select("doc_id", "dl", F.col("x.code").alias("codes"), F.col("x.tf").alias("tfs"))
    return _searched(hits, asked, terms, _frequencies(df.select("code", "df").collect(), len(terms)), row["n"], row["avgdl"], queries, k)


def ranked(df: DataFrame, by: str | list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def exact_tier(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node_id) of symbols whose id or simple name is the query."""
    by_id = symbols.select("node_id", F.col("node_id").cast("string").alias("query"))
    by_name = symbols.select("node_id", F.col("simple_name").alias("query"))
    return queries.join(by_id.unionByName(by_name), "query").select("query_id", "node_id").distinct()


def pool_size(k: int, filtered: bool) -> int:
    """How many candidates each stream offers."""
    return min(600, (24 if filtered else 3) * k)


def fuse(streams: DataFrame, ks: DataFrame, top: int, by: tuple[str, ...] = ()) -> DataFrame:
    """A3: reciprocal-rank fusion of (*by, stream, id, rank) for each constant of ks (k), a short stated list."""
    each = streams.crossJoin(F.broadcast(ks))
    scored = each.groupBy(*by, "k", "id").agg(F.round(F.sum(1 / (F.col("k") + F.col("rank"))), 9).alias("score"), F.bool_or(F.col("stream") == "lexical").alias("lex"), F.bool_or(F.col("stream") == "semantic").alias("sem"))
    kind = F.when(F.col("lex") & F.col("sem"), "both").when(F.col("lex"), "lexical").otherwise("semantic")
    return ranked(scored.select(*by, "k", "id", "score", kind.alias("match")), [*by, "k"], [F.desc("score"), F.asc("id")], top)
