"""Retrieval over whole collections for many queries at once: BM25, sparse and dense inner products, fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewell.functions import text as X
from tidewell.operators import postings
from tidewell.sources.files import cut, shared_path

EPSILON, FUSE_K = 0.25, 60
#: Query vectors that are compared with every other vector in one pass, in bytes.
QUERY_BYTES = 64 << 20
#: Scores that a task holds at once: some queries with a batch of vectors.
CELLS = 1 << 20


def top(rows: DataFrame, group: str, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The k first rows of each group with their rank from 1. The filter stands right above the window, so Spark cuts groups early."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= k)


def top_by_count(counted: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows of counted (key, n) with the highest n, ties by key."""
    return counted.orderBy(F.desc("n"), key).limit(most)


def lower_words(rows: DataFrame, text: str) -> DataFrame:
    """rows with tokens: lower-cased runs of letters and digits."""
    return rows.withColumn("tokens", X.tokens(F.col(text)))


@dataclass(frozen=True)
class Index:
    """A collection's postings (see postings.build), terms (term, df, idf), its size, and how its texts and questions become tokens."""

    blocks: DataFrame
    terms: DataFrame
    n: int
    mean_length: float
    words: Callable[[DataFrame, str], DataFrame] = lower_words


def bm25_index(docs: DataFrame, id_column: str, text: str, path: str | None = None, words: Callable[[DataFrame, str], DataFrame] = lower_words) -> Index:
    """An index as tables at path (else in the shared folder); texts are tokenised once. No documents: ValueError.

    A negative idf becomes EPSILON times the mean idf. words adds the column tokens to rows (see segment.tokenizer for texts without spaces).
    """
    path = path or shared_path(docs.sparkSession, "index")
    own = words(docs.select(F.col(id_column).alias("doc"), F.col(text).alias("text")), "text").select("doc", "tokens")
    postings.build(own, path)
    return _opened(docs.sparkSession, path, words)


def _opened(spark: SparkSession, path: str, words: Callable[[DataFrame, str], DataFrame]) -> Index:
    n, mean_length = spark.read.parquet(f"{path}/about").select("n", "mean_length").first()
    terms = spark.read.parquet(f"{path}/terms")
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean_idf = terms.agg(F.avg(raw)).first()[0] or 0.0
    idf = F.when(raw < 0, F.lit(EPSILON * mean_idf)).otherwise(raw)
    return Index(spark.read.parquet(f"{path}/blocks"), terms.select("term", "df", idf.alias("idf")), n, mean_length, words)


def open_index(spark: SparkSession, path: str, docs: DataFrame, id_column: str, text: str, words: Callable[[DataFrame, str], DataFrame] = lower_words) -> Index:
    """The index at path; what isn't there, or can't be read, is built anew from docs."""
    try:
        index = _opened(spark, path, words)
        sizes = index.blocks.agg(F.sum(F.size("docs"))).first()[0]
        if sizes == index.n:
            return index
    except AnalysisException:
        pass
    return bm25_index(docs, id_column, text, path, words)


def drop_index(spark: SparkSession, path: str) -> bool:
    """Remove the index at path; whether there was one."""
    return postings.drop(spark, path)


def query_terms(queries: DataFrame, id_column: str, text: str, words: Callable[[DataFrame, str], DataFrame] = lower_words) -> DataFrame:
    own = words(queries.select(F.col(id_column).alias("query"), F.col(text).alias("text")), "text")
    return own.select("query", F.explode("tokens").alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))


def _best(index: Index, asked: DataFrame, ids: DataFrame, k: int, kind: str, digits: int, zeros: bool) -> DataFrame:
    found = postings.search(index.blocks, cut(asked), ids, k, kind, index.mean_length or 1.0, digits, zeros)
    return top(found.where("total is null").drop("total"), "query", k, F.desc("score"), F.asc("doc"))


def _asked(index: Index, queries: DataFrame, id_column: str, text: str) -> DataFrame:
    rows = query_terms(queries.where(F.col(id_column).isNotNull()), id_column, text, index.words).join(index.terms.select("term", "idf"), "term")
    return rows.select("query", "term", (F.col("times") * F.col("idf")).alias("weight"))


def bm25(index: Index, queries: DataFrame, k: int = 10, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(query, doc, score, rank): Okapi BM25, a query's repeated tokens counting again; ties by doc.

    Every question has min(k, n) rows: documents without any of its terms score 0. Null ids ask nothing.
    """
    ids = queries.select(F.col(id_column).alias("query")).where("query is not null")
    return _best(index, _asked(index, queries, id_column, text), ids, k, "bm25", 6, True)


def bm25_work(index: Index, queries: DataFrame, k: int = 10, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(query, read, total): how many postings of its terms a question took, and how many there are."""
    ids = queries.select(F.col(id_column).alias("query")).where("query is not null")
    found = postings.search(index.blocks, cut(_asked(index, queries, id_column, text)), ids, k, "bm25", index.mean_length or 1.0, 6, True)
    return found.where("total is not null").groupBy("query").agg(F.sum("score").cast("long").alias("read"), F.sum("total").alias("total"))


def sparse_vectors(rows: DataFrame, id_column: str, text: str, as_name: str) -> DataFrame:
    """(as_name, term, weight): each token's share of its text."""
    split = rows.select(F.col(id_column).alias(as_name), X.tokens(F.col(text)).alias("tokens"))
    return split.select(as_name, F.size("tokens").alias("n"), F.explode_outer("tokens").alias("term")).where("term is not null").groupBy(as_name, "n", "term").agg(F.count("*").alias("c")).select(as_name, "term", (F.col("c") / F.col("n")).alias("weight"))


def sparse_ip(index: Index, queries: DataFrame, k: int = 10, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(query, doc, score, rank) by the inner product of sparse vectors, whose weights are tokens' shares of their text."""
    asked = cut(sparse_vectors(queries.where(F.col(id_column).isNotNull()), id_column, text, "query"))
    return _best(index, asked, asked.select("query"), k, "share", 9, False)


def hashed_vectors(docs: DataFrame, dims: int = 64) -> DataFrame:
    """(doc, vector) of documents (doc, tokens): unit vectors of token counts by hash, a stand-in for a model's; none without tokens."""
    bucket = X.hash_bucket(F.col("token"), dims).cast("int")
    counts = docs.select("doc", F.explode("tokens").alias("token")).select("doc", bucket.alias("b")).groupBy("doc", "b").agg(F.count("*").alias("c"))
    of = counts.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"), F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))  # dims entries at most
    return of.select("doc", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("norm")).alias("vector"))


def hashed_rows(docs: DataFrame, dims: int = 64) -> DataFrame:
    """hashed_vectors of documents each of which is one row: the same vectors, made row by row without a shuffle."""
    schema = T.StructType([docs.schema["doc"], T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            words = batch.column(1).flatten().dictionary_encode()
            bucket = np.array([int(md5(w).hexdigest()[:8], 16) % dims for w in words.dictionary.cast(pa.binary()).to_pylist()], np.int64)  # as X.hash_bucket
            place = np.repeat(np.arange(batch.num_rows) * dims, sizes) + bucket[words.indices.to_numpy()]
            counts = np.bincount(place, minlength=batch.num_rows * dims).reshape(-1, dims)[sizes > 0]
            vector = counts / np.sqrt((counts * counts).sum(1))[:, None]
            ends = pa.array(np.arange(len(counts) + 1) * dims, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(sizes > 0)), pa.ListArray.from_arrays(ends, pa.array(vector.ravel()))], names=schema.names)

    return docs.select("doc", "tokens").mapInArrow(run, schema)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", squared_l2: bool = False) -> DataFrame:
    """(query, doc, score, rank) by exact inner product, or by squared distance (lower is better).

    Queries meet all vectors in blocks of QUERY_BYTES, CELLS scores at a time; every batch of vectors keeps k rows a query, so what
    is shuffled doesn't depend on how many vectors there are in a batch.
    """
    spark = vectors.sparkSession
    wanted = queries.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).where("v is not null")
    size, count = wanted.agg(F.max(F.size("v")), F.count("*")).first()
    n_blocks = max(1, -(-(size or 1) * 8 * count // QUERY_BYTES))
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("score", T.DoubleType())])
    best = None
    for b in range(n_blocks):
        block = wanted.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).toPandas()
        sent = spark.sparkContext.broadcast((block["id"].to_numpy(np.int64), np.array(block["v"].tolist(), float).reshape(len(block), -1)))

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            for batch in batches:
                batch = batch[batch["v"].notna()]
                if not len(batch) or not len(ids):
                    continue
                v, doc = np.array(batch["v"].tolist(), float), batch["id"].to_numpy(np.int64)
                step = max(1, CELLS // len(v))
                for own in (slice(at, at + step) for at in range(0, len(q), step)):
                    s = q[own] @ v.T
                    if squared_l2:
                        s = (q[own] * q[own]).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * s
                    s = np.round(s, 6) + 0.0
                    keep = np.lexsort((np.broadcast_to(doc, s.shape), s if squared_l2 else -s), axis=1)[:, :k]
                    yield pd.DataFrame({"query": np.repeat(ids[own], keep.shape[1]), "doc": doc[keep].ravel(), "score": np.take_along_axis(s, keep, 1).ravel()})

        found = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).mapInPandas(scan, schema)
        best = found if best is None else best.unionByName(found)
    return top(best, "query", k, F.asc("score") if squared_l2 else F.desc("score"), F.asc("doc"))


def fuse(arms: list[DataFrame], k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of ranked arms (query, doc, rank): the sum of 1 / (60 + rank)."""
    rows = arms[0].select("query", "doc", "rank")
    for a in arms[1:]:
        rows = rows.unionByName(a.select("query", "doc", "rank"))
    scored = rows.groupBy("query", "doc").agg(F.round(F.sum(1 / (FUSE_K + F.col("rank"))), 6).alias("score"))
    return top(scored, "query", k, F.desc("score"), F.asc("doc"))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query, doc, source, rank): both ranked lists one after the other, each document at its first place; rows without a document go."""
    both = first.select("query", "doc", F.lit(0).alias("source"), F.col("rank").alias("r")).unionByName(second.select("query", "doc", F.lit(1).alias("source"), F.col("rank").alias("r"))).where("doc is not null")
    firsts = both.groupBy("query", "doc").agg(F.min(F.struct("source", "r")).alias("m"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("m.source", "m.r"))
    return firsts.select("query", "doc", F.col("m.source").alias("source"), place.alias("rank"))


def expand_parents(hits: DataFrame, children: DataFrame, parents: DataFrame, keep_missing: bool = False) -> DataFrame:
    """hits (query, doc, rank) with each child replaced by its parent, a parent once at its best rank.

    children (doc, parent), parents (parent, text); documents without a parent stay themselves. A child whose
    parent is missing goes, or stays as it is with keep_missing.
    """
    there = parents.select(F.col("parent").alias("found"))
    known = hits.join(children.select("doc", "parent"), "doc", "left").join(there, F.col("parent") == F.col("found"), "left")
    target = F.when(F.col("parent").isNull(), F.col("doc")).otherwise(F.coalesce("found", F.col("doc") if keep_missing else F.lit(None)))
    best = known.withColumn("doc", target).where("doc is not null").groupBy("query", "doc").agg(F.min("rank").alias("r"))
    return best.select("query", "doc", F.row_number().over(Window.partitionBy("query").orderBy("r", "doc")).alias("rank"))


def overlap_score(query: Column, candidate: Column) -> Column:
    """The default reranker: the share of the query's distinct tokens that the candidate has."""
    q = F.array_distinct(X.tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, X.tokens(candidate))).cast("double"), F.size(q).cast("double")), F.lit(0.0))


def rerank(candidates: DataFrame, k: int, query_text: str = "query_text", text: str = "text", score=overlap_score) -> DataFrame:
    """The k best of each query's candidates (query, doc, rank, texts) by score(query, candidate), ties as they stood.

    A blank query keeps its first k unchanged. k may exceed what there is.
    """
    own = F.when(X.is_blank(F.col(query_text)), F.lit(0.0)).otherwise(F.round(score(F.col(query_text), F.col(text)), 6))
    return top(candidates.withColumnRenamed("rank", "before").withColumn("score", own), "query", k, F.desc("score"), F.asc("before"))


def rerank_or_keep(candidates: DataFrame, k: int, score: str, failed: str) -> DataFrame:
    """The k best of each query's candidates (query, doc, rank) by a remote score, a missing one being 0; where the call failed, the first k as they stood."""
    own = F.when(F.col(failed), F.lit(0.0)).otherwise(F.coalesce(F.col(score), F.lit(0.0)))
    return top(candidates.withColumnRenamed("rank", "before").withColumn("score", own), "query", k, F.desc("score"), F.asc("before")).select("query", "doc", "score", "rank")


def contexts(ranked: DataFrame, texts: str = "text") -> DataFrame:
    """(query, context): every query's texts by rank as one numbered context."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(texts).alias("t")))), lambda x: x["t"])
    return ranked.groupBy("query").agg(X.numbered_context(ordered).alias("context"))


def post_process(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query, answer, cite_pages, related_images): citations resolved against the ranked documents.

    answers (query, response), ranked (query, rank, page, images array<struct<path,title>>). Citations
    outside the list are ignored, as are images without a title.
    """
    own = answers.select("query", X.strip_citations(F.col("response")).alias("answer"), X.citations(F.col("response")).alias("cites"))
    cited = own.select("query", F.posexplode("cites").alias("at", "rank")).join(ranked, ["query", "rank"])
    titled = F.coalesce(F.transform(F.filter("images", lambda i: ~X.is_blank(i["title"])), lambda i: i["path"]), F.array().cast("array<string>"))
    found = cited.groupBy("query").agg(
        F.array_sort(F.collect_set("page")).alias("cite_pages"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", titled.alias("own")))), lambda x: x["own"])).alias("related_images"),
    )
    none = F.array()
    return own.join(found, "query", "left").select("query", "answer", F.coalesce("cite_pages", none.cast("array<bigint>")).alias("cite_pages"), F.coalesce("related_images", none.cast("array<string>")).alias("related_images"))
