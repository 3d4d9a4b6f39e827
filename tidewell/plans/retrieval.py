"""Search plans: the benchmark's texts as questions over all documents; vectors whose id is a multiple of 100 over all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import conversation, metrics, search
from tidewell.plans.base import BM25, CONTEXTS, DOC_TOKENS, MERGED, RERANKED, SPARSE, TERMS, TRUTH, query
from tidewell.sources.files import table

K, KEEP = 10, 5


def doc_index(spark: SparkSession, folder: str) -> search.Index:
    return search.bm25_index(table(spark, folder, "documents"), "doc_id", "text")


def bm25_arm(spark: SparkSession, folder: str) -> DataFrame:
    return search.bm25(doc_index(spark, folder), table(spark, folder, "benchmark"), K)


def sparse_arm(spark: SparkSession, folder: str) -> DataFrame:
    return search.sparse_ip(doc_index(spark, folder), table(spark, folder, "benchmark"), K)


def both_arms(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """BM25 and sparse over one index."""
    index, asked = doc_index(spark, folder), table(spark, folder, "benchmark")
    return search.bm25(index, asked, K), search.sparse_ip(index, asked, K)


def merged_arms(spark: SparkSession, folder: str) -> DataFrame:
    return search.merge(*both_arms(spark, folder))


def reranked(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("query_text"))
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text")
    return search.rerank(merged_arms(spark, folder).join(asked, "query").join(texts, "doc"), KEEP)


@query(f"WITH {DOC_TOKENS}, {TERMS} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_terms(spark: SparkSession, folder: str) -> DataFrame:
    return doc_index(spark, folder).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25} SELECT query, doc, score, rank FROM bm25")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return bm25_arm(spark, folder)


@query(f"WITH {DOC_TOKENS}, {SPARSE} SELECT query, doc, score, rank FROM sparse")
def sparse_ip_topk(spark: SparkSession, folder: str) -> DataFrame:
    return sparse_arm(spark, folder)


def _vectors(spark: SparkSession, folder: str, **more) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return search.dense(vectors, vectors.where("vec_id % 100 = 0"), K, **more)


_DENSE = """WITH s AS (SELECT q.vec_id AS query, v.vec_id AS doc, round({}, 6) + 0.0 AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
            SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score {}, doc) AS rank FROM s QUALIFY rank <= 10"""


@query(_DENSE.format("list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])", "DESC"))
def dense_ip_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder)


@query(_DENSE.format("list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) ** 2", "ASC"))
def dense_l2_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder, squared_l2=True)


@query(f"""WITH {BM25}, {SPARSE}, f AS (SELECT query, doc, round(sum(1 / (60 + rank)), 6) AS score FROM (SELECT query, doc, rank FROM bm25 UNION ALL SELECT query, doc, rank FROM sparse) GROUP BY ALL)
    SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f QUALIFY rank <= 10""")
def rrf_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return search.fuse([*both_arms(spark, folder)], K)


_VECTORS = """hd AS (SELECT {0} AS id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS b, count(*) AS c FROM (SELECT {0}, unnest(t) AS token FROM {1}) GROUP BY ALL),
    {2} AS (SELECT id, b, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM hd)"""


@query(f"""WITH {DOC_TOKENS}, {SPARSE}, {_VECTORS.format('doc_id', 'dt', 'dv')}, {_VECTORS.format('item_id', 'qt', 'qv').replace('hd', 'hq')},
    ds AS (SELECT q.id AS query, d.id AS doc, round(sum(q.w * d.w), 6) + 0.0 AS score FROM (SELECT DISTINCT id FROM qv) i JOIN qv q USING (id) JOIN dv d ON d.b = q.b GROUP BY ALL),
    every AS (SELECT q.id AS query, d.id AS doc, coalesce(score, 0) AS score FROM (SELECT DISTINCT id FROM qv) q CROSS JOIN (SELECT DISTINCT id FROM dv) d LEFT JOIN ds ON ds.query = q.id AND ds.doc = d.id),
    dense AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM every QUALIFY rank <= 10),
    f AS (SELECT query, doc, round(sum(1 / (60 + rank)), 6) AS score FROM (SELECT query, doc, rank FROM dense UNION ALL SELECT query, doc, rank FROM sparse) GROUP BY ALL)
    SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_dense_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Dense and sparse arms over the documents, fused; hashed token counts stand in for a model's vectors."""
    index, asked = doc_index(spark, folder), table(spark, folder, "benchmark")
    questions = search.hashed_vectors(asked.select(F.col("item_id").alias("doc"), X.tokens(F.col("text")).alias("tokens")))
    split = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), X.tokens(F.col("text")).alias("tokens"))
    near = search.dense(search.hashed_vectors(split), questions, K, "doc", "vector")
    return search.fuse([near, search.sparse_ip(index, asked, K)], K)

@query(f"WITH {BM25}, {SPARSE}, {MERGED} SELECT query, doc, source, rank FROM merged")
def merge_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return merged_arms(spark, folder)


@query(f"""WITH {BM25}, {SPARSE}, {MERGED}, parents AS (SELECT doc_id AS doc, md5(source) AS parent FROM documents), known AS (SELECT DISTINCT md5(source) AS p FROM documents WHERE lang <> 'de'),
    up AS (SELECT query, p AS doc, min(rank) AS r FROM merged JOIN parents USING (doc) JOIN known ON p = parent GROUP BY ALL)
    SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY r, doc) AS rank FROM up""")
def parent_expand(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as children of their source; sources seen in other languages than de are the parents that exist."""
    docs = table(spark, folder, "documents")
    children = docs.select(F.col("doc_id").cast("string").alias("doc"), F.md5("source").alias("parent"))
    parents = docs.where("lang <> 'de'").select(F.md5("source").alias("parent")).distinct()
    return search.expand_parents(merged_arms(spark, folder).withColumn("doc", F.col("doc").cast("string")), children, parents)


@query(f"WITH {BM25}, {SPARSE}, {MERGED}, {RERANKED} SELECT query, doc, score, rank FROM reranked")
def rerank_topk(spark: SparkSession, folder: str) -> DataFrame:
    return reranked(spark, folder).select("query", "doc", "score", "rank")


@query(f"WITH {BM25}, {SPARSE}, {MERGED}, {RERANKED}, {CONTEXTS} SELECT query, context FROM contexts")
def hybrid_rag_context(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: two arms, merged, reranked, and joined into one numbered context a question."""
    return search.contexts(reranked(spark, folder))


@query(rf"""WITH {BM25}, {SPARSE}, {MERGED}, {RERANKED}, {CONTEXTS}
    SELECT query, unnest(list_filter(list_transform(regexp_split_to_array(context, '【[0-9]+】'), lambda x: regexp_replace(x, '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+\z', '', 'g')), lambda x: x <> '')) AS piece FROM contexts""")
def context_split(spark: SparkSession, folder: str) -> DataFrame:
    return search.contexts(reranked(spark, folder)).select("query", F.explode(X.split_context(F.col("context"))).alias("piece"))


@query(f"""WITH {BM25}, {SPARSE}, {MERGED}, {RERANKED},
    pages AS (SELECT query, rank, doc % 50 AS page, [CASE WHEN doc % 3 = 0 THEN '' ELSE 'title' END] AS titles, 'p' || doc || '.png' AS path FROM reranked),
    ans AS (SELECT item_id AS query, text || '【' || (item_id % 6 + 1) || ',1】' AS response FROM benchmark),
    c AS (SELECT query, response, unnest(cites) AS rank, generate_subscripts(cites, 1) AS k FROM (SELECT query, response, CASE WHEN query % 6 = 0 THEN [1] ELSE [query % 6 + 1, 1] END AS cites FROM ans)),
    j AS (SELECT c.query, page, k, path, titles FROM c JOIN pages p ON p.query = c.query AND p.rank = c.rank),
    g AS (SELECT query, list_sort(list(DISTINCT page)) AS cite_pages, coalesce(list(path ORDER BY k) FILTER (titles[1] <> ''), []) AS related_images FROM j GROUP BY query)
    SELECT ans.query, regexp_replace(b.text, '^\\s+|\\s+$', '', 'g') AS answer, coalesce(cite_pages, []) AS cite_pages, coalesce(related_images, []) AS related_images
    FROM ans JOIN benchmark b ON b.item_id = ans.query LEFT JOIN g ON g.query = ans.query""")
def post_process(spark: SparkSession, folder: str) -> DataFrame:
    """Each question answered by its own text with two citations; documents' pages and images follow from their ids."""
    images = F.array(F.struct(F.concat(F.lit("p"), F.col("doc").cast("string"), F.lit(".png")).alias("path"), F.when(F.col("doc") % 3 == 0, "").otherwise("title").alias("title")))
    ranked = reranked(spark, folder).select("query", "rank", (F.col("doc") % 50).alias("page"), images.alias("images"))
    cite = F.concat(F.col("text"), F.lit("【"), (F.col("item_id") % 6 + 1).cast("string"), F.lit(",1】"))
    answers = table(spark, folder, "benchmark").select(F.col("item_id").alias("query"), cite.alias("response"))
    return search.post_process(answers, ranked)


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """(query, doc): documents that hold an item's text. A word trigram inside the item is its key: texts
    meet it by hash, not each with each, and containment decides; only then are texts fetched."""
    split = lambda c: F.split(F.regexp_replace(c, r"\s+", " "), " ")
    trigrams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(3))))
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("item"), split("text").alias("w"))
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text")
    keyed = items.where("size(w) >= 5").select("query", F.concat_ws(" ", F.slice("w", 2, 3)).alias("key"))
    met = texts.select("doc", F.explode(F.array_distinct(X.once(split("text"), trigrams))).alias("key")).join(keyed, "key").select("query", "doc").distinct()
    found = met.join(items.select("query", "item"), "query").join(texts, "doc").where(F.contains("text", "item")).select("query", "doc")
    short = items.where("size(w) < 5").select("query", "item")
    if not short.limit(1).count():
        return found.distinct()
    # items without a whole trigram inside: the question set in one block against all texts
    return found.unionByName(texts.join(short, F.contains("text", "item")).select("query", "doc")).distinct()


def _ranking(column: str, k: int):
    def plan(spark: SparkSession, folder: str) -> DataFrame:
        return metrics.ranking_metrics(bm25_arm(spark, folder), truth(spark, folder), k).select("query", *column.split(","))

    return plan


_HITS = f"""WITH {BM25}, {TRUTH}, n AS (SELECT query, count(DISTINCT doc) AS n FROM truth GROUP BY query),
    h AS (SELECT query, count(DISTINCT doc) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM bm25 SEMI JOIN truth USING (query, doc) GROUP BY query)"""


@query(f"{_HITS} SELECT query, round(coalesce(hits, 0) / n, 6) AS accuracy FROM n LEFT JOIN h USING (query)")
def topk_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return _ranking("accuracy", K)(spark, folder)


@query(f"{_HITS} SELECT query, round(coalesce(1 / first, 0), 6) AS mrr FROM n LEFT JOIN h USING (query)")
def mrr_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return _ranking("mrr", K)(spark, folder)


@query(f"{_HITS} SELECT query, round(coalesce(hits, 0) / 10, 6) AS precision, round(coalesce(hits, 0) / n, 6) AS recall FROM n LEFT JOIN h USING (query)")
def precision_recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return _ranking("precision,recall", K)(spark, folder)


@query(f"{_HITS} SELECT query, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM n LEFT JOIN h USING (query)")
def ndcg_binary(spark: SparkSession, folder: str) -> DataFrame:
    return _ranking("ndcg", K)(spark, folder)


def graded(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked vectors with a grade: 2 for the query's own label, 1 for its neighbours in number, else 0."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    own = labels.select(F.col("vec_id").alias("query"), F.col("label").alias("own"))
    return dense_ip_topk(spark, folder).join(labels, F.col("doc") == F.col("vec_id")).join(own, "query").select("query", "doc", "rank", F.greatest(F.lit(0), 2 - F.abs(F.col("label") - F.col("own"))).alias("label"))


_GRADED = f"""WITH ranked AS ({_DENSE.format("list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])", "DESC")}),
    g AS (SELECT query, doc, rank, greatest(0, 2 - abs(e.label - o.label)) AS label FROM ranked JOIN embeddings e ON e.vec_id = doc JOIN embeddings o ON o.vec_id = query)"""


@query(f"""{_GRADED}, b AS (SELECT *, CASE WHEN label > 0 THEN 2.0 ** label - 1 ELSE 0 END AS gain, row_number() OVER (PARTITION BY query ORDER BY label DESC, rank) AS best FROM g),
    s AS (SELECT query, sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 5 THEN gain / log2(best + 1) ELSE 0 END) AS ideal FROM b GROUP BY query)
    SELECT query, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg FROM s""")
def ndcg_graded(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.graded_ndcg(graded(spark, folder), 5)


@query(f"""{_GRADED}, s AS (SELECT query, count_if(label > 0 AND rank <= 5) AS hits, count_if(label > 0) AS n, min(rank) FILTER (label > 0) AS first FROM g GROUP BY query)
    SELECT query, round(hits / 5, 6) AS precision, round(coalesce(hits / nullif(n, 0), 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr FROM s""")
def graded_precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.graded_precision_recall(graded(spark, folder), 5)


@query(f"""WITH {BM25}, {SPARSE}, {MERGED}, {RERANKED}, {TRUTH}, p AS (SELECT query, min(rank) FILTER (t.doc IS NOT NULL) AS r FROM reranked LEFT JOIN truth t USING (query, doc) GROUP BY query)
    SELECT round(avg(coalesce((r <= 1)::INT, 0)), 6) AS top1, round(avg(coalesce((r <= 3)::INT, 0)), 6) AS top3, round(avg(coalesce(1 / r, 0)), 6) AS mrr FROM p""")
def top1_top3_recall(spark: SparkSession, folder: str) -> DataFrame:
    true = truth(spark, folder).withColumn("is_truth", F.lit(True))
    ranked = reranked(spark, folder).select("query", "doc", "rank").join(true, ["query", "doc"], "left").withColumn("is_truth", F.coalesce("is_truth", F.lit(False)))
    return metrics.first_item_recall(ranked)


@query(f"""{_GRADED}, b AS (SELECT *, CASE WHEN label > 0 THEN 2.0 ** label - 1 ELSE 0 END AS gain, row_number() OVER (PARTITION BY query ORDER BY label DESC, rank) AS best FROM g),
    s AS (SELECT query, sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 5 THEN gain / log2(best + 1) ELSE 0 END) AS ideal FROM b GROUP BY query)
    SELECT count(*) AS n_queries, round(coalesce(avg(round(coalesce(dcg / nullif(ideal, 0), 0), 6)), 0), 6) AS ndcg FROM s""")
def reranker_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Two levels: a metric for each query, then its mean."""
    return metrics.mean_over_queries(ndcg_graded(spark, folder), ["ndcg"])


@query(f"""WITH {BM25}, {SPARSE}, {MERGED}, {RERANKED}, {CONTEXTS}
    SELECT query, 'Answer from the numbered context only and cite it like 【1】.' || chr(10) || chr(10) || context || chr(10) || chr(10) || text || ' /no_think' AS prompt FROM contexts JOIN benchmark ON item_id = query""")
def chat_prompts(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query"), "text")
    return hybrid_rag_context(spark, folder).join(asked, "query").select("query", conversation.chat_prompt(F.col("text"), F.col("context")).alias("prompt"))
