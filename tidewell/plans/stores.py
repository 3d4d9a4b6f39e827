"""Plans over stores: indexes and stage tables that are found again, vector rows, zips, samples, fallbacks, model maps and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import overlap as V
from tidewell.functions import text as X
from tidewell.operators import curation, generate, search
from tidewell.plans.base import DOC_TOKENS, NEXT_TURNS, TERMS, next_turns, query
from tidewell.plans.data import docs, pairs
from tidewell.plans.pairs import _PAIRS, _set_f1
from tidewell.plans.retrieval import _DENSE, dense_ip_topk
from tidewell.sources import files


@query(f"WITH {DOC_TOKENS}, {TERMS} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_index_reopened(spark: SparkSession, folder: str) -> DataFrame:
    """The index is built at a path where none is, then found there."""
    path = files.shared_path(spark, "index")
    for _ in range(2):
        index = search.open_index(spark, path, docs(spark, folder), "doc_id", "text")
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {DOC_TOKENS} SELECT tf.doc_id AS doc, term, round(tf / len(t), 9) AS weight FROM tf JOIN dt USING (doc_id)")
def sparse_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return search.sparse_vectors(docs(spark, folder), "doc_id", "text", "doc").select("doc", "term", F.round("weight", 9).alias("weight"))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR ELSE 'd' || doc_id END AS id, left(text, 512) AS text FROM documents")
def vector_insert_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth document has no id of its own."""
    rows = docs(spark, folder).select("doc_id", "text", F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("key"))
    return curation.vector_rows(rows, "key", "text", [F.col("doc_id")])


@query("SELECT doc_id, source, lang FROM documents WHERE n_chars > 500")
def stage_reload(spark: SparkSession, folder: str) -> DataFrame:
    """A stage table is built once and found by the second call."""
    path = files.shared_path(spark, "stage")
    for _ in range(2):
        rows = files.stage(spark, path, lambda: docs(spark, folder).where("n_chars > 500").select("doc_id", "source", "lang"))
    return rows


@query("SELECT doc_id::VARCHAR AS unique_id, text FROM documents WHERE doc_id IS NOT NULL")
def json_lines_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = files.shared_path(spark, "lines")
    docs(spark, folder).select(F.col("doc_id").cast("string").alias("unique_id"), "text").write.json(path)
    schema = T.StructType([T.StructField("unique_id", T.StringType()), T.StructField("text", T.StringType())])
    return files.read_json_lines(spark, path, schema, "unique_id")


@query("""WITH d AS (SELECT doc_id, source, doc_id % 50 AS page FROM documents), p AS (SELECT source, page, count(*) AS n FROM d WHERE doc_id % 2 = 0 GROUP BY ALL)
    SELECT doc_id, coalesce(n, 0) AS n_parents FROM d LEFT JOIN p USING (source, page)""")
def parents_by_page(spark: SparkSession, folder: str) -> DataFrame:
    """Documents against parents of the same source and page; parents are counted by key first, so that a page with many is one row."""
    rows = docs(spark, folder).select("doc_id", "source", (F.col("doc_id") % 50).alias("page"))
    parents = rows.where("doc_id % 2 = 0").groupBy("source", "page").agg(F.count("*").alias("n"))
    return rows.join(parents, ["source", "page"], "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_parents"))


@query("""SELECT place, doc_id, page_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM documents) JOIN (SELECT page_id, row_number() OVER (ORDER BY page_id) AS place FROM pages) USING (place)""")
def positional_zip(spark: SparkSession, folder: str) -> DataFrame:
    return curation.zipped(docs(spark, folder).select("doc_id"), [F.col("doc_id")], files.table(spark, folder, "pages").select("page_id"), [F.col("page_id")])


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1)
    SELECT count(*) AS n_keys, coalesce(sum(n - 1), 0)::BIGINT AS n_repeated, (SELECT count(*) FROM conversations WHERE conv_id IS NULL) AS n_missing FROM c""")
def duplicate_accounting(spark: SparkSession, folder: str) -> DataFrame:
    return curation.duplicate_accounting(files.table(spark, folder, "conversations"), "conv_id")


@query("SELECT doc_id, source FROM documents ORDER BY md5('42' || doc_id) LIMIT 100")
def fixed_sample(spark: SparkSession, folder: str) -> DataFrame:
    return curation.fixed_sample(docs(spark, folder).select("doc_id", "source"), F.col("doc_id"), 100)


@query("SELECT 'checkpoint-' || doc_id AS name, row_number() OVER (ORDER BY doc_id) AS place, doc_id = (SELECT max(doc_id) FROM documents) AS best FROM documents")
def checkpoint_order(spark: SparkSession, folder: str) -> DataFrame:
    """Names by their numeric suffix; the last is the best."""
    names = docs(spark, folder).select(F.concat(F.lit("checkpoint-"), F.col("doc_id").cast("string")).alias("name"))
    suffix = F.regexp_extract("name", r"([0-9]+)$", 1).cast("long")
    return curation.numbered(names, [suffix], "place").select("name", "place", (F.col("place") == names.count()).alias("best"))


@query(f"""WITH r AS ({_DENSE.format("list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])", "DESC")}),
    s AS (SELECT query, doc, rank AS before, CASE WHEN query % 300 = 0 OR doc % 4 = 0 THEN 0 ELSE (doc % 7) / 7 END AS score FROM r)
    SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, before) AS rank FROM s QUALIFY rank <= 5""")
def rerank_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Remote scores by the document's id, missing for every fourth; calls for every third query fail."""
    rows = dense_ip_topk(spark, folder).drop("score").withColumn("s", F.when(F.col("doc") % 4 != 0, F.col("doc") % 7 / 7)).withColumn("failed", F.col("query") % 300 == 0)
    return search.rerank_or_keep(rows, 5, "s", "failed").withColumn("score", F.round("score", 6))


@query("""SELECT source, sum(len(text) // 3)::BIGINT AS tokens, round(sum(len(text) // 3) / sum(doc_id % 9 + 1), 6) AS tokens_a_second FROM documents GROUP BY source""")
def throughput_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """A third of a token a character; a remainder of the id as seconds."""
    tokens = F.sum(F.floor(F.length("text") / 3))
    return docs(spark, folder).groupBy("source").agg(tokens.cast("long").alias("tokens"), F.round(tokens / F.sum(F.col("doc_id") % 9 + 1), 6).alias("tokens_a_second"))


@query(f"""{_PAIRS} SELECT count(*) AS n, round(avg((gold = predicted)::INT), 6) AS exact, round(avg({_set_f1('gt', 'pt')}), 6) AS f1, round(avg(len(predicted)), 4) AS avg_length FROM p""")
def comparison_summary(spark: SparkSession, folder: str) -> DataFrame:
    f1 = V.set_f1(X.tokens(F.col("gold")), X.tokens(F.col("predicted")))
    exact = (F.col("gold") == F.col("predicted")).cast("int")
    return next_turns(spark, folder).agg(F.count("*").alias("n"), F.round(F.avg(exact), 6).alias("exact"), F.round(F.avg(f1), 6).alias("f1"), F.round(F.avg(F.length("predicted")), 4).alias("avg_length"))


#: What the stand-in model answers: the first sentence.
_FIRST = "left(string_split(replace({0}, chr(10), ' '), '. ')[1], 200)"
_STRIP = r"regexp_replace({0}, '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g')"


@query(f"SELECT doc_id, {_FIRST.format('text')} AS text FROM documents WHERE {_STRIP.format('text')} <> ''")
def model_clean(spark: SparkSession, folder: str) -> DataFrame:
    return generate.clean(docs(spark, folder).select("doc_id", "text"), "text", generate.Extract())


@query(f"""WITH {NEXT_TURNS}, q AS (SELECT DISTINCT gold AS question FROM next_turns),
    r AS (SELECT question, {_STRIP.format("regexp_replace(" + _STRIP.format(_FIRST.format("question")) + r", '^[0-9]+[.)\s]+\s*', '')")} AS r FROM q)
    SELECT question, CASE WHEN {_STRIP.format('question')} <> '' AND r <> '' THEN [r] ELSE [] END AS rewrites FROM r""")
def model_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    return generate.rewrite(pairs(spark, folder), generate.Extract())


@query(f"""WITH {NEXT_TURNS}, q AS (SELECT DISTINCT predicted AS answer FROM next_turns)
    SELECT answer, CASE WHEN {_STRIP.format('answer')} = '' THEN [] ELSE list_filter(list_transform(string_split({_FIRST.format('answer')}, ','), lambda x: {_STRIP.format('x')}), lambda x: x NOT IN ('', '无', 'Model 3')) END AS keywords FROM q""")
def model_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return generate.keywords(pairs(spark, folder), generate.Extract())
