"""Smaller steps over the documents: mined reranker rows, joined parents, scores and tokens of model texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import curation
from tidewell.plans.base import query
from tidewell.plans.data import _PICK, _TRACES, docs, traces

_IS_TEST = "('0x' || substr(md5('rr' || query_id), 1, 8))::BIGINT % 1000 < 100"
_MINED = f"""{_TRACES}, p AS (SELECT query_id, query, context, merged, query_id % 7 NOT IN (3, 6) AS answered, {_IS_TEST} AS test, CASE WHEN len(context) >= 2 THEN context[len(context) - 1:] ELSE [] END AS last_two,
        list_filter(merged, lambda x: NOT list_contains(context, x)) AS neg FROM traces WHERE len(query) > 0),
    c AS (SELECT *, context[1] AS first, {_PICK.format('last_two', 'mid')} AS middle, CASE WHEN len(context) > 0 THEN {_PICK.format('neg', 'neg')} END AS other, {_PICK.format('merged', 'any')} AS lone FROM p)"""


@query(f"""WITH {_MINED}, r AS (SELECT query_id, query, unnest(CASE WHEN answered THEN [first, middle, other] ELSE [lone] END) AS content, unnest(CASE WHEN answered THEN [2, 1, 0] ELSE [0] END) AS label FROM c WHERE NOT test)
    SELECT query_id, query, content, label FROM r WHERE len(content) > 0""")
def rerank_mined(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows for a reranker, questions without an answer included."""
    return curation.mined(traces(spark, folder))[0]


@query(f"WITH {_MINED} SELECT query_id, query, list_filter([first, middle, other], lambda x: x IS NOT NULL) AS contents FROM c WHERE test AND answered AND first IS NOT NULL")
def rerank_test_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The test's lists of contents, the right one first."""
    return curation.mined(traces(spark, folder))[1]


@query("""WITH d AS (SELECT doc_id, source, doc_id % 50 AS page FROM documents), p AS (SELECT doc_id AS parent, source, page FROM d WHERE doc_id % 7 = 0)
    SELECT d.doc_id, p.parent FROM d JOIN p USING (source, page) WHERE d.doc_id % 2 = 1""")
def parents_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned documents with the parents of their source and page, row by row."""
    rows = docs(spark, folder).select("doc_id", "source", (F.col("doc_id") % 50).alias("page"))
    parents = rows.where("doc_id % 7 = 0").select(F.col("doc_id").alias("parent"), "source", "page")
    return rows.where("doc_id % 2 = 1").join(parents, ["source", "page"]).select("doc_id", "parent")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 1 OR text IS NULL THEN NULL ELSE (doc_id % 6)::INT END AS score FROM documents""")
def quality_scores_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Scores in model answers around the documents' texts: in a fence, bare, missing, or in prose."""
    n = (F.col("doc_id") % 6).cast("string")
    head = F.regexp_replace(F.substring("text", 1, 40), r"[{}]", "")
    object_ = F.concat(F.lit('{"score": '), n, F.lit(', "why": "x"}'))
    said = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("```json\n"), object_, F.lit("\n```\n"), head)).when(F.col("doc_id") % 4 == 1, head).when(F.col("doc_id") % 4 == 2, F.when(F.col("text").isNotNull(), object_)).otherwise(F.concat(head, F.lit(" so "), object_, F.lit(".")))
    return docs(spark, folder).select("doc_id", X.quality_score(said).alias("score"))


@query(r"SELECT doc_id, regexp_replace(text || '。，、；：！？', '[。，、；：！？ \t\n\x0B\f\r]', '', 'g') AS bare FROM documents")
def punctuation_removed(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", X.normal_punctuation(F.concat("text", F.lit("。，、；：！？"))).alias("bare"))


@query(r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN left(text, 10) || '打开车窗的方法座椅加热' ELSE text END AS x FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND 11.0 / len(x) > 0.3 THEN list_filter(string_split(regexp_replace(x, '[ \t\n\x0B\f\r]', '', 'g'), ''), lambda c: c <> '')
        ELSE list_filter(regexp_split_to_array(lower(x), '[ \t\n\x0B\f\r]+'), lambda c: c <> '') END AS tokens FROM t""")
def switched_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Characters where a text is Chinese for more than three parts in ten, words elsewhere."""
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.substring("text", 1, 10), F.lit("打开车窗的方法座椅加热"))).otherwise(F.col("text"))
    return docs(spark, folder).select("doc_id", X.switched_tokens(text).alias("tokens"))
