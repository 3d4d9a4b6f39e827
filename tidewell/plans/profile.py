"""Profile plans over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import chunks, profile
from tidewell.plans.base import TOKENS, query
from tidewell.sources.files import table

_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, pos, piece): the non-blank lines of all documents, as children of their document."""
    return chunks.explode_pieces(docs(spark, folder), "doc_id", X.paragraphs(F.col("text"), "\n")).where("piece <> ''")


_LINES = "lines AS (SELECT doc_id, piece FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece FROM documents) WHERE piece <> '')"


@query(f"SELECT doc_id, len(text)::BIGINT AS chars, len({_WORDS.format('text')})::BIGINT AS words, len({TOKENS.format('text')})::BIGINT AS tokens, (len(text) - len(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents")
def text_stats(spark: SparkSession, folder: str) -> DataFrame:
    return profile.text_stats(docs(spark, folder), "doc_id", "text")


@query(f"""WITH s AS (SELECT len(text) AS chars, len({_WORDS.format('text')}) AS words, len({TOKENS.format('text')}) AS tokens, source FROM documents)
    SELECT count(*) AS n_docs, round(avg(chars), 2) AS avg_chars, round(avg(words), 2) AS avg_words, round(avg(tokens), 2) AS avg_tokens, min(chars)::BIGINT AS min_chars, max(chars)::BIGINT AS max_chars, count(DISTINCT source) AS n_groups FROM s""")
def corpus_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile.corpus_profile(docs(spark, folder), "text", "source")


def _histogram_sql(value: str, names: list[str], tests: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS bucket, count_if({t.replace('v', value)}) AS n FROM documents" for n, t in zip(names, tests, strict=True))


@query(_histogram_sql("len(text)", ["<100", "<256", "<512", "<1024", ">=1024"], ["v < 100", "v >= 100 AND v < 256", "v >= 256 AND v < 512", "v >= 512 AND v < 1024", "v >= 1024"]))
def char_histogram_halfopen(spark: SparkSession, folder: str) -> DataFrame:
    return profile.histogram(docs(spark, folder), F.length("text"), profile.CHAR_EDGES)


@query(_histogram_sql("len(text)", ["<=100", "<=256", "<=512", "<=1024", ">1024"], ["v <= 100", "v > 100 AND v <= 256", "v > 256 AND v <= 512", "v > 512 AND v <= 1024", "v > 1024"]))
def char_histogram_closed(spark: SparkSession, folder: str) -> DataFrame:
    return profile.histogram(docs(spark, folder), F.length("text"), profile.CLOSED_EDGES, closed=True)


@query("WITH t AS (SELECT len(" + TOKENS.format("text") + ") AS x FROM documents) " + " UNION ALL ".join(f"SELECT '{n}' AS bucket, count_if({t}) AS n FROM t" for n, t in (("<50", "x < 50"), ("<100", "x >= 50 AND x < 100"), ("<200", "x >= 100 AND x < 200"), ("<500", "x >= 200 AND x < 500"), (">=500", "x >= 500"))))
def token_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return profile.histogram(docs(spark, folder).select(F.size(X.tokens(F.col("text"))).alias("t")), F.col("t"), profile.TOKEN_EDGES)


@query("SELECT md5(text) AS content_id, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING n > 1")
def duplicate_content(spark: SparkSession, folder: str) -> DataFrame:
    return profile.duplicate_content(docs(spark, folder), "doc_id", "text")


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING n > 1")
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    return profile.duplicate_ids(table(spark, folder, "conversations"), "conv_id")


@query("SELECT source, list_sort(list(n_chars))[(count(*) // 2 + 1)::BIGINT] AS median FROM documents GROUP BY source")
def upper_median_length(spark: SparkSession, folder: str) -> DataFrame:
    return profile.upper_median(docs(spark, folder), "source", "n_chars")


@query(f"""WITH {_LINES}, s AS (SELECT 0 AS k, 'documents' AS stage, count(*) AS n, avg(len(text)) AS a FROM documents UNION ALL SELECT 1, 'lines', count(*), avg(len(piece)) FROM lines)
    SELECT s.stage, s.n, round(s.a, 4) AS avg_chars, round(s.n / f.n, 4) AS expansion, round((f.a - s.a) * 100 / f.a, 4) AS reduction FROM s, (SELECT * FROM s WHERE k = 0) f""")
def stage_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return profile.stage_comparison({"documents": docs(spark, folder).select("text"), "lines": lines(spark, folder).select(F.col("piece").alias("text"))}, "text")


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, count(*) AS c FROM lines GROUP BY 1)
    SELECT count(*) AS n_parents, coalesce(sum(c), 0)::BIGINT AS n_children, round(avg(c), 2) AS avg_children, min(c) AS min_children, max(c) AS max_children FROM p""")
def parent_child_fanout(spark: SparkSession, folder: str) -> DataFrame:
    return profile.fan_out(lines(spark, folder), "doc_id")


@query("SELECT o_custkey AS custkey, o_orderkey AS orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def orphan_children(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as children of customers of the first twelve nations."""
    parents = table(spark, folder, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("custkey"))
    return profile.orphans(table(spark, folder, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey")), parents, "custkey")


@query("SELECT count_if(len(text) > 512) AS over_512, count_if(len(text) > 1024) AS over_1024, count_if(len(text) > 2048) AS over_2048, count(*) AS n_docs FROM documents")
def length_violations(spark: SparkSession, folder: str) -> DataFrame:
    return profile.length_violations(docs(spark, folder), "text")


@query("SELECT page_id AS page, md5(html) AS unique_id FROM pages WHERE page_id BETWEEN 4 AND 247")
def page_range(spark: SparkSession, folder: str) -> DataFrame:
    """The page range is a filter that reaches the scan."""
    return table(spark, folder, "pages").where("page_id between 4 and 247").select(F.col("page_id").alias("page"), X.content_id(F.col("html")).alias("unique_id"))
