"""Plans that build training data from the documents, the benchmark and the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import curation
from tidewell.plans.base import NEXT_TURNS, RESPONSES, next_turns, query, responses
from tidewell.sources.files import table

_BUCKET = "('0x' || substr(md5({} || {}), 1, 8))::BIGINT % 1000"


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(unique_id, question, answer): a user's turn and the turn that follows it."""
    rows = next_turns(spark, folder)
    return rows.select(F.concat_ws(":", "conv_id", "turn").alias("unique_id"), F.col("gold").alias("question"), F.col("predicted").alias("answer"))


_QA = f"{NEXT_TURNS}, qa AS (SELECT conv_id || ':' || turn AS unique_id, gold AS question, predicted AS answer FROM next_turns)"


@query("SELECT doc_id, source FROM documents WHERE trim(text) <> '' AND NOT contains(text, ' the ') AND NOT contains(text, '###')")
def refusal_filter(spark: SparkSession, folder: str) -> DataFrame:
    return curation.without_refusals(docs(spark, folder), "text", (" the ", "###")).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE len(replace(text, chr(10), '')) >= 1000")
def short_doc_filter(spark: SparkSession, folder: str) -> DataFrame:
    return curation.without_short(docs(spark, folder), "text", 1000).select("doc_id")


@query("SELECT event_id, user_id FROM events WHERE try_cast(props->>'$.k' AS INT) >= 30")
def quality_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The event's number as a score in text form."""
    rows = table(spark, folder, "events").withColumn("score", F.get_json_object("props", "$.k"))
    return curation.of_quality(rows, "score", 30).select("event_id", "user_id")


@query(f"""WITH {_QA}, r AS (SELECT question, list_filter(list_distinct(list(answer)), lambda x: x <> question) AS rewrites FROM qa GROUP BY question),
    e AS (SELECT qa.unique_id, qa.answer, unnest([qa.question] || rewrites) AS question, generate_subscripts([qa.question] || rewrites, 1) > 1 AS is_rewrite FROM qa JOIN r USING (question))
    SELECT unique_id, answer, question, is_rewrite FROM e""")
def question_expand(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that follows the same question counts as a rewrite of it."""
    rows = pairs(spark, folder)
    rewrites = rows.where("answer <> question").groupBy("question").agg(F.collect_set("answer").alias("rewrites"))
    return curation.expand_questions(rows, rewrites)


@query(f"SELECT doc_id, CASE WHEN {_BUCKET.format(chr(39) * 2, 'doc_id')} < 900 THEN 'train' ELSE 'test' END AS split FROM documents")
def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    return curation.hash_split(docs(spark, folder).select("doc_id"), F.col("doc_id"), 0.9)


@query(f"""WITH {_QA}, n AS (SELECT md5(trim(text)) AS unique_id, trim(text) AS question FROM benchmark WHERE trim(text) <> '')
    SELECT unique_id, question, answer, CASE WHEN {_BUCKET.format("''", 'unique_id')} < 900 THEN 'train' ELSE 'test' END AS split FROM qa
    UNION ALL SELECT unique_id, question, '无答案', CASE WHEN {_BUCKET.format("'neg'", 'unique_id')} < 950 THEN 'train' ELSE 'test' END FROM n""")
def negatives_union(spark: SparkSession, folder: str) -> DataFrame:
    rows = curation.hash_split(pairs(spark, folder), F.col("unique_id"), 0.9)
    return curation.add_negatives(rows, table(spark, folder, "benchmark").select(F.col("text").alias("question")))


@query(f"""WITH {_QA}, k AS (SELECT answer, list_filter(regexp_split_to_array(lower(answer), '[^\\p{{L}}\\p{{N}}]+'), lambda x: len(x) > 7) AS keywords FROM (SELECT DISTINCT answer FROM qa WHERE len(answer) % 2 = 0))
    SELECT unique_id, question, qa.answer, coalesce(keywords, []) AS keywords FROM qa LEFT JOIN k USING (answer)""")
def keywords_join(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords are the long tokens of answers; those of odd length have none."""
    rows = pairs(spark, folder)
    words = rows.select("answer").distinct().where(F.length("answer") % 2 == 0).withColumn("keywords", F.filter(X.tokens(F.col("answer")), lambda x: F.length(x) > 7))
    return curation.join_keywords(rows, words)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def checkpoint_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents are done already."""
    return curation.not_done(docs(spark, folder).select("doc_id", "source"), table(spark, folder, "labels"), "doc_id")


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, query, context, merged, response): lines of a document as what a question retrieved; the odd ones are its context."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    rows = docs(spark, folder).select(F.col("doc_id").alias("query_id"), F.concat(F.lit("about "), "source").alias("query"), lines.alias("merged"))
    return rows.select("query_id", "query", F.filter("merged", lambda x, i: i % 2 == 0).alias("context"), "merged").join(responses(spark, folder).withColumnRenamed("doc_id", "query_id"), "query_id")


_TRACES = f"""{RESPONSES}, m AS (SELECT doc_id AS query_id, 'about ' || source AS query, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS merged FROM documents),
    traces AS (SELECT query_id, query, list_filter(merged, lambda x, i: i % 2 = 1) AS context, merged, response FROM m JOIN responses ON doc_id = query_id)"""
_PICK = "CASE WHEN len({0}) > 0 THEN {0}[1 + (('0x' || substr(md5('{1}' || query_id), 1, 8))::BIGINT % 1073741824) % len({0})] END"


@query(f"""WITH {_TRACES}, p AS (SELECT query_id, query, context, CASE WHEN len(context) >= 3 THEN context[greatest(2, len(context) - 1):] ELSE context[2:] END AS last_two, list_filter(merged, lambda x: NOT list_contains(context, x)) AS neg FROM traces),
    r AS (SELECT query_id, query, unnest([context[1], {_PICK.format('last_two', 'mid')}, {_PICK.format('neg', 'neg')}]) AS content, unnest([2, 1, 0]) AS label FROM p)
    SELECT query_id, query, content, label FROM r WHERE len(query) > 0 AND len(content) > 0""")
def rerank_triplets(spark: SparkSession, folder: str) -> DataFrame:
    return curation.rerank_rows(traces(spark, folder))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY source, doc_id) > count(*) OVER () - 100 THEN 'dev' ELSE 'train' END AS split FROM documents")
def dev_tail_split(spark: SparkSession, folder: str) -> DataFrame:
    return curation.tail_split(docs(spark, folder).select("source", "doc_id"), [F.col("source"), F.col("doc_id")], 100).select("doc_id", "split")


@query("SELECT doc_id, source FROM documents ORDER BY md5('42' || doc_id) LIMIT (SELECT greatest(1, floor(count(*) * 0.1))::BIGINT FROM documents)")
def exact_sample(spark: SparkSession, folder: str) -> DataFrame:
    return curation.exact_sample(docs(spark, folder).select("doc_id", "source"), F.col("doc_id"), 0.1)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42' || doc_id)) AS place FROM documents")
def seeded_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    return curation.seeded_order(docs(spark, folder).select("doc_id"), F.col("doc_id"))


@query(f"""WITH {_TRACES}, c AS (SELECT query_id, query, left(list_aggregate(list_transform(context, lambda x, i: i || '.' || x), 'string_agg', chr(10)), 4096) AS context0, response FROM traces)
    SELECT query_id, query, coalesce(context0, '') AS context, 'Answer from the context.' AS instruction, coalesce(context0, '') || chr(10) || query AS input,
    CASE WHEN {_BUCKET.format("'sft'", 'query_id')} < 920 THEN 'train' ELSE 'test' END AS split FROM c""")
def sft_format(spark: SparkSession, folder: str) -> DataFrame:
    return curation.sft_rows(traces(spark, folder), "Answer from the context.").drop("output")


@query()
def sft_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Outputs of the same rows: the stripped answer with its sorted citations, or no answer."""
    return curation.sft_rows(traces(spark, folder), "Answer from the context.").select("query_id", "output", "split")


@query("""WITH l AS (SELECT quality + toxic AS label FROM labels), c AS (SELECT count(*) AS n, count_if(label = 2) AS a, count_if(label = 1) AS b, count_if(label = 0) AS z FROM l)
    SELECT n, a AS n_2, b AS n_1, z AS n_0, round(a / n, 6) AS share_2, round(b / n, 6) AS share_1, round(z / n, 6) AS share_0,
    concat_ws('; ', CASE WHEN a / n < 0.2 THEN 'few positives' END, CASE WHEN z / n > 0.6 THEN 'many negatives' END, CASE WHEN b / n < 0.1 THEN 'few middles' END) AS warnings FROM c""")
def label_balance(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").select((F.col("quality") + F.col("toxic")).alias("label"))
    return curation.label_balance(rows, "label").select("n", "n_2", "n_1", "n_0", "share_2", "share_1", "share_0", "warnings")


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'not an object' WHEN 2 THEN 'text missing or no string' WHEN 3 THEN 'label out of range' END AS error FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL""")
def validate_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Turns written as JSON rows: well, cut off, with a number for a text, and with a label out of range."""
    good = F.to_json(F.struct("role", "text", F.lit(2).alias("label")))
    line = F.when(F.col("turn") % 4 == 0, good).when(F.col("turn") % 4 == 1, F.substring(good, 1, 12)).when(F.col("turn") % 4 == 2, F.to_json(F.struct("role", F.lit(5).alias("text"), F.lit(1).alias("label")))).otherwise(F.to_json(F.struct("role", "text", F.lit(9).alias("label"))))
    rows = table(spark, folder, "conversations").where("text is not null and role is not null").select("conv_id", "turn", line.alias("line"))
    return curation.validate_json(rows, "line", ("role", "text"), (0, 1, 2)).select("conv_id", "turn", "error")


@query(f"""WITH {RESPONSES}, r AS (SELECT source, text, response FROM responses JOIN documents USING (doc_id)),
    c AS (SELECT *, regexp_matches(response, '【[^\\n]*?[0-9][^\\n]*?】') AS cited FROM r)
    SELECT source, count(*) AS n, round(avg(len(text)), 4) AS avg_context, round(avg(len(response)), 4) AS avg_output, min(len(response))::INT AS min_output, max(len(response))::INT AS max_output,
    count_if(cited) AS n_cited, round(avg(cited::INT), 6) AS cited_rate, count_if(response = '无答案') AS n_no_answer, round(avg((response = '无答案')::INT), 6) AS no_answer_rate FROM c GROUP BY source""")
def sft_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = responses(spark, folder).join(docs(spark, folder).select("doc_id", "source", "text"), "doc_id")
    return curation.sft_stats(rows, "text", "response", "source")


@query("""SELECT source, count(*) AS n, count_if(quality + toxic = 2) AS n_2, count_if(quality + toxic = 1) AS n_1, count_if(quality + toxic = 0) AS n_0, count_if(quality IS NULL) AS n_other, round(avg(len(text)), 4) AS avg_length
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    rows = docs(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left").withColumn("label", F.col("quality") + F.col("toxic"))
    return curation.label_distribution(rows, "label", "text", "source")


@query("""WITH r AS (SELECT conv_id AS unique_id, text AS question, CASE WHEN turn % 5 = 4 THEN '无答案' ELSE role END AS answer, CASE WHEN turn % 2 = 0 THEN [role] ELSE [] END AS keywords FROM conversations)
    SELECT count(DISTINCT unique_id) AS n_docs, count(*) AS n_pairs, round(count(*) / count(DISTINCT unique_id), 4) AS pairs_a_doc, count_if(answer = '无答案') AS n_no_answer, count_if(len(keywords) > 0) AS n_with_keywords,
    round(avg(len(question)), 4) AS avg_question, round(avg(len(answer)), 4) AS avg_answer FROM r""")
def dataset_stats(spark: SparkSession, folder: str) -> DataFrame:
    turn = F.col("turn")
    rows = table(spark, folder, "conversations").select(F.col("conv_id").alias("unique_id"), F.col("text").alias("question"), F.when(turn % 5 == 4, X.NO_ANSWER).otherwise(F.col("role")).alias("answer"), F.when(turn % 2 == 0, F.array("role")).otherwise(F.array().cast("array<string>")).alias("keywords"))
    return curation.dataset_stats(rows)
