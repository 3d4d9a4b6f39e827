"""Plans over whole runs: traces, predictions, evaluated samples, two models, results that are written and read, counted indexes, files of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import evaluate, generate, postings, search
from tidewell.plans.base import BM25, CONTEXTS, MERGED, RERANKED, SPARSE, query
from tidewell.plans.retrieval import K, KEEP, both_arms, doc_index
from tidewell.plans.texts import _SPACE, _STRIP
from tidewell.sources import files
from tidewell.sources.results import Results, summary
from tidewell.sources.files import cut, shared_path, table


class Silent:
    """A stand-in model that has no answer to prompts of odd length."""

    def __call__(self, prompt: str) -> str | None:
        return None if len(prompt) % 2 else prompt[:100]


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question"))


def _candidates(spark: SparkSession, folder: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Merged and reranked documents of each question, with texts; k of either arm."""
    index, asked = doc_index(spark, folder), table(spark, folder, "benchmark")
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text")
    merged = cut(search.merge(search.bm25(index, asked, k), search.sparse_ip(index, asked, k)).join(texts, "doc"))
    questions = _questions(spark, folder).withColumnRenamed("question", "query_text")
    return merged, cut(search.rerank(merged.join(questions, "query"), KEEP))


_ANSWER = "substr(split_part(replace(context || chr(10) || chr(10) || question, chr(10), ' '), '. ', 1), 1, 200)"
_CLEAN = f"""raws AS (SELECT b.item_id AS query, b.text AS question, {_ANSWER.replace('question', 'b.text')} AS raw FROM benchmark b JOIN contexts c ON c.query = b.item_id),
    clean0 AS (SELECT query, question, raw, regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g') AS x FROM raws WHERE raw <> ''),
    clean1 AS (SELECT query, question, raw, regexp_replace(regexp_replace(regexp_replace(x, '(?m)^答案内容[：:]{_SPACE}*', '', 'g'), '\\{{答案\\}}', '', 'g'), '\\{{从[^}}]*\\}}', '', 'g') AS x FROM clean0),
    clean2 AS (SELECT query, question, raw, {_STRIP.format(f"regexp_replace(x, '{chr(92)}n{_SPACE}*{chr(92)}n', chr(10), 'g')")} AS x FROM clean1),
    answered AS (SELECT query, question, CASE WHEN regexp_matches(x, '^[{_SPACE[1:-1]}【】0-9,，]*\\z') THEN '无答案' ELSE x END AS response FROM clean2)"""


def _trace(spark: SparkSession, folder: str, k: int = K) -> DataFrame:
    merged, ranked = _candidates(spark, folder, k)
    return evaluate.trace(_questions(spark, folder), merged, ranked, generate.FirstSentence())


@query(f"""WITH {BM25}, {SPARSE}, {MERGED}, {RERANKED}, {CONTEXTS}, {_CLEAN},
    c AS (SELECT query, list(text ORDER BY rank) AS context FROM reranked GROUP BY query),
    m AS (SELECT query, list(d.text ORDER BY rank) AS merged_docs FROM merged JOIN documents d ON d.doc_id = doc GROUP BY query)
    SELECT query, question, context, response, merged_docs FROM answered JOIN c USING (query) JOIN m USING (query)""")
def rag_trace(spark: SparkSession, folder: str) -> DataFrame:
    """What training data are made from: each question with its context, the stand-in's answer, and all candidates."""
    return _trace(spark, folder)


_GOLD = "gold AS (SELECT item_id AS query, substr(text, 1, 80) AS gold FROM benchmark)"
_STRIPPED = _STRIP.format("regexp_replace(regexp_replace(response, '【[^\\n]*?】', '', 'g'), '[{{}}【】]', '', 'g')").replace("{{}}", "{}")


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    return _questions(spark, folder).select("query", F.substring("question", 1, 80).alias("gold"))


@query(f"""WITH {BM25}, {SPARSE}, {MERGED}, {RERANKED}, {CONTEXTS}, {_CLEAN}, {_GOLD}
    SELECT g.query, a.question, g.gold, {_STRIPPED} AS answer,
           list_distinct(list_transform(regexp_extract_all(response, '【([0-9]+)】', 1), x -> x::INT)) AS cites FROM gold g JOIN answered a USING (query)""".replace("x -> x::INT", "lambda x: x::INT"))
def test_prediction(spark: SparkSession, folder: str) -> DataFrame:
    """A test set's first characters beside the answers that the flagship's contexts give."""
    return evaluate.predictions(_trace(spark, folder), _gold(spark, folder))


_TOKENS = r"regexp_extract_all({}, '(?s)(\p{{L}}+|\p{{N}}+|.)', 1)"
_COUNTED = "list_sum(list_transform(list_distinct({0}), lambda x: least(len(list_filter({0}, lambda y: y = x)), len(list_filter({1}, lambda y: y = x)))))"
_TWO = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
_METRICS = f"""toks AS (SELECT *, {_TOKENS.format('gold')} AS g, {_TOKENS.format('answer')} AS p FROM pred),
    twos AS (SELECT *, {_TWO.format('g')} AS g2, {_TWO.format('p')} AS p2 FROM toks)"""


def _wide(sql: str) -> str:
    """The flagship's SQL with twice as many documents of either arm."""
    return sql.replace("QUALIFY rank <= 10", "QUALIFY rank <= 20")


_SCORES = f"""round(CASE WHEN len(g) = 0 OR len(p) = 0 THEN 0 ELSE coalesce({_COUNTED.format('g', 'p')}, 0) / len(p) END, 6)::DOUBLE AS bleu1,
    round(coalesce({_COUNTED.format('g', 'p')} / nullif(len(g), 0), 0), 6)::DOUBLE AS rouge1, round(coalesce({_COUNTED.format('g2', 'p2')} / nullif(len(g2), 0), 0), 6)::DOUBLE AS rouge2"""


@query(_wide(f"""WITH {BM25}, {SPARSE}, {MERGED}, {RERANKED}, {CONTEXTS}, {_CLEAN}, {_GOLD},
    pred AS (SELECT g.query, g.gold, {_STRIPPED} AS answer FROM gold g JOIN answered a USING (query)), {_METRICS}
    SELECT query, answer, {_SCORES} FROM twos"""))
def rag_sample_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Each sample through the whole chain, with twice as many documents of either arm, and its scores."""
    rows = evaluate.predictions(_trace(spark, folder, 2 * K), _gold(spark, folder))
    return evaluate.sample_metrics(rows).select("query", "answer", "bleu1", "rouge1", "rouge2")


@query(f"""WITH {BM25}, {SPARSE},
    top5 AS (SELECT s.query, s.rank, d.text FROM sparse s JOIN documents d ON d.doc_id = s.doc WHERE s.rank <= 5),
    contexts AS (SELECT query, string_agg('【' || rank || '】' || text, chr(10) ORDER BY rank) AS context FROM top5 GROUP BY query),
    {_GOLD}, pred AS (SELECT g.query, g.gold, {_ANSWER.replace('question', 'b.text')} AS answer FROM gold g JOIN contexts c USING (query) JOIN benchmark b ON b.item_id = g.query), {_METRICS}
    SELECT query, answer, {_SCORES} FROM twos""")
def baseline_sample_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline: one vector arm, no reranking, and the response as it is."""
    index, asked = doc_index(spark, folder), table(spark, folder, "benchmark")
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text")
    near = search.contexts(search.sparse_ip(index, asked, KEEP).join(texts, "doc"))
    rows = near.join(_questions(spark, folder), "query").join(_gold(spark, folder), "query")
    prompt = X.fill_template(evaluate.PROMPT, context=F.col("context"), query=F.col("question"))
    answered = generate.ask_each(rows.withColumn("prompt", prompt), "prompt", generate.FirstSentence(), "answer")
    return evaluate.sample_metrics(answered.where("answer <> ''").select("query", "gold", "answer")).select("query", "answer", "bleu1", "rouge1", "rouge2")


@query()
def two_model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Two stand-ins asked the same prompts: each turn's text, with the next turn as the right answer."""
    from tidewell.plans.base import next_turns

    rows = next_turns(spark, folder).select(F.col("gold").alias("prompt"), F.col("predicted").alias("gold"))
    return evaluate.two_models(rows, "prompt", generate.FirstSentence(), Silent())


# --- results, counts, lists ---


def _written(spark: SparkSession, folder: str, parts: int) -> str:
    """events in so many writes of the results format; a write that is cut short before leaves nothing."""
    spark.dataSource.register(Results)
    path = shared_path(spark, "results").removeprefix("file://")
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    for k in range(parts):
        rows.where(F.col("event_id") % parts == k).write.format("results").mode("append").save(path)
    return path


@query("SELECT event_id, user_id, event_type, value FROM events")
def results_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("results").load(_written(spark, folder, 2))


@query("SELECT count(*)::BIGINT AS n, round(avg(value), 6) AS mean_value, round(avg(user_id), 6)::DOUBLE AS mean_user FROM events")
def results_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What _summary.json says after two writes."""
    found = summary(_written(spark, folder, 2))
    return spark.range(1).select(F.lit(found["rows"]).cast("long").alias("n"), F.round(F.lit(found["means"]["value"]), 6).alias("mean_value"), F.round(F.lit(found["means"]["user_id"]), 6).alias("mean_user"))


@query("SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY event_type")
def results_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The results as a stream, appended to a table and rolled up."""
    path, out, state = _written(spark, folder, 3), shared_path(spark, "out"), shared_path(spark, "state")
    stream = spark.readStream.format("results").schema("event_id long, user_id long, event_type string, value double").load(path)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(once=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("""SELECT count(*)::BIGINT AS documents, count(*)::BIGINT AS indexed, sum(len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')))::BIGINT AS tokens FROM documents""")
def index_verified(spark: SparkSession, folder: str) -> DataFrame:
    """An index whose build counts the documents it reads as it runs, and fails if its blocks hold others."""
    own = search.lower_words(table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), "text"), "text")
    rows, seen = evaluate.counted(own.select("doc", "tokens"), "indexed", tokens=F.sum(F.size("tokens")))
    path = shared_path(spark, "counted")
    postings.build(rows, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    held = blocks.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0))).first()[0]
    evaluate.require(seen, n=held)
    got = seen.get
    return spark.range(1).select(F.lit(got["n"]).cast("long").alias("documents"), F.lit(held).cast("long").alias("indexed"), F.lit(got["tokens"]).cast("long").alias("tokens"))


@query(r"""WITH stop AS (SELECT term FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY term ORDER BY count(*) DESC, term LIMIT 25)
    SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> '' AND NOT list_contains(words, x)))::INT AS n_tokens
    FROM documents, (SELECT list(term) AS words FROM stop)""")
def stopword_file_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A word list in a file: the 25 most frequent words, written, read and left out of the texts."""
    docs = table(spark, folder, "documents")
    path = shared_path(spark, "stopwords")
    counted = docs.select(F.explode(X.tokens_kept_case(F.col("text"))).alias("term")).groupBy("term").count()
    counted.orderBy(F.desc("count"), "term").limit(25).select("term").coalesce(1).write.text(path)
    words = tuple(sorted(r.value for r in files.read_list(spark, path).collect()))  # a list of 25
    return docs.select("doc_id", F.size(X.tokens_kept_case(F.col("text"), words)).alias("n_tokens"))


@query("SELECT doc_id, lang FROM documents WHERE n_chars > 1000")
def stage_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """A stage table that is built, and built anew from other rows when asked to."""
    path, docs = shared_path(spark, "stage"), table(spark, folder, "documents")
    files.stage(spark, path, lambda: docs.where("n_chars <= 1000").select("doc_id", "lang"))
    return files.stage(spark, path, lambda: docs.where("n_chars > 1000").select("doc_id", "lang"), rebuild=True)


@query("SELECT doc_id, lang, coalesce(n_chars, 0)::BIGINT AS n_chars FROM documents")
def json_array_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as one JSON array a source's file, read back."""
    path = shared_path(spark, "arrays")
    rows = table(spark, folder, "documents").select("doc_id", "lang", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    files.write_json_arrays(rows, path)
    return files.read_json_array(spark, path, rows.schema)
