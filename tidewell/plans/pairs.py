"""Plans that compare texts: each conversation turn as gold beside the next one as prediction; and metric summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import overlap as V
from tidewell.functions import text as X
from tidewell.operators import metrics
from tidewell.plans.base import NEXT_TURNS, RESPONSES, TOKENS, next_turns, query, responses
from tidewell.sources.files import table

_ALL = r"regexp_extract_all({}, '(?s)(\p{{L}}+|\p{{N}}+|.)', 1)"
_PAIRS = f"WITH {NEXT_TURNS}, p AS (SELECT conv_id, turn, gold, predicted, {_ALL.format('gold')} AS g, {_ALL.format('predicted')} AS p, {TOKENS.format('gold')} AS gt, {TOKENS.format('predicted')} AS pt FROM next_turns)"


def _counted(a: str, b: str) -> str:
    """SQL of the multisets' intersection."""
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)"


def _two(a: str) -> str:
    return f"list_transform(range(1, greatest(1, len({a}))), lambda i: {a}[i] || ' ' || {a}[i + 1])"


def _set_f1(a: str, b: str) -> str:
    n = f"len(list_intersect({a}, {b}))"
    p, r = f"coalesce({n} / nullif(len(list_distinct({a})), 0), 0)", f"coalesce({n} / nullif(len(list_distinct({b})), 0), 0)"
    return f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)"


def _scored(spark: SparkSession, folder: str, score: Column, name: str = "score") -> DataFrame:
    return next_turns(spark, folder).select("conv_id", "turn", F.round(score, 6).alias(name))


def _all(name: str) -> Column:
    return X.all_tokens(F.col(name))


def _tok(name: str) -> Column:
    return X.tokens(F.col(name))


@query(f"{_PAIRS} SELECT conv_id, turn, round(CASE WHEN len(g) = 0 THEN 0 ELSE coalesce({_counted('g', 'p')} / nullif(len(p), 0), 0) END, 6)::DOUBLE AS score FROM p")
def unigram_bleu(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder, metrics.unigram_precision(_all("gold"), _all("predicted")))


@query(f"{_PAIRS} SELECT conv_id, turn, round(coalesce({_counted('g', 'p')} / nullif(len(g), 0), 0), 6)::DOUBLE AS score FROM p")
def rouge1_recall(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder, metrics.ngram_recall(_all("gold"), _all("predicted")))


@query(f"{_PAIRS}, b AS (SELECT conv_id, turn, {_two('g')} AS g, {_two('p')} AS p FROM p) SELECT conv_id, turn, round(coalesce({_counted('g', 'p')} / nullif(len(g), 0), 0), 6)::DOUBLE AS score FROM b")
def rouge2_recall(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder, metrics.ngram_recall(_all("gold"), _all("predicted"), 2))


@query(f"{_PAIRS}, b AS (SELECT conv_id, turn, gt, pt, {_two('gt')} AS g2, {_two('pt')} AS p2 FROM p) SELECT conv_id, turn, round({_set_f1('gt', 'pt')}, 6) AS rouge1, round({_set_f1('g2', 'p2')}, 6) AS rouge2 FROM b")
def rouge_f1_set(spark: SparkSession, folder: str) -> DataFrame:
    r1, r2 = (metrics.set_rouge_f1(_tok("gold"), _tok("predicted"), n) for n in (1, 2))
    return next_turns(spark, folder).select("conv_id", "turn", F.round(r1, 6).alias("rouge1"), F.round(r2, 6).alias("rouge2"))


@query()
def rouge_l(spark: SparkSession, folder: str) -> DataFrame:
    """Longest common subsequence of tokens: recall over the gold's, and F1."""
    pairs = next_turns(spark, folder).select("conv_id", "turn", _tok("gold").alias("g"), _tok("predicted").alias("p"))
    n = F.col("lcs")
    recall, precision = V.ratio(n, F.size("g")), V.ratio(n, F.size("p"))
    return metrics.with_lcs(pairs, "g", "p").select("conv_id", "turn", "lcs", F.round(recall, 6).alias("recall"), F.round(V.f1(precision, recall), 6).alias("f1"))


@query()
def bleu4(spark: SparkSession, folder: str) -> DataFrame:
    pairs = next_turns(spark, folder).select("conv_id", "turn", _tok("gold").alias("g"), _tok("predicted").alias("p"))
    return metrics.with_bleu4(pairs, "g", "p").select("conv_id", "turn", F.round("bleu4", 6).alias("bleu4"))


@query(f"{_PAIRS}, b AS (SELECT conv_id, turn, gt, pt, {_two('gt')} AS g2, {_two('pt')} AS p2 FROM p), r AS (SELECT conv_id, turn, coalesce(len(list_intersect(gt, pt)) / nullif(len(list_distinct(gt)), 0), 0) AS a, coalesce(len(list_intersect(g2, p2)) / nullif(len(list_distinct(g2)), 0), 0) AS b FROM b) SELECT conv_id, turn, round(a, 6) AS bleu1, round((a + b) / 2, 6) AS mean FROM r")
def bleu_set(spark: SparkSession, folder: str) -> DataFrame:
    return next_turns(spark, folder).select("conv_id", "turn", F.round(metrics.set_bleu(_tok("gold"), _tok("predicted")), 6).alias("bleu1"), F.round(metrics.mean_set_bleu(_tok("gold"), _tok("predicted")), 6).alias("mean"))


def _chars(c: str) -> str:
    return rf"list_filter(string_split(regexp_replace(lower(regexp_replace({c}, '[{{}}【】]', '', 'g')), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]', '', 'g'), ''), lambda x: x <> '')".replace("{{}}", "{}").replace("{{85}}", "{85}").replace("{{Z}}", "{Z}")


@query(f"WITH {NEXT_TURNS}, c AS (SELECT conv_id, turn, {_chars('gold')} AS g, {_chars('predicted')} AS p FROM next_turns) SELECT conv_id, turn, round({_set_f1('g', 'p')}, 6) AS score FROM c")
def char_f1(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder, metrics.char_f1(F.col("gold"), F.col("predicted")))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(lower(regexp_replace(regexp_replace(text, '【[^\n]*?】', '', 'g'), '[{}【】]', '', 'g')), '[\s]', '', 'g') AS a FROM documents)
    SELECT a.doc_id, b.doc_id AS other, a.a = b.a AS same FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""")
def exact_match(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's normalised text against the next id's."""
    docs = table(spark, folder, "documents").select("doc_id", X.normal_answer(F.col("text")).alias("a"))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("other"), F.col("a").alias("b"))
    return docs.join(nxt, "doc_id").select("doc_id", "other", (F.col("a") == F.col("b")).alias("same"))


_KEYWORDS = "list_filter(gt, lambda x: len(x) >= 6)"


def _keywords() -> Column:
    return F.filter(_tok("gold"), lambda x: F.length(x) >= 6)


@query(f"{_PAIRS}, k AS (SELECT conv_id, turn, predicted, {_KEYWORDS} AS k FROM p) SELECT conv_id, turn, CASE WHEN len(k) > 0 THEN (len(list_filter(k, lambda x: contains(predicted, x))) / (len(k) + 1e-6) > 0.3)::INT::DOUBLE END AS hit FROM k")
def keyword_hit(spark: SparkSession, folder: str) -> DataFrame:
    return next_turns(spark, folder).select("conv_id", "turn", metrics.keyword_hit(_keywords(), F.col("predicted")).alias("hit"))


@query(f"""{_PAIRS}, k AS (SELECT *, {_KEYWORDS} AS k, {_set_f1('gt', 'pt')} AS s FROM p),
    h AS (SELECT conv_id, turn, s, CASE WHEN len(k) > 0 THEN (len(list_filter(k, lambda x: contains(predicted, x))) / (len(k) + 1e-6) > 0.3)::INT END AS kw FROM k)
    SELECT conv_id, turn, round(CASE WHEN kw IS NULL THEN s ELSE 0.2 * kw + 0.8 * s END, 6)::DOUBLE AS score FROM h""")
def semantic_keyword_score(spark: SparkSession, folder: str) -> DataFrame:
    """Token-set F1 stands in for the semantic score of a model."""
    kw = metrics.keyword_hit(_keywords(), F.col("predicted"))
    return _scored(spark, folder, metrics.semantic_keyword(F.col("gold"), F.col("predicted"), V.set_f1(_tok("gold"), _tok("predicted")), kw))


_STRICT = r"regexp_extract({}, '【([0-9]+(?:,[ \t\n]*[0-9]+)*)】', 1)"


@query(f"""WITH {RESPONSES}, i AS (SELECT a.doc_id, {_STRICT.format('a.response')} AS a, {_STRICT.format('b.response')} AS b FROM responses a JOIN responses b ON b.doc_id = a.doc_id + 1),
    l AS (SELECT doc_id, regexp_split_to_array(a, ',[ \\t\\n]*') AS x, regexp_split_to_array(b, ',[ \\t\\n]*') AS y, a = '' OR b = '' AS none FROM i)
    SELECT doc_id, round(CASE WHEN none THEN 0 ELSE len(list_intersect(list_distinct(x), list_distinct(y))) / len(x) END, 6)::DOUBLE AS accuracy FROM l""")
def citation_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Every answer's citations as expected ones against the next id's answer."""
    rows = responses(spark, folder)
    nxt = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("response").alias("other"))
    return rows.join(nxt, "doc_id").select("doc_id", F.round(metrics.citation_accuracy(F.col("response"), F.col("other")), 6).alias("accuracy"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def summary_mean_std(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.mean_std(table(spark, folder, "events"), "value", "event_type")


@query(f"""WITH {RESPONSES}, n AS (SELECT a.response = '无答案' AS g, b.response = '无答案' OR b.doc_id % 2 = 0 AS p FROM responses a JOIN responses b ON a.doc_id = b.doc_id),
    c AS (SELECT count_if(g) AS total, count_if(g AND p) AS correct, count_if(NOT g AND p) AS f, count_if(NOT g) AS a FROM n)
    SELECT total, correct, total - correct AS incorrect, round(coalesce(correct / nullif(total, 0), 0), 6) AS hit_rate, round(coalesce(f / nullif(a, 0), 0), 6) AS false_positive_rate FROM c""")
def no_answer_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of even ids are withheld."""
    rows = responses(spark, folder).withColumn("said", F.when(F.col("doc_id") % 2 == 0, X.NO_ANSWER).otherwise(F.col("response")))
    return metrics.no_answer_stats(rows, F.col("response"), F.col("said"))


@query(f"""{_PAIRS}, s AS (SELECT conv_id, avg({_set_f1('gt', 'pt')}) AS s, avg(coalesce(len(list_intersect(gt, pt)) / nullif(len(list_distinct(gt)), 0), 0)) AS r, avg(coalesce(len(list_intersect(gt, pt)) / nullif(len(list_distinct(pt)), 0), 0)) AS p FROM p GROUP BY conv_id)
    SELECT conv_id, round(CASE WHEN (r + p) / 2 = 0 THEN s ELSE 0.7 * s + 0.3 * (r + p) / 2 END, 6) AS accuracy FROM s""")
def comprehensive_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    g, p = _tok("gold"), _tok("predicted")
    s = next_turns(spark, folder).groupBy("conv_id").agg(F.avg(V.set_f1(g, p)).alias("s"), F.avg(metrics.set_bleu(g, p)).alias("r"), F.avg(metrics.set_bleu(p, g)).alias("p"))
    return s.select("conv_id", F.round(metrics.comprehensive(F.col("s"), F.col("r"), F.col("p")), 6).alias("accuracy"))


@query("""WITH b AS (SELECT source AS metric, avg(n_chars) AS base FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), t AS (SELECT source AS metric, avg(n_chars) AS tuned FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
    SELECT metric, base, tuned, round(tuned - base, 6) AS absolute, round(CASE WHEN base = 0 THEN CASE WHEN tuned > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE 100 * (tuned - base) / base END, 6) AS relative FROM b JOIN t USING (metric)""")
def model_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Mean lengths by source of even ids against those of odd ids."""
    half = lambda k: table(spark, folder, "documents").where(F.col("doc_id") % 2 == k).groupBy(F.col("source").alias("metric")).agg(F.avg("n_chars").alias("value"))
    return metrics.compare(half(0), half(1))


@query(f"{_PAIRS}, s AS (SELECT conv_id, turn, round({_set_f1('gt', 'pt')}, 6) AS score, gold FROM p) SELECT conv_id, turn, score, CASE WHEN len(gold) > 50 THEN left(gold, 50) || '...' ELSE gold END AS gold FROM s WHERE score < 0.85")
def low_score_samples(spark: SparkSession, folder: str) -> DataFrame:
    score = F.round(V.set_f1(_tok("gold"), _tok("predicted")), 6)
    return next_turns(spark, folder).select("conv_id", "turn", score.alias("score"), X.preview(F.col("gold"), 50).alias("gold")).where("score < 0.85")


@query("""SELECT user_id, event_id, round(CASE WHEN count(*) OVER (PARTITION BY user_id) < 10 THEN value ELSE avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END, 6) AS smoothed FROM events""")
def moving_average(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.moving_average(table(spark, folder, "events"), "user_id", "event_id", "value").select("user_id", "event_id", F.round("smoothed", 6).alias("smoothed"))


@query("""SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most, round(sum(coalesce((props->>'$.k')::DOUBLE, 0)), 6) AS k FROM events GROUP BY ALL""")
def resource_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Samples by day and kind; a field that a sample lacks counts as 0."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(0.0))
    return table(spark, folder, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.round(F.sum(k), 6).alias("k"))


@query("""SELECT user_id, event_id, round((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts)) / 1e6, 6) AS seconds FROM events""")
def step_durations(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.step_durations(table(spark, folder, "events").select("user_id", "event_id", "ts"), "user_id", "ts").select("user_id", "event_id", F.round("seconds", 6).alias("seconds"))


@query("""WITH s AS (SELECT event_type, sum(value) AS v FROM events GROUP BY 1)
    SELECT event_type, CASE WHEN v < 60 THEN printf('%.2fs', v) WHEN v < 3600 THEN printf('%.2fm', v / 60) ELSE printf('%.2fh', v / 3600) END AS took FROM s""")
def duration_format(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    return s.select("event_type", X.duration(F.col("v")).alias("took"))


@query("""SELECT doc_id, coalesce(n_chars, 0)::DOUBLE + 0.0 + (doc_id % 9)::DOUBLE AS total_time FROM documents""")
def response_times(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths as retrieval times, nothing for reranking, and a remainder of the id for generation."""
    rows = table(spark, folder, "documents").select("doc_id", F.col("n_chars").cast("double").alias("retrieval"), F.lit(None).cast("double").alias("rerank"), (F.col("doc_id") % 9).cast("double").alias("generation"))
    return metrics.response_times(rows).select("doc_id", "total_time")
