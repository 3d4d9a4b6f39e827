"""Answers through retrieval, kept as traces, predictions and evaluated samples, and two models side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import generate, metrics

#: What a model is asked: the numbered context, then the question.
PROMPT = "{{context}}\n\n{{query}}"


def ordered_texts(ranked: DataFrame, name: str, text: str = "text") -> DataFrame:
    """(query, name): each query's texts as one array by rank; as long as the ranked lists are, some tens."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t"))))
    return ranked.groupBy("query").agg(F.transform(rows, lambda x: x["t"]).alias(name))


def trace(questions: DataFrame, merged: DataFrame, ranked: DataFrame, client: Callable[[str], str | None], done: DataFrame | None = None, **options) -> DataFrame:
    """(query, question, context, response, merged_docs) of each question (query, question) that isn't blank and not in done (question).

    merged and ranked (query, text, rank) are the candidates before and after reranking. The response is cleaned; a question whose call failed
    has no row, so that a later run asks it again.
    """
    asked = questions.where(~X.is_blank(F.col("question")))
    if done is not None:
        asked = asked.join(done.select("question").distinct(), "question", "left_anti")
    rows = asked.join(ordered_texts(ranked, "context"), "query", "left").join(ordered_texts(merged, "merged_docs"), "query", "left")
    none = F.array().cast("array<string>")
    rows = rows.select("query", "question", F.coalesce("context", none).alias("context"), F.coalesce("merged_docs", none).alias("merged_docs"))
    prompt = X.fill_template(PROMPT, context=X.numbered_context(F.col("context")), query=F.col("question"))
    answered = generate.ask_each(rows.withColumn("prompt", prompt), "prompt", client, "raw", **options).where("raw <> ''")
    return answered.select("query", "question", "context", X.clean_response(F.col("raw")).alias("response"), "merged_docs")


def predictions(traces: DataFrame, gold: DataFrame) -> DataFrame:
    """(query, question, gold, answer, cites): a test set's (query, gold) beside what was answered, citations apart; unanswered ones have no answer."""
    own = traces.select("query", "question", X.strip_citations(F.col("response")).alias("answer"), X.citations(F.col("response")).alias("cites"))
    kept = gold.select("query", "gold").join(own, "query", "left")
    return kept.select("query", "question", "gold", F.coalesce("answer", F.lit(X.NO_ANSWER)).alias("answer"), F.coalesce("cites", F.array().cast("array<int>")).alias("cites"))


def sample_metrics(rows: DataFrame, gold: str = "gold", answer: str = "answer", keywords: str | None = None, semantic: str | None = None) -> DataFrame:
    """rows with the scores of each sample: bleu1, rouge1, rouge2 (as recalls over multisets, case kept), semantic_keyword, and exact (0 or 1).

    semantic is a model's score column; without one the overlap of characters stands in.
    """
    g, p = X.all_tokens(F.col(gold)), X.all_tokens(F.col(answer))
    likeness = F.col(semantic) if semantic else metrics.char_f1(F.col(gold), F.col(answer))
    hit = metrics.keyword_hit(F.col(keywords), F.col(answer)) if keywords else F.lit(None).cast("double")
    return rows.select(
        "*",
        F.round(metrics.unigram_precision(g, p), 6).alias("bleu1"),
        F.round(metrics.ngram_recall(g, p), 6).alias("rouge1"),
        F.round(metrics.ngram_recall(g, p, 2), 6).alias("rouge2"),
        F.round(metrics.semantic_keyword(F.col(gold), F.col(answer), likeness, hit), 6).alias("semantic_keyword"),
        (X.normal_answer(F.col(gold)) == X.normal_answer(F.col(answer))).cast("int").alias("exact"),
    )


def without_errors(rows: DataFrame, error: str = "error") -> DataFrame:
    """Samples whose evaluation failed go."""
    return rows.where(F.col(error).isNull()) if error in rows.columns else rows


def model_summary(rows: DataFrame, model: str, gold: str = "gold", answer: str = "answer") -> DataFrame:
    """One row a model: samples, exact, f1 (characters), bleu1, rouge_l (F1 of the longest common subsequence of tokens), and mean length."""
    own = rows.withColumn("_g", X.switched_tokens(F.col(gold))).withColumn("_p", X.switched_tokens(F.col(answer)))
    own = metrics.with_lcs(own, "_g", "_p", "_lcs")
    recall, precision = F.col("_lcs") / F.size("_g"), F.col("_lcs") / F.size("_p")
    rouge_l = F.when((F.size("_g") == 0) | (F.size("_p") == 0) | (F.col("_lcs") == 0), 0.0).otherwise(2 * recall * precision / (recall + precision))
    exact = (X.normal_answer(F.col(gold)) == X.normal_answer(F.col(answer))).cast("double")
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return own.groupBy(model).agg(
        F.count("*").alias("samples"), mean(exact, "exact"), mean(metrics.char_f1(F.col(gold), F.col(answer)), "f1"), mean(metrics.set_bleu(F.col("_g"), F.col("_p")), "bleu1"), mean(rouge_l, "rouge_l"), mean(F.length(answer).cast("double"), "length")
    )


def two_models(rows: DataFrame, prompt: str, first: Callable[[str], str | None], second: Callable[[str], str | None], gold: str = "gold", **options) -> DataFrame:
    """(metric, first, second, change) over the same prompts, both models asked side by side; failed calls count as empty answers."""
    asked = generate.ask_each(generate.ask_each(rows, prompt, first, "first", **options), prompt, second, "second", **options)
    long = asked.select(F.col(gold).alias("gold"), F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("answer")) for m in ("first", "second")))).alias("a")).select("gold", "a.*")
    names = ["samples", "exact", "f1", "bleu1", "rouge_l", "length"]
    summary = model_summary(long, "model").select("model", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("m")).select("model", "m.*")
    value = lambda m: F.max(F.when(F.col("model") == m, F.col("value")))
    return summary.groupBy("metric").agg(value("first").alias("first"), value("second").alias("second")).withColumn("change", F.round(F.col("second") - F.col("first"), 6))


def counted(rows: DataFrame, name: str, **values: Column) -> tuple[DataFrame, Observation]:
    """rows, and what an action over them says of these aggregates (and the number of rows, ``n``) without another scan."""
    observation = Observation(name)
    return rows.observe(observation, F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in values.items())), observation


def require(observation: Observation, **wanted: int) -> None:
    """ValueError unless an observed run counted what is wanted."""
    got = observation.get
    wrong = {k: (got.get(k), v) for k, v in wanted.items() if got.get(k) != v}
    if wrong:
        raise ValueError(f"counted (got, wanted): {wrong}")
