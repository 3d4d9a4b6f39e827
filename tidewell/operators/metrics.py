"""Metrics of ranked lists, of generated texts, and their summaries. Variants that differ have their own names."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidewell.functions import overlap as V
from tidewell.functions import text as X
from tidewell.operators.ordered import with_neighbours


def _log2(c: Column) -> Column:
    return F.log2(c.cast("double"))


def ranking_metrics(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query, accuracy, mrr, precision, recall, ndcg) at k, one row for each query in truth.

    ranked (query, doc, rank), truth (query, doc). accuracy and recall divide by the relevant ones, precision by
    k itself; ndcg is binary, its ideal has min(relevant, k) hits.
    """
    relevant = truth.select("query", "doc").distinct()
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["query", "doc"], "left_semi")
    found = hits.groupBy("query").agg(F.count_distinct("doc").alias("hits"), F.min("rank").alias("first"), F.sum(1 / _log2(F.col("rank") + 1)).alias("dcg"))
    n = relevant.groupBy("query").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / _log2(i + 1))
    zero, hit = F.lit(0.0), F.coalesce("hits", F.lit(0))
    return n.join(found, "query", "left").select(
        "query",
        F.round(hit / F.col("n"), 6).alias("accuracy"),
        F.round(F.coalesce(1 / F.col("first"), zero), 6).alias("mrr"),
        F.round(hit / F.lit(k), 6).alias("precision"),
        F.round(hit / F.col("n"), 6).alias("recall"),
        F.round(F.coalesce(F.col("dcg") / ideal, zero), 6).alias("ndcg"),
    )


def graded_ndcg(ranked: DataFrame, k: int) -> DataFrame:
    """(query, ndcg): gain 2^label - 1 for labels above 0, the ideal taken from the same list; 0 without any."""
    gain = F.when(F.col("label") > 0, F.pow(F.lit(2.0), F.col("label")) - 1).otherwise(0.0)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("label"), "rank"))
    rows = ranked.select("query", "rank", gain.alias("gain"), best.alias("best"))
    both = rows.groupBy("query").agg(F.sum(F.when(F.col("rank") <= k, F.col("gain") / _log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("best") <= k, F.col("gain") / _log2(F.col("best") + 1)).otherwise(0.0)).alias("ideal"))
    return both.select("query", F.round(V.ratio(F.col("dcg"), F.col("ideal")), 6).alias("ndcg"))


def graded_precision_recall(ranked: DataFrame, k: int) -> DataFrame:
    """(query, precision, recall, mrr): labels above 0 are relevant; mrr looks at the whole list."""
    good = F.col("label") > 0
    g = ranked.groupBy("query").agg(F.count_if(good & (F.col("rank") <= k)).alias("hits"), F.count_if(good).alias("n"), F.min(F.when(good, F.col("rank"))).alias("first"))
    return g.select("query", F.round(F.col("hits") / F.lit(k), 6).alias("precision"), F.round(V.ratio(F.col("hits"), F.col("n")), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def first_item_recall(ranked: DataFrame) -> DataFrame:
    """One row: how often the true document (is_truth) ranks first, among three, and its mean reciprocal rank."""
    per = ranked.groupBy("query").agg(F.min(F.when(F.col("is_truth"), F.col("rank"))).alias("r"))
    r = F.col("r")
    return per.agg(F.round(F.avg(F.coalesce((r <= 1).cast("double"), F.lit(0.0))), 6).alias("top1"), F.round(F.avg(F.coalesce((r <= 3).cast("double"), F.lit(0.0))), 6).alias("top3"), F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"))


# --- generated texts: gold and predicted token arrays ---


def unigram_precision(gold: Column, predicted: Column) -> Column:
    """Clipped unigram precision without a brevity penalty; 0 without gold tokens."""
    return F.when(F.size(gold) == 0, 0.0).otherwise(V.ratio(V.common_counted(gold, predicted), F.size(predicted)))


def ngram_recall(gold: Column, predicted: Column, n: int = 1) -> Column:
    """ROUGE-1 or ROUGE-2 as recall over multisets; 0 without gold n-grams."""
    if n == 2:
        gold, predicted = X.bigrams(gold), X.bigrams(predicted)
    return V.ratio(V.common_counted(gold, predicted), F.size(gold))


def set_rouge_f1(gold: Column, predicted: Column, n: int = 1) -> Column:
    if n == 2:
        gold, predicted = X.bigrams(gold), X.bigrams(predicted)
    return V.set_f1(gold, predicted)


def char_f1(a: Column, b: Column) -> Column:
    """F1 of the sets of characters, citations and white space left out."""
    chars = [F.filter(F.split(X.normal_answer(c), ""), lambda x: x != "") for c in (a, b)]
    return V.set_f1(*chars)


def set_bleu(gold: Column, predicted: Column) -> Column:
    """Distinct tokens in common over the gold's: a recall that goes by the name of BLEU-1."""
    return V.ratio(V.common(gold, predicted), F.size(F.array_distinct(gold)))


def mean_set_bleu(gold: Column, predicted: Column) -> Column:
    """Mean of the unigrams' and the bigrams' set overlap with the gold."""
    return (set_bleu(gold, predicted) + set_bleu(X.bigrams(gold), X.bigrams(predicted))) / 2


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence by bit rows: each of b's items updates one number that has a bit for each of a's."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        m = row & places.get(y, 0)
        row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def with_lcs(pairs: DataFrame, gold: str, predicted: str, name: str = "lcs") -> DataFrame:
    """pairs with the length of the longest common subsequence of two token arrays."""

    @F.pandas_udf("long")
    def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(list(x), list(y)) if x is not None and y is not None else 0 for x, y in zip(a, b, strict=True)])

    return pairs.withColumn(name, lcs(F.col(gold), F.col(predicted)))


def sentence_bleu(references: list, hypothesis: list, n: int = 4, small: float = 0.1) -> float:
    """BLEU of one pair with equal weights to n-grams, counts of 0 replaced by small, and a brevity penalty."""
    from collections import Counter
    from math import exp, log

    if not hypothesis or not references:
        return 0.0
    total = 0.0
    for k in range(1, n + 1):
        mine = Counter(zip(*(hypothesis[i:] for i in range(k)), strict=False))
        theirs = Counter(zip(*(references[i:] for i in range(k)), strict=False))
        hits, of = sum((mine & theirs).values()), max(1, sum(mine.values()))
        if k == 1 and not hits:
            return 0.0
        total += log((hits or small) / of) / n
    return min(1.0, exp(1 - len(references) / len(hypothesis))) * exp(total)


def with_bleu4(pairs: DataFrame, gold: str, predicted: str, name: str = "bleu4") -> DataFrame:
    @F.pandas_udf("double")
    def bleu(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sentence_bleu(list(x), list(y)) if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)])

    return pairs.withColumn(name, bleu(F.col(gold), F.col(predicted)))


def keyword_hit(keywords: Column, predicted: Column, share: float = 0.3) -> Column:
    """1 if over share of the keywords stand in the prediction as substrings, repeats counted; null without keywords."""
    hits = F.size(F.filter(keywords, lambda k: F.contains(predicted, k)))
    return F.when(F.size(keywords) > 0, (hits / (F.size(keywords) + 1e-6) > share).cast("double"))


def semantic_keyword(gold: Column, predicted: Column, semantic: Column, keyword: Column) -> Column:
    """0.8 semantic + 0.2 keyword score; semantic alone without keywords; all or nothing where the gold is no answer."""
    mixed = F.when(keyword.isNull(), semantic).otherwise(0.2 * keyword + 0.8 * semantic)
    return F.when(gold == X.NO_ANSWER, (predicted == X.NO_ANSWER).cast("double")).otherwise(mixed)


def citation_accuracy(expected: Column, predicted: Column) -> Column:
    """Share of the expected citations (first group only) that the prediction has; 0 if either has none."""
    a, b = X.strict_citations(expected), X.strict_citations(predicted)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(V.ratio(V.common(a, b), F.size(a)))


# --- summaries ---


def mean_std(rows: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """n, mean, population deviation, least and most; zeros where there are no values. NaN counts as no value."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    zero = F.lit(0.0)
    aggs = [F.count(v).alias("n"), F.round(F.coalesce(F.avg(v), zero), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop(v), zero), 6).alias("std"), F.coalesce(F.min(v), zero).alias("least"), F.coalesce(F.max(v), zero).alias("most")]
    return rows.groupBy(group).agg(*aggs) if group else rows.agg(*aggs)


def no_answer_stats(rows: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """How well missing answers are told: counts, hit rate, and answers withheld where there was one."""
    is_none, said_none = gold == X.NO_ANSWER, predicted == X.NO_ANSWER
    c = rows.agg(F.count_if(is_none).alias("total"), F.count_if(is_none & said_none).alias("correct"), F.count_if(~is_none & said_none).alias("false_positives"), F.count_if(~is_none).alias("answerable"))
    return c.select("total", "correct", (F.col("total") - F.col("correct")).alias("incorrect"), F.round(V.ratio(F.col("correct"), F.col("total")), 6).alias("hit_rate"), F.round(V.ratio(F.col("false_positives"), F.col("answerable")), 6).alias("false_positive_rate"))


def comprehensive(semantic: Column, recall: Column, precision: Column) -> Column:
    """0.7 semantic + 0.3 of the mean of recall and precision; semantic alone where that mean is missing or 0."""
    mean = (recall + precision) / 2
    return F.when(mean.isNull() | (mean == 0), semantic).otherwise(0.7 * semantic + 0.3 * mean)


def compare(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """(metric, base, tuned, absolute, relative): metrics of both, relative in percent; from 0 it is infinite or 0."""
    both = base.select("metric", F.col("value").alias("base")).join(tuned.select("metric", F.col("value").alias("tuned")), "metric")
    rise = F.col("tuned") - F.col("base")
    relative = F.when(F.col("base") == 0, F.when(F.col("tuned") > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(100 * F.try_divide(rise, F.col("base")))
    return both.select("metric", "base", "tuned", F.round(rise, 6).alias("absolute"), F.round(relative, 6).alias("relative"))


def response_times(rows: DataFrame, parts: tuple[str, ...] = ("retrieval", "rerank", "generation")) -> DataFrame:
    total = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0.0)))
    return rows.withColumn("total_time", total)


def moving_average(rows: DataFrame, group: str, order: str, value: str, window: int = 10, large: int | None = None) -> DataFrame:
    """value smoothed over window // 2 rows on either side, cut at the ends; groups shorter than window stay as they are.

    A group of more than `large` rows is parted into ranges (see ordered.with_neighbours).
    """

    def add(w: WindowSpec) -> dict[str, Column]:
        near = w.orderBy(order).rowsBetween(-(window // 2), window // 2)
        return {"smoothed": F.when(F.count(F.lit(1)).over(w) < window, F.col(value)).otherwise(F.avg(value).over(near))}

    return with_neighbours(rows, group, [order], window, add, large)


def step_durations(rows: DataFrame, group: str, time: str, large: int | None = None) -> DataFrame:
    """rows with the seconds from each to the next one of its group; the last has none. Groups of more than `large` rows are parted."""
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    return with_neighbours(rows, group, [time], 1, lambda w: {"seconds": (F.lead(seconds).over(w.orderBy(time)) - seconds) / 1e6}, large)


def mean_over_queries(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row: how many queries there are and each metric's mean over them, 0 without any."""
    return rows.agg(F.count("*").alias("n_queries"), *(F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias(n) for n in names))
