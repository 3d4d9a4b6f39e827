"""Corpus profiles: counts, lengths, histograms, duplicates, parents and children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import text as X

# The edges of the histograms; half-open and closed ones differ and both are kept.
CHAR_EDGES, TOKEN_EDGES = (100, 256, 512, 1024), (50, 100, 200, 500)
CLOSED_EDGES = (100, 256, 512, 1024)


def text_stats(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    c = F.col(text)
    return docs.select(id_column, F.length(c).cast("long").alias("chars"), X.n_words(c).cast("long").alias("words"), F.size(X.tokens(c)).cast("long").alias("tokens"), X.n_lines(c).cast("long").alias("lines"))


def corpus_profile(docs: DataFrame, text: str, group: str) -> DataFrame:
    """One row: documents, mean (two decimals) and extreme lengths, distinct groups."""
    s = docs.select(F.length(text).alias("chars"), X.n_words(F.col(text)).alias("words"), F.size(X.tokens(F.col(text))).alias("tokens"), group)
    return s.agg(
        F.count("*").alias("n_docs"),
        *(F.round(F.avg(c), 2).alias(f"avg_{c}") for c in ("chars", "words", "tokens")),
        F.min("chars").cast("long").alias("min_chars"),
        F.max("chars").cast("long").alias("max_chars"),
        F.count_distinct(group).alias("n_groups"),
    )


def histogram(values: DataFrame, value: Column, edges: tuple[int, ...], closed: bool = False) -> DataFrame:
    """(bucket, n) for buckets below, between and above edges; closed: an edge belongs to the bucket that it ends. Empty buckets have 0."""
    names = [f"{'<=' if closed else '<'}{edges[0]}", *(f"{'<=' if closed else '<'}{b}" for b in edges[1:]), f"{'>' if closed else '>='}{edges[-1]}"]
    low = [None, *edges]
    tests = []
    for i in range(len(names)):
        test = F.lit(True)
        if low[i] is not None:
            test = test & (value > low[i] if closed else value >= low[i])
        if i < len(edges):
            test = test & (value <= edges[i] if closed else value < edges[i])
        tests.append(test)
    one = values.agg(*(F.count_if(t).alias(f"b{i}") for i, t in enumerate(tests)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("bucket"), F.col(f"b{i}").alias("n")) for i, n in enumerate(names)))).alias("e")).select("e.*")


def duplicate_content(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(content_id, n, first_id) of each text that stands more than once."""
    found = docs.groupBy(X.content_id(F.col(text)).alias("content_id")).agg(F.count("*").alias("n"), F.min(id_column).alias("first_id"))
    return found.where("n > 1")


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of each key that stands more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): of n sorted values the one at n // 2 from 0; never between two of them.

    Values are counted first, so a group sorts its distinct values and not its rows.
    """
    counts = rows.groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    return ranked.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(group).agg(F.min(value).alias("median"))


def fan_out(children: DataFrame, parent: str) -> DataFrame:
    """One row: parents with children, children, and the mean, least and most children a parent."""
    per = children.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.count("*").alias("c"))
    return per.agg(F.count("*").alias("n_parents"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_children"), F.round(F.avg("c"), 2).alias("avg_children"), F.min("c").alias("min_children"), F.max("c").alias("max_children"))


def orphans(children: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Children whose parent is missing; those that name none are no orphans."""
    return children.where(F.col(parent).isNotNull()).join(parents.select(F.col(parent)), parent, "left_anti")


def stage_comparison(stages: dict[str, DataFrame], text: str) -> DataFrame:
    """(stage, n, avg_chars, expansion, reduction): counts against the first stage's, and how much smaller texts are in percent."""
    rows = None
    for i, (name, df) in enumerate(stages.items()):
        one = df.agg(F.lit(i).alias("at"), F.lit(name).alias("stage"), F.count("*").alias("n"), F.avg(F.length(text)).alias("avg"))
        rows = one if rows is None else rows.unionByName(one)
    w = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a stage
    first_n, first_avg = F.first("n").over(w), F.first("avg").over(w)
    return rows.select("stage", "n", F.round("avg", 4).alias("avg_chars"), F.round(F.try_divide("n", first_n), 4).alias("expansion"), F.round(F.try_divide((first_avg - F.col("avg")) * 100, first_avg), 4).alias("reduction"))


def length_violations(docs: DataFrame, text: str, limits: tuple[int, ...] = (512, 1024, 2048)) -> DataFrame:
    n = F.length(text)
    return docs.agg(*(F.count_if(n > m).alias(f"over_{m}") for m in limits), F.count("*").alias("n_docs"))
