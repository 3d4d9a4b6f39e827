"""Question-answer training data: filters, expansion, splits, negatives, rerank rows, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.functions import text as X
from tidewell.sources.files import cut

# Phrases of refusals.
REFUSALS = ("无法准确", "未提及")


def without_refusals(rows: DataFrame, answer: str, phrases: tuple[str, ...] = REFUSALS) -> DataFrame:
    """Rows whose stripped question-side columns hold an answer that refuses nothing."""
    keep = ~X.is_blank(F.col(answer))
    for p in phrases:
        keep = keep & ~F.contains(F.col(answer), F.lit(p))
    return rows.where(keep)


def without_short(docs: DataFrame, text: str, least: int = 100) -> DataFrame:
    return docs.where(F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) >= least)


def of_quality(rows: DataFrame, score: str, least: int = 3) -> DataFrame:
    """Rows whose score reads as an integer of least or more."""
    return rows.where(F.col(score).try_cast("int") >= least)


def expand_questions(pairs: DataFrame, rewrites: DataFrame, question: str = "question") -> DataFrame:
    """Each pair under its question and under every rewrite (question, rewrites) of it; is_rewrite tells them apart."""
    joined = pairs.join(rewrites, question, "left")
    every = F.concat(F.array(F.col(question)), F.coalesce("rewrites", F.array().cast("array<string>")))
    return joined.select(*[c for c in pairs.columns if c != question], F.posexplode(every).alias("n", question)).withColumn("is_rewrite", F.col("n") > 0).drop("n")


def hash_split(rows: DataFrame, key: Column, train: float, seed: str = "") -> DataFrame:
    """rows with split train or test, by a hash of key."""
    return rows.withColumn("split", F.when(X.hash_bucket(key, 1000, seed) < round(1000 * train), "train").otherwise("test"))


def add_negatives(rows: DataFrame, negatives: DataFrame, train: float = 0.95, seed: str = "neg") -> DataFrame:
    """rows and the negatives' questions (question), answered by no answer and split by their own rate."""
    own = negatives.where(~X.is_blank(F.col("question"))).select(X.strip(F.col("question")).alias("question"))
    marked = hash_split(own.select(X.content_id(F.col("question")).alias("unique_id"), "question", F.lit(X.NO_ANSWER).alias("answer")), F.col("unique_id"), train, seed)
    return rows.unionByName(marked, allowMissingColumns=True)


def join_keywords(rows: DataFrame, keywords: DataFrame, answer: str = "answer") -> DataFrame:
    """rows with the keywords (answer, keywords) of their answer, none where it has no entry."""
    return rows.join(keywords, answer, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those already written."""
    return rows.join(done.select(key), key, "left_anti")


def choose(items: Column, key: Column) -> Column:
    """One of the items by a hash of key; null without any."""
    return F.when(F.size(items) > 0, F.element_at(items, (X.hash_bucket(key, 1 << 30) % F.size(items) + 1).cast("int")))


def rerank_rows(traces: DataFrame, key: str = "query_id", query: str = "query") -> DataFrame:
    """(key, query, content, label): the first context as 2, one of the last two others as 1, one negative as 0.

    traces: query, context array<string>, merged array<string>. Negatives are the merged documents outside
    the context, repeats kept. Empty queries and contents give no row.
    """
    ctx, neg = F.col("context"), F.filter("merged", lambda m: ~F.array_contains(F.col("context"), m))
    last_two = F.slice(ctx, F.greatest(F.lit(2), F.size(ctx) - 1), F.lit(2))
    rows = F.array(
        F.struct(F.when(F.size(ctx) > 0, F.element_at(ctx, 1)).alias("content"), F.lit(2).alias("label")),
        F.struct(choose(last_two, F.concat(F.lit("mid"), F.col(key).cast("string"))).alias("content"), F.lit(1).alias("label")),
        F.struct(choose(neg, F.concat(F.lit("neg"), F.col(key).cast("string"))).alias("content"), F.lit(0).alias("label")),
    )
    out = traces.select(key, query, F.explode(rows).alias("r")).select(key, query, "r.content", "r.label")
    return out.where((F.length(query) > 0) & (F.length("content") > 0))


def mined(traces: DataFrame, key: str = "query_id", query: str = "query", test: float = 0.1, seed: str = "rr") -> tuple[DataFrame, DataFrame]:
    """Training rows (key, query, content, label) and test rows (key, query, contents) for a reranker, from traces with responses.

    Questions are dealt to the test by a hash of their key. Of those with cited answers training gets the first context as 2, one of the
    last two as 1 if there are two, and one candidate outside the context as 0; the test gets these as one list. Of those without an
    answer training gets one candidate as 0, the test nothing. Blank queries and contents give no row.
    """
    ctx, merged, k = F.col("context"), F.col("merged"), F.col(key).cast("string")
    neg = F.filter(merged, lambda m: ~F.array_contains(ctx, m))
    middle = F.when(F.size(ctx) >= 2, choose(F.slice(ctx, F.greatest(F.lit(1), F.size(ctx) - 1), F.lit(2)), F.concat(F.lit("mid"), k)))
    first, other = F.when(F.size(ctx) > 0, F.element_at(ctx, 1)), choose(neg, F.concat(F.lit("neg"), k))
    rows = traces.where(F.length(query) > 0).select(
        key, query, (X.hash_bucket(F.col(key), 1000, seed) < round(1000 * test)).alias("_test"), (F.size(X.citations(F.col("response"))) > 0).alias("_answered"),
        first.alias("_first"), middle.alias("_middle"), F.when(F.size(ctx) > 0, other).alias("_other"), choose(merged, F.concat(F.lit("any"), k)).alias("_any"),
    )
    labelled = F.array(*(F.struct(F.col(c).alias("content"), F.lit(n).alias("label")) for c, n in (("_first", 2), ("_middle", 1), ("_other", 0))))
    lone = F.array(F.struct(F.col("_any").alias("content"), F.lit(0).alias("label")))
    train = rows.where(~F.col("_test")).select(key, query, F.explode(F.when(F.col("_answered"), labelled).otherwise(lone)).alias("r")).select(key, query, "r.content", "r.label")
    tests = rows.where(F.col("_test") & F.col("_answered") & F.col("_first").isNotNull())
    return train.where(F.length("content") > 0), tests.select(key, query, F.array_compact(F.array("_first", "_middle", "_other")).alias("contents"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows numbered from 1 in a total order: ranges are sorted side by side and their counts added up."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    placed = cut(placed)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    return placed.join(F.broadcast(starts.select("_part", "_first", "_start")), "_part").withColumn(name, F.col("_row") - F.col("_first") + F.col("_start") + 1).drop("_part", "_row", "_first", "_start")


def tail_split(rows: DataFrame, order: list[Column], dev: int) -> DataFrame:
    """rows with split dev for the last dev rows in order and train before; fewer rows than dev are all dev, and dev 0 is none."""
    n = rows.count()
    return numbered(rows, order, "_i").withColumn("split", F.when(F.col("_i") > n - dev, "dev").otherwise("train")).drop("_i")


def seeded_order(rows: DataFrame, key: Column, seed: str = "42") -> DataFrame:
    """rows with their place in a shuffle that depends on key and seed alone."""
    return numbered(rows.withColumn("_h", F.md5(F.concat(F.lit(seed), key.cast("string")))), [F.col("_h")], "place").drop("_h")


def exact_sample(rows: DataFrame, key: Column, share: float, seed: str = "42") -> DataFrame:
    """Exactly max(1, floor(n * share)) rows, those whose seeded hash of key is smallest; they are numbered side by side, not sorted into one place."""
    n = max(1, int(rows.count() * share))
    return seeded_order(rows, key, seed).where(F.col("place") <= n).drop("place")


def fixed_sample(rows: DataFrame, key: Column, n: int, seed: str = "42") -> DataFrame:
    """The n rows whose seeded hash of key is smallest, or all if there are fewer."""
    return seeded_order(rows, key, seed).where(F.col("place") <= n).drop("place")


def zipped(left: DataFrame, left_order: list[Column], right: DataFrame, right_order: list[Column]) -> DataFrame:
    """(place, left's columns, right's columns): rows side by side by their place in order, as many as the shorter table has."""
    return numbered(left, left_order, "place").join(numbered(right, right_order, "place"), "place")


def vector_rows(rows: DataFrame, key: str, text: str, order: list[Column], most: int = 512) -> DataFrame:
    """(id, text) for a vector store: the first most characters, and the place from 0 where there is no id."""
    placed = numbered(rows, order, "_i")
    return placed.select(F.coalesce(F.col(key).cast("string"), (F.col("_i") - 1).cast("string")).alias("id"), F.substring(text, 1, most).alias("text"))


def duplicate_accounting(rows: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys, rows beyond the first of each key, and rows without a key."""
    by_key = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    there = by_key.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"))
    return there.withColumn("n_missing", F.lit(rows.where(F.col(key).isNull()).count()).cast("long"))


def sft_rows(traces: DataFrame, instruction: str, key: str = "query_id") -> DataFrame:
    """(key, query, context, instruction, input, output, split) for fine-tuning from query, context and response."""
    context = X.training_context(F.col("context"))
    cites = F.array_sort(X.citations(F.col("response")))
    out = traces.select(
        key, "query", context.alias("context"), F.lit(instruction).alias("instruction"),
        X.fill_template("{{context}}\n{{question}}", context=context, question=F.col("query")).alias("input"),
        X.format_answer(X.strip_citations(F.col("response")), cites).alias("output"),
    )
    return hash_split(out, F.col(key), 0.92, "sft")


def label_balance(rows: DataFrame, label: str) -> DataFrame:
    """Counts and shares of labels 2, 1 and 0, and warnings where positives are few, negatives many or middles few."""
    c = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(label) == k).alias(f"n_{k}") for k in (0, 1, 2)))
    share = {k: F.coalesce(F.try_divide(F.col(f"n_{k}"), F.col("n")), F.lit(0.0)) for k in (0, 1, 2)}
    warnings = F.array_compact(F.array(F.when(share[2] < 0.2, "few positives"), F.when(share[0] > 0.6, "many negatives"), F.when(share[1] < 0.1, "few middles")))
    return c.select("n", *(F.col(f"n_{k}") for k in (0, 1, 2)), *(F.round(share[k], 6).alias(f"share_{k}") for k in (0, 1, 2)), F.array_join(warnings, "; ").alias("warnings"))


def validate_json(lines: DataFrame, value: str, strings: tuple[str, ...], labels: tuple[int, ...] = ()) -> DataFrame:
    """lines with error: why a JSON row isn't valid (not an object, a field missing or no string, a wrong label), or null."""
    c = F.col(value)
    parsed = F.try_parse_json(c)
    error = F.when(parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object")
    for s in strings:
        got = F.try_variant_get(parsed, f"$.{s}", "variant")
        error = error.when(got.isNull() | (F.schema_of_variant(got) != "STRING"), f"{s} missing or no string")
    if labels:
        error = error.when(~F.coalesce(F.try_variant_get(parsed, "$.label", "int").isin(*labels), F.lit(False)), "label out of range")
    return lines.withColumn("error", error)


def sft_stats(rows: DataFrame, context: str, output: str, group: str) -> DataFrame:
    """Counts, lengths, and how many outputs cite or withhold an answer, by group."""
    cites = F.size(X.citations(F.col(output))) > 0
    none = F.col(output) == X.NO_ANSWER
    return rows.groupBy(group).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.length(context)), 4).alias("avg_context"), F.round(F.avg(F.length(output)), 4).alias("avg_output"),
        F.min(F.length(output)).alias("min_output"), F.max(F.length(output)).alias("max_output"),
        F.count_if(cites).alias("n_cited"), F.round(F.avg(cites.cast("double")), 6).alias("cited_rate"),
        F.count_if(none).alias("n_no_answer"), F.round(F.avg(none.cast("double")), 6).alias("no_answer_rate"),
    )


def label_distribution(rows: DataFrame, label: str, text: str, group: str) -> DataFrame:
    """Counts by group of labels 2, 1, 0 and of others or none (-1), and mean text lengths."""
    known = F.when(F.col(label).isin(0, 1, 2), F.col(label)).otherwise(-1)
    return rows.groupBy(group).agg(F.count("*").alias("n"), *(F.count_if(known == k).alias(f"n_{'other' if k < 0 else k}") for k in (2, 1, 0, -1)), F.round(F.avg(F.length(text)), 4).alias("avg_length"))


def dataset_stats(rows: DataFrame) -> DataFrame:
    """One row over (unique_id, question, answer, keywords): documents, pairs, pairs a document, no answers, pairs with keywords."""
    return rows.agg(
        F.count_distinct("unique_id").alias("n_docs"), F.count("*").alias("n_pairs"), F.round(F.count("*") / F.greatest(F.count_distinct("unique_id"), F.lit(1)), 4).alias("pairs_a_doc"),
        F.count_if(F.col("answer") == X.NO_ANSWER).alias("n_no_answer"), F.count_if(F.size(F.coalesce("keywords", F.array().cast("array<string>"))) > 0).alias("n_with_keywords"),
        F.round(F.avg(F.length("question")), 4).alias("avg_question"), F.round(F.avg(F.length("answer")), 4).alias("avg_answer"),
    )
