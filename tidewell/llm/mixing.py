"""Mix sources to target weights: tokens a source, repetition rates, then whole copies of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewell.llm.base import WORD, cut, named, with_small

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with target: shares by weight of all sizes, none above most times its own.

    Sources by code point, null last, get the weights in turn. Excess is reshared by weight until no target
    is above its cap; each round is one aggregate, and the last of at most as many rounds as there are
    sources changes nothing.
    """
    window = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source, not a document
    place = (F.row_number().over(window) - 1) % len(weights)
    ranked = cut(sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1)).withColumn("cap", most * F.col("source_size")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, n_capped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        capped, used, free = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if capped == n_capped or not free:
            break
        n_capped, level = capped, (total - used) / free
    return ranked.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level))).alias("target"))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on key and seed alone: 52 bits of their md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(rate: Column, key: Column, seed: str) -> Column:
    whole = F.floor(rate)
    return (whole + (draw(key, seed) < rate - whole).cast("long")).cast("long")


def key_of(id_column: str, text: str) -> Column:
    return F.coalesce(F.col(id_column).cast("string"), F.md5(F.col(text)), F.lit(""))


def mix(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """One row a document: id, size (words), source_size, target, rate, copies and taken (size * copies).

    rate is target / source_size, 0 where the source has no words. A document without an id draws by its
    text. Null texts have size 0; documents without a source form one. Repeated rows draw alike. Other
    columns aren't read. Texts are read once, and only narrow rows meet the sources' targets.
    """
    own = docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"), key_of(id_column, text).alias("key"), words_in(F.col(text)).alias("size"))
    own = cut(own)
    aims = cut(_aims(own))
    joined = with_small(own, aims, "source", "of", F.col("key"))
    n = copies(F.col("rate"), F.col("key"), seed)
    return joined.select(F.col("id").alias(id_column), F.col("source").alias(source), "size", "source_size", "target", "rate", n.alias("copies"), (F.col("size") * n).alias("taken"))


def _aims(own: DataFrame) -> DataFrame:
    aims = targets(own.groupBy("source").agg(F.sum("size").alias("source_size")))
    return aims.select(F.col("source").alias("of"), "source_size", "target", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate"))


def emit(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """docs with every document as often as the mix takes it: whole rows, all columns, whatever their names.

    A source without words gives none of its documents.
    """
    aims = cut(_aims(docs.select(F.col(source).alias("source"), words_in(F.col(text)).alias("size")))).select(F.col("of").alias("_tw_of"), F.col("rate").alias("_tw_rate"))
    joined = with_small(docs, aims, source, "_tw_of", key_of(id_column, text))
    n = copies(F.col("_tw_rate"), key_of(id_column, text), seed)
    times = joined.withColumn("_tw_copy", F.explode(F.array_repeat(F.lit(1), n.cast(T.IntegerType()))))
    return times.select(*named(docs.columns))
