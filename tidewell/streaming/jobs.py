"""Structured Streaming jobs: keyed upserts, resumable appends, history budgets, windowed rollups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import text as X


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What the stream has now, appended to Parquet at path; a later call with the same checkpoint goes on from there."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


def first_of_each(stream: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """Each key's first row, its state dropped once the watermark has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def upsert_batches(stream: DataFrame, store: str, key: str, order: str, checkpoint: str) -> DataFrame:
    """A keyed store at store/v=<batch>: every batch is merged into the last version, the last row in order winning.

    A batch that is run again after a failure writes the same version again. Versions before the last two are
    removed. A run that finds nothing new returns the store as it is; one that never found anything has no rows.
    """
    from tidewell.sources.files import upsert

    spark = stream.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions() -> list[int]:
        """Whole versions, the last one first."""
        found = [f.getPath().getName() for f in fs.listStatus(at(store))] if fs.exists(at(store)) else []
        return sorted((int(n[2:]) for n in found if n.startswith("v=") and fs.exists(at(f"{store}/{n}/_SUCCESS"))), reverse=True)

    def merge(batch: DataFrame, number: int) -> None:
        before = [v for v in versions() if v < number]
        if before:
            old = spark.read.parquet(f"{store}/v={before[0]}")
            newer = batch.join(old.select(key, F.col(order).alias("_was")), key, "left").where(F.col("_was").isNull() | (F.col(order) >= F.col("_was"))).drop("_was")
        else:
            old, newer = batch.limit(0), batch
        upsert(old, newer, key, order).write.mode("overwrite").parquet(f"{store}/v={number}")
        for v in before[1:]:
            fs.delete(at(f"{store}/v={v}"), True)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    there = versions()
    return spark.read.parquet(f"{store}/v={there[0]}") if there else spark.createDataFrame([], stream.schema)


#: Buckets of keys of a store that is rewritten in parts.
BUCKETS = 64


def _store_files(spark: SparkSession, store: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def live_buckets(spark: SparkSession, store: str) -> tuple[int, dict[int, int]]:
    """The last batch that a bucketed store has whole, and the version of each of its buckets."""
    path, fs = _store_files(spark, store)
    found = sorted(int(f.getPath().getName()) for f in fs.listStatus(path(f"{store}/manifests"))) if fs.exists(path(f"{store}/manifests")) else []
    if not found:
        return -1, {}
    return found[-1], {r["bucket"]: r["version"] for r in spark.read.parquet(f"{store}/manifests/{found[-1]}").collect()}  # one row a bucket


def read_buckets(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """What a bucketed store holds now: the files that its last manifest names."""
    _, live = live_buckets(spark, store)
    return spark.read.schema(schema).parquet(*[f"{store}/data/v={v}/bucket={b}" for b, v in sorted(live.items())]) if live else spark.createDataFrame([], schema)


def upsert_buckets(stream: DataFrame, store: str, key: str, order: str, checkpoint: str, buckets: int = BUCKETS) -> DataFrame:
    """A keyed store whose keys are dealt into buckets; of each batch only the buckets that it has keys of are read and written.

    The last row of a key in order wins; ties go to the later batch. A manifest (one row a bucket) names the live version of every
    bucket and appears whole or not at all, so readers see the store before or after a batch, and a batch run again writes the same
    version again. Versions that neither the last nor the next to last manifest names are removed.
    """
    from tidewell.sources.files import last_of_each

    spark, schema = stream.sparkSession, stream.schema
    path, fs = _store_files(spark, store)
    names = schema.names

    def merge(batch: DataFrame, number: int) -> None:
        last, live = live_buckets(spark, store)
        if last >= number:
            return
        batch = batch.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # `buckets` at most
            if not touched:
                return
            old = spark.read.schema(schema).parquet(*[f"{store}/data/v={live[b]}/bucket={b}" for b in touched if b in live]) if set(touched) & live.keys() else spark.createDataFrame([], schema)
            both = old.withColumn("_new", F.lit(0)).unionByName(batch.select(*names, F.lit(1).alias("_new")))
            kept = last_of_each(both, key, F.struct(order, "_new")).drop("_new").withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/data/v={number}")
        finally:
            batch.unpersist()
        now = live | dict.fromkeys(touched, number)
        staged = f"{store}/staged/{number}"
        spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(staged)
        fs.mkdirs(path(f"{store}/manifests"))
        fs.rename(path(staged), path(f"{store}/manifests/{number}"))
        kept_versions = set(now.values()) | set(live.values())
        for f in fs.listStatus(path(f"{store}/data")):
            if int(f.getPath().getName()[2:]) not in kept_versions:
                fs.delete(f.getPath(), True)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_buckets(spark, store, schema)


def windowed_rollup(stream: DataFrame, time: str, value: str, group: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, group, n, mean, most) by tumbling windows; rows later than the watermark are left out."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), group)
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))
        .select(F.col("w.start").alias("start"), group, "n", "mean", "most")
    )


def history_budget(stream: DataFrame, conv: str, text: str, budget: int = 4096) -> DataFrame:
    """(conv, used, over): each conversation's estimated tokens so far, and whether it is over budget.

    State is two numbers a conversation.
    """
    costs = stream.select(conv, X.token_estimate(F.coalesce(F.col(text), F.lit(""))).alias("cost"))

    def add(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = (state.get[0] if state.exists else 0) + sum(int(f["cost"].sum()) for f in frames)
        state.update((used,))
        yield pd.DataFrame({conv: [key[0]], "used": [used], "over": [used > budget]})

    return costs.groupBy(conv).applyInPandasWithState(add, f"{conv} long, used long, over boolean", "used long", "update", "NoTimeout")


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All updates that the stream makes now, as rows with the number of their batch."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/number={number}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path).drop("number")
