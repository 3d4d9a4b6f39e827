"""Readers and writers around the pipeline: JSON lines and arrays, word lists, logs, stage tables, keyed stores."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import text as X


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; on one machine a temporary folder will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-tidewell-")
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read from there: lost executors cost no recomputation."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def last_of_each(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key in order; rows without a key go. One aggregate, so hot keys combine before the shuffle."""
    value = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    keyed = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return keyed.groupBy(F.col(key).alias("_key")).agg(F.max_by(value, order).alias("_row")).select("_row.*")


def upsert(store: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """store with new rows in place of those of the same key; within new the last in order wins."""
    fresh = last_of_each(new, key, F.col(order))
    return store.join(fresh.select(key), key, "left_anti").select(*store.columns).unionByName(fresh, allowMissingColumns=True)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Rows of a JSON-lines file, the last one of each key; blank and broken lines and rows without a key go."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("_at"), F.from_json("value", schema).alias("r"))
    return last_of_each(lines.where("r is not null").select("_at", "r.*"), key, F.col("_at")).drop("_at")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """rows as files that hold a JSON array each, one a partition; read_json_array() reads the folder."""
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([("[" if first else ",") + ",\n".join(lines)], pa.string())], names=["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], names=["value"])

    rows.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(run, "value string").write.text(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): distinct trimmed lines of a word or text list, blank ones left out."""
    return spark.read.text(path).select(X.strip(F.col("value")).alias("value")).where("value <> ''").distinct()


def read_gpu_log(spark: SparkSession, path: str) -> DataFrame:
    """(ts, device, name, util, used_mb, total_mb, temperature) of a CSV log that is headed by an own time stamp;
    rows with fewer than 8 fields go, units are cut off, and what isn't a number is null."""
    parts = F.split(F.col("value"), r",\s*")
    number = lambda i: F.regexp_replace(F.get(F.col("p"), i), r"\s*(%|MiB|C)\s*$", "").try_cast("double")
    rows = spark.read.text(path).select(parts.alias("p")).where("size(p) >= 8")
    return rows.select(F.get("p", 0).alias("ts"), F.get("p", 2).try_cast("int").alias("device"), F.get("p", 3).alias("name"), *(number(i).alias(n) for i, n in enumerate(("util", "used_mb", "total_mb", "temperature"), 4)))


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at path, built and written first if it isn't there or is to be rebuilt."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if rebuild or not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_sft(rows: DataFrame, path: str) -> None:
    """instruction, input and output as JSON lines, nulls written as empty texts."""
    rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("instruction", "input", "output"))).write.mode("overwrite").json(path)
