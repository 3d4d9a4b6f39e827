"""What the operators share: batches of whole texts, cut lineage, exact global offsets."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of bytes other than space and 0x09 to 0x0D, which is what bytes.split() parts at.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Where the setting is absent (tests on one machine) a temporary folder is made and set once; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        return spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed now and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffled files of each query are deleted when it ends: what is read again is written as tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Narrow rows a task aims at in rounds over the same table, and tasks that may stay whatever the rows.
ROWS_A_TASK, TASKS = 250_000, 16


def tasks_for(rows: int) -> int:
    """How many tasks work on so many narrow rows: rounds over small tables would else write a file for every shuffle partition."""
    return max(TASKS, -(-rows // ROWS_A_TASK))


def in_few_tasks(df: DataFrame) -> DataFrame:
    """A cut table of narrow rows, read by as many tasks as its rows ask for.

    What follows a shuffle is cut into a file for each shuffle partition, and every later pass over it would be as many tasks, each of
    which the driver has to send, watch and log.
    """
    return df.coalesce(tasks_for(df.count()))


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


#: Bytes of texts that a task turns into Python objects at once.
LOT_BYTES = 2 << 20


def lots(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of about LOT_BYTES in its texts each, one row at least; in order and whole."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    lot = (np.cumsum(size, dtype=np.int64) - size) // LOT_BYTES
    cuts = [*np.flatnonzero(np.diff(lot, prepend=-1)).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def per_text(df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[list[bytes]], dict]], added: T.StructType) -> DataFrame:
    """keep's columns and those in added, which make()'s function returns for a batch of texts.

    Columns of keep that are named like added ones give way to them. make runs once a task, so that automata and tables are built there. Rows keep their order.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    keep = [c for c in keep if c not in added.names]
    columns = list(dict.fromkeys([*keep, text]))
    schema = T.StructType([df.schema[c] for c in keep] + list(added))
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in added]
    at, source = [columns.index(c) for c in keep], columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            out = work(raw(batch.column(source)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in at] + [pa.array(out[n], k, from_pandas=False) for n, k in kinds], names=plain(schema).names)

    return map_batches(df.select(*named(columns)), run, schema)


def plain(schema: T.StructType) -> T.StructType:
    """schema with names that every interface takes: mapInArrow stumbles over dots."""
    return T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])


def map_batches(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """df through run by Arrow batches, whose columns have plain() names on both sides."""
    return df.toDF(*plain(df.schema).names).mapInArrow(run, plain(schema)).toDF(*schema.names)


def named(names: list[str]) -> list[Column]:
    """Columns by their whole names, dots included."""
    return [F.col(f"`{n}`") for n in names]


#: Tables of up to so many rows and bytes of keys are broadcast, after counting them.
SMALL_ROWS, SMALL_BYTES, SALTS = 200_000, 16 << 20, 64


def with_small(rows: DataFrame, few: DataFrame, key: str, few_key: str, spread: Column, how: str = "inner", also: Column | None = None) -> DataFrame:
    """rows joined with few (one narrow row a key) where the keys are equal, null with null; and also holds, if given.

    A key may have a third of all rows, so rows are never dealt by it: few is counted and then broadcast,
    or beyond the bound repeated under SALTS salts, between which spread deals each key's rows.
    """
    n, size = few.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(few_key).cast("string"))), F.lit(0))).first()
    same = F.col(key).eqNullSafe(F.col(few_key))
    if n <= SMALL_ROWS and size <= SMALL_BYTES:
        return rows.join(F.broadcast(few), same if also is None else same & also, how)
    salted = rows.withColumn("_tw_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    every = few.withColumn("_tw_of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    same = same & (F.col("_tw_salt") == F.col("_tw_of_salt"))
    return salted.join(every, same if also is None else same & also, how).drop("_tw_salt", "_tw_of_salt")


#: Keys with more rows than that are joined apart from the others.
HOT = 500


def hot_keys(rows: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """(_tw_hot), a cut table: the keys of over HOT rows, found by so many tasks, if given."""
    hot = rows.groupBy(key).count().where(F.col("count") > HOT).select(F.col(key).alias("_tw_hot"))
    return cut(hot.coalesce(tasks) if tasks else hot)


def with_keyed(rows: DataFrame, keyed: DataFrame, key: str, spread: str, how: str = "inner", tasks: int | None = None) -> DataFrame:
    """rows joined with keyed, which has one row a key (not null), where the keys are equal. tasks, if given, find the hot keys, and
    the ordinary join is by sorting: as a broadcast one it would send its rows through the driver, and be a task for each shuffle partition.

    Both are read more than once, so they are cut tables or cheap. Keys of over HOT rows are at most one in HOT rows: their rows
    meet keyed's few rows for them in with_small, all others in an ordinary join.
    """
    hot = hot_keys(rows, key, tasks)
    plain_side = keyed.hint("merge") if tasks else keyed
    if not hot.limit(1).count():
        return rows.join(plain_side, key, how)
    marked = with_small(rows, hot, key, "_tw_hot", F.col(spread), "left")
    few = keyed.join(F.broadcast(hot) if hot.count() <= SMALL_ROWS else hot, keyed[key] == hot["_tw_hot"], "left_semi").withColumnRenamed(key, "_tw_key")
    heavy = with_small(marked.where("_tw_hot is not null").drop("_tw_hot"), few, key, "_tw_key", F.col(spread), how).drop("_tw_key")
    return marked.where("_tw_hot is null").drop("_tw_hot").join(plain_side, key, how).unionByName(heavy)


def ascii_lower(column: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
