"""An index of vectors in lists around centroids: every vector stands in its nearest list and in a second one, and a query looks into a few lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.operators.postings import drop
from tidewell.operators.search import top
from tidewell.sources.files import shared_path

#: Centroids are fitted on so many vectors at most, in so many rounds; lists at most, vectors of a row of the index, and bytes of queries sent at once.
SAMPLE, ROUNDS, LISTS, BLOCK, QUERY_BYTES = 20_000, 12, 4_096, 4_096, 64 << 20
#: Lists a query looks into are as many as give this share of the nearest AMONG vectors of the sample, for up to TRIED of its vectors.
RECALL, AMONG, TRIED = 0.95, 10, 400
#: Distances that are held at once, and bytes of vectors that a task holds before it writes its lists.
CELLS, HELD_BYTES = 1 << 20, 32 << 20


@dataclass(frozen=True)
class Lists:
    """blocks (list, ids, vectors as 32-bit floats) in folders by list, the centroids, whether vectors are compared by squared distance, and
    how many lists a query looks into."""

    blocks: DataFrame
    centroids: np.ndarray
    squared_l2: bool
    probes: int


def _far(x: np.ndarray, y: np.ndarray, squared_l2: bool) -> np.ndarray:
    """How far each x is from each y: squared distance, or the negative inner product."""
    return (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T if squared_l2 else -(x @ y.T)


def _least(d: np.ndarray, most: int) -> np.ndarray:
    """The columns of the `most` least values of each row, ties by column; d is written over."""
    if most > 2:
        return np.argsort(d, 1, kind="stable")[:, :most].copy()
    first = np.argmin(d, 1)
    if most == 1 or d.shape[1] == 1:
        return first[:, None]
    d[np.arange(len(d)), first] = np.inf
    second = np.argmin(d, 1)
    return np.column_stack((first, np.where(second == first, first == 0, second)))  # equal where all others are infinite


def _nearest(x: np.ndarray, centre: np.ndarray, most: int, squared_l2: bool) -> np.ndarray:
    """The `most` centres nearest to each x, nearest first, for some rows of x at a time."""
    step = max(1, CELLS // len(centre))
    far = (_far(x[at : at + step], centre, squared_l2) for at in range(0, len(x), step))
    found = [_least(d, most) for d in far]
    return np.concatenate(found) if found else np.zeros((0, min(most, len(centre))), np.int64)


def centroids(sample: np.ndarray, lists: int, squared_l2: bool) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of the sample; an empty list keeps its centre."""
    centre = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].astype(float)
    for _ in range(ROUNDS):
        near = _nearest(sample, centre, 1, True)[:, 0]
        sums = np.zeros_like(centre)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=lists)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
        if not squared_l2:
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def probes_for(sample: np.ndarray, centre: np.ndarray, squared_l2: bool) -> int:
    """The fewest lists to look into (a power of two, or all) for RECALL among the sample's own vectors."""
    asked = sample[np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)]
    true = np.argsort(_far(asked, sample, squared_l2), 1, kind="stable")[:, :AMONG]
    stands = _nearest(sample, centre, 2, squared_l2)
    order = np.argsort(_far(asked, centre, squared_l2), 1, kind="stable")
    place = np.argsort(order, 1)  # how early each query looks into each list
    first = np.take_along_axis(place, stands[true].reshape(len(asked), -1), 1).reshape(len(asked), true.shape[1], -1).min(2)
    probes = 1
    while probes < len(centre) and (first < probes).mean() < RECALL:
        probes *= 2
    return min(probes, len(centre))


def create(vectors: DataFrame, path: str | None = None, id_column: str = "vec_id", vector: str = "embedding", squared_l2: bool = False, lists: int | None = None) -> Lists:
    """Index all vectors at path (else in the shared folder); null vectors are left out. No vectors: ValueError.

    Centroids come from SAMPLE vectors chosen by a hash of their ids; their number is about the root of the number of vectors. Every vector
    is written to its two nearest lists. A task packs the vectors it reads into rows of some BLOCK of a list, or of what it has when it holds
    HELD_BYTES. These rows are dealt by list and joined to larger ones there, so that a list is about one file however many tasks read
    vectors; a list of very many is parted. vectors is read three times: it should be a table.
    """
    spark = vectors.sparkSession
    path = path or shared_path(spark, "vectors")
    own = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<float>").alias("v")).where("v is not null")
    n = own.count()
    if not n:
        raise ValueError("there are no vectors to index")
    share = min(1.0, 1.2 * SAMPLE / n)
    drawn = own.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(SAMPLE)
    chosen = drawn.select("v").toPandas()["v"].tolist() or [own.first()["v"]]
    sample = np.array(chosen, float)
    lists = min(lists or max(1, round(n**0.5)), LISTS, len(sample))
    centre = centroids(sample, lists, squared_l2)
    sent = spark.sparkContext.broadcast(centre)
    id_type = own.schema["id"].dataType
    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("vectors", T.BinaryType())])
    arrow = to_arrow_type(schema["ids"].dataType)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held, size, total = sent.value, {}, {}, 0

        def row(k: int) -> pa.RecordBatch:
            nonlocal total
            ids, rows = zip(*held.pop(k), strict=True)
            total -= size.pop(k)
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([[i for own in ids for i in own]], arrow), pa.array([np.concatenate(rows).tobytes()], pa.binary())], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            near, most = _nearest(v, centre, 2, squared_l2), HELD_BYTES // (4 * v.shape[1])
            of = np.repeat(np.arange(len(ids)), near.shape[1])
            order = np.argsort(near.ravel(), kind="stable")
            lists, begins = np.unique(near.ravel()[order], return_index=True)
            for k, at in zip(lists.tolist(), np.split(of[order], begins[1:]), strict=True):
                held.setdefault(k, []).append(([ids[i] for i in at.tolist()], v[at].astype("<f4")))
                size[k], total = size.get(k, 0) + len(at), total + len(at)
                if size[k] >= BLOCK:
                    yield row(k)
            if total >= most:
                for k in sorted(held):
                    yield row(k)
        for k in sorted(held):
            yield row(k)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a list follow each other, and become rows of up to BLOCK vectors and HELD_BYTES where they were smaller."""
        held, n, size = [], 0, 0

        def row() -> pa.RecordBatch:
            ids = pa.concat_arrays([x.values for _, x, _ in held])
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([b"".join(v for _, _, v in held)], pa.binary())], names=schema.names)

        for batch in batches:
            for k, ids, v in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if held and (k != held[0][0] or n + len(ids) > BLOCK or size + len(v) > HELD_BYTES):
                    yield row()
                    held, n, size = [], 0, 0
                held.append((k, ids, v))
                n, size = n + len(ids), size + len(v)
        if held:
            yield row()

    dealt = own.mapInArrow(pack, schema).hint("rebalance", F.col("list")).sortWithinPartitions("list")
    dealt.mapInArrow(join, schema).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    probes = probes_for(sample, centre, squared_l2)
    rows = [(i, [float(x) for x in c], squared_l2, probes) for i, c in enumerate(centre)]
    spark.createDataFrame(rows, "list int, centre array<double>, squared_l2 boolean, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return reopen(spark, path)


def reopen(spark: SparkSession, path: str) -> Lists | None:
    """The index at path; None if there is none."""
    try:
        rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["list"])
        return Lists(spark.read.parquet(f"{path}/lists"), np.array([r["centre"] for r in rows], float), rows[0]["squared_l2"], rows[0]["probes"])
    except AnalysisException:
        return None


def remove(spark: SparkSession, path: str) -> bool:
    """Drop the index at path; whether there was one."""
    return drop(spark, path)


def nearest(index: Lists, queries: DataFrame, k: int = 10, probes: int | None = None, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, doc, score, rank) from the `probes` lists nearest to each query (else as many as the index found to do), scored exactly; ties by doc.

    Only folders of probed lists are read. Queries go to all tasks in blocks of QUERY_BYTES, and a task keeps k rows a query and row of the
    index. As search.dense() scores: the inner product, or the squared distance, where lower is better.
    """
    spark = index.blocks.sparkSession
    wanted = queries.select(F.col(id_column).alias("id"), F.col(vector).cast("array<float>").alias("v")).where("v is not null")
    width, count = index.centroids.shape[1], wanted.count()
    n_blocks = max(1, -(-width * 8 * count // QUERY_BYTES))
    doc_type = index.blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query", wanted.schema["id"].dataType), T.StructField("doc", doc_type), T.StructField("score", T.DoubleType())])
    arrow = [to_arrow_type(f.dataType) for f in schema]
    found = None
    for b in range(n_blocks):
        block = wanted.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).toPandas()
        q = np.array(block["v"].tolist(), float).reshape(len(block), width)
        probed = _nearest(q, index.centroids, probes or index.probes, index.squared_l2)
        sent = spark.sparkContext.broadcast((block["id"].tolist(), q, probed))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, probed = sent.value
            for batch in batches:
                for i in range(batch.num_rows):
                    asking = np.flatnonzero((probed == batch.column("list")[i].as_py()).any(1))
                    if not len(asking):
                        continue
                    docs = batch.column("ids")[i].as_py()
                    v = np.frombuffer(batch.column("vectors")[i].as_py(), "<f4").reshape(len(docs), -1).astype(float)
                    step = max(1, CELLS // len(docs))
                    for own in (asking[a : a + step] for a in range(0, len(asking), step)):
                        score = np.round(_far(q[own], v, index_l2), 6)
                        keep = np.argsort(score, 1, kind="stable")
                        last = np.take_along_axis(score, keep[:, min(k, keep.shape[1]) - 1 : min(k, keep.shape[1])], 1)
                        at, of = np.nonzero(score <= last)  # with all that tie with the k-th
                        values = score[at, of] if index_l2 else -score[at, of]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([ids[i] for i in own[at].tolist()], [docs[i] for i in of.tolist()], values + 0.0), arrow, strict=True)], names=schema.names)

        index_l2 = index.squared_l2
        lists = sorted(set(probed.ravel().tolist()))
        hits = index.blocks.where(F.col("list").isin(lists)).select("list", "ids", "vectors").mapInArrow(scan, schema)
        found = hits if found is None else found.unionByName(hits)
    once = found.groupBy("query", "doc").agg(F.first("score").alias("score"))  # a vector stands in two lists
    return top(once, "query", k, F.asc("score") if index.squared_l2 else F.desc("score"), F.asc("doc"))
