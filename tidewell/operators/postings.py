"""Postings in blocks of documents, and the best documents of many questions by them, skipping what can't be among the best.

A block holds some thousand documents: its terms in order, and for each term the places of its documents and how often it
stands there, the highest impact first. A term's highest impact bounds what it can add to a score, so once a question
has k documents, terms that together can't lift a document over the k-th score aren't opened for new documents
(MaxScore), and a term that a document needs is read only as far as its impact is high enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

K1, B = 1.5, 0.75
#: Documents and tokens of a block at most; one text alone can have more tokens.
BLOCK_DOCS, BLOCK_TOKENS = 8_192, 1 << 20
#: (question, term) rows that are sent to all blocks at once; more take further passes.
ASKED_ROWS = 1_000_000
#: Scores are compared with bounds with so much to spare, since they are rounded.
SPARE = 1e-5


def impact(kind: str, tf: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
    """What one occurrence list entry adds to a score for weight 1: of BM25, or as a share of the document."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean)) if kind == "bm25" else tf / dl


def _schema(id_type: T.DataType) -> T.StructType:
    binary = [T.StructField(c, T.BinaryType()) for c in ("lengths", "ends", "places", "times")]
    return T.StructType([T.StructField("docs", T.ArrayType(id_type)), T.StructField("terms", T.ArrayType(T.StringType())), *binary])


def _small(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in 1, 2, 4 or 8 bytes each, after a byte that says so."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _ordered(term: np.ndarray, place: np.ndarray, times: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
    return np.lexsort((place, -impact("bm25", times.astype(float), dl[place].astype(float), mean), term))


def build(rows: DataFrame, path: str) -> None:
    """Write blocks of rows (doc, tokens) to path/blocks and (term, df, n, mean_length) to path/terms; n and mean_length alone to path/about.

    Each task packs the documents it reads, so no text moves. Blocks are written twice, since the order
    by impact needs the mean length.
    """
    spark, id_type = rows.sparkSession, rows.schema["doc"].dataType
    schema, arrow = _schema(id_type), to_arrow_type(_schema(id_type).fields[0].dataType)

    def packed(ids: list[pa.Array], tokens: list[pa.Array]) -> pa.RecordBatch:
        doc = pa.concat_arrays(ids)
        order = pc.sort_indices(pa.table({"doc": doc}), sort_keys=[("doc", "ascending")], null_placement="at_end")
        lists = pa.concat_arrays(tokens).take(order)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        flat = lists.flatten().cast(pa.string()).dictionary_encode()
        words = flat.dictionary.to_pylist()
        alphabetic = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words), np.int64)
        rank[alphabetic] = np.arange(len(words))
        key, times = np.unique(rank[flat.indices.to_numpy()] * len(doc) + np.repeat(np.arange(len(doc)), lengths), return_counts=True)
        term, place = np.divmod(key, max(1, len(doc)))
        ends = np.cumsum(np.bincount(term, minlength=len(words)))
        return pa.RecordBatch.from_arrays(
            [pa.array([doc.take(order).to_pylist()], arrow), pa.array([[words[i] for i in alphabetic]], pa.list_(pa.string()))] + [pa.array([_small(x)], pa.binary()) for x in (lengths, ends, place, times)], names=schema.names
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, n, size = [], [], 0, 0
        for batch in batches:
            sizes, at = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64), 0
            while at < batch.num_rows:
                fit = int(np.searchsorted(np.cumsum(sizes[at : at + BLOCK_DOCS - n]), BLOCK_TOKENS - size, "right"))
                if fit or not n:
                    part = batch.slice(at, max(1, fit))
                    ids.append(part.column(0))
                    tokens.append(part.column(1))
                    n, size, at = n + part.num_rows, size + int(sizes[at : at + part.num_rows].sum()), at + part.num_rows
                if not fit or n >= BLOCK_DOCS or size >= BLOCK_TOKENS:
                    yield packed(ids, tokens)
                    ids, tokens, n, size = [], [], 0, 0
        if n:
            yield packed(ids, tokens)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([terms.values, pa.array(np.diff(_wide(ends.as_py()), prepend=0))], names=["term", "df"])

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(x), int(x.sum())) for x in (_wide(y.as_py()) for y in batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["n", "total"])

    rows.select("doc", "tokens").mapInArrow(pack, schema).write.mode("overwrite").parquet(f"{path}/packed")
    blocks = spark.read.schema(schema).parquet(f"{path}/packed")
    n, total = blocks.select("lengths").mapInArrow(sized, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    if not n:
        raise ValueError("there are no documents to index")
    mean = total / n

    def by_impact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one block after the other: a batch can have very many
                row = batch.slice(i, 1)
                dl, ends, place, tf = (_wide(row.column(c)[0].as_py()) for c in ("lengths", "ends", "places", "times"))
                order = _ordered(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), place, tf, dl, mean or 1.0)
                yield pa.RecordBatch.from_arrays([*row.columns[:4], pa.array([_small(place[order])], pa.binary()), pa.array([_small(tf[order])], pa.binary())], names=schema.names)

    blocks.mapInArrow(by_impact, schema).write.mode("overwrite").parquet(f"{path}/blocks")
    df = blocks.select("terms", "ends").mapInArrow(counted, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df.write.mode("overwrite").parquet(f"{path}/terms")
    spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(mean).cast("double").alias("mean_length")).write.mode("overwrite").parquet(f"{path}/about")
    drop(spark, f"{path}/packed")


def drop(spark, path: str) -> bool:
    """Remove what stands at path in whatever store it is; whether anything did."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


class Block:
    """A block made ready for one kind of impact."""

    def __init__(self, row: dict, kind: str, mean: float) -> None:
        self.docs, self.n = row["docs"], len(row["docs"])
        dl, ends, self.places = (_wide(row[c]) for c in ("lengths", "ends", "places"))
        self.begins = np.concatenate(([0], ends)).astype(np.int64)
        self.impacts = impact(kind, _wide(row["times"]).astype(float), dl[self.places].astype(float), mean)
        if kind != "bm25":  # the order on disk is that of BM25
            order = np.lexsort((-self.impacts, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))))
            self.places, self.impacts = self.places[order], self.impacts[order]
        self.tops = self.impacts[self.begins[:-1]] if len(ends) else np.zeros(0)

    def scores(self, terms: np.ndarray, weights: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """Summed scores of all places for these terms, and how many postings that took; of wanted places only, if given."""
        sizes = self.begins[terms + 1] - self.begins[terms]
        at = np.arange(int(sizes.sum())) + np.repeat(self.begins[terms] - np.cumsum(sizes) + sizes, sizes)
        places, added = self.places[at], np.repeat(weights, sizes) * self.impacts[at]
        if wanted is not None:
            keep = wanted[places]
            places, added = places[keep], added[keep]
        return np.bincount(places, added, self.n), int(sizes.sum())

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: float, digits: int, zeros: bool) -> tuple[list[tuple[float, object]], int]:
        """(score, doc) of places that can be among a question's k best, whose k-th score so far is floor; and postings read.

        terms are the question's terms in this block, with their weights. Scores are rounded; with zeros, places without any term count as 0.
        """
        if floor <= 0 or not len(terms) or weights.min() < 0:
            if not len(terms) and (not zeros or floor > 0):
                return [], 0
            score, read = self.scores(terms, weights) if len(terms) else (np.zeros(self.n), 0)
            found = np.arange(self.n) if zeros else np.flatnonzero(score > 0)
        else:
            bounds = weights * self.tops[terms]
            order = np.argsort(-bounds)
            terms, weights, bounds = terms[order], weights[order], bounds[order]
            rest = np.append(np.cumsum(bounds[::-1])[::-1], 0.0)  # what the terms from here on can add
            if rest[0] < floor - SPARE:
                return [], 0
            # a document over the floor has at least this much of the first term: read as far as its impacts reach
            need = floor - SPARE - rest[1]
            if need > 0:
                begin, end = self.begins[terms[0]], self.begins[terms[0] + 1]
                reach = int(np.searchsorted(-weights[0] * self.impacts[begin:end], -need, "right"))
                score, read, opened = np.zeros(self.n), reach, 1
                score[self.places[begin : begin + reach]] = weights[0] * self.impacts[begin : begin + reach]
            else:
                opened = int(np.count_nonzero(rest[:-1] >= floor - SPARE))
                score, read = self.scores(terms[:opened], weights[:opened])
            while True:
                able = (score > 0) & (score + rest[opened] >= floor - SPARE)
                if opened == len(terms) or not able.any():
                    break
                more, took = self.scores(terms[opened : opened + 1], weights[opened : opened + 1], able)
                score, read, opened = np.where(able, score + more, 0.0), read + took, opened + 1
            found = np.flatnonzero(able)
        score = np.round(score[found], digits) + 0.0
        first = np.lexsort((found, -score))[:k]
        return [(float(s), self.docs[i]) for s, i in zip(score[first].tolist(), found[first].tolist(), strict=True)], read


def _key(hit: tuple[float, object]) -> tuple:
    return -hit[0], hit[1] is None, hit[1]


def search(blocks: DataFrame, asked: DataFrame, ids: DataFrame, k: int, kind: str, mean: float, digits: int, zeros: bool) -> DataFrame:
    """(query, doc, score) and, in rows without a doc, how many postings a task read for a query (score) and might have (doc is null, total).

    asked (query, term, weight) goes to all blocks in passes of ASKED_ROWS; ids (query) are all questions. A task keeps k documents a question.
    """
    spark, passes = blocks.sparkSession, max(1, -(-asked.count() // ASKED_ROWS))
    types = {"query": ids.schema["query"].dataType, "doc": blocks.schema["docs"].dataType.elementType}
    schema = T.StructType([T.StructField("query", types["query"]), T.StructField("doc", types["doc"]), T.StructField("score", T.DoubleType()), T.StructField("total", T.LongType())])
    arrow = [to_arrow_type(f.dataType) for f in schema]
    out = None
    for number in range(passes):
        mine = F.pmod(F.xxhash64("query"), F.lit(passes)) == number
        rows, own = asked.where(mine).toArrow(), sorted(r[0] for r in ids.where(mine).distinct().collect())
        place = {q: i for i, q in enumerate(own)}
        of = np.array([place[q] for q in rows.column("query").to_pylist()], np.int64)
        order = np.argsort(of, kind="stable")
        term = rows.column("term").combine_chunks().cast(pa.string()).dictionary_encode()
        cuts = np.searchsorted(of[order], np.arange(len(own) + 1))
        sent = spark.sparkContext.broadcast((own, term.dictionary, term.indices.to_numpy()[order], rows.column("weight").to_numpy()[order], cuts.tolist()))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, vocabulary, term, weight, cuts = sent.value
            best: list[list] = [[] for _ in own]
            read, total = [0] * len(own), [0] * len(own)
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "terms"}
                    block = Block(row, kind, mean)
                    there = pc.fill_null(pc.index_in(vocabulary, batch.column("terms")[i].values.cast(pa.string())), -1).to_numpy().astype(np.int64)[term]
                    for q in range(len(own)):
                        a, b = cuts[q], cuts[q + 1]
                        known = there[a:b] >= 0
                        terms = there[a:b][known]
                        floor = best[q][-1][0] if len(best[q]) == k else -1.0
                        hits, took = block.best(terms, weight[a:b][known], k, floor, digits, zeros)
                        read[q] += took
                        total[q] += int((block.begins[terms + 1] - block.begins[terms]).sum())
                        if hits:
                            best[q] = sorted(best[q] + hits, key=_key)[:k]
            found = [(q, d, s, None) for q, hits in zip(own, best, strict=True) for s, d in hits]
            found += [(q, None, float(r), t) for q, r, t in zip(own, read, total, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate(arrow)], names=schema.names)

        scored = blocks.mapInArrow(scan, schema)
        out = scored if out is None else out.unionByName(scored)
    return out


Words = Callable[[DataFrame, str], DataFrame]
