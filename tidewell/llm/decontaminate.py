"""Benchmark decontamination: a BM25 inverted index of test items with block maxima; every passage of every
text is a query, all items above the threshold are retrieved, and question and answer overlap verify them.

* Test items are cut into entries of at most HALF words. An entry's weights are its BM25 weights divided
  by their sum: so a passage that holds all its words scores 1, and one threshold suits all entries.
* Passages are windows of 2 * HALF words, HALF apart: any HALF words in a row lie inside one.
* Postings are sorted by entry; entries are numbered in blocks of BLOCK, and each term has its largest
  weight in each block. A passage's distinct terms sum these maxima block by block, and as in WAND only
  blocks whose bound reaches the threshold are opened and their entries scored. All passages of a text
  go through this side by side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.base import lots, map_batches, raw

HALF, BLOCK = 64, 8
K1, B, THRESHOLD, OVERLAP, GRAM = 1.2, 0.75, 0.6, 0.6, 3
#: Postings and bounds that are in memory at once while a text's passages are evaluated.
AT_ONCE = 1 << 21
#: Text bytes of the test items that one index holds and one broadcast sends; more items take more passes.
INDEX_BYTES = 16 << 20
#: Maps every byte outside words to a space and A-Z to a-z.
FOLD = bytes(32 if c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 128 else c + 32 if 65 <= c < 91 else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def grams(words: list[bytes], size: int = GRAM) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@dataclass
class Index:
    """number: of each term; entries: (item, question grams, answer grams).

    For term t, entry[at[t]:at[t+1]] and weight[...] are its postings, block[block_at[t]:...] and
    most[...] the blocks it is in with its largest weight there.
    """

    number: dict[bytes, int]
    entries: list[tuple[int, set, set]]
    at: np.ndarray
    entry: np.ndarray
    weight: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    most: np.ndarray


def build(items: list[tuple[int, bytes]]) -> Index:
    """The index of (item id, text). A question is an entry's first two thirds of words, its answer the rest.

    An entry too short for GRAM words in both is all question, and one gram of all its words.
    """
    parts, entries = [], []
    for item, text in items:
        words = words_of(text)
        n = -(-len(words) // HALF)
        for k in range(n):
            own = words[k * len(words) // n : (k + 1) * len(words) // n]
            middle = -(-2 * len(own) // 3)
            parts.append(Counter(own))
            entries.append((item, grams(own[:middle]), grams(own[middle:])) if len(own) - middle >= GRAM else (item, {tuple(own)}, set()))
    number = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
    df = np.bincount([number[w] for p in parts for w in p], minlength=len(number)) if parts else np.zeros(0)
    idf = np.log(1 + (len(parts) - df + 0.5) / (df + 0.5))
    mean = sum(p.total() for p in parts) / max(1, len(parts))
    rows = []
    for e, p in enumerate(parts):
        t = np.array([number[w] for w in p], np.int64)
        tf = np.array(list(p.values()), float)
        w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * p.total() / mean))
        rows.append((t, np.full(len(t), e), w / w.sum()))
    term, entry, weight = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, int) for i in range(3))
    order = np.lexsort((entry, term))
    term, entry, weight = term[order], entry[order], weight[order].astype(float)
    first = np.flatnonzero(np.diff(term * (len(parts) // BLOCK + 2) + entry // BLOCK, prepend=-1)) if len(term) else np.zeros(0, int)
    edges = np.arange(len(number) + 1)
    return Index(number, entries, np.searchsorted(term, edges), entry, weight, np.searchsorted(term[first], edges), entry[first] // BLOCK, np.maximum.reduceat(weight, first) if len(first) else weight)


def _spread(at: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the terms' slices of postings: every posting's place, and which of terms it belongs to."""
    n = at[terms + 1] - at[terms]
    of = np.repeat(np.arange(len(terms)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + at[terms][of], of


def retrieve(numbers: np.ndarray, index: Index, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, entry, score) of all that score threshold or more; numbers: the text's terms, -1 if in no item.

    Passages go through in runs of so many as need AT_ONCE postings and bounds, at least one.
    """
    n_windows, wide = max(1, -(-len(numbers) // HALF) - 1), len(index.number)
    n_blocks = len(index.entries) // BLOCK + 1
    place = np.flatnonzero(numbers >= 0)
    half, terms = place // HALF, numbers[place]
    keys = np.concatenate([w[ok] * wide + terms[ok] for w, ok in ((half, half < n_windows), (half - 1, half > 0))])
    keys = np.unique(keys)
    window, terms = keys // wide, keys % wide
    first = np.searchsorted(window, np.arange(n_windows + 1))
    needs = np.concatenate(([0], np.cumsum(index.at[terms + 1] - index.at[terms])))[first] + np.arange(n_windows + 1) * n_blocks
    found, a = [], 0
    while a < n_windows:
        b = max(a + 1, int(np.searchsorted(needs, needs[a] + AT_ONCE, "right")) - 1)
        own = slice(first[a], first[b])
        w, e, score = _retrieved(window[own] - a, terms[own], b - a, n_blocks, index, threshold)
        found.append((w + a, e, score))
        a = b
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _retrieved(window: np.ndarray, terms: np.ndarray, n_windows: int, n_blocks: int, index: Index, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, of = _spread(index.block_at, terms)
    bound = np.bincount(window[of] * n_blocks + index.block[at], index.most[at], n_windows * n_blocks)
    opened = bound >= threshold - 1e-9
    if not opened.any():
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    live = opened.reshape(n_windows, n_blocks).any(1)[window]
    window, terms = window[live], terms[live]
    at, of = _spread(index.at, terms)
    inside = opened[window[of] * n_blocks + index.entry[at] // BLOCK]
    pair, back = np.unique(window[of][inside] * len(index.entries) + index.entry[at][inside], return_inverse=True)
    score = np.bincount(back, index.weight[at][inside], len(pair))
    hit = score >= threshold - 1e-9
    return pair[hit] // len(index.entries), pair[hit] % len(index.entries), score[hit]


def share(part: set, there: set) -> float:
    return len(part & there) / len(part) if part else 1.0


def matches(text: bytes, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> dict[int, tuple[float, float, float]]:
    """For each item that the text holds: the best entry's score, question overlap and answer overlap."""
    words = words_of(text)
    get = index.number.get
    found: dict[int, tuple[float, float, float]] = {}
    if not words or not index.entries:
        return found
    for w, e, score in zip(*(x.tolist() for x in retrieve(np.array([get(x, -1) for x in words], np.int64), index, threshold)), strict=True):
        item, question, answer = index.entries[e]
        there = grams(words[w * HALF : (w + 2) * HALF], len(next(iter(question))))
        row = (score, share(question, there), share(answer, there))
        if min(row[1:]) >= overlap and row > found.get(item, (0.0, 0.0, 0.0)):
            found[item] = row
    return found


FIELDS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())])


def indexes(benchmark: DataFrame, item_id: str, text: str) -> Iterator:
    """Broadcast indexes of all items, each of about INDEX_BYTES of texts at most; one for a usual benchmark."""
    spark = benchmark.sparkSession
    own = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")).where("text is not null")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // INDEX_BYTES))
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text").collect()
        yield spark.sparkContext.broadcast(build([(r.item, r.text.encode()) for r in rows]))


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, score, question_overlap, answer_overlap): each test item that each whole text holds.

    An item counts if one of its entries is retrieved and both its parts' word trigrams are found to at least
    OVERLAP in the passage; items of fewer than 9 words, if all their words stand there in a row. Null and
    empty texts and items match nothing. Repeated documents each have their rows; an item id that stands twice
    counts once. Empty tables give no rows.
    """
    out = None
    for sent in indexes(benchmark, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                rows = [(i, item, *v) for i, x in zip(batch.column(0), raw(batch.column(1)), strict=True) for item, v in matches(x, index).items()]
                kinds = [batch.column(0).type, pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k].as_py() if k == 0 else r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=schema.names)

        own = docs.select(F.col(id_column), F.col(text))
        schema = T.StructType([own.schema[0], *FIELDS])
        found = own.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without those that hold a test item; whole rows, all columns, in one pass over the texts."""
    for sent in indexes(benchmark, item_id, item_text):
        at = docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at: int = at) -> Iterator[pa.RecordBatch]:
            for lot in (x for batch in batches for x in lots(batch, at)):
                yield lot.filter(pa.array([not matches(x, sent.value) for x in raw(lot.column(at))], pa.bool_()))

        docs = map_batches(docs, run, docs.schema)
    return docs
