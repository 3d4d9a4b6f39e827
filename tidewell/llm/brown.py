"""Brown class n-grams: exchange clustering puts words into classes; class transitions and word
emissions, both smoothed, give the log10 probability of whole texts.

Every word that makes up SHARE or more of the training tokens is exchanged by itself (so there are 1 / SHARE at
most, whatever the corpus). Every other word belongs to one of FORMS forms, by its ending and its marks, and a form is
exchanged like a word. So each word has a class, learnt from the corpus, as a word and as the history of the next.

* Bigrams of items (words and forms) are counted in tasks, packed as sorted numbers, and merged in buckets of items.
* Items of a part are tried side by side against one table of class bigrams, by their own neighbours' classes; a part's
  moves are kept only if the recomputed likelihood rises; else the better half of them is tried. Passes go on until one
  of them gains next to nothing.
* Then every other training word is exchanged by itself (op5 asks for it). Texts stay in lots as items; a lot's other words go to
  buckets of words, packed, and their classes come back, so that class bigrams and scores are of each word's own class.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.base import cut, freed, raw, shared_path

#: Words of this share of all training tokens, and LEAST occurrences, are items of their own; others are known by form.
SHARE, LEAST, FORMS, CLASSES = 2.0**-15, 2, 4_096, 48
#: Parts that are tried against the same table, buckets of items, tasks that share them at least and bytes of bigrams for each, and bigrams a task
#: holds before it folds them.
PARTS, BUCKETS, TASKS, TASK_BYTES, FOLD = 4, 256, 16, 64 << 20, 4 << 20
#: Words whose items a task remembers, and bytes of texts it numbers at once.
KNOWN, TEXT_BYTES = 200_000, 2 << 20
#: Bytes of texts in a lot; training tokens for each bucket of words that aren't listed, and buckets at least.
LOT_BYTES, BUCKET_TOKENS, LEAST_WORD_BUCKETS = 1 << 20, 2 << 20, 64
#: Such words whose gains are found at once, counts of neighbours up to which gains are looked up, and bins of gains.
AT_ONCE, STEPS, GAIN_BINS = 4_096, 4, 512
#: A pass that raises the likelihood by less than this share of it is the last.
LEAST_GAIN = 1e-4
#: No word holds white space, so this stands for the end of a text.
END = b"\n"
ADD, PRIOR = 0.1, 20.0
MARKS = b".,;:!?%$*#&|"


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def form(word: bytes) -> int:
    """The form of a word: its last three bytes before marks at its end, and the first two of those marks."""
    core = word.rstrip(MARKS)
    return zlib.crc32(b"%b|%b" % (word[len(core) :][:2], core[-3:])) % FORMS


def word_counts(train: DataFrame, text: str) -> DataFrame:
    """(word binary, n): every batch of texts is counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for x in raw(batch.column(0)):
                found.update(tokens(x))
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    return train.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Numbers:
    """Words to items: listed words from 0, then the end, then forms. Items of other words are remembered, up to KNOWN of them."""

    def __init__(self, listed: list[bytes]) -> None:
        self.of = {w: i for i, w in enumerate(listed)}
        self.end = self.of[END] = len(listed)
        self.size = len(listed) + 1 + FORMS
        self.items = Items(self.of, self.end + 1)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.items.__getitem__, words), np.int64, len(words))


class Items(dict):
    def __init__(self, of: dict[bytes, int], first_form: int) -> None:
        super().__init__(of)
        self.first_form = first_form

    def __missing__(self, word: bytes) -> int:
        item = self.first_form + form(word)
        if len(self) < KNOWN:
            self[word] = item
        return item

    def __reduce__(self):
        return Items, ({w: i for w, i in self.items() if i < self.first_form}, self.first_form)


def _folded(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def _rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Bigrams (a << 16 | b) in a row for each bucket of their first items."""
    bucket = (keys >> 16) % BUCKETS
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[k] : cuts[k + 1]]
        n = counts[own]
        kind = np.min_scalar_type(int(n.max()))
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([keys[own].astype("<u4").tobytes()], pa.binary()), pa.array([kind.itemsize], pa.int32()), pa.array([n.astype(kind).tobytes()], pa.binary())], names=["bucket", "pairs", "width", "n"])


def _read(pairs: bytes, width: int, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(pairs, "<u4").astype(np.int64), np.frombuffer(n, f"<u{width}").astype(np.int64)


def parts_of(texts: list[bytes], bytes_at_once: int = TEXT_BYTES) -> Iterator[tuple[list[bytes], int]]:
    """Neighbouring texts of about so many bytes together, and where they begin."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= bytes_at_once or i + 1 == len(texts):
            yield texts[start : i + 1], start
            start, size = i + 1, 0


def sequence(texts: list[bytes], numbers: Numbers) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of texts, one after the other: themselves, their items, the items before them (an end at first), and their texts."""
    words = [tokens(x) for x in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = list(chain.from_iterable(words))
    at = numbers(flat)
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[np.cumsum(sizes) - sizes] = numbers.end
    return flat, at, before, np.repeat(np.arange(len(texts)), sizes)


PACKED = "bucket int, pairs binary, width int, n binary"


def merged(rows: DataFrame, turned: bool) -> DataFrame:
    """Packed bigrams, each once; turned: by their second items, with those in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            for k, w, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                pairs, often = _read(k, w, n)
                keys.append(pairs)
                counts.append(often)
                if sum(map(len, keys)) > 2 * max(len(keys[0]), FOLD):
                    keys, counts = ([x] for x in _folded(keys, counts))
        if keys:
            pairs, often = _folded(keys, counts)
            yield from _rows((pairs & 65535) << 16 | pairs >> 16 if turned else pairs, often)

    return rows.mapInArrow(run, PACKED)


def bigrams(lots: DataFrame, end: int) -> DataFrame:
    """(bucket, side, pairs, width, n): how often an item of the bucket is followed (side 0) and preceded (side 1) by which, in training texts.

    Texts begin after an end. At most (1 / SHARE + FORMS + 1)^2 pairs a side, in packed rows, in the shared folder.
    """
    spark = lots.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            for texts, _ in parts_of(batch.column(0).to_pylist(), LOT_BYTES):
                at = np.frombuffer(b"".join(texts), "<u2").astype(np.int64)  # each text ends with an end
                found, n = np.unique(np.append(end, at[:-1]) << 16 | at, return_counts=True)
                keys.append(found)
                counts.append(n)
                if sum(map(len, keys)) > 2 * max(len(keys[0]), FOLD):
                    keys, counts = ([x] for x in _folded(keys, counts))
        if keys:
            yield from _rows(*_folded(keys, counts))

    path = shared_path(spark, "bigrams")
    merged(lots.where("bucket is null and not held_out").select("items").mapInArrow(run, PACKED).repartition("bucket"), False).write.parquet(path)
    right = spark.read.schema(PACKED).parquet(path)
    left = merged(merged(right, True).repartition("bucket"), False)
    return right.withColumn("side", F.lit(0)).unionByName(left.withColumn("side", F.lit(1)))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """What the log likelihood of the class bigrams depends on by the choice of classes."""
    t = table.astype(float)
    return float(_f(t).sum() - _f(t.sum(0)).sum() - _f(t.sum(1)).sum())


def best_class(own: int, right: np.ndarray, left: np.ndarray, self_n: int, table: np.ndarray, classes: int) -> tuple[int, float]:
    """The class that a word fits best, and how much the likelihood gains by the move.

    right, left: how often the word is followed and preceded by each class, itself left out; table: class
    bigrams, the word still in its own class. A class's totals keep its bigrams into the word.
    """
    t = table.astype(float)
    after, before = t.sum(1), t.sum(0)
    n_after, n_before = float(right.sum() + self_n), float(left.sum() + self_n)
    after[own] -= n_after
    before[own] -= n_before
    t[own] -= right
    t[:, own] -= left
    t[own, own] -= self_n
    now, d = _f(t), np.diag(t)
    rows, columns = _f(t + right).sum(1) - now.sum(1), _f(t + left[:, None]).sum(0) - now.sum(0)
    corner = _f(d + right + left + self_n) - _f(d + right) - _f(d + left) + _f(d)
    gain = rows + columns + corner - (_f(after + n_after) - _f(after)) - (_f(before + n_before) - _f(before))
    best = int(np.argmax(gain[:classes]))
    return best, float(gain[best] - gain[own])


def cluster(pairs: DataFrame, items: int, end: int, classes: int, first: np.ndarray, passes: int | None = None, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each item, class bigrams) after exchange over bigrams(); the end keeps a class of its own, the last.

    first: the classes to begin with. A task has the neighbours of some buckets of items; what it sends back are moves, one an item at
    most, and class bigrams. Without passes, they go on until one gains less than LEAST_GAIN.
    """
    wide = classes + 1
    of = np.where(np.arange(items) == end, classes, first).astype(np.int64)
    rows = cut(pairs.repartition("bucket").sortWithinPartitions("bucket", "side"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("pairs")), F.lit(0))).first()[0]
    rows = rows.coalesce(max(TASKS, -(-size // TASK_BYTES)))  # a round over little data isn't worth a task for each shuffle partition

    def table_of(of: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(wide * wide)
            for batch in batches:
                for p, w, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    keys, often = _read(p, w, n)
                    found += np.bincount(of[keys >> 16] * wide + of[keys & 65535], often, wide * wide)
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at].astype(np.int64))], names=["at", "n"])

        found = np.zeros(wide * wide, np.int64)
        for at, n in rows.where("side = 0").select("pairs", "width", "n").mapInArrow(run, "at long, n long").collect():
            found[at] += n
        return found.reshape(wide, wide)

    def moves(of: np.ndarray, table: np.ndarray, part: int) -> list[tuple[int, int]]:
        def of_bucket(sides: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, float]]:
            none = np.zeros(0, np.int64), np.zeros(0, np.int64)
            keys = [sides.get(s, none) for s in (0, 1)]
            own = np.unique(np.concatenate([k >> 16 for k, _ in keys]))
            own = own[(own // BUCKETS % parts == part) & (own != end)]
            near = []
            for k, n in keys:
                at = np.searchsorted(own, k >> 16)
                here = (at < len(own)) & (k >> 16 != k & 65535)
                here[here] = own[at[here]] == (k >> 16)[here]
                near.append(np.bincount(at[here] * wide + of[k[here] & 65535], n[here], len(own) * wide).reshape(len(own), wide))
            k, n = keys[0]
            alone = dict(zip((k >> 16)[k >> 16 == k & 65535].tolist(), n[k >> 16 == k & 65535].tolist(), strict=True))
            found = []
            for i, w in enumerate(own.tolist()):
                to, gain = best_class(int(of[w]), near[0][i], near[1][i], alone.get(w, 0), table, classes)
                if gain > 1e-6:
                    found.append((w, to, gain))
            return found

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moved, sides, now = [], {}, None
            for batch in batches:
                for bucket, p, w, n, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if bucket != now:
                        moved += of_bucket(sides)
                        sides, now = {}, bucket
                    sides[side] = _read(p, w, n)
            moved += of_bucket(sides)
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in moved], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["word", "to", "gain"])

        found = rows.select("bucket", "pairs", "width", "n", "side").mapInArrow(run, "word long, to long, gain double").collect()
        return [(w, to) for w, to, _ in sorted(found, key=lambda m: (-m[2], m[0]))]

    table, done = table_of(of), 0
    while classes > 1 and (passes is None or done < passes):
        at_first = likelihood(table)
        for part in range(parts):
            moved = moves(of, table, part)
            while moved:
                new = of.copy()
                new[[w for w, _ in moved]] = [to for _, to in moved]
                found = table_of(new)
                if likelihood(found) > likelihood(table):
                    of, table = new, found
                    break
                moved = moved[: len(moved) // 2]
        done += 1
        if likelihood(table) - at_first <= LEAST_GAIN * abs(at_first):
            break
    return of, table


@dataclass
class Model:
    """What tasks need to score: items, counts of listed words and the end, classes, log10 of class transitions and of classes' masses.

    The last column of steps is that of words never seen. The mass of a class without any history is that of its words in
    the unigrams, so that both agree there.
    """

    numbers: Numbers
    count: np.ndarray
    class_of: np.ndarray
    steps: np.ndarray
    mass: np.ndarray
    n: int
    n_distinct: int
    follows: np.ndarray

    @property
    def whole(self) -> float:
        return self.n + ADD * (self.n_distinct + 1)


def train_model(train: DataFrame, text: str) -> tuple[Model, DataFrame]:
    """The model by forms, and (word, n) of all training words that aren't listed."""
    found = listing(train, text)
    lots = encoded(train.select(F.lit(0).alias("id"), F.lit(False).alias("held_out"), F.col(text).alias("text")), found)
    return learnt(lots, found), found.rare


@dataclass
class Listing:
    """Words to items, counts of listed words and of the end, (word, n) of other training words, all training tokens and distinct ones."""

    numbers: Numbers
    count: np.ndarray
    rare: DataFrame
    n: int
    n_distinct: int


def listing(train: DataFrame, text: str) -> Listing:
    spark, path = train.sparkSession, shared_path(train.sparkSession, "counts")
    word_counts(train, text).write.parquet(path)
    counts = spark.read.schema("word binary, n long").parquet(path)
    n, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(LEAST, math.ceil(n * SHARE))
    rows = counts.where((F.col("n") >= least) | (F.col("word") == F.lit(END))).collect()  # 1 / SHARE at most, and the end
    known = {bytes(w): k for w, k in rows}
    listed = sorted((w for w in known if w != END), key=lambda w: (-known[w], w))
    count = np.array([*(known[w] for w in listed), known.get(END, 0)], np.int64)
    return Listing(Numbers(listed), count, counts.where((F.col("n") < least) & (F.col("word") != F.lit(END))), n, distinct)


def learnt(lots: DataFrame, found: Listing) -> Model:
    """Listed words and forms after exchange; other words have the class of their form."""
    numbers, count = found.numbers, found.count

    def by_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(FORMS, np.int64), np.zeros(FORMS, np.int64)
        for batch in batches:
            at = np.array([form(w) for w in batch.column(0).to_pylist()], np.int64)
            total += np.bincount(at, batch.column(1).to_numpy(), FORMS).astype(np.int64)
            words += np.bincount(at, minlength=FORMS)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(words[at])], names=["form", "total", "words"])

    sizes, words = np.zeros(numbers.size, np.int64), np.zeros(numbers.size, np.int64)
    sizes[: len(count)], words[: len(count)] = count, count > 0
    for f, k, d in found.rare.mapInArrow(by_form, "form long, total long, words long").groupBy("form").agg(F.sum("total"), F.sum("words")).collect():
        sizes[numbers.end + 1 + f], words[numbers.end + 1 + f] = k, d
    first = np.empty(numbers.size, np.int64)
    first[np.argsort(-sizes, kind="stable")] = np.arange(numbers.size) % CLASSES  # each class gets frequent and rare items
    of, follows = cluster(bigrams(lots, numbers.end), numbers.size, numbers.end, CLASSES, first)
    mass = np.append(np.bincount(of, sizes + ADD * words, CLASSES + 1), ADD)  # the last class is that of words never seen
    return Model(numbers, count, of, steps_of(follows, mass[:-1]), mass, found.n, found.n_distinct, follows)


def steps_of(follows: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """log10 of the steps from each class to each, and to words never seen."""
    seen, unseen = mass / max(ADD, mass.sum()), ADD / (mass.sum() + ADD)
    steps = (1 - unseen) * (follows + PRIOR * seen) / (follows.sum(1, keepdims=True) + PRIOR)
    return np.log10(np.maximum(1e-300, np.column_stack((steps, np.full(len(steps), unseen)))))


def encoded(docs: DataFrame, found: Listing) -> DataFrame:
    """docs (id, held_out, text) in lots of neighbouring texts, written as one table, whose rows are of two kinds.

    A text: its lot, id, held_out, items, and for each word that isn't listed its place among the lot's such words. A bucket of those
    words (bucket not null): its words in the order of their places, and how many.
    """
    spark = docs.sparkSession
    sent, buckets = spark.sparkContext.broadcast(found.numbers), max(LEAST_WORD_BUCKETS, found.n // BUCKET_TOKENS)
    schema = T.StructType([T.StructField("lot", T.LongType()), T.StructField("bucket", T.IntegerType()), docs.schema["id"], docs.schema["held_out"]])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema] + [T.StructField(c, T.BinaryType()) for c in ("items", "places", "words")] + [T.StructField("size", T.IntegerType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value
        lot = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, start in parts_of(raw(batch.column(2)), LOT_BYTES):
                words, items, _, of = sequence(part, numbers)
                others = np.flatnonzero(items > numbers.end)
                rare = [words[k] for k in others.tolist()]
                distinct = list(dict.fromkeys(rare))
                bucket = np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct)) % buckets
                order = np.argsort(bucket, kind="stable")
                place = dict(zip([distinct[k] for k in order.tolist()], range(len(order)), strict=True))
                own = np.fromiter(map(place.__getitem__, rare), np.int64, len(rare))
                cuts, rare_cuts = (np.searchsorted(x, np.arange(len(part) + 1)) for x in (of, of[others]))
                ids, held = (batch.column(i).slice(start, len(part)) for i in (0, 1))
                cells = [pa.array(np.full(len(part), lot)), pa.nulls(len(part), kinds[1]), ids, held, _slices(items.astype("<u2"), cuts), _slices(_small(own, len(place)), rare_cuts)]
                yield pa.RecordBatch.from_arrays([*cells, *(pa.nulls(len(part), k) for k in kinds[6:])], names=schema.names)
                if place:
                    listed = list(place)
                    kept, first = np.unique(bucket[order], return_index=True)
                    ends = np.append(first, len(order))
                    cells = [pa.array(np.full(len(kept), lot)), pa.array(kept, kinds[1]), *(pa.nulls(len(kept), k) for k in kinds[2:6])]
                    cells += [pa.array([b" ".join(listed[i:j]) for i, j in zip(ends, ends[1:], strict=False)], pa.binary()), pa.array(np.diff(ends), kinds[7])]
                    yield pa.RecordBatch.from_arrays(cells, names=schema.names)
                lot += 1

    path = shared_path(spark, "lots")
    docs.select("id", "held_out", "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _small(places: np.ndarray, n: int) -> np.ndarray:
    return places.astype("<u2" if n <= 1 << 16 else "<u4")


def _slices(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of values between neighbouring cuts."""
    ends = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def contexts(classes: np.ndarray, at: np.ndarray, place: np.ndarray, wide: int) -> np.ndarray:
    """The classes before and behind each token in at, as one number; wide stands for the word itself. Every text ends with an end, so each token there has a next one."""
    end = wide - 1
    whole = np.full(len(classes), -1)
    whole[at] = place
    left, right = classes[at - 1], classes[at + 1]
    left[at == 0] = end
    left = np.where((at > 0) & (whole[at - 1] == place), wide, left)
    return left * (wide + 1) + np.where(whole[at + 1] == place, wide, right)


def by_bucket(place: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times of each place, codes in the order of places, their cuts between buckets); bucket i has the places from ends[i] to ends[i + 1]."""
    times = np.bincount(place, minlength=ends[-1])
    cuts = np.append(0, np.cumsum(times))[ends]
    return times.astype(np.min_scalar_type(int(times.max()))), codes[np.argsort(place, kind="stable")].astype("<u2"), cuts


def _counts(cell: bytes, size: int) -> np.ndarray:
    """So many whole numbers of one width."""
    return np.frombuffer(cell, f"<u{len(cell) // size}").astype(np.int64)


def best_classes(own: np.ndarray, right: np.ndarray, left: np.ndarray, self_n: np.ndarray, table: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """What best_class says of each of many words (rows of right and left), by the class bigrams that each of them touches."""
    t, words = table.astype(float), np.arange(len(own))
    gain = np.zeros((len(own), classes))

    def side(near: np.ndarray, other: np.ndarray, t: np.ndarray) -> None:
        """t: class bigrams by the neighbour's class and the word's. As if the word weren't in its own class, and then what that changes."""
        to = t[:, :classes]
        for k in range(1, min(STEPS, near.max(initial=0)) + 1):
            gain[:] += (near == k).astype(float) @ (_f(to + k) - _f(to))
        w, j = np.nonzero(near > STEPS)
        if len(w):
            first = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[first]] += np.add.reduceat(_f(to[j] + near[w, j][:, None]) - _f(to[j]), first)
        w, j = np.nonzero(near)
        k, o = near[w, j].astype(float), own[w]
        now = t[j, o]
        less = now - k - np.where(j == o, other[w, o] + self_n[w], 0)
        gain[words, own] += np.bincount(w, _f(less + k) - _f(less) - _f(now + k) + _f(now), len(own))
        m = np.flatnonzero(near[words, own])
        w, c = np.nonzero(other[m, :classes])
        w = m[w]
        w, c = w[c != own[w]], c[c != own[w]]
        k, now = near[w, own[w]], t[own[w], c]
        less = now - other[w, c]
        gain[w, c] += _f(less + k) - _f(less) - _f(now + k) + _f(now)

    side(right, left, t.T)
    side(left, right, t)
    m = np.flatnonzero((self_n > 0) | ((right > 0) & (left > 0)).any(1))
    r, n_left, s, d = right[m, :classes], left[m, :classes], self_n[m, None], np.repeat(np.diag(t)[None, :classes], len(m), 0)
    d[np.arange(len(m)), own[m]] -= right[m, own[m]] + left[m, own[m]] + self_n[m]
    gain[m] += _f(d + r + n_left + s) - _f(d + r) - _f(d + n_left) + _f(d)
    for sums, n in ((t.sum(1), right.sum(1) + self_n), (t.sum(0), left.sum(1) + self_n)):
        often, kind = np.unique(n, return_inverse=True)
        more = _f(sums[:classes] + often[:, None]) - _f(sums[:classes])
        gain -= more[kind]
        gain[words, own] += more[kind, own] - _f(sums[own]) + _f(sums[own] - n)
    best = gain.argmax(1)
    return best, gain[words, best] - gain[words, own]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Sorted rows by their first column."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=itemgetter(0))


def moves_of(cls: np.ndarray, number: np.ndarray, codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best class, its gain) of each word, whose contexts are codes, sorted by word. Words of one class that stand once, in the same context, are asked once."""
    wide = len(table)
    times = np.bincount(number, minlength=len(cls))
    once = np.flatnonzero(times == 1)
    _, at, back = np.unique(cls[once] * (wide + 1) ** 2 + codes[np.searchsorted(number, once)], return_index=True, return_inverse=True)
    like = np.arange(len(cls))
    like[once] = once[at[back]]
    asked = np.flatnonzero((times > 0) & (like == np.arange(len(cls))))
    to, gain = cls.copy(), np.zeros(len(cls))
    is_asked = np.zeros(len(cls), bool)
    is_asked[asked] = True
    number, codes = np.searchsorted(asked, number[is_asked[number]]), codes[is_asked[number]]
    for k in range(0, len(asked), AT_ONCE):
        some = asked[k : k + AT_ONCE]
        i, j = np.searchsorted(number, (k, k + AT_ONCE))
        left, right = (np.bincount((number[i:j] - k) * (wide + 1) + c, minlength=len(some) * (wide + 1)).reshape(len(some), wide + 1) for c in np.divmod(codes[i:j], wide + 1))
        to[some], gain[some] = best_classes(cls[some], right[:, :wide], left[:, :wide], right[:, wide], table, wide - 1)
    return to[like], gain[like]


def fitted(rows: DataFrame, model: Model, table: np.ndarray, least: float, path: str) -> DataFrame:
    """Every word that isn't listed moves to its best class, if that gains more than least.

    rows (bucket, lot, words, times, codes, numbers, cls, n): what a lot says of a bucket, in one row or more: how often each word stands in training, and
    between which classes; the first time its words, later their numbers in the bucket, and lot -1 has the classes and counts so far. A word begins
    in the class of its form. The result, written as one table: (bucket, lot, cls), the first time with numbers and n, and in lot -1 n, gains (of the moves) and mass (of classes).
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((model.class_of, model.numbers.end + 1, table))
    wide = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, first_form, table = sent.value
        for bucket, group in _grouped(batches):
            lots: dict[int, dict[str, bytes]] = {}
            for _, lot, *cells in group:
                lots.setdefault(lot, {}).update((k, x) for k, x in zip(("words", "times", "codes", "numbers", "cls", "n"), cells, strict=True) if x is not None)
            before = lots.pop(-1, None)
            if before is None:
                place: dict[bytes, int] = {}
                numbers = {lot: np.array([place.setdefault(w, len(place)) for w in x.pop("words").split(b" ")], "<u4") for lot, x in lots.items()}
                cls = class_of[np.array([first_form + form(w) for w in place], np.int64)]
                del place
            else:
                numbers = {lot: np.frombuffer(x["numbers"], "<u4") for lot, x in lots.items()}
                cls = np.frombuffer(before["cls"], "u1").astype(np.int64)
            number = np.concatenate([np.repeat(numbers[lot], _counts(x["times"], len(numbers[lot]))) if "times" in x else numbers[lot][:0] for lot, x in lots.items()]).astype(np.int64)
            codes = np.concatenate([np.frombuffer(x.get("codes", b""), "<u2") for x in lots.values()]).astype(np.int64)
            n = np.bincount(number, minlength=len(cls)) if before is None else np.frombuffer(before["n"], "<u4").astype(np.int64)
            gains = np.zeros(GAIN_BINS, np.int64)
            if least < math.inf:
                order = np.argsort(number, kind="stable")
                number, codes = number[order], codes[order]
                to, gain = moves_of(cls, number, codes, table)
                m = gain > least
                cls = np.where(m, to, cls)
                gains += np.bincount(gain_bin(gain[m]), minlength=GAIN_BINS)
            mass = np.bincount(cls[n > 0], n[n > 0] + ADD, wide)
            small = cls.astype("u1")
            cells = [(bucket, lot, None, small[i].tobytes(), None, None, None) for lot, i in numbers.items()]
            if before is None:
                cells = [(bucket, lot, i.tobytes(), cls, n[i].astype(np.min_scalar_type(int(n[i].max()))).tobytes(), None, None) for (_, lot, _, cls, *_), i in zip(cells, numbers.values(), strict=True)]
            cells.append((bucket, -1, None, small.tobytes(), n.astype("<u4").tobytes(), gains.tobytes(), mass.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells, strict=True), [pa.int32(), pa.int64(), *[pa.binary()] * 5], strict=True)], names=["bucket", "lot", "numbers", "cls", "n", "gains", "mass"])

    schema = "bucket int, lot long, numbers binary, cls binary, n binary, gains binary, mass binary"
    rows.select("bucket", "lot", "words", "times", "codes", "numbers", "cls", "n").repartition("bucket").sortWithinPartitions("bucket", "lot").mapInArrow(run, schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def gain_bin(gain: np.ndarray) -> np.ndarray:
    """Eight bins for each doubling, from 2^-24 up to 2^40."""
    return np.clip(np.floor(8 * (np.log2(gain) + 24)), 0, GAIN_BINS - 1).astype(np.int64)


def _met(lots: DataFrame, known: DataFrame, texts: list[str]) -> DataFrame:
    """The texts of each lot behind what is known of its words (cls, n, size), by bucket, so that places count through the lot."""
    few = lots.where("bucket is null").select("lot", "bucket", *texts)
    rows = known.where("lot >= 0").unionByName(few, allowMissingColumns=True)
    return rows.repartition("lot").sortWithinPartitions("lot", F.col("bucket").asc_nulls_last()).select(*known.columns, *texts)


@dataclass
class Lot:
    """A lot's tokens one after the other: items, classes, texts, classes before; which aren't listed, and their places; counts by place."""

    items: np.ndarray
    cls: np.ndarray
    of: np.ndarray
    before: np.ndarray
    others: np.ndarray
    place: np.ndarray
    n: np.ndarray


def read_lot(known: list[bytes], counts: list[bytes], size: int, texts: list[tuple[bytes, bytes]], class_of: np.ndarray, end: int) -> Lot:
    """known, counts: classes and counts of the lot's words, size in all, by bucket, if any are known; texts: (items, places) cells."""
    items = np.frombuffer(b"".join(x for x, _ in texts), "<u2").astype(np.int64)
    place = np.frombuffer(b"".join(x for _, x in texts), "<u2" if size <= 1 << 16 else "<u4").astype(np.int64)
    sizes = np.array([len(x) // 2 for x, _ in texts], np.int64)
    cls, others = class_of[items], np.flatnonzero(items > end)
    if known:
        cls[others] = np.frombuffer(b"".join(known), "u1")[place]
    before = np.empty_like(cls)
    before[1:] = cls[:-1]
    before[np.cumsum(sizes) - sizes] = class_of[end]
    n = np.concatenate([_counts(c, len(k)) for c, k in zip(counts, known, strict=True)]) if counts else np.zeros(0, np.int64)
    return Lot(items, cls, np.repeat(np.arange(len(texts)), sizes), before, others, place, n)


def measured(lots: DataFrame, known: DataFrame | None, model: Model, path: str) -> tuple[np.ndarray, DataFrame]:
    """(class bigrams of the training texts, (bucket, lot, times, codes) of their words that aren't listed) by the classes in known, or by forms."""
    spark = lots.sparkSession
    sent, wide = spark.sparkContext.broadcast((model.class_of, model.numbers.end)), CLASSES + 1
    names, kinds = ["bucket", "lot", "times", "codes", "bigrams"], [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (class_of, end), table = sent.value, np.zeros(wide * wide, np.int64)
        for lot, group in _grouped(batches):
            buckets, sizes, found, texts = [], [0], [], []
            for _, bucket, cls, size, items, places in group:
                if bucket is None:
                    texts.append((items, places))
                else:
                    buckets.append(bucket)
                    sizes.append(len(cls) if size is None else size)
                    found += [] if cls is None else [cls]
            if not texts:
                continue
            ends = np.cumsum(sizes)
            x = read_lot(found, [], int(ends[-1]), texts, class_of, end)
            table += np.bincount(x.before * wide + x.cls, minlength=wide * wide)
            if buckets:
                times, codes, cuts = by_bucket(x.place, contexts(x.cls, x.others, x.place, wide), ends)
                yield pa.RecordBatch.from_arrays([pa.array(buckets, kinds[0]), pa.array([lot] * len(buckets), kinds[1]), _slices(times, ends), _slices(codes, cuts), pa.nulls(len(buckets), kinds[4])], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, None, None, None, table.tobytes()), kinds, strict=True)], names=names)

    schema = "bucket int, lot long, times binary, codes binary, bigrams binary"
    if known is None:
        known = lots.where("bucket is not null").select("lot", "bucket", F.lit(None).cast("binary").alias("cls"), "size")
    else:
        known = known.select("lot", "bucket", "cls", F.lit(None).cast("int").alias("size"))
    _met(lots.where("not held_out"), known, ["items", "places"]).mapInArrow(run, schema).write.mode("overwrite").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    table = np.zeros(wide * wide, np.int64)
    for row in found.where("bigrams is not null").select("bigrams").toLocalIterator():
        table += np.frombuffer(row[0], np.int64)
    return table.reshape(wide, wide), found.where("bucket is not null").drop("bigrams")


def exchanged(lots: DataFrame, model: Model, own_classes: bool) -> tuple[Model, DataFrame]:
    """The model, and (lot, bucket, cls, n) of words that aren't listed. With own_classes, every training word that isn't listed is exchanged by itself too.

    All of them are tried side by side against one table, and their moves are kept only if the likelihood of the bigrams, counted again over the texts,
    rises; else the better half of them is tried. Passes go on until one of them gains next to nothing.
    """
    table, least, first = model.follows, 1e-6 if own_classes else math.inf, None
    none = F.lit(None).cast("binary")
    start, *later, near, other = (shared_path(lots.sparkSession, k) for k in ("fitted", "fitted", "fitted", "near", "near"))
    nears, turn = (near, other), 1  # a pass overwrites what the last but one wrote
    rows = measured(lots, None, model, near)[1].unionByName(lots.where("bucket is not null").select("bucket", "lot", "words"), allowMissingColumns=True)
    rows = rows.select("*", *(none.alias(c) for c in ("numbers", "cls", "n")))
    while True:
        known = fitted(rows, model, table, least, start if first is None else later[turn])
        gains, mass = np.zeros(GAIN_BINS, np.int64), np.zeros(CLASSES + 1)
        for a, b in known.where("lot = -1").select("gains", "mass").toLocalIterator():
            gains += np.frombuffer(a, np.int64)
            mass += np.frombuffer(b, float)
        if not gains.any():
            break
        found, near = measured(lots, known, model, nears[turn])
        rise = likelihood(found) - likelihood(table)
        if rise <= 0:  # one bin at least is left out
            middle = int(np.searchsorted(np.cumsum(gains), gains.sum() / 2))
            least = 2.0 ** ((middle + 1) / 8 - 24)
            continue
        turn = 1 - turn
        first = known if first is None else first
        last, table, least = rise <= LEAST_GAIN * abs(likelihood(table)), found, 1e-6
        if last:
            break
        numbers, so_far = first.where("lot >= 0").select("bucket", "lot", "numbers"), known.where("lot < 0").select("bucket", "lot", "cls", "n")
        rows = near.unionByName(numbers, allowMissingColumns=True).unionByName(so_far, allowMissingColumns=True).withColumn("words", none)
    listed = np.arange(len(model.class_of)) <= model.numbers.end
    mass += np.bincount(model.class_of[listed], np.where(model.count > 0, model.count + ADD, 0), CLASSES + 1)
    return replace(model, follows=table, mass=np.append(mass, ADD), steps=steps_of(table, mass)), known.select("lot", "bucket", "cls").unionByName((known if first is None else first).select("lot", "bucket", "n"), allowMissingColumns=True)


def score(lots: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_score, score) of each whole text in lots, by the classes and counts of words in known."""
    sent = lots.sparkSession.sparkContext.broadcast(replace(model, numbers=None))
    end = model.numbers.end
    schema = T.StructType([lots.schema["id"], lots.schema["held_out"], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    id_type = to_arrow_type(lots.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        mass, unseen = np.log10(np.maximum(m.mass, 1e-300)), m.steps[0, -1]
        for _, group in _grouped(batches):
            found, counts, texts, ids, held = [], [], [], [], []
            for _, bucket, cls, n, items, places, i, h in group:
                if bucket is None:
                    texts.append((items, places))
                    ids.append(i)
                    held.append(h)
                else:
                    found += [] if cls is None else [cls]
                    counts += [] if n is None else [n]
            x = read_lot(found, counts, sum(map(len, found)), texts, m.class_of, end)
            n = m.count[np.minimum(x.items, end)]
            n[x.others] = x.n[x.place]
            log = np.log10(n + ADD)
            own = np.where(n > 0, m.steps[x.before, x.cls] - mass[x.cls] + log, unseen)
            sums = [np.bincount(x.of, w, len(texts)) for w in (None, n > 0, log - np.log10(m.whole), own)]
            cells = [pa.array(ids, id_type), pa.array(held, pa.bool_()), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), *map(pa.array, sums[2:])]
            yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return _met(lots, known, ["items", "places", "id", "held_out"]).mapInArrow(run, schema)


def class_scores(docs: DataFrame, held_out: Callable[[Column], Column], id_column: str = "doc_id", text: str = "text", own_classes: bool = False) -> DataFrame:
    """One row a document: id, held_out, n_tokens (the end counts as one), n_known (in training),
    train_tokens, base_score (smoothed unigrams) and score (the class model), both log10.

    held_out says of the id column what isn't learnt from. Null texts count as empty: their one token is
    the end. Repeated rows count as often as they stand there, and each has its own row. Words of equal
    count stand in order of their bytes. Without training texts every word is unknown, an empty table
    gives no rows. Words are listed by their counts alone, whatever their lengths. Further columns are not read.
    own_classes: training words that aren't listed leave the class of their form for the one they fit best by themselves.
    """
    own = docs.select(F.col(id_column).alias("id"), held_out(F.col(id_column)).alias("held_out"), F.col(text).alias("text"))
    with freed(own.sparkSession):
        words = listing(own.where(~F.col("held_out")), "text")
        lots = encoded(own, words)
        model, known = exchanged(lots, learnt(lots, words), own_classes)
    scored = score(lots, known, model)
    return scored.select(F.col("id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
