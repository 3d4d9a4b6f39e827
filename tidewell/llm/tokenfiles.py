"""Token files: whole texts as ids in one array, and where each document begins in Elias-Fano form.

A file is a Parquet table of segments. Its rows hold runs of consecutive documents in ascending order:

* ``part`` and ``segment`` say where the run stands: the order of the rows by both is the documents'.
* ``before`` (ids of the part's earlier segments), ``n_docs`` and ``n_ids``.
* ``n_null``, ``first_id`` and ``id_low_bits``, ``id_low``, ``id_high``, ``id_select``: the documents' own ids, which ascend: so
  many have none, and the others are in Elias-Fano form as well, counted from the first.
* ``ids``: all ids one after the other, as little-endian 16- or 32-bit integers (``width`` bytes each).
* ``low_bits``, ``low``, ``high``, ``select``: the documents' ends in ids (see EliasFano).
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.base import raw, shared_path

#: A segment ends with the document that brings it to so many ids; one document is never split.
SEGMENT_IDS = 1 << 20
#: Every so many-th one bit of ``high`` has its place stored.
EVERY = 64
#: Words that the memo holds before it starts anew; the older half stays beside it.
MEMO = 400_000
ENDS = b".,;:!?"


class EliasFano:
    """A non-decreasing sequence below 2^63 in about 2 + log2(largest / n) bits a value.

    The low bits of every value stand packed in ``low``; its high part h is bit h + i of ``high``, set for
    the i-th value. ``select`` has the places of every EVERY-th set bit, so that the i-th is found by
    looking at a few bytes behind the nearest stored one.
    """

    def __init__(self, low_bits: int, low: bytes, high: bytes, select: bytes) -> None:
        self.low_bits, self.low, self.high = low_bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.select = np.frombuffer(select, "<u4")

    @classmethod
    def parts(cls, values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
        n = len(values)
        bits = max(0, int(values[-1] // max(1, n)).bit_length() - 1) if n else 0
        places = (values >> bits) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel()
        return bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[::EVERY].astype("<u4").tobytes()

    def get(self, i: int) -> int:
        """The i-th value."""
        place = int(self.select[i // EVERY])
        left = i % EVERY
        byte = place >> 3
        rest = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (ones := rest.bit_count()) <= left:
            left -= ones
            byte += 1
            rest = int(self.high[byte])
        for _ in range(left):
            rest &= rest - 1
        h = 8 * byte + (rest & -rest).bit_length() - 1 - i
        at = i * self.low_bits
        window = self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes()
        return h << self.low_bits | (int.from_bytes(window, "little") >> (at & 7)) & ((1 << self.low_bits) - 1)

    def all(self, n: int) -> np.ndarray:
        """The first n values at once."""
        h = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:n] - np.arange(n)
        low = np.unpackbits(self.low, bitorder="little")[: n * self.low_bits].reshape(n, self.low_bits).astype(np.int64)
        return (h << self.low_bits) | (low << np.arange(self.low_bits)).sum(1)


def all_letters(s: str) -> bool:
    """Whether s is letters and stays so when it is normalised and lower-cased."""
    return s.isalpha() and (s.isascii() or unicodedata.normalize("NFC", s).lower().isalpha())


class Memo(dict):
    """Ids of words as bytes. Texts are normalised and split at white space before any merge, so the ids of
    a text are those of its words; a final mark behind letters is a piece of its own, so such words share
    their letters' ids. A full memo becomes the older half, which is kept until the newer one is full.
    """

    def __init__(self, tokenizer_json: str, kind: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.kind, self.older = Tokenizer.from_str(tokenizer_json), np.dtype(kind), {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([x.decode("utf-8") for x in texts], add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def encode_letters(self, words: list[bytes]) -> list[bytes] | None:
        """Ids of words of letters, all in one text; None unless each is one piece up to a word's end."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode("utf-8")], add_special_tokens=False)[0].ids, self.kind)
        to = np.flatnonzero(self.ends_word[ids]) + 1
        if len(to) != len(words) or to[-1] != len(ids):
            return None
        data, width = ids.tobytes(), self.kind.itemsize
        to = (to * width).tolist()
        return [data[a:b] for a, b in zip([0, *to], to, strict=False)]

    def learn(self, texts: list[list[bytes]], chunk: int = 2_000) -> None:
        """Make sure that all these words are known."""
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()
        new = set().union(*texts).difference(self)
        older = {w: self.older[w] for w in self.older.keys() & new}
        self.update(older)
        marked, letters, others = [], set(), []
        for w in new.difference(older):
            if w.isalpha() or not w.isascii() and all_letters(w.decode("utf-8")):
                letters.add(w)
            elif len(w) > 1 and w[-1] in ENDS and ((start := w[:-1]).isalpha() or not w.isascii() and all_letters(start.decode("utf-8"))):
                marked.append(w)
                if start not in self:
                    letters.add(start)
            else:
                others.append(w)
        if marked:
            others += {w[-1:] for w in marked} - self.keys()
        words = list(letters)
        for at in range(0, len(words), chunk):
            own = words[at : at + chunk]
            found = self.encode_letters(own)
            self.update(zip(own, found or self.encode(own), strict=True))
        for at in range(0, len(others), chunk):
            self.update(zip(others[at : at + chunk], self.encode(others[at : at + chunk]), strict=True))
        for w in marked:
            self[w] = self[w[:-1]] + self[w[-1:]]


#: One tokenizer and memo a worker process; tasks that follow in it use them again.
_LOADED: dict[tuple, Memo] = {}


def loaded(key: str, tokenizer_json: str, kind: str) -> Memo:
    if (key, kind) not in _LOADED:
        _LOADED[key, kind] = Memo(tokenizer_json, kind)
    return _LOADED[key, kind]


def ids_of(texts: list[bytes], memo: Memo) -> list[bytes]:
    """All ids of each text. Special tokens are found before lower-casing, so texts that may hold them are encoded whole."""
    words = [None if b"<|" in x else x.lower().split() for x in texts]
    memo.learn([w for w in words if w])
    return [memo.encode([x])[0] if w is None else b"".join(map(memo.__getitem__, w)) for x, w in zip(texts, words, strict=True)]


SEGMENTS = (
    "part int, segment long, before long, n_docs long, n_ids long, width int, n_null long, first_id long, id_low_bits int, id_low binary, "
    "id_high binary, id_select binary, ids binary, low_bits int, low binary, high binary, select binary"
)
#: A segment's ids lie within so much of its first.
ID_RANGE = 1 << 62


def write(docs: DataFrame, path: str, tokenizer_json: str, end_id: int, id_column: str = "doc_id", text: str = "text", wide: bool = False) -> None:
    """Write every whole text's ids and end_id behind each, in ascending order of id_column (nulls first).

    Texts move once, to range partitions; each is sorted there and encoded in that order. Documents that
    share an id stand in the order of their texts. Null texts are empty: their end alone. wide: 32-bit
    ids, for vocabularies over 65,536. An empty table writes no segments.
    """
    spark = docs.sparkSession
    sent, key = spark.sparkContext.broadcast(tokenizer_json), md5(tokenizer_json.encode()).hexdigest()
    kind, width = ("<u4", 4) if wide else ("<u2", 2)
    end = np.array([end_id], kind).tobytes()
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = loaded(key, sent.value, kind)
        part, segment, before, doc_ids, ids, ends, n, first = 0, 0, 0, [], [], [], 0, None

        def closed() -> pa.RecordBatch:
            own = [i for i in doc_ids if i is not None]
            coded = EliasFano.parts(np.array([i - own[0] for i in own], np.int64)), EliasFano.parts(np.array(ends, np.int64))
            values = [part, segment, before, len(ends), n, width, len(ends) - len(own), own[0] if own else None, *coded[0], b"".join(ids), *coded[1]]
            form = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *form, pa.binary(), *form]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

        for batch in batches:
            for p, i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids_of(raw(batch.column(2)), memo), strict=True):
                part = p
                if i is not None and first is None:
                    first = i
                if ends and i is not None and i - first >= ID_RANGE:
                    yield closed()
                    segment, before, doc_ids, ids, ends, n, first = segment + 1, before + n, [], [], [], 0, i
                ids += [x, end]
                n += len(ids[-2]) // width + 1
                doc_ids.append(i)
                ends.append(n)
                if n >= SEGMENT_IDS:
                    yield closed()
                    segment, before, doc_ids, ids, ends, n, first = segment + 1, before + n, [], [], [], 0, None
        if ends:
            yield closed()

    dealt.select(F.spark_partition_id().alias("part"), "id", "text").mapInArrow(run, SEGMENTS).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """One row a document from the files at path: doc_id, start (ids of all before it), n_tokens (its end
    included) and ids (array of integers, as numbered in the file)."""
    return _decoded(spark, path, "ids")


def digests(spark, path: str) -> DataFrame:
    """As read(), with ids_crc32 in place of the ids: unsigned crc32 over them as little-endian 32-bit integers."""
    return _decoded(spark, path, "ids_crc32")


def _decoded(spark, path: str, what: str) -> DataFrame:
    segments = spark.read.schema(SEGMENTS.replace(", ", ",")).parquet(path)
    sizes = {r[0]: r[1] for r in segments.groupBy("part").agg(F.sum("n_ids")).collect()}  # one number a range partition
    order = sorted(sizes)
    starts = dict(zip(order, np.concatenate(([0], np.cumsum([sizes[p] for p in order])[:-1])).tolist(), strict=True)) if order else {}
    last = pa.int64() if what == "ids_crc32" else pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                at = EliasFano(s["low_bits"], s["low"], s["high"], s["select"])
                ends = np.array([at.get(i) for i in range(s["n_docs"])], np.int64)
                begins = np.concatenate(([0], ends[:-1]))
                numbered = EliasFano(s["id_low_bits"], s["id_low"], s["id_high"], s["id_select"]).all(s["n_docs"] - s["n_null"])
                doc_ids = [None] * s["n_null"] + (numbered + (s["first_id"] or 0)).tolist()
                ids = np.frombuffer(s["ids"], "<u2" if s["width"] == 2 else "<u4").astype("<u4")
                cut = [ids[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                values = [zlib.crc32(x.tobytes()) for x in cut] if what == "ids_crc32" else [x.tolist() for x in cut]
                start = begins + s["before"] + starts[s["part"]]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start), pa.array(ends - begins), pa.array(values, last)], names=["doc_id", "start", "n_tokens", what])

    needed = segments.drop("segment", "n_ids")
    return needed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {what} {'long' if what == 'ids_crc32' else 'array<long>'}")


def token_digests(docs: DataFrame, tokenizer_json: str, end_id: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Write docs' token files in the shared folder and return what reading them back gives: doc_id, start,
    n_tokens, ids_crc32; each document's place comes from the files' select structures.

    Null texts are empty, their end alone; documents without an id come first. Repeated rows and equal ids each
    have their own row, in order of their texts. An empty table gives none; further columns are not read.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "token-files")
    write(docs, path, tokenizer_json, end_id, id_column, text)
    return digests(spark, path).withColumnRenamed("doc_id", id_column)
