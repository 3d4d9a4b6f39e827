"""Cross-tokenizer alignment: which ids of two tokenizers cover the same bytes, and how often ids meet in a corpus.

Texts are parted at single spaces and line ends between words, where neither tokenizer lets a token reach
across; such a stretch is encoded once a task and remembered. Its tokens are intervals of bytes. Every token
points to the farthest-right token it overlaps; doubling the pointers brings each to the last token of its
component, and components are the groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.base import map_batches, named, raw, shared_path

#: Stretches that a task remembers before it starts anew.
MEMO = 300_000
#: Bytes of texts worked on at once, and bytes of new stretches encoded at once.
TEXT_BYTES, NEW_BYTES = 4 << 20, 1 << 18
#: Pairs of ids sent to tasks at once (12 bytes each); beyond it their counts go in further passes, at most 1,024 for two vocabularies of 65,536.
PAIRS = 1 << 22
#: Pairs that a task counts before it hands them on.
BUFFER = 4 << 20
#: Where texts are parted: white space that both tokenizers see lies neither before nor behind. Python's classes hold all of theirs.
PART = re.compile(r"(?<=\S)(?=[ \n]\S)")


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of two tokenizations of the same bytes, by their ends, numbered from 0.

    The last token of the other kind that begins before a token's end is the farthest right it overlaps. It ends no
    earlier; where both end together a token of the second kind points to itself.
    """
    n = len(ends_a)
    starts_a, starts_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    to_b = np.searchsorted(starts_b, ends_a) - 1
    to_a = np.searchsorted(starts_a, ends_b) - 1
    to_a = np.where(ends_a[to_a] > ends_b, to_a, n + np.arange(len(ends_b)))
    points = np.concatenate((n + to_b, to_a))
    while True:
        further = points[points]
        if np.array_equal(further, points):
            break
        points = further
    labels = np.unique(points, return_inverse=True)[1]
    return labels[:n], labels[n:]


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of tokens (of the first, of the second) that overlap, and where each overlap ends."""
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), ends


def byte_level() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoders:
    """Both tokenizers, and their tokens' bytes. A is a byte-level BPE of the tokenizers library, B a sentencepiece model that adds a space."""

    def __init__(self, byte_json: str, piece_model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=piece_model)
        chars, vocabulary = byte_level(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << 16:
            raise ValueError("vocabularies of up to 65,536 ids are supported")
        own = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        #: Whether no token of B reaches across a place where texts are parted.
        self.parts = all("▁" not in p.lstrip("▁") and "\n" not in p for p in own)
        self.len_a, self.len_b = np.array([len(x) for x in self.bytes_a]), np.array([len(x) for x in self.bytes_b])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text that begins with a space; None where a tokenizer's tokens don't give its bytes back."""
        own = text.encode("utf-8")
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:])
        if b"".join([self.bytes_a[i] for i in a]) != own or b"".join([self.bytes_b[i] for i in b]) != own:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


class Memo:
    """What is known of stretches. Words are known by their text without the space before it, or with the line end; odd stretches as bytes."""

    def __init__(self, encoders: Encoders) -> None:
        self.encoders = encoders
        self.clear()

    def clear(self) -> None:
        self.places: dict[str | bytes, int] = {}
        self.strings: list[str] = []
        #: n_a, n_b, n_groups of each stretch (-1: no tokens), where its links begin, and all links as a * 65536 + b.
        self.counts, self.begins, self.codes = np.zeros((0, 3), np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def part(self, text: str) -> list[str | bytes]:
        """The stretches of a space and text."""
        if not self.encoders.parts:
            return [(" " + text).encode("utf-8")]
        if " ".join(text.split()) == text.replace("\n", " "):
            return text.replace("\n", " \n").split(" ")
        found = PART.split(" " + text)
        return [x.encode("utf-8") if x[1:2].isspace() or x[-1].isspace() else x.removeprefix(" ") for x in found]

    def learn(self, new: list[str | bytes]) -> None:
        counts, codes, sizes = [self.counts], [self.codes], []
        held, size = [], 0
        for key in [*new, None]:
            if key is None or size > NEW_BYTES:
                for k, c, links, strings in self._encoded(held):
                    self.places.update(zip(k, range(len(self.strings), len(self.strings) + len(k)), strict=True))
                    self.strings += strings
                    counts.append(c)
                    codes.append(links[0])
                    sizes.append(links[1])
                held, size = [], 0
            if key is not None:
                held.append(key)
                size += len(key) + 1
        self.counts, self.codes = np.concatenate(counts), np.concatenate(codes)
        self.begins = np.concatenate((self.begins, self.begins[-1] + np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))))

    def _encoded(self, keys: list) -> Iterator[tuple]:
        """Stretches with their counts, links and group strings. All are encoded as one text; where that one has no tokens, as two halves."""
        if not keys:
            return
        texts = [k.decode("utf-8") if isinstance(k, bytes) else k if k[0] == "\n" else " " + k for k in keys]
        # Odd stretches may have white space at either end and then can't stand beside others; a line end would lose its place at the start.
        whole = len(keys) == 1 or not any(isinstance(k, bytes) for k in keys)
        lead = " a" if texts[0][0] == "\n" else ""
        ids = self.encoders.encode(lead + "".join(texts)) if whole else None
        if ids is None:
            if len(keys) == 1:
                yield keys, np.full((1, 3), -1, np.int64), (np.zeros(0, np.uint32), np.zeros(1, np.int64)), [""]
                return
            odd = [k for k in keys if isinstance(k, bytes)]
            if whole:
                yield from self._encoded(keys[: len(keys) // 2])
                yield from self._encoded(keys[len(keys) // 2 :])
            else:
                yield from self._encoded([k for k in keys if not isinstance(k, bytes)])
                for k in odd:
                    yield from self._encoded([k])
            return
        a, b = ids
        ends_a, ends_b = np.cumsum(self.encoders.len_a[a]), np.cumsum(self.encoders.len_b[b])
        if lead:
            a, b, ends_a, ends_b = a[ends_a > 2], b[ends_b > 2], ends_a[ends_a > 2] - 2, ends_b[ends_b > 2] - 2
        group_a, group_b = groups_of(ends_a, ends_b)
        link_a, link_b, link_ends = links_of(ends_a, ends_b)
        last_a, last_b = np.flatnonzero(np.diff(group_a, append=-1)) + 1, np.flatnonzero(np.diff(group_b, append=-1)) + 1
        ends = np.cumsum([len(t.encode("utf-8")) for t in texts])
        to_a, to_b, to_link, to_group = (np.searchsorted(x, ends, "right") for x in (ends_a, ends_b, link_ends, ends_a[last_a - 1]))
        begin = [np.diff(x, prepend=0) for x in (to_a, to_b, to_group, to_link)]
        said_a, said_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, i, j = [], 0, 0
        for p, q in zip(last_a.tolist(), last_b.tolist(), strict=True):
            groups.append(f"{','.join(said_a[i:p])}|{','.join(said_b[j:q])}")
            i, j = p, q
        cuts = [0, *to_group.tolist()]
        strings = [";".join(groups[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        yield keys, np.stack(begin[:3], 1), ((a[link_a] << 16 | b[link_b]).astype(np.uint32), begin[3]), strings

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, bytes, bytes]]:
        """For each text n_a, n_b, n_groups, n_links, the sha256 of its groups, its distinct links ascending, and how often it has each."""
        parts = [self.part(x) if x else [] for x in texts]
        new = list(dict.fromkeys(w for w in chain.from_iterable(parts) if w not in self.places))
        if len(self.places) + len(new) > MEMO:
            if self.places:
                self.clear()
                yield from self.align(texts)
            elif len(texts) > 1:
                yield from self.align(texts[: len(texts) // 2])
                yield from self.align(texts[len(texts) // 2 :])
            else:
                yield from self._alone(texts[0])
            return
        if new:
            self.learn(new)
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(parts)), np.int64)
        sizes = np.array([len(p) for p in parts])
        of = np.repeat(np.arange(len(parts)), sizes)
        counts = self.counts[at]
        bad = np.bincount(of, counts[:, 0] < 0, len(parts)) > 0
        totals = np.stack([np.bincount(of, counts[:, k], len(parts)) for k in range(3)], 1).astype(np.int64)
        begins, lengths = self.begins[at], self.begins[at + 1] - self.begins[at]
        where = np.arange(int(lengths.sum())) + np.repeat(begins - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        both = np.sort(np.repeat(of.astype(np.uint64), lengths) << np.uint64(32) | self.codes[where])
        first = np.flatnonzero(np.concatenate((both[:1] == both[:1], both[1:] != both[:-1])))
        often = np.diff(first, append=len(both)).astype("<u4")
        codes = (both[first] & np.uint64(0xFFFFFFFF)).astype("<u4")
        edges = np.searchsorted(both[first] >> np.uint64(32), np.arange(len(parts) + 1, dtype=np.uint64)).tolist()
        strings, at, stop = self.strings, at.tolist(), 0
        for i, n in enumerate(sizes.tolist()):
            start, stop = stop, stop + n
            if not n or bad[i]:
                yield 0, 0, 0, 0, "", b"", b""
                continue
            said = ";".join([strings[k] for k in at[start:stop]])
            n_a, n_b, n_groups = totals[i].tolist()
            x, y = edges[i], edges[i + 1]
            yield n_a, n_b, n_groups, n_a + n_b - n_groups, sha256(said.encode()).hexdigest(), codes[x:y].tobytes(), often[x:y].tobytes()

    def _alone(self, text: str) -> Iterator[tuple]:
        """A text of more distinct stretches than are remembered, as one stretch."""
        found = next(self._encoded([(" " + text).encode("utf-8")]))
        n_a, n_b, n_groups = found[1][0].tolist()
        if n_a < 0:
            yield 0, 0, 0, 0, "", b"", b""
            return
        codes, often = np.unique(found[2][0], return_counts=True)
        yield n_a, n_b, n_groups, n_a + n_b - n_groups, sha256(found[3][0].encode()).hexdigest(), codes.astype("<u4").tobytes(), often.astype("<u4").tobytes()


#: One memo a worker process; tasks that follow in it use it again.
_LOADED: dict[str, Memo] = {}
FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, often binary"


def groups(docs: DataFrame, byte_json: str, piece_model: bytes, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document id_column, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs: codes (a * 65536 + b, ascending,
    as little-endian 32-bit integers) and often (how many of its links have each). See aligned()."""
    sent = docs.sparkSession.sparkContext.broadcast((byte_json, piece_model))
    schema = docs.select(F.col(f"`{id_column}`").alias("id")).limit(0).selectExpr("id", *[f"cast(null as {k}) {n}" for n, k in (x.split() for x in FOUND.split(", "))]).schema
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sha256(sent.value[0].encode() + sent.value[1]).hexdigest()
        if key not in _LOADED:
            _LOADED[key] = Memo(Encoders(*sent.value))
        memo = _LOADED[key]
        for batch in batches:
            texts = raw(batch.column(1))
            held, size, start = [], 0, 0
            for i, x in enumerate(texts):
                held.append(x.decode("utf-8"))
                size += len(x)
                if size >= TEXT_BYTES or i + 1 == len(texts):
                    rows = list(zip(*memo.align(held), strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(held)), *(pa.array(v, k) for v, k in zip(rows, kinds, strict=True))], names=[f"c{n}" for n in range(8)])
                    held, size, start = [], 0, i + 1

    out = map_batches(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string")), run, schema)
    return out.withColumnRenamed("id", id_column) if id_column != "id" else out


def pair_counts(found: DataFrame) -> DataFrame:
    """For each pair of ids that some document holds linked (a, b), documents: how many do. found: the rows of groups().

    Tasks count pairs in sorted arrays and hand on one row a pair, so a pair of a third of all documents is no hot key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(known), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(known[at : at + 100_000]), pa.array(times[at : at + 100_000])], names=["code", "documents"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, often = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            both, at = np.unique(np.concatenate((known, new.astype(np.int64))), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            total[at[: len(known)]] = times
            total[at[len(known) :]] += often
            return both, total

        for batch in batches:
            for codes in batch.column(0):
                held.append(np.frombuffer(codes.as_buffer(), "<u4"))
                size += len(held[-1])
                if size > BUFFER:
                    known, times = merged()
                    held, size = [], 0
                    if len(known) > BUFFER:
                        yield from rows()
                        known, times = known[:0], times[:0]
        known, times = merged()
        yield from rows()

    counted = found.select("codes").mapInArrow(run, "code long, documents long").groupBy("code").agg(F.sum("documents").alias("documents"))
    return counted.select(F.shiftright("code", 16).alias("a"), F.col("code").bitwiseAND(65535).alias("b"), "documents")


def aligned(docs: DataFrame, byte_json: str, piece_model: bytes, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document how its tokens by two tokenizers lie over each other, and how usual its pairs of ids are.

    A is byte_json's encoding of a space and the text, B piece_model's of the text. Returned are id_column, n_a, n_b, n_groups (offsets
    where tokens of both end), n_links (pairs of an A and a B token that overlap), n_best (links whose pair is in as many documents as any
    pair of its A id), count_sum (sum over links of the documents that hold the pair) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``).

    Texts that are null or empty, or that a tokenizer's tokens don't give back byte for byte, have no tokens: zeros and an empty string.
    Copies and repeated rows count as documents of their own; ties for an A id's highest count are all best; an empty table gives no
    rows; columns of other names are not read. Texts are encoded once: their pairs are kept in a table in the shared folder and looked up
    there, in passes over PAIRS pairs at a time. Texts of more than MEMO distinct words are encoded in one piece.
    """
    spark = docs.sparkSession
    path, pairs_path = shared_path(spark, "aligned"), shared_path(spark, "pairs")
    groups(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")), byte_json, piece_model, "id").write.parquet(path)
    found = spark.read.parquet(path)
    pair_counts(found).write.parquet(pairs_path)
    pairs = spark.read.parquet(pairs_path)
    best = pairs.groupBy("a").agg(F.max("documents").alias("most"))  # one row an id of A
    ranked = pairs.join(F.broadcast(best), "a").select((F.col("a") * 65536 + F.col("b")).alias("code"), "documents", (F.col("documents") == F.col("most")).alias("best"))
    out = found.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    edges = _edges(pairs)
    for k, (low, high) in enumerate(edges):
        own = ranked.where((F.col("code") >= low) & (F.col("code") < high)).toArrow()
        out = _looked_up(out, own)
        if k + 1 < len(edges):
            path = shared_path(spark, "aligned")
            out.write.parquet(path)
            out = spark.read.parquet(path)
    own = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return out.select(F.col("id").alias(id_column), *named(own))


def _edges(pairs: DataFrame) -> list[tuple[int, int]]:
    """Ranges of codes that hold about PAIRS pairs at most: whole ids of A, whose numbers of pairs are at most 65,536 each."""
    sizes = sorted(pairs.groupBy("a").count().collect())  # one row an id of A
    edges, low, held = [], 0, 0
    for a, n in sizes:
        if held and held + n > PAIRS:
            edges.append((low << 16, a << 16))
            low, held = a, 0
        held += n
    return [*edges, (low << 16, 1 << 32)] if sizes else []


def _looked_up(found: DataFrame, pairs: pa.Table) -> DataFrame:
    """found with n_best and count_sum raised by the links whose pairs are in pairs (code, documents, best), which is sent to all tasks."""
    codes = pairs.column("code").to_numpy()
    order = np.argsort(codes)
    best = pairs.column("best").to_numpy(zero_copy_only=False)[order]
    sent = found.sparkSession.sparkContext.broadcast((codes[order].astype(np.uint32), pairs.column("documents").to_numpy()[order], best))
    names, schema = found.columns, found.schema
    at = {n: names.index(n) for n in ("codes", "often", "n_best", "count_sum")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, documents, best = sent.value
        for batch in batches:
            columns = list(batch.columns)
            raised = {"n_best": [], "count_sum": []}
            for codes, often in zip(batch.column(at["codes"]), batch.column(at["often"]), strict=True):
                own, times = np.frombuffer(codes.as_buffer(), "<u4"), np.frombuffer(often.as_buffer(), "<u4").astype(np.int64)
                where = np.minimum(np.searchsorted(known, own), len(known) - 1)
                times = np.where(known[where] == own, times, 0)
                raised["n_best"].append(int(times[best[where]].sum()))
                raised["count_sum"].append(int((times * documents[where]).sum()))
            for name, values in raised.items():
                columns[at[name]] = pa.array(columns[at[name]].to_numpy(zero_copy_only=False) + np.array(values, np.int64))
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return map_batches(found, run, schema)
