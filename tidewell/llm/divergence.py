"""How far the sources of a language differ in their use of words.

Terms are counted packed: up to 8 bytes are one 64-bit word, up to 16 are two, longer ones stand as bytes in
buckets of like length. Packed terms are sorted digit by digit (16 bits a pass, each a radix sort) and equal
neighbours counted as runs. Tasks hand on their runs in one row a bucket of terms; a bucket's rows are merged
the same way, so no term, however frequent, has more than one run a task and group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.base import raw, shared_path

#: A term stays if so many documents of its language have it, and a group shows so many terms.
LEAST_DOCUMENTS, SHOWN = 10, 10
#: Bytes of text packed at once, runs a task holds before it hands them on, cells of terms by sources worked on at once, sums held.
TEXT_BYTES, RUNS, CELLS, SUMS = 8 << 20, 3_000_000, 1 << 20, 8 << 20
#: Shares are whole numbers of this unit.
UNIT = 1_000_000_000

_LOWER = np.zeros(256, np.uint8)
_LOWER[0x61:0x7B] = _LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order by the last of keys, then the one before it, and so on: least digit first, 16 bits a pass."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, 8 * key.dtype.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


class Packed:
    """Runs of terms of one or two words: words, group, occurrences, documents, each an array. Terms ascend, and groups within a term."""

    def __init__(self, n_words: int) -> None:
        self.n_words, self.parts, self.size = n_words, [], 0

    def add(self, words: list[np.ndarray], group: np.ndarray, count: np.ndarray, docs: np.ndarray) -> None:
        if len(group):
            self.parts.append(([np.asarray(w, np.uint64) for w in words], np.asarray(group, np.uint32), np.asarray(count, np.int64), np.asarray(docs, np.int64)))
            self.size += len(group)

    def add_terms(self, words: list[np.ndarray], group: np.ndarray, doc: np.ndarray) -> None:
        """Single occurrences in order of their documents."""
        if not len(group):
            return
        group = np.asarray(group, np.uint32)
        order = radix_order([group, *words[::-1]])
        words, group, doc = [w[order] for w in words], group[order], doc[order]
        starts = self._starts(words, group)
        fresh = np.ones(len(doc), np.int64)
        fresh[1:] = doc[1:] != doc[:-1]
        fresh[starts] = 1
        self.add([w[starts] for w in words], group[starts], np.diff(starts, append=len(doc)), np.add.reduceat(fresh, starts))

    @staticmethod
    def _starts(words: list[np.ndarray], group: np.ndarray) -> np.ndarray:
        change = group[1:] != group[:-1]
        for w in words:
            change |= w[1:] != w[:-1]
        return np.concatenate(([0], np.flatnonzero(change) + 1))

    def merge(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """All runs, one a term and group."""
        if not self.parts:
            return [np.zeros(0, np.uint64)] * self.n_words, np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.parts) > 1:
            words = [np.concatenate([p[0][k] for p in self.parts]) for k in range(self.n_words)]
            group, count, docs = (np.concatenate([p[k] for p in self.parts]) for k in (1, 2, 3))
            order = radix_order([group, *words[::-1]])
            words, group = [w[order] for w in words], group[order]
            starts = self._starts(words, group)
            self.parts = [([w[starts] for w in words], group[starts], np.add.reduceat(count[order], starts), np.add.reduceat(docs[order], starts))]
            self.size = len(starts)
        return self.parts[0]


class Long:
    """Runs of longer terms: (term, group, occurrences, documents), in byte-sorted buckets by the bits of their lengths."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[tuple[bytes, int, int, int]]] = {}
        self.size = 0

    def add(self, runs: list[tuple[bytes, int, int, int]]) -> None:
        for run in runs:
            self.buckets.setdefault(len(run[0]).bit_length(), []).append(run)
        self.size += len(runs)

    def add_terms(self, terms: list[bytes], group: list[int], doc: list[int]) -> None:
        own = sorted(zip(terms, group, doc, strict=True))
        self.add([(t, g, len(docs := [x[2] for x in same]), len(set(docs))) for (t, g), same in groupby(own, lambda x: x[:2])])

    def merge(self) -> list[tuple[bytes, int, int, int]]:
        for k, runs in self.buckets.items():
            runs.sort()
            self.buckets[k] = [(t, g, sum(x[2] for x in same), sum(x[3] for x in same)) for (t, g), rest in groupby(runs, lambda x: x[:2]) for same in [list(rest)]]
        self.size = sum(map(len, self.buckets.values()))
        return [run for _, runs in sorted(self.buckets.items()) for run in runs]


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """All terms of texts: their text, where they start and end, their first and second words (as numbers that sort as their bytes), and all bytes."""
    own = np.frombuffer(b"\0".join(texts) + bytes(17), np.uint8)
    low = _LOWER[own]
    edges = np.flatnonzero(np.diff(low != 0, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    places = np.cumsum([len(x) + 1 for x in texts])
    of = np.searchsorted(places, starts, "right")
    view = np.ndarray((len(low) - 7,), ">u8", low.data, 0, (1,))
    words = []
    for k in (0, 8):
        short = (8 - np.clip(ends - starts - k, 0, 8)).astype(np.uint64) * np.uint64(8)
        word = view[np.minimum(starts + k, len(view) - 1)].astype(np.uint64)
        words.append(np.where(short < 64, word >> np.minimum(short, np.uint64(63)) << np.minimum(short, np.uint64(63)), np.uint64(0)))
    return of, starts, ends, words, low


def squeezed(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs, after one byte that says how many."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def spread(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


ROWS = "bucket int, langs array<string>, sources array<string>, " + ", ".join(f"{k}_{v} binary" for k in ("one", "two", "long") for v in ("terms", "group", "count", "docs")) + ", long_sizes binary"
_KINDS = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())] + [pa.binary()] * 13
_NAMES = [x.split()[0] for x in ROWS.split(", ")]


class Runs:
    """Runs of all lengths, with the groups (lang, source) they belong to."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.one, self.two, self.long = Packed(1), Packed(2), Long()

    @property
    def size(self) -> int:
        return self.one.size + self.two.size + self.long.size

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def count(self, texts: list[bytes], groups: np.ndarray) -> None:
        """Add the terms of whole texts, each of its group."""
        of, starts, ends, words, low = pack(texts)
        sizes = ends - starts
        for runs, fits in ((self.one, sizes <= 8), (self.two, (sizes > 8) & (sizes <= 16))):
            at = np.flatnonzero(fits)
            runs.add_terms([w[at] for w in words[: runs.n_words]], groups[of[at]], of[at])
        at = np.flatnonzero(sizes > 16)
        data = low.tobytes()
        self.long.add_terms([data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], groups[of[at]].tolist(), of[at].tolist())

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """All runs, in a row for each of so many buckets of terms that has any."""
        names = list(self.groups)
        one, two, long = self.one.merge(), self.two.merge(), self.long.merge()
        at = [_scatter(one[0][0]) % np.uint64(buckets), _scatter(two[0][0] ^ _scatter(two[0][1])) % np.uint64(buckets), np.array([_of_bytes(t) % buckets for t, *_ in long], np.uint64)]
        orders = [radix_order([x]) for x in at]
        edges = [np.searchsorted(x[o], np.arange(buckets + 1, dtype=np.uint64)).tolist() for x, o in zip(at, orders, strict=True)]
        rows, size = [], 0
        for b in range(buckets):
            own = [o[e[b] : e[b + 1]] for o, e in zip(orders, edges, strict=True)]
            if sum(map(len, own)):
                rows.append(self._row(b, names, [x[own[0]] for x in (*one[0], *one[1:])], [x[own[1]] for x in (*two[0], *two[1:])], [long[i] for i in own[2].tolist()]))
                size += sum(map(len, own))
                if size > 100_000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    @staticmethod
    def _row(bucket: int, names: list[tuple[str, str]], one: list[np.ndarray], two: list[np.ndarray], long: list[tuple]) -> list:
        said = [one[1], two[2], np.array([x[1] for x in long], np.uint32)]
        present, local = np.unique(np.concatenate(said), return_inverse=True)
        local = np.split(local, np.cumsum([len(x) for x in said])[:-1])
        langs, sources = [names[g][0] for g in present.tolist()], [names[g][1] for g in present.tolist()]
        ends = [squeezed(np.array([x[k] for x in long], np.int64)) for k in (2, 3)]
        return [
            bucket, langs, sources, one[0].astype(">u8").tobytes(), squeezed(local[0]), squeezed(one[2]), squeezed(one[3]),
            np.stack(two[:2], 1).astype(">u8").tobytes(), squeezed(local[1]), squeezed(two[3]), squeezed(two[4]),
            b"".join([x[0] for x in long]), squeezed(local[2]), *ends, squeezed(np.array([len(x[0]) for x in long], np.int64)),
        ]

    def add_row(self, row: dict) -> None:
        to = np.array([self.group(x, y) for x, y in zip(row["langs"], row["sources"], strict=True)], np.uint32)
        for runs, k in ((self.one, "one"), (self.two, "two")):
            words = np.frombuffer(row[f"{k}_terms"], ">u8").reshape(-1, runs.n_words)
            runs.add([words[:, i].astype(np.uint64) for i in range(runs.n_words)], to[spread(row[f"{k}_group"])], spread(row[f"{k}_count"]), spread(row[f"{k}_docs"]))
        cuts = [0, *np.cumsum(spread(row["long_sizes"])).tolist()]
        terms = [row["long_terms"][a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        self.long.add(list(zip(terms, to[spread(row["long_group"])].tolist(), spread(row["long_count"]).tolist(), spread(row["long_docs"]).tolist(), strict=True)))

    def by_term(self) -> Iterator[tuple[list | np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, object]]:
        """For each length class: which language and term each run has (numbered), its group, occurrences and documents, and a function that names terms.

        Groups are numbered anew, so that those of a language stand together; runs ascend by language, then term.
        """
        langs = sorted({g[0] for g in self.groups})
        lang_of = np.array([langs.index(g[0]) for g in self.groups], np.int64)
        one, two, long = self.one.merge(), self.two.merge(), self.long.merge()
        for words, group, count, docs in (one, two):
            if len(group):
                order = radix_order([lang_of[group].astype(np.uint32)])
                words, group, count, docs = [w[order] for w in words], group[order], count[order], docs[order]
                change = np.diff(lang_of[group]) != 0
                for w in words:
                    change |= w[1:] != w[:-1]
                yield np.concatenate(([0], np.cumsum(change))), lang_of[group], group, count, docs, words
        if long:
            long = sorted(long, key=lambda x: (lang_of[x[1]], x[0]))
            numbers = [k for k, (_, same) in enumerate(groupby(long, lambda x: (lang_of[x[1]], x[0]))) for _ in same]
            group = np.array([x[1] for x in long])
            yield np.array(numbers), lang_of[group], group, np.array([x[2] for x in long]), np.array([x[3] for x in long]), [x[0] for x in long]


def term_at(words: list, i: int) -> bytes:
    """The bytes of a run's term, as by_term() gives them."""
    return words[i] if isinstance(words[0], bytes) else b"".join(int(w[i]).to_bytes(8, "big") for w in words).rstrip(b"\0")


def _scatter(words: np.ndarray) -> np.ndarray:
    """Words mixed, so that their remainders are even."""
    words = words * np.uint64(0x9E3779B97F4A7C15)
    words = (words ^ (words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return words ^ (words >> np.uint64(32))


def _of_bytes(term: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(term)


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def term_runs(docs: DataFrame, lang: Column, source: Column, text: Column, buckets: int) -> DataFrame:
    """Runs of all terms of docs as each task found them: rows of packed runs, one a bucket (see Runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        for batch in batches:
            texts = raw(batch.column(2))
            groups = np.array([runs.group(x, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.uint32)
            start, size = 0, 0
            for i, x in enumerate(texts):
                size += len(x)
                if size >= TEXT_BYTES or i + 1 == len(texts):
                    runs.count(texts[start : i + 1], groups[start : i + 1])
                    start, size = i + 1, 0
                    if runs.size > RUNS:
                        for part in (runs.one, runs.two, runs.long):
                            part.merge()
                        if runs.size > RUNS // 2:
                            yield from runs.rows(buckets)
                            runs.clear()
        yield from runs.rows(buckets)

    return docs.select(lang.alias("lang"), source.alias("source"), text.alias("text")).mapInArrow(run, ROWS)


def kept_terms(found: DataFrame, least: int) -> DataFrame:
    """The runs of terms that at least so many documents of their language have, merged; all runs of a term and language stand in one row.

    A bucket goes to one task. Its size is that of its distinct terms and groups; spark.sql.shuffle.partitions sets the number of buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        for batch in batches:
            for row in batch.to_pylist():
                runs.add_row(row)
                if runs.size > 2 * RUNS:
                    for part in (runs.one, runs.two, runs.long):
                        part.merge()
        kept = Runs()
        kept.groups = runs.groups
        for number, _, group, count, docs, words in runs.by_term():
            stays = (np.bincount(number, docs) >= least)[number]
            at = np.flatnonzero(stays)
            if isinstance(words[0], bytes):
                kept.long.add([(words[i], int(group[i]), int(count[i]), int(docs[i])) for i in at.tolist()])
            else:
                (kept.one if len(words) == 1 else kept.two).add([w[at] for w in words], group[at], count[at], docs[at])
        yield from kept.rows(max(1, kept.size // 20_000))

    return found.repartition("bucket").mapInArrow(run, ROWS)


def _sizes(kept: DataFrame) -> DataFrame:
    """lang, source, n: occurrences of kept terms in each group that has any; source null: the number of the language's kept terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = Runs()
            for row in batch.to_pylist():
                runs.add_row(row)
            names, total = list(runs.groups), {}
            for number, lang, group, count, _, _ in runs.by_term():
                for g in np.unique(group).tolist():
                    total[names[g]] = total.get(names[g], 0) + int(count[group == g].sum())
                for k in np.unique(lang).tolist():
                    name = names[int(group[lang == k][0])][0]
                    total[name, None] = total.get((name, None), 0) + len(np.unique(number[lang == k]))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "source", "n"])

    return kept.mapInArrow(run, "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n"))


def shares(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)) without overflow for totals below 2^53: three digits of a long division."""
    left, by, out = np.asarray(count, np.int64) + 2, np.asarray(total, np.int64) + 2 * terms, 0
    for _ in range(3):
        out = out * 1000 + left * 1000 // by
        left = left * 1000 % by
    return 1 + out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    d = p - q
    return d * d // (p + q)


class Compared:
    """Sums of distances of two sources, and the terms that mark a source most, for the rows a task sees."""

    def __init__(self, sources: dict[str, list[tuple[str, int]]], terms: dict[str, int], shown: int) -> None:
        self.sources, self.terms, self.shown = sources, terms, shown
        self.place = {lang: {s: i for i, (s, _) in enumerate(own)} for lang, own in sources.items()}
        self.sums: dict[str, np.ndarray] = {}
        self.best: dict[tuple[str, str], list[tuple[int, bytes]]] = {}

    def add(self, runs: Runs) -> Iterator[tuple]:
        names = list(runs.groups)
        for number, lang_of, group, count, _, words in runs.by_term():
            for k in np.unique(lang_of).tolist():
                own = np.flatnonzero(lang_of == k)
                lang = names[int(group[own[0]])][0]
                place = np.array([self.place[lang][names[g][1]] if names[g][0] == lang else -1 for g in range(len(names))])
                first = int(number[own[0]])
                chunk = max(1, CELLS // len(self.sources[lang]))
                for start in range(first, int(number[own[-1]]) + 1, chunk):
                    at = own[np.searchsorted(number[own], start) : np.searchsorted(number[own], start + chunk)]
                    self._chunk(lang, number[at] - start, place[group[at]], count[at], words, at)
                    if sum(x.size for x in self.sums.values()) > SUMS:
                        yield from self.rows(False)

    def _chunk(self, lang: str, term: np.ndarray, source: np.ndarray, count: np.ndarray, words: list, at: np.ndarray) -> None:
        totals, v = np.array([n for _, n in self.sources[lang]], np.int64), self.terms[lang]
        counts = np.zeros((int(term[-1]) + 1, len(totals)), np.int64)
        counts[term, source] = count
        p, q = shares(counts, totals, v), shares(counts.sum(1), int(totals.sum()), v)
        sums = self.sums.setdefault(lang, np.zeros((len(totals), len(totals)), np.int64))
        for i in range(len(totals) - 1):
            sums[i, i + 1 :] += distance(p[:, i : i + 1], p[:, i + 1 :]).sum(0)
        own, all_of = p[term, source], q[term]
        marks = np.flatnonzero(own > all_of)
        value = distance(own[marks], all_of[marks])
        order = np.lexsort((-value, source[marks]))
        marks, value = marks[order], value[order]
        cuts = np.searchsorted(source[marks], np.arange(len(totals) + 1)).tolist()
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if b - a > self.shown:  # all that tie with the last one shown, before their terms decide
                b = a + int(np.searchsorted(-value[a:b], -value[a + self.shown - 1], "right"))
            if b > a:
                key = lang, self.sources[lang][i][0]
                new = [(-int(value[j]), term_at(words, int(at[marks[j]]))) for j in range(a, b)]
                self.best[key] = heapq.nsmallest(self.shown, self.best.get(key, []) + new)

    def rows(self, last: bool = True) -> Iterator[tuple]:
        """(part, lang, source, item, value) so far; the sums start anew."""
        for lang, sums in self.sums.items():
            names = [s for s, _ in self.sources[lang]]
            for i, j in zip(*(x.tolist() for x in np.nonzero(sums)), strict=True):
                yield "pair", lang, names[i], names[j], int(sums[i, j])
                yield "pair", lang, names[j], names[i], int(sums[i, j])
        self.sums = {}
        if last:
            for (lang, source), found in self.best.items():
                for value, term in found:
                    yield "term", lang, source, term.decode("utf-8"), -value


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, shown: int = SHOWN) -> DataFrame:
    """Each source against the other sources of its language and against the language: lang, source, part, item, value, rank.

    Terms are runs of letters (A-Z lower-cased; bytes from 0x80 count as letters). A language keeps the terms that `least` of its documents
    have. A source's share of a term is p = 1 + floor(UNIT * (count + 2) / (N + 2 * V)), N its occurrences of kept terms and V the number
    of the language's. Part ``pair``: item is another source, value the sum of floor((p - q)^2 / (p + q)) over all kept terms. Part
    ``term``: item is a term that the source has and uses more than its language, value the same for the two, the `shown` highest alone.
    Ranks go from 1, by value descending, then item in the order of its bytes.

    Nulls are empty strings, also as language and source; texts without terms still make their group; copies and repeated rows count
    each; an empty table gives no rows; further columns are not read. All sums are exact for up to 2^53 occurrences a group. The
    list of groups goes to all tasks: it is at most as long as the result, which has a row for each two sources of a language.
    """
    spark = docs.sparkSession
    names = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (lang, source, text)]
    path, rows_path = shared_path(spark, "terms"), shared_path(spark, "compared")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept_terms(term_runs(docs, *names, buckets), least).write.parquet(path)
    kept = spark.read.schema(ROWS).parquet(path)
    groups = docs.select(names[0].alias("lang"), names[1].alias("source")).distinct()
    found = {(r["lang"], r["source"]): r["n"] for r in _sizes(kept).collect()}
    sources: dict[str, list[tuple[str, int]]] = {}
    for r in sorted(groups.collect()):
        sources.setdefault(r["lang"], []).append((r["source"], found.get((r["lang"], r["source"]), 0)))
    sent = spark.sparkContext.broadcast((sources, {k[0]: n for k, n in found.items() if k[1] is None}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compared = Compared(*sent.value, shown)

        def out(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            if held := list(rows):
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), [pa.string()] * 4 + [pa.int64()], strict=True)], names=["part", "lang", "source", "item", "value"])

        for batch in batches:
            for row in batch.to_pylist():
                runs = Runs()
                runs.add_row(row)
                yield from out(compared.add(runs))
        yield from out(compared.rows())

    kept.mapInArrow(run, "part string, lang string, source string, item string, value long").write.parquet(rows_path)
    rows = spark.read.schema("part string, lang string, source string, item string, value long").parquet(rows_path)
    every = spark.createDataFrame([(k, s) for k, own in sources.items() for s, _ in own], "lang string, source string")
    summed = rows.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = every.join(every.withColumnRenamed("source", "item"), "lang").where("source <> item").join(summed, ["lang", "source", "item"], "left")
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    both = both.unionByName(rows.where("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= shown))
