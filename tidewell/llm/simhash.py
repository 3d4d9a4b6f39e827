"""SimHash near-duplicates: fingerprints, a forest of vantage-point trees, exact pairs, components.

Two fingerprints are linked if at most ``radius`` of their 64 bits differ. Over whole fingerprints
a vantage-point tree prunes little: the distances from any vantage point lie close to 32. So the
64 bits are split into blocks whose own radii add up to radius + 1 - blocks: if every block of a
pair differed by more than its radius, more than ``radius`` bits would differ in all. Each block has
a tree with its own small radius (0 or 1), and there the triangle bound cuts most branches.

* A tree's top is grown from a small, bounded sample of fingerprints (SHARE, SAMPLE; on the driver); its
  leaves are the shards. Every fingerprint is sent to its own shard, and to each earlier shard which its
  ball reaches over the boundary.
* A shard splits further inside its task, by the same rule, down to LEAF fingerprints, and compares
  there. It returns a spanning forest of what it links, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.base import HOT, SALTS, cut, freed, hot_keys, in_few_tasks, lots, per_text, raw, shared_path, tasks_for, with_keyed, with_small
from tidewell.operators.postings import drop

SEED = 42
#: The trees' tops are grown from one fingerprint in SHARE, SAMPLE of them at most, and as many of them a shard at least.
SHARE, SAMPLE, SHARD_SAMPLE = 16, 1 << 19, 16
#: Fingerprints of a shard aimed at, and those that are compared without splitting.
SHARD, LEAF = 4_000, 1_024


def fingerprint_of(text: bytes, width: int = 4, seed: int = SEED, block: int = 65_536) -> int:
    """64 bits, each 1 if set in over half of the hashes of the text's word shingles; no words: 0."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if n <= width:
        return hashed(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: n - width + 1].tolist(), ends[width - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(first), block):
        hashes = np.array([hashed(joined[a:b], seed) for a, b in zip(first[at : at + block], last[at : at + block], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n - width + 1, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = 4, name: str = "fingerprint") -> DataFrame:
    """keep's columns and the fingerprint of every whole text, as a signed long."""

    def make() -> Callable[[list[bytes]], dict]:
        return lambda texts: {name: np.array([fingerprint_of(x, width) for x in texts], np.uint64).view(np.int64)}

    return per_text(docs, keep, text, make, T.StructType([T.StructField(name, T.LongType())]))


def blocks(radius: int) -> list[tuple[int, int]]:
    """(mask, radius) of each block: radius 1 in all but one at most, and the widths as even as that allows."""
    n = radius // 2 + 1
    own = [1] * (radius + 1 - n) + [0] * (2 * n - radius - 1)
    weights = [4 if r else 3 for r in own]
    edges = [round(64 * sum(weights[:i]) / sum(weights)) for i in range(n + 1)]
    return [(((1 << (b - a)) - 1) << a, r) for a, b, r in zip(edges, edges[1:], own, strict=False)]


def _split(points: np.ndarray, mask: np.uint64, radius: int, tries: int = 8) -> tuple[np.uint64, int] | None:
    """The vantage point and cut (inside: distance <= cut) with the lightest boundary among some that halve the points."""
    best = None
    for vantage in points[:: max(1, len(points) // tries)][:tries]:
        d = np.bitwise_count((points ^ vantage) & mask).astype(np.int64)
        counts = np.bincount(d, minlength=65)
        below = np.cumsum(counts)
        c = int(np.argmin(np.abs(2 * below - len(points))))
        inside = int(below[c])
        if inside in (0, len(points)):
            continue
        shared = int(counts[max(0, c - radius + 1) : c + radius + 1].sum()) if radius else 0
        cost = max(inside, len(points) - inside) + shared
        if best is None or cost < best[0]:
            best = (cost, vantage, c)
    return best and best[1:]


def grow(points: np.ndarray, mask: int, radius: int, leaf: int) -> list:
    """A tree's top: nodes (vantage, cut, inside, outside) by number, or (None, shard) for leaves; the first is the root."""
    m, nodes, shards = np.uint64(mask), [], 0

    def make(own: np.ndarray) -> int:
        nonlocal shards
        at = len(nodes)
        nodes.append(None)
        found = _split(own, m, radius) if len(own) > leaf else None
        if found is None:
            nodes[at] = (None, shards)
            shards += 1
            return at
        near = np.bitwise_count((own ^ found[0]) & m) <= found[1]
        inside = make(own[near])
        nodes[at] = (found[0], found[1], inside, make(own[~near]))
        return at

    make(points)
    return nodes


def _deal(d: np.ndarray, cut_at: int, radius: int, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Who goes inside and who outside, and who of them is at home there.

    Of a pair at home on both sides of a boundary, the outer one visits inside: that finds it once.
    """
    near = d <= cut_at
    return d - radius <= cut_at, home & near, np.where(home, ~near, d + radius > cut_at), home & ~near


def route(nodes: list, points: np.ndarray, mask: int, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indexes of the points sent there, whether each is at home there)."""
    m = np.uint64(mask)
    stack = [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        at, own, home = stack.pop()
        if not len(own):
            continue
        node = nodes[at]
        if node[0] is None:
            yield node[1], own, home
            continue
        d = np.bitwise_count((points[own] ^ node[0]) & m).astype(np.int64)
        goes_in, home_in, goes_out, home_out = _deal(d, node[1], radius, home)
        stack.append((node[2], own[goes_in], home_in[goes_in]))
        stack.append((node[3], own[goes_out], home_out[goes_out]))


class Links:
    """Components of what one shard links: a label for each point, and the edges that joined two."""

    def __init__(self, n: int) -> None:
        self.label, self.alone, self.edges = np.arange(n), np.ones(n, bool), []

    def join(self, i: int, others: np.ndarray) -> None:
        mine = self.label[i]
        others = others[self.label[others] != mine]
        if not len(others):
            return
        single = others[self.alone[others]]
        self.label[single] = mine
        firsts, self.alone[i] = [single], False
        rest = others[~self.alone[others]]
        self.alone[single] = False
        if len(rest):
            groups, at = np.unique(self.label[rest], return_index=True)
            self.label[np.isin(self.label, groups)] = mine
            firsts.append(rest[at])
        self.edges += [np.column_stack((np.full(len(x), i), x)) for x in firsts if len(x)]


def link(points: np.ndarray, home: np.ndarray, mask: int, block_radius: int, radius: int) -> np.ndarray:
    """Edges (rows of two indexes) that connect the points as all their links do which touch a home point."""
    links, m = Links(len(points)), np.uint64(mask)

    def compare(own: np.ndarray, at_home: np.ndarray) -> None:
        order = np.concatenate((own[at_home], own[~at_home]))
        n, n_home = len(order), int(at_home.sum())
        p, step = points[order], max(1, 2_000_000 // max(1, n))
        for a in range(0, n_home, step):
            b = min(n_home, a + step)
            close = np.bitwise_count(p[a:b, None] ^ p[None, a:]) <= radius
            close[np.arange(b - a)[:, None] >= np.arange(n - a)[None, :]] = False
            for r in np.flatnonzero(close.any(1)):
                i, others = order[a + r], order[a:][close[r]]
                others = others[links.label[others] != links.label[i]]
                if len(others):
                    links.join(i, others)

    stack = [(np.arange(len(points)), home)]
    while stack:
        own, at_home = stack.pop()
        n_home = int(at_home.sum())
        if not n_home:
            continue
        found = _split(points[own[at_home]], m, block_radius) if n_home > LEAF else None
        if found is None:
            compare(own, at_home)
            continue
        d = np.bitwise_count((points[own] ^ found[0]) & m).astype(np.int64)
        goes_in, home_in, goes_out, home_out = _deal(d, found[1], block_radius, at_home)
        stack += [(own[goes_in], home_in[goes_in]), (own[goes_out], home_out[goes_out])]
    return np.concatenate(links.edges) if links.edges else np.empty((0, 2), np.int64)


def links(points: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between the nodes of points (node, fingerprint), as many as connect what all links do."""
    forest, n = blocks(radius), points.count()
    share = min(1 / SHARE, SAMPLE / max(1, n))
    drawn = points.select("fingerprint").where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE)
    sample = np.sort(np.array([r[0] for r in drawn.collect()], np.int64)).view(np.uint64)
    sample = np.random.default_rng(SEED).permutation(sample)
    leaf = max(SHARD_SAMPLE, round(SHARD * share))
    trees = points.sparkSession.sparkContext.broadcast([grow(sample, mask, r, leaf) for mask, r in forest])
    cols = ["node", "fingerprint"]
    fields = [T.StructField("tree", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("home", T.BooleanType())] + [points.schema[c] for c in cols]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            p, values = batch["fingerprint"].to_numpy(np.int64).view(np.uint64), {c: batch[c].to_numpy() for c in cols}
            for k, (mask, r) in enumerate(forest):
                parts = list(route(trees.value[k], p, mask, r))
                own = np.concatenate([x for _, x, _ in parts])
                yield pd.DataFrame({"tree": np.int32(k), "shard": np.repeat(np.array([x for x, _, _ in parts], np.int32), [len(x) for _, x, _ in parts]), "home": np.concatenate([x for _, _, x in parts])} | {c: v[own] for c, v in values.items()})

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mask, r = forest[key[0]]
        p, node = rows["fingerprint"].to_numpy(np.int64).view(np.uint64), rows["node"].to_numpy(np.int64)
        edges = link(p, rows["home"].to_numpy(bool), mask, r, radius)
        return pd.DataFrame({"a": node[edges[:, 0]], "b": node[edges[:, 1]]})

    sent = points.select(*cols).mapInPandas(send, T.StructType(fields))
    return sent.groupBy("tree", "shard").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(node, root): of all nodes that each node in edges (a, b) reaches, the least label.

    A label is a struct: with first (node, first_id) the node's id (nulls last) and the node, else the node
    alone. Every round a node takes the least label of its neighbours, then the label of the node that this
    label names; so labels travel twice as far each round. The end is when a round changes none. Hubs
    and widespread labels are never dealt by their own key.
    """
    both = cut(edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    tasks = tasks_for(both.count())  # no table of a round has more rows
    both = both.coalesce(tasks)
    nodes = both.select(F.col("a").alias("node")).distinct()
    hubs = hot_keys(both, "b", tasks)
    heavy = None
    if hubs.limit(1).count():  # parted once; a round broadcasts no more than the hubs' labels
        marked = cut(with_small(both, hubs, "b", "_tw_hot", F.col("a"), "left"))
        both, heavy = marked.where("_tw_hot is null").select("a", "b"), marked.where("_tw_hot is not null").select("a", "b")
    if first is None:
        own = F.struct(F.lit(False).alias("no_id"), F.lit(None).cast("long").alias("first_id"), F.col("node"))
    else:
        nodes, own = nodes.join(first.select("node", "first_id").hint("merge"), "node"), F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "node")
    labels = cut(nodes.select("node", own.alias("root")).coalesce(tasks))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root").hint("merge"), "b").select("a", "root")
        if heavy is not None:
            few = labels.join(hubs.hint("merge"), F.col("node") == F.col("_tw_hot"), "left_semi").select(F.col("node").alias("_tw_key"), "root").coalesce(tasks)
            near = near.unionByName(with_small(heavy, few, "b", "_tw_key", F.col("a")).select("a", "root"))
        near = near.coalesce(tasks).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = cut(labels.join(near.hint("merge"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("low"), F.least("root", "near")["node"].alias("at")).coalesce(tasks))
        if not low.where("old <> low").limit(1).count():
            return low.select("node", F.col("low").alias("root"))
        lows = low.select(F.col("at").alias("_tw_at")).distinct()
        jump = low.where(F.col("at") != F.col("node")).join(lows.hint("merge"), F.col("node") == F.col("_tw_at"), "left_semi").select(F.col("node").alias("_tw_at"), F.col("low").alias("far"))
        labels = with_small(low.select("node", "low", "at"), jump.coalesce(tasks), "at", "_tw_at", F.col("node"), "left")
        labels = cut(labels.select("node", F.coalesce(F.least("low", "far"), "low").alias("root")).coalesce(tasks))


def near_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row a document: its id, ``fingerprint`` (signed long) and ``component_id``.

    component_id is the smallest id among the documents that links reach, itself included; null where
    none of them has an id. Texts without words, null ones too, have fingerprint 0 and link like any
    other. Equal fingerprints (copies, ties, repeated rows) become one point before any search. An
    empty table gives an empty result; further columns are not read.
    """
    marked = cut(fingerprints(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")), ["id"], "text", width, "node"))
    points = cut(marked.groupBy("node").agg(F.min("id").alias("first_id")))
    roots = components(links(points.select("node", F.col("node").alias("fingerprint")), radius), points)
    found = with_keyed(marked, grouped(points, roots), "node", "id")
    return found.select(F.col("id").alias(id_column), F.col("node").alias("fingerprint"), "component_id")


def grouped(points: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component_id) of all points (node, first_id): the least id of the nodes that links reach."""
    of = F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("root.first_id"))
    return cut(points.join(roots.hint("merge"), "node", "left").select("node", of.alias("component_id")).coalesce(tasks_for(points.count())))


# --- near duplicates by the similarity of their shingles ---

#: Trees over fingerprints of distinct words find most near copies within so many bits: texts with a few edits.
WORDS_RADIUS = 7
WIDTH = 5
#: Texts that share a rare shingle are paired if they are so many at most; else they are compared block by block.
FEW = 64
#: Sets that one task compares at once come in two blocks of about so many.
BLOCK = 1_024
#: Narrow rows (three longs) that are broadcast, after counting them.
NARROW_ROWS = 2_000_000
#: Counters for how often shingles occur, and what a task must have counted there, besides four times its mean, to report it.
COUNTERS, REPORTED = 1 << 24, 3
#: Shingles that a task holds before it counts them.
FOLD = 1 << 19
#: Posts (a shingle of a text's prefix each) that are shuffled at once, in so many parts at most; and rows whose texts are.
POSTS, PARTS, SENT = 1 << 24, 16, 1 << 19


def majority(hashes: np.ndarray, block: int = 65_536) -> np.uint64:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        counts += np.unpackbits(hashes[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


def words_fingerprint(text: bytes) -> int:
    """The fingerprint of a text's distinct words; no words: 0."""
    words = set(text.lower().split())
    return int(majority(np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64))) if words else 0


def shingles_of(text: bytes) -> np.ndarray:
    """The hashes of a text's distinct five-word shingles, sorted; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    hashed, n = xxhash.xxh64_intdigest, len(words)
    joined = b" ".join(words)
    if n <= WIDTH:
        return np.array([hashed(joined, SEED)] if n else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: n - WIDTH + 1].tolist(), ends[WIDTH - 1 :].tolist()
    return np.unique(np.array([hashed(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64))


def counter_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(40)).astype(np.int32)


def prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The rarest fifth of a set, and one more: any two sets of Jaccard similarity 0.8 or more share one of these.

    That holds for any one order of all shingles. Here common (steps of counts, by counter_of) decides, then the
    hash, so that widespread passages come last. A set without shingles has a mark of its own.
    """
    if not len(shingles):
        return np.zeros(1, np.uint64)
    rank = common[counter_of(shingles)]
    return shingles[np.lexsort((shingles, rank))[: len(shingles) // 5 + 1]]


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls under each of 2^k bits, one a shingle at least. Sets differ in no fewer shingles than bits."""
    bits = 64
    while bits < len(shingles):
        bits *= 2
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) % 2
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def may_reach(n: int, odd: np.ndarray, m: int, other: np.ndarray) -> bool:
    """Whether sets of n and m shingles with these parities can have a Jaccard similarity of 0.8."""
    if len(odd) > len(other):
        odd, other = other, odd
    apart = odd ^ np.bitwise_xor.reduce(other.reshape(-1, len(odd)), axis=0)
    return 9 * int(np.bitwise_count(apart).sum(dtype=np.int64)) <= n + m


def surveyed(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """docs (id, node, text) as (id, node, fingerprint of the words, n shingles, parity), and how common shingles are by COUNTERS.

    Each task reports only the counters that stand out; so what reaches the driver is at most COUNTERS
    numbers, and rare shingles count 0. The counts, in steps of a third more, order shingles and decide nothing.
    """

    id_type, longs = docs.schema["id"].dataType, pa.list_(pa.int64())
    kind = to_arrow_type(id_type)
    names = ["id", "node", "fingerprint", "n", "parity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, seen = None, []  # all counters in a task with many shingles, else those it has seen
        for batch in batches:
            for lot in lots(batch, 2):
                texts = raw(lot.column(2))
                sets = [shingles_of(x) for x in texts]
                seen.append(counter_of(np.concatenate(sets)))
                if sum(map(len, seen)) > FOLD:
                    every = np.zeros(COUNTERS, np.uint32) if every is None else every
                    slots, n = np.unique(np.concatenate(seen), return_counts=True)
                    every[slots] += n.astype(np.uint32)
                    seen = []
                marks = np.array([words_fingerprint(x) for x in texts], np.uint64).view(np.int64)
                own = [pa.array(marks), pa.array([len(x) for x in sets], pa.int64()), pa.array([parities(x).view(np.int64) for x in sets], longs)]
                yield pa.RecordBatch.from_arrays([lot.column(0), lot.column(1), *own], names=names)
        slots, counts = np.unique(np.concatenate([np.zeros(0, np.int32), *seen]), return_counts=True)
        if every is not None:
            every[slots] += counts.astype(np.uint32)
            slots = np.flatnonzero(every)
            counts = every[slots]
        clear = counts >= REPORTED + 4 * counts.sum(dtype=np.int64) / COUNTERS
        slots, counts = slots[clear].astype(np.int64), counts[clear].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(slots), kind), pa.array(slots), pa.nulls(len(slots), pa.int64()), pa.array(counts), pa.nulls(len(slots), longs)], names=names)

    schema = T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in names[1:4]), T.StructField("parity", T.ArrayType(T.LongType()))])
    rows = cut(docs.select("id", "node", "text").mapInArrow(run, schema))
    common = np.zeros(COUNTERS, np.uint8)
    steps = rows.where("parity is null").groupBy("node").agg(F.least(F.lit(255), F.ceil(F.log(F.sum("n")) * 3.5)).alias("step"))
    found = steps.select(F.col("node").cast("int"), F.col("step").cast("short")).toArrow()
    common[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return rows.where("parity is not null"), common


#: Whether a set may be the smaller of two similar ones that first share this shingle.
SMALLER = "9 * (n - place) >= 8 * n"


def sharing(docs: DataFrame, common: np.ndarray, parts: int = 1) -> DataFrame:
    """(a, b, many): nodes of docs (node, text) that share a shingle of their prefixes and may be similar by it; a cut table.

    Where up to FEW nodes share one, their pairs; where many do, each of them with the least. Nodes of a shingle that tasks reported as
    common are first met in salted parts, and each part that has many hands on one for all. So no key has more rows than FEW for
    each salt, or those that single tasks don't report. Shingles meet in so many parts, one after the other, so that no more
    than a part of all posts is shuffled at once; posts are written once and go when all have met.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common)
    names, kinds = ["shingle", "salt", "node", "n", "place", "stands"], "shingle long, salt int, node long, n int, place int, stands boolean"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text are sent once a task
        for lot in (x for batch in batches for x in lots(batch, 1)):
            new = [(node, x) for node, x in zip(lot.column(0).to_pylist(), raw(lot.column(1)), strict=True) if node not in seen and not seen.add(node)]
            sets = [shingles_of(x) for _, x in new]
            found = [prefix(x, sent.value) for x in sets]
            if found:
                sizes = [len(x) for x in found]
                node, n = (np.repeat(np.array(v), sizes) for v in ([n for n, _ in new], [len(x) for x in sets]))
                place, shingle = np.concatenate([np.arange(k) for k in sizes]), np.concatenate(found)
                salt = np.where(sent.value[counter_of(shingle)] > 0, node % SALTS, -1)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in ((shingle.view(np.int64), pa.int64()), (salt, pa.int32()), (node, pa.int64()), (n, pa.int32()), (place, pa.int32()), (np.zeros(len(n), bool), pa.bool_()))], names=names)

    def ordered(batches: Iterator[pa.RecordBatch], salted: bool) -> tuple[np.ndarray, ...] | None:
        seen = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches]
        if not seen:
            return None
        s, salt, node, n, place, stands = (np.concatenate(x) for x in zip(*seen, strict=True))
        order = np.lexsort((place, n, node, salt, s) if salted else (place, n, node, s))
        s, salt, node, n, place, stands = (x[order] for x in (s, salt, node, n, place, stands))
        fresh = np.ones(len(s), bool)
        fresh[1:] = (np.diff(s) != 0) | (np.diff(node) != 0)
        s, salt, node, n, place = (x[fresh] for x in (s, salt, node, n, place))
        stands = np.logical_or.reduceat(stands, np.flatnonzero(fresh))
        key = np.append(True, (np.diff(s) != 0) | ((np.diff(salt) != 0) & salted))
        return s, salt, node, n, place, stands, np.flatnonzero(key)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Salted parts of common shingles: parts of up to FEW nodes pass, others as edges (no shingle left to meet) and one that stands for them."""
        got = ordered(batches, True)
        if got is None:
            return
        s, salt, node, n, place, stands, first = got
        sizes = np.diff(first, append=len(s))
        stays = np.repeat(sizes <= FEW, sizes)
        edges = []
        for k, size in zip(first[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            stays[k] = stands[k] = True
            edges += [(node[k], x) for x in node[k + 1 : k + size]]
        rows = [x[stays] for x in (s, np.full(len(s), -1, np.int32), node, n, place, stands)]
        edge = np.array(edges, np.int64).reshape(-1, 2)
        # an edge: n is -1, and the shingle is the other node
        full = [np.concatenate(x) for x in zip(rows, [edge[:, 0], np.full(len(edge), -2, np.int32), edge[:, 1], np.full(len(edge), -1), np.zeros(len(edge), int), np.ones(len(edge), bool)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(full, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = ordered(batches, False)
        if got is None:
            return
        s, _, node, n, place, stands, first = got
        sizes = np.diff(first, append=len(s))
        whole = np.maximum.reduceat(stands, first)
        for k in np.unique(sizes[(sizes > 1) & (sizes <= FEW) & ~whole]).tolist():
            at = first[(sizes == k) & ~whole][:, None] + np.arange(k)
            i, j = np.triu_indices(k, 1)
            step = max(1, (1 << 18) // len(i))
            for x in range(0, len(at), step):
                left, right = at[x : x + step, i].ravel(), at[x : x + step, j].ravel()
                fit = 9 * np.minimum(n[left] - place[left], n[right] - place[right]) >= 4 * (n[left] + n[right])
                pairs = np.unique(np.column_stack((node[left[fit]], node[right[fit]])), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(np.zeros(len(pairs), bool))], names=["a", "b", "many"])
        large = (sizes > FEW) | whole
        edges = []
        for k, size in zip(first[large].tolist(), sizes[large].tolist(), strict=True):
            at = np.arange(k, k + size)
            at = at if stands[at].any() else at[able(n[at], place[at])]
            edges += [(node[at[0]], x) for x in node[at[1:]]] if len(at) else []
        edge = np.unique(np.array(edges, np.int64).reshape(-1, 2), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0].copy()), pa.array(edge[:, 1].copy()), pa.array(np.ones(len(edge), bool))], names=["a", "b", "many"])

    posts = docs.select("node", "text").mapInArrow(send, kinds)
    path, part = shared_path(docs.sparkSession, "posts"), F.pmod("shingle", F.lit(parts)).cast("int")
    posts.withColumn("part", part).write.partitionBy("part").parquet(path)
    posts = docs.sparkSession.read.schema(f"{kinds}, part int").parquet(path)
    # as able(), by the least and largest size of nodes that may be the smaller of two
    size = F.when(F.expr(SMALLER), F.col("n"))
    sizes = in_few_tasks(cut(posts.where("salt >= 0").groupBy(F.col("shingle").alias("_tw_shingle")).agg(F.min(size).alias("low"), F.max(size).alias("high")).where("low is not null")))
    reported = with_small(posts.where("salt >= 0").drop("part"), sizes, "shingle", "_tw_shingle", F.col("node"))
    reported = reported.where(F.expr(SMALLER) | F.expr("5 * high >= 4 * n and low <= n and 4 * low <= 9 * (n - place) - 4 * n")).select(*names)
    gathered = in_few_tasks(cut(reported.repartition("shingle", "salt").mapInArrow(gather, kinds)))
    found = gathered.where("n < 0").select(F.col("shingle").alias("a"), F.col("node").alias("b"), F.lit(True).alias("many"))
    for k in range(parts):
        own = posts.where((F.col("part") == k) & (F.col("salt") < 0)).drop("part").unionByName(gathered.where((part == k) & (F.col("n") >= 0)))
        met = own.repartition("shingle").mapInArrow(meet, "a long, b long, many boolean")
        found = found.unionByName(met if parts == 1 else cut(met.distinct()))
    found = cut(found.distinct())
    drop(docs.sparkSession, path)
    return found


def able(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of the sets that share a shingle may be similar to another of them, if it is the first they share.

    A set of n shingles that has it at `place` shares n - place at most. It needs a partner, and of two partners the
    smaller one has it within its first ninth.
    """
    left = n - place
    small = 9 * left >= 8 * n  # may be the smaller of two, and is similar to others of its kind by these bounds
    sizes = np.sort(n[small])
    # the smaller partner m: 5 m >= 4 n and 9 (n - place) >= 4 (n + m)
    low, high = np.searchsorted(sizes, -(-4 * n // 5)), np.searchsorted(sizes, np.minimum((9 * left - 4 * n) // 4, n), "right")
    return small | (high > low)


def likely(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Those of pairs (a, b; of a cut table) of points (node, n, label, parity) with other labels whose sizes and parities let them be similar."""

    tasks = tasks_for(pairs.count())

    def both(rows: DataFrame, own: DataFrame, small: bool) -> DataFrame:
        for k, other in (("a", "b"), ("b", "a")):
            side = own.select(F.col("node").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in own.columns if c != "node"))
            rows = rows.join(F.broadcast(side), k) if small else with_keyed(cut(rows.coalesce(tasks)), side, k, other, tasks=tasks)
        return rows

    near = both(pairs, points.select("node", "n", "label"), points.count() <= NARROW_ROWS)
    near = near.where("label_a <> label_b and 5 * n_a >= 4 * n_b and 5 * n_b >= 4 * n_a")
    wide = both(near.select("a", "b"), points.select("node", "n", "parity"), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = [(c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in (batch.column(4), batch.column(5))]
            n, m = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            fit = [may_reach(n[k], *(v[e[k] : e[k + 1]] for v, e in odd[:1]), m[k], *(v[e[k] : e[k + 1]] for v, e in odd[1:])) for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

    return wide.select("a", "b", "n_a", "n_b", "parity_a", "parity_b").coalesce(tasks).mapInArrow(run, "a long, b long")


def joined(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect the sets as all pairs of Jaccard similarity 0.8 or more do, where label says which are connected already."""
    n, size = len(sets), np.array([len(x) for x in sets])
    of, begin = np.repeat(np.arange(n), size), np.cumsum(size) - size
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    posting, at = of[order], np.searchsorted(number[order], np.arange(int(number.max(initial=-1)) + 2))
    label, todo, edges = label.copy(), np.ones(n, bool), []
    while True:
        left = np.flatnonzero(todo)
        if not len(left) or (label[left] == label[left[0]]).all():
            return edges
        i = left[np.argmin(np.bincount(label[left], minlength=n)[label[left]])]
        todo[i] = False
        others = left[label[left] != label[i]]
        own = number[begin[i] : begin[i] + size[i]]
        times = at[own + 1] - at[own]
        place = np.arange(times.sum()) + np.repeat(at[own] - np.cumsum(times) + times, times)
        both = np.bincount(posting[place], minlength=n)[others]
        for j in others[9 * both >= 4 * (size[i] + size[others])]:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                edges.append((i, j))


def spread(few: DataFrame) -> DataFrame:
    """few, a cut table of narrow rows, broadcast if it is small."""
    return F.broadcast(few) if few.count() <= NARROW_ROWS else few


def with_texts(texts: DataFrame, few: DataFrame) -> DataFrame:
    """few (first_id, ...), a cut table of narrow rows, with the text of each one's id in texts (id, text)."""
    return texts.select("id", "text").join(spread(few), F.col("id") == F.col("first_id")).drop("id", "first_id")


def in_lots(few: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What work makes of few, a cut table of narrow rows with whose texts it deals by keys: SENT rows or so at a time, each lot's result cut.

    So the texts that are shuffled at once are bounded, and a lot is small enough to be broadcast to where the texts are.
    """
    n = max(1, -(-few.count() // SENT))
    if n == 1:
        return work(few)
    lot = F.pmod(F.xxhash64(*keys), F.lit(n))
    return reduce(DataFrame.unionByName, [cut(work(few.where(lot == k))) for k in range(n)])


def verified(edges: DataFrame, points: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of edges (a, b; a cut table) whose nodes' Jaccard similarity is 0.8 or more.

    Whole texts move once for each edge, and a hub's edges are dealt over several copies of it; tasks take them one by one.
    """
    tasks = tasks_for(edges.count())
    edges = edges.coalesce(tasks)
    hubs = edges.groupBy(F.col("a").alias("_tw_hub")).count().where(F.col("count") > HOT)
    salt = F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("count") / HOT), F.lit(1)))
    dealt = cut(with_small(edges, cut(hubs.coalesce(tasks)), "a", "_tw_hub", F.col("b"), "left").select("a", salt.alias("salt"), "b"))
    sides = dealt.select("a", "salt", F.lit(True).alias("other"), F.col("b").alias("node")).unionByName(dealt.select("a", "salt").distinct().select("*", F.lit(False).alias("other"), F.col("a").alias("node")))
    sides = cut(sides.join(points.select("node", "first_id").hint("merge"), "node").coalesce(tasks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.zeros(0, np.uint64)
        for lot in (x for batch in batches for x in lots(batch, 4)):
            found = []
            a, salt, other, node = (lot.column(i).to_pylist() for i in range(4))
            for k, text in enumerate(raw(lot.column(4))):
                shingles = shingles_of(text)
                if not other[k]:
                    key, own = (a[k], salt[k]), shingles
                elif key == (a[k], salt[k]) and 9 * len(np.intersect1d(own, shingles, assume_unique=True)) >= 4 * (len(own) + len(shingles)):
                    found.append((a[k], node[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def compared(few: DataFrame) -> DataFrame:
        rows = with_texts(texts, few).select("a", "salt", "other", "node", "text")
        # false sorts first: the hub stands before its edges
        return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "other").mapInArrow(run, "a long, b long")

    return in_lots(sides, ["a", "salt"], compared)


def in_units(asked: DataFrame) -> DataFrame:
    """asked (root, node, label, n, ...) once for each unit that compares its node; a unit has two blocks of about BLOCK nodes at most.

    All nodes of a root that have different labels and sizes within a fourth of each other meet in some unit: large roots are parted
    by sizes in steps of a fourth, each step with the next. Labels of many nodes have blocks of their own, which don't meet each other.
    """
    tasks = tasks_for(asked.count())
    per_root = asked.groupBy(F.col("root").alias("_tw_root")).count().where(F.col("count") > 2 * BLOCK).select("_tw_root")
    wide = cut(per_root.coalesce(tasks))
    if wide.limit(1).count():
        marked = cut(with_small(asked, wide, "root", "_tw_root", F.col("node"), "left"))
        step = F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(math.log(1.25)) + F.lit(1e-9))
        bands = marked.where("_tw_root is not null").withColumn("band", F.explode(F.array(step, step + 1))).withColumn("root", F.xxhash64("root", "band"))
        asked = cut(marked.where("_tw_root is null").select(*asked.columns).unionByName(bands.select(*asked.columns)))
    by_label = asked.groupBy("root", "label").agg(F.count("*").alias("of_label"))
    by_root = by_label.groupBy("root").agg(F.sum("of_label").alias("of_root"), F.sum(F.when(F.col("of_label") <= BLOCK, F.col("of_label")).otherwise(0)).alias("of_few"))
    large = cut(by_root.where(F.col("of_root") > 2 * BLOCK).coalesce(tasks))
    if not large.limit(1).count():
        return asked.withColumn("unit", F.col("root"))
    marked = with_small(asked, large.withColumnRenamed("root", "_tw_root"), "root", "_tw_root", F.col("node"), "left")
    small = marked.where("_tw_root is null").select(*asked.columns, F.col("root").alias("unit"))
    many = by_label.where(F.col("of_label") > BLOCK).select(F.col("label").alias("_tw_label"), F.col("root").alias("_tw_of"), "of_label")
    big = with_small(marked.where("_tw_root is not null"), cut(many.coalesce(tasks)), "label", "_tw_label", F.col("node"), "left", F.col("root") == F.col("_tw_of"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.ceil(F.col(n) / BLOCK))
    block = F.when(F.col("_tw_label").isNull(), F.xxhash64(F.lit("few"), part("label", "of_few"))).otherwise(F.xxhash64("label", part("node", "of_label")))
    big = cut(big.withColumn("block", block).select(*asked.columns, "block", "_tw_label"))
    blocks = cut(big.select("root", "block", F.col("_tw_label").alias("own")).distinct().coalesce(tasks))
    others = blocks.select(F.col("root").alias("r"), F.col("block").alias("other"), F.col("own").alias("its"))
    meet = blocks.join(others, (F.col("root") == F.col("r")) & ~F.coalesce(F.col("own") == F.col("its"), F.lit(False)))
    units = meet.select("root", "block", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("unit"))
    return small.unionByName(big.join(units, ["root", "block"]).select(*asked.columns, "unit"))


def joined_within(rows: DataFrame) -> DataFrame:
    """(a, b): links between the nodes of each unit in rows (unit, node, label, text), as many as connect what all links do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, own = None, []

        def found() -> Iterator[pa.RecordBatch]:
            label = np.unique([x[1] for x in own], return_inverse=True)[1]
            pairs = [(own[i][0], own[j][0]) for i, j in joined([x[2] for x in own], label)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for lot in (x for batch in batches for x in lots(batch, 3)):
            for u, node, label, text in zip(*(lot.column(i).to_pylist() for i in range(3)), raw(lot.column(3)), strict=True):
                if u != unit and own:
                    yield from found()
                    own = []
                unit = u
                own.append((node, label, shingles_of(text)))
        if own:
            yield from found()

    return rows.select("unit", "node", "label", "text").repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, node (a hash of the text) and component_id, as in near_groups, for near duplicates by similarity; ids are unique.

    Two texts are linked if the Jaccard similarity of their five-word shingles is 0.8 or more. Trees over the
    fingerprints of their words find most links, which all shingles verify. For the rest, texts
    that share a rare shingle are compared exactly, unless links connect them already: no such pair shares none.
    """
    own = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    marked, common = surveyed(own)
    tasks = tasks_for(marked.count())  # no table of nodes has more rows
    points = cut(marked.groupBy("node").agg(F.min("id").alias("first_id"), *(F.any_value(c).alias(c) for c in ("fingerprint", "n", "parity"))).coalesce(tasks))
    near = cut(links(points.select("node", "fingerprint"), WORDS_RADIUS).distinct())
    sure = cut(verified(near, points, own))
    label = components(sure).select("node", F.col("root.node").alias("label"))
    points = cut(points.join(label.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")).coalesce(tasks))
    posts = marked.agg(F.sum(F.floor(F.col("n") / 5) + 1)).first()[0] or 0
    shared = in_few_tasks(sharing(own, common, min(PARTS, max(1, -(-posts // POSTS)))))
    paired = verified(cut(likely(shared.where("not many").select("a", "b"), points)), points, own)
    maybe = components(shared.where("many").select("a", "b")).select("node", F.col("root.node").alias("root"))
    asked = cut(maybe.join(points.select("node", "first_id", "label", "n").hint("merge"), "node").coalesce(tasks))
    open_ = asked.groupBy("root").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select(F.col("root").alias("_tw_open"))
    asked = cut(with_small(asked, cut(open_.coalesce(tasks)), "root", "_tw_open", F.col("node")).drop("_tw_open"))
    more = in_lots(in_few_tasks(cut(in_units(asked))), ["unit"], lambda few: joined_within(with_texts(own, few)))
    found = in_few_tasks(cut(paired.unionByName(more)))
    for k, other in (("a", "b"), ("b", "a")):  # links between what is linked already: no hub of a large group is gone through again
        of = points.select(F.col("node").alias("_tw_node"), F.col("label").alias("_tw_of"))
        found = with_keyed(found.withColumnRenamed(k, "_tw_node"), of, "_tw_node", other, tasks=tasks).select(F.col("_tw_of").alias(k), other)
        found = in_few_tasks(cut(found))
    whole = cut(points.groupBy(F.col("label").alias("node")).agg(F.min("first_id").alias("first_id")).coalesce(tasks))
    of_label = grouped(whole, components(found, whole)).withColumnRenamed("node", "label")
    of_node = cut(with_keyed(points.select("node", "label"), of_label, "label", "node", tasks=tasks).select("node", "component_id").coalesce(tasks))
    return with_keyed(marked.select("id", "node"), of_node, "node", "id", tasks=tasks).coalesce(tasks)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one document of each group: the one with the smallest id stays.

    Where ids are missing or repeat, rows are numbered first and the first of each group stays. All columns
    stay, whatever their names.
    """
    if docs.groupBy(id_column).count().where(F.col(id_column).isNull() | (F.col("count") > 1)).limit(1).count():
        rows = cut(docs.withColumn("_tw_row", F.monotonically_increasing_id()))
        return _without_later(rows, "_tw_row", text).drop("_tw_row")
    return _without_later(docs, id_column, text)


def _without_later(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """keep_one for unique ids. While groups are found, no query's shuffled files outlive it; then texts stay where they are
    if those that go, or those that stay, are few enough to be broadcast."""
    with freed(docs.sparkSession):
        of = cut(similar_groups(docs, id_column, text).select(F.col("id").alias("_tw_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("stays")))
        n, stay = of.agg(F.count("*"), F.count_if("stays")).first()
        few = spread(of.where("stays" if 2 * stay <= n else "not stays").select("_tw_id"))
    return docs.join(few, docs[id_column] == few["_tw_id"], "left_semi" if 2 * stay <= n else "left_anti")
