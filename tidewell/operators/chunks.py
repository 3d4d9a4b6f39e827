"""Cutting texts into parents and children: headers, paragraphs, groups of similar paragraphs, token windows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.functions import text as X

PARENT_LIMIT, SMALL = 512, 50
#: Bytes of texts that a task cuts at once.
TEXT_BYTES = 2 << 20


def explode_pieces(docs: DataFrame, id_column: str, pieces: Column) -> DataFrame:
    """(id, pos, piece) of every piece."""
    return docs.select(id_column, F.posexplode(pieces).alias("pos", "piece"))


def absorb_small(pieces: Column, least: int = SMALL) -> Column:
    """An array of pieces in which pieces shorter than least have been appended to the one before them."""
    start = F.array().cast("array<string>")
    joined = lambda acc, x: F.when((F.size(acc) == 0) | (F.length(x) >= least), F.concat(acc, F.array(x))).otherwise(
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), x)))
    )
    return F.aggregate(pieces, start, joined)


def hashed_vector(text: str, size: int = 64) -> np.ndarray:
    """Word counts hashed into size places, with unit length: the default embedding of a paragraph."""
    v = np.zeros(size)
    for w in text.lower().split():
        v[zlib.crc32(w.encode()) % size] += 1
    n = np.linalg.norm(v)
    return v / n if n else v


def average_linkage(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Labels of agglomerative clusters by mean cosine distance of unit vectors; labels follow their clusters' first members.

    The mean distance of two clusters follows from the sums of their vectors, so chains of nearest
    neighbours find all merges in memory that grows with the vectors, not with their pairs.
    """
    n = len(vectors)
    sums, sizes, height, alive = np.array(vectors, float), np.ones(n), np.zeros(n), np.ones(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        i, before = chain[-1], chain[-2] if len(chain) > 1 else -1
        d = np.where(alive, 1 - sums @ sums[i] / (sizes * sizes[i]), np.inf)
        d[i] = np.inf
        j = int(np.argmin(d))
        if before < 0 or d[before] > d[j] + 1e-12:  # rounding must not lead a chain in a circle
            chain.append(j)
            continue
        i, j = sorted((i, before))
        height[i] = max(d[before], height[i], height[j])
        merges.append((height[i], i, j))
        sums[i] += sums[j]
        sizes[i] += sizes[j]
        alive[j] = False
        del chain[-2:]
    label = np.arange(n)
    for _, i, j in sorted(merges, key=lambda m: m[0])[: max(0, n - clusters)]:
        label[j] = i
    for x in range(n):  # a cluster keeps the number of its first member, so labels point back
        label[x] = label[label[x]]
    firsts = {x: k for k, x in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([firsts[x] for x in label.tolist()])


def semantic_groups(text: str, group_size: int = 5, embed: Callable[[str], np.ndarray] = hashed_vector, between: str = "\n") -> list[str]:
    """Paragraphs grouped by likeness, each group's in their order; headers part first, and small groups join the one before.

    All paragraphs of a text are clustered together: memory grows with their number, time with its square.
    """
    if group_size < 1:
        raise ValueError("group_size must be 1 or more")
    if len(text) < SMALL:
        return [text]
    if "###" in text:
        first, *rest = text.split("###")
        found = ([first] if first.strip() else []) + ["###" + x for x in rest if x.strip()]
        if len(found) > 1:
            return found
    parts = [p for p in text.split(between) if p.strip()]
    if len(parts) <= group_size:
        return parts or [text]
    labels = average_linkage(np.array([embed(p) for p in parts]), -(-len(parts) // group_size))
    own: list[list[str]] = [[] for _ in range(labels.max() + 1)]
    for p, x in zip(parts, labels.tolist(), strict=True):
        own[x].append(p)
    out: list[str] = []
    for g in map(" ".join, own):
        if out and len(g) < SMALL:
            out[-1] += g
        else:
            out.append(g)
    return out


def semantic_groups_or_text(text: str, group_size: int = 5, embed: Callable[[str], np.ndarray] = hashed_vector) -> list[str]:
    """semantic_groups, or the text itself where the embedder fails: a chunking service that is down costs no document."""
    try:
        return semantic_groups(text, group_size, embed)
    except Exception:  # noqa: BLE001  any failure of a remote model
        return [text]


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n"), length: Callable[[str], int] = len) -> list[str]:
    """Chunks of at most size (by length) that share up to overlap with the one before.

    Splits at the first separator that the text has, goes on with the next ones in pieces that are still
    too long, and merges neighbours. A piece without any separator can exceed size.
    """
    found = next((s for s in separators if s in text), None)
    if found is None:
        return [text] if text.strip() else []
    deeper = separators[separators.index(found) + 1 :]
    pieces, out, run, total, sep = [p for p in text.split(found) if p], [], [], 0, length(found)

    def flush() -> None:
        if run and (joined := found.join(run).strip()):
            out.append(joined)

    for p in pieces:
        n = length(p)
        if n > size:
            flush()
            run, total = [], 0
            out += recursive_split(p, size, overlap, deeper, length) if deeper else [p]
            continue
        if run and total + n + sep > size:
            flush()
            while run and (total > overlap or total + n + sep > size):
                total -= length(run.pop(0)) + (sep if run else 0)
        total += n + (sep if run else 0)
        run.append(p)
    flush()
    return out


def _pieces(docs: DataFrame, id_column: str, text: str, cut: Callable[[str], list[str]]) -> DataFrame:
    return _rows_of(docs.select(id_column, text), [T.StructField("pos", T.IntegerType()), T.StructField("piece", T.StringType())], lambda x: list(enumerate(cut(x or ""))))


def _rows_of(texts: DataFrame, added: list[T.StructField], rows: Callable[[str | None], list[tuple]]) -> DataFrame:
    """(id, added) of all rows that rows() gives for each text of texts (id, text), TEXT_BYTES of texts at a time."""
    schema = T.StructType([texts.schema[0], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [to_arrow_type(f.dataType) for f in added]
        for batch in batches:
            ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right")))
                found = [rows(x) for x in batch.column(1).slice(at, to - at).to_pylist()]
                of = pa.array(np.repeat(np.arange(at, to), [len(x) for x in found]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), *(pa.array([r[c] for x in found for r in x], t) for c, t in enumerate(kinds))], names=schema.names)
                at = to

    return texts.mapInArrow(run, schema)


def split_semantic(docs: DataFrame, id_column: str, text: str, group_size: int = 5) -> DataFrame:
    """(id, pos, piece) of semantic_groups over every text."""
    return _pieces(docs, id_column, text, lambda x: semantic_groups_or_text(x, group_size))


def split_recursive(docs: DataFrame, id_column: str, text: str, size: int = 256, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n"), by_words: bool = True) -> DataFrame:
    """(id, pos, piece) of recursive_split over every text, by words or by characters."""
    return _pieces(docs, id_column, text, lambda x: recursive_split(x, size, overlap, separators, (lambda t: len(t.split())) if by_words else len))


def parents_and_children(docs: DataFrame, id_column: str, text: str, child: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(id, unique_id, parent_id, page_content, in_index): parents by semantic_groups, children by recursive_split.

    Ids are the texts' md5. in_index: parents below PARENT_LIMIT characters, and all children; a child equal
    to its parent is no row. covered: false for a longer parent without children, which no index would see.
    """
    cut = child or (lambda x: recursive_split(x, 256, 50, length=lambda t: len(t.split())))
    groups = split_semantic(docs, id_column, text)
    added = [T.StructField("page_content", T.StringType()), T.StructField("parent", T.StringType())]
    rows = _rows_of(groups.select(id_column, "piece"), added, lambda p: [(p, None), *((c, p) for c in cut(p) if c != p)])
    small = F.col("parent").isNotNull() | (F.length("page_content") < PARENT_LIMIT)
    return rows.select(id_column, X.content_id(F.col("page_content")).alias("unique_id"), X.content_id(F.col("parent")).alias("parent_id"), "page_content", small.alias("in_index"))


# --- pages: images and the titles around them ---


def title_score(size: Column, bold: Column, lines: Column, text: Column, above: Column) -> Column:
    """How much a text block looks like an image's title; 0 for a sentence. Titles have 3 or more."""
    points = (
        F.when(size >= 10, 2.0).otherwise(0.0)
        + F.when(bold, 1.0).otherwise(0.0)
        + F.when(lines <= 3, 0.5).otherwise(0.0)
        + F.when(F.length(text) <= 30, 0.5).otherwise(0.0)
        + F.when(above, 2.0).otherwise(-1.0)
    )
    return F.when(text.rlike(r"[.。!！]\z"), 0.0).otherwise(points)


#: Sides of the grid's cells, and cells a rectangle may touch before it is compared by page alone.
CELL, MOST_CELLS = 100.0, 4_096


def near_blocks(images: DataFrame, blocks: DataFrame, page_height: float, reach: float = 200.0, margin: float = 50.0, cell: float = CELL) -> DataFrame:
    """Blocks (page, block, x0, y0, x1, y1, content) that touch images (page, image, x0, y0, x1, y1) widened
    upwards by reach and downwards by three heights, inside the page; above says on which side they lie.

    Rectangles are put into the cells of a grid over their page, and meet by page and cell; a pair counts in the cell of its
    overlap's upper left corner, so it comes once. A page of very many blocks is thus dealt over its cells. Rectangles
    of more than MOST_CELLS cells are few or none, and meet by page. Missing coordinates touch nothing.
    """
    i = images.select("page", "image", F.col("x0").alias("ix0"), F.col("x1").alias("ix1"), F.col("y0").alias("iy0"), F.greatest(F.lit(0.0), F.col("y0") - reach).alias("top"), F.least(F.lit(page_height - margin), F.col("y1") + 3 * (F.col("y1") - F.col("y0"))).alias("bottom"))
    b = blocks.where(~X.is_blank(F.col("content")))
    touch = (F.col("x0") < F.col("ix1")) & (F.col("ix0") < F.col("x1")) & (F.col("y0") < F.col("bottom")) & (F.col("top") < F.col("y1"))
    at = lambda c: F.floor(F.col(c) / cell)

    def in_cells(rows: DataFrame, x0: str, x1: str, y0: str, y1: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """rows once for each cell they touch, those rows once, and the rest: turned inside out, or of too many cells."""
        own = rows.where(~F.isnan(x0) & ~F.isnan(x1) & ~F.isnan(y0) & ~F.isnan(y1))
        small = (F.col(x0) <= F.col(x1)) & (F.col(y0) <= F.col(y1)) & ((at(x1) - at(x0) + 1.0) * (at(y1) - at(y0) + 1.0) <= MOST_CELLS)
        fits = own.where(small)
        cells = fits.withColumn("cx", F.explode(F.sequence(at(x0), at(x1)))).withColumn("cy", F.explode(F.sequence(at(y0), at(y1))))
        return cells, fits, own.where(~small)

    near, fits, wide = in_cells(b, "x0", "x1", "y0", "y1")
    seen, _, wide_seen = in_cells(i, "ix0", "ix1", "top", "bottom")
    once = (F.floor(F.greatest("x0", "ix0") / cell) == F.col("cx")) & (F.floor(F.greatest("y0", "top") / cell) == F.col("cy"))
    found = near.join(seen, ["page", "cx", "cy"]).where(touch & once).drop("cx", "cy")
    every = found.unionByName(wide.join(i, "page").where(touch)).unionByName(fits.join(wide_seen, "page").where(touch))
    return every.select("page", "image", "block", "content", (F.col("y1") <= F.col("iy0")).alias("above"))
