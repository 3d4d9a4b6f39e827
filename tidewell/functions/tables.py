"""Table functions for SQL: register(spark) makes them known, LATERAL calls them.

    SELECT doc_id, pos, piece FROM documents, LATERAL chunk_text(text, 256, 50)
    SELECT doc_id, pos, piece FROM documents, LATERAL split_semantic(text, 5)
    SELECT * FROM group_paragraphs(TABLE(SELECT doc_id, pos, piece FROM pieces) PARTITION BY doc_id ORDER BY (pos), 200)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from tidewell.operators import chunks

PIECES = "pos: int, piece: string"


class ChunkText:
    """Chunks of a text of at most `size` words that share up to `overlap`, with their places from 0; null texts have none."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunks.recursive_split(text or "", size or 256, overlap or 0, length=lambda t: len(t.split())))


class SplitSemantic:
    """Groups of like paragraphs with their places from 0. If the embedder fails, the whole text is the one group."""

    embed: Callable[[str], np.ndarray] = staticmethod(chunks.hashed_vector)

    def eval(self, text: str, group_size: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunks.semantic_groups_or_text(text or "", group_size or 5, type(self).embed))


class GroupParagraphs:
    """For a table (id, pos, piece) parted by id and ordered by pos: runs of pieces joined until they have `least` characters.

    A partition is one document; its pieces pass one by one, and only the open run is held.
    """

    def __init__(self) -> None:
        self.id, self.n, self.run, self.size = None, 0, [], 0

    def eval(self, row: Row, least: int) -> Iterator[tuple[int | None, int, str]]:
        self.id = row[0]
        self.run.append(row[2] or "")
        self.size += len(self.run[-1])
        if self.size >= (least or 0):
            yield self._joined()

    def terminate(self) -> Iterator[tuple[int | None, int, str]]:
        if self.run:
            yield self._joined()

    def _joined(self) -> tuple[int | None, int, str]:
        out = (self.id, self.n, " ".join(self.run))
        self.n, self.run, self.size = self.n + 1, [], 0
        return out


def register(spark: SparkSession, embed: Callable[[str], np.ndarray] | None = None) -> None:
    """Make chunk_text, split_semantic and group_paragraphs known to SQL; embed in place of the stand-in vectors."""
    semantic = type("SplitSemanticBy", (SplitSemantic,), {"embed": staticmethod(embed)}) if embed else SplitSemantic
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType=PIECES, useArrow=True))
    spark.udtf.register("split_semantic", udtf(semantic, returnType=PIECES, useArrow=True))
    spark.udtf.register("group_paragraphs", udtf(GroupParagraphs, returnType="id: bigint, pos: int, piece: string"))
