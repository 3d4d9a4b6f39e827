"""Token counts by greedy longest match in linear time: a trie of the vocabulary with failure links, and
for each node how many pieces are popped when its link is taken. Pieces themselves are never built."""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewell.llm.base import per_text

MEMO = 500_000


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for
    itself, and the other bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(tokenizer_json: str, end: str = "</w>") -> list[bytes]:
    """The vocabulary of a byte-level tokenizer file as bytes, marks of word ends and special tokens left out."""
    stored, known = json.loads(tokenizer_json), byte_of()
    special = {t["content"] for t in stored["added_tokens"]}
    return [bytes(known[c] for c in token.removesuffix(end)) for token in stored["model"]["vocab"] if token not in special]


class LongestMatch:
    """Counts the pieces of words by greedy longest match.

    A node's link leads to where the match goes on after the pieces that are certain have been popped;
    a node without one means that the rest can't be matched.
    """

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.step: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in vocabulary:
            at = 0
            for c in piece:
                to = self.step[at].get(c)
                if to is None:
                    to = self.step[at][c] = len(self.step)
                    self.step.append({})
                    whole.append(False)
                at = to
            whole[at] = at != 0
        self.link: list[int] = [-1] * len(self.step)
        self.popped = [0] * len(self.step)
        level = [0]
        while level:
            below = []
            for parent in level:
                for c, node in self.step[parent].items():
                    below.append(node)
                    if whole[node]:
                        self.link[node], self.popped[node] = 0, 1
                        continue
                    at, n = self.link[parent], self.popped[parent]
                    while at >= 0 and c not in self.step[at]:
                        n += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.step[at][c], n
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of the word; 0 if it has a part that no piece matches."""
        step, link, popped = self.step, self.link, self.popped
        at = n = 0
        for c in word:
            while (to := step[at].get(c)) is None:
                if link[at] < 0:
                    return 0
                n += popped[at]
                at = link[at]
            at = to
        while at:
            if link[at] < 0:
                return 0
            n += popped[at]
            at = link[at]
        return n


class Memo(dict):
    def __init__(self, matcher: LongestMatch) -> None:
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = n = self.matcher.count(word)
        return n


#: One automaton and memo a worker process; tasks that follow in it use them again.
_LOADED: dict[str, Memo] = {}


def loaded(key: str, tokenizer_json: Callable[[], str]) -> Memo:
    if key not in _LOADED:
        _LOADED[key] = Memo(LongestMatch(pieces(tokenizer_json())))
    return _LOADED[key]


def token_counts(docs: DataFrame, keep: list[str], tokenizer_json: str, text: str = "text") -> DataFrame:
    """keep's columns with n_words, n_tokens and n_unknown of every whole text.

    Words are lower-cased (A-Z) runs between white space; each is matched greedily against the vocabulary,
    wherever in a word its pieces were meant to stand. A word that the vocabulary can't match counts as one token and
    as unknown. Null and empty texts have none of them, very long ones are counted whole, repeated rows and ties each have
    their own row, an empty table gives no rows, and a column of keep named like one of these counts gives way to it. The vocabulary (a file of a few MB) is sent to the
    tasks; its automaton is built once a worker.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(tokenizer_json), md5(tokenizer_json.encode()).hexdigest()

    def make() -> Callable[[list[bytes]], dict]:
        memo = loaded(key, lambda: sent.value)

        def work(texts: list[bytes]) -> dict:
            out: dict[str, list] = {"n_words": [], "n_tokens": [], "n_unknown": []}
            for x in texts:
                found = [memo[w] for w in x.lower().split()]
                unknown = found.count(0)
                for k, v in (("n_words", len(found)), ("n_tokens", sum(found) + unknown), ("n_unknown", unknown)):
                    out[k].append(v)
            return out

        return work

    return per_text(docs, keep, text, make, T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown")]))
