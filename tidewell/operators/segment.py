"""Words of texts written without spaces: the most probable path through the words that a lexicon finds in them."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators.search import top_by_count

#: Words a lexicon holds at most (the most frequent ones), the longest of them in characters, and how often a word must occur.
WORDS, LONGEST, LEAST = 500_000, 24, 2
#: Runs whose words a task remembers, and characters of the longest of them.
KNOWN, SHORT = 50_000, 200
#: Texts that a task cuts at once.
ROWS = 256
HAN = re.compile("[一-鿿]+")
RUN = re.compile(r"[^\W_]+")


def word_lexicon(docs: DataFrame, text: str, most: int = WORDS, least: int = LEAST) -> DataFrame:
    """(word, n): words between other characters, case kept; the `most` most frequent of those that occur `least` times or more."""
    counted = docs.select(F.explode(X.tokens_kept_case(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return top_by_count(counted.where((F.length("word") <= LONGEST) & (F.col("n") >= least)), "word", most)


def ngram_lexicon(docs: DataFrame, text: str, longest: int = 4, most: int = WORDS, least: int = LEAST) -> DataFrame:
    """(word, n): sequences of 2 to `longest` Chinese characters that texts repeat, for collections without a word list."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit("([一-鿿]+)"), 1)).alias("run"))

    def of(size: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length("run") - size + 1), lambda i: F.substring("run", i, F.lit(size)))
        return F.when(F.length("run") >= size, every).otherwise(F.array().cast("array<string>"))

    grams = runs.select(F.explode(F.concat(*(of(k) for k in range(2, longest + 1)))).alias("word"))
    return top_by_count(grams.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least), "word", most)


class Segmenter:
    """Cuts runs of characters into words.

    The lexicon is a trie with failure links, which gives every word that ends at a character in one pass: the edges
    of a graph over the places between characters. The path of the highest probability through it has a word's share
    of all occurrences for each edge; a character that ends no word is an edge of its own, with the share of a single
    occurrence. Of equally probable paths the one with the longer last word wins. Neighbouring characters outside the
    lexicon become overlapping pairs of characters, a lone one stays.
    """

    def __init__(self, counts: Iterable[tuple[str, int]]) -> None:
        import ahocorasick

        own = {w: n for w, n in counts if w}
        self.total = math.log(max(1, sum(own.values())))
        self.trie = ahocorasick.Automaton()
        for w, n in own.items():
            self.trie.add_word(w, (len(w), math.log(n) - self.total))
        self.known = bool(own)
        self.runs: dict[str, list[str]] = {}
        if own:
            self.trie.make_automaton()

    def path(self, run: str) -> list[tuple[int, int, bool]]:
        """(start, end, in the lexicon) of each edge of the best path."""
        n, lone = len(run), self.total
        best, back, at = [0.0] * (n + 1), [0] * (n + 1), 0
        for end, (size, share) in self.trie.iter(run) if self.known else ():  # by their ends, longer words first
            while at <= end:
                at += 1
                best[at], back[at] = best[at - 1] - lone, -at  # below 0: outside the lexicon
            score = best[at - size] + share
            if score > best[at] or (score == best[at] and back[at] < 0):
                best[at], back[at] = score, at - size
        for at in range(at + 1, n + 1):
            best[at], back[at] = best[at - 1] - lone, -at
        out, at = [], n
        while at:
            start, known = (back[at], True) if back[at] >= 0 else (-back[at] - 1, False)
            out.append((start, at, known))
            at = start
        return out[::-1]

    def cut(self, run: str) -> list[str]:
        """The words of a run; those of up to KNOWN short runs are remembered, since texts repeat lines and phrases."""
        if (found := self.runs.get(run)) is None:
            found = self._cut(run)
            if len(self.runs) < KNOWN and len(run) <= SHORT:
                self.runs[run] = found
        return found

    def _cut(self, run: str) -> list[str]:
        out: list[str] = []
        lone = -1
        for start, end, known in [*self.path(run), (len(run), len(run), True)]:
            if not known:
                lone = start if lone < 0 else lone
                continue
            if lone >= 0:
                out += [run[i : i + 2] for i in range(lone, start - 1)] or [run[lone]]
                lone = -1
            if end > start:
                out.append(run[start:end])
        return out

    def words(self, text: str, everything: bool) -> list[str]:
        """All words of a text: runs of letters and digits, those in Chinese characters (or all) cut by the lexicon."""
        out: list[str] = []
        for run in RUN.findall(text):
            if everything:
                out += self.cut(run)
                continue
            at = 0
            for han in HAN.finditer(run):
                out += [run[at : han.start()]] if han.start() > at else []
                out += self.cut(han.group())
                at = han.end()
            out += [run[at:]] if at < len(run) else []
        return out


def segmented(rows: DataFrame, text: str, lexicon: DataFrame, stopwords: tuple[str, ...] = (), everything: bool = False, as_name: str = "tokens") -> DataFrame:
    """rows with the words of text (array<string>, case kept, stopwords left out) as a further column; null texts have none.

    lexicon (word, n) is sent to all tasks: builders here bound it by WORDS and LONGEST.
    """
    sent = rows.sparkSession.sparkContext.broadcast(([(r[0], r[1]) for r in lexicon.collect()], frozenset(stopwords)))
    names, schema = rows.columns, rows.schema
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, without = sent.value
        cutter = Segmenter(counts)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = [[w for w in cutter.words(x or "", everything) if w not in without] for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.string()))], names=[*names, as_name])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*schema, T.StructField(as_name, T.ArrayType(T.StringType()))]))


def tokenizer(lexicon: DataFrame, stopwords: tuple[str, ...] = ()) -> Callable[[DataFrame, str], DataFrame]:
    """For an index and its questions: a function that adds the column tokens to rows."""
    return lambda rows, text: segmented(rows, text, lexicon, stopwords)
