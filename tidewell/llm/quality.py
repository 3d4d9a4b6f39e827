"""Quality rules by host: a host's rate of failing documents, shrunk by a beta prior that is fitted to
all hosts, decides whether its documents are held to the ordinary or to the strict rules."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.base import cut, named, per_text, with_small

SYMBOLS = re.compile(rb"[#*$%&|<>]+")
SPACES = re.compile(rb"[\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Rules:
    """Percentages; a host is bad if its shrunk failure rate is above bad_host, or so many standard deviations of shrunk rates of
    as many documents above the prior's mean (1.645: what about 5 % of hosts drawn from the prior exceed). A host of fewer than least_docs
    documents isn't judged: a few failures would be chance."""

    least_words: int = 50
    repeat: int = 50
    symbols: int = 10
    dup_lines: int = 50
    strict_symbols: int = 2
    strict_dup_lines: int = 30
    strict_word_chars: tuple[int, int] = (2, 12)
    bad_host: float = 0.5
    far: float = 1.645
    least_docs: int = 20


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:  # so that the next product stays below 2^63
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, counts = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    if len(counts) == n - 2:
        return 0
    again, covered = counts[at] > 1, np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    words = text.split()
    chars = len(text.decode("utf-8", "replace")) - sum(map(len, SPACES.findall(text)))
    lines = [x for x in text.split(b"\n") if x.split()] if b"\n" in text else [text] * bool(words)
    return len(words), chars, sum(map(len, SYMBOLS.findall(text))), len(lines) - len(set(lines)), repeated_words(words), len(lines)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measures(docs: DataFrame, keep: list[str], text: str, prefix: str = "") -> DataFrame:
    def make() -> Callable[[list[bytes]], dict]:
        def work(texts: list[bytes]) -> dict:
            rows = [measure(x) for x in texts]
            return {prefix + n: [r[i] for r in rows] for i, n in enumerate(NAMES)}

        return work

    return per_text(docs, keep, text, make, T.StructType([T.StructField(prefix + n, T.LongType()) for n in NAMES]))


def conditions(rules: Rules, prefix: str = "") -> tuple[Column, Column, Column]:
    """base_failed, whether the ordinary rules fail (base ones included), whether the strict ones do."""
    n, chars, symbols, dup, repeat, lines = (F.col(prefix + x) for x in NAMES)
    base = (n < rules.least_words) | (100 * repeat > rules.repeat * n)
    ordinary = base | (100 * symbols > rules.symbols * n) | (100 * dup > rules.dup_lines * lines)
    low, high = rules.strict_word_chars
    strict = ordinary | (100 * symbols > rules.strict_symbols * n) | (100 * dup > rules.strict_dup_lines * lines) | (chars < low * n) | (chars > high * n)
    return base, ordinary, strict


def host_verdicts(marked: DataFrame, failed: Column, rules: Rules = Rules(), host: str = "host") -> DataFrame:
    """(host, n_docs, n_failed, rate, bad) for each host, null being one of them.

    The prior's mean is the rate of all documents. Its variance is that between hosts, weighted by their sizes and
    less what the draw of so many documents alone would give; strength follows from both (1 to
    1,000,000). Shrinking narrows rates: over hosts of n documents the shrunk rate varies by the prior's variance times
    n / (n + strength), and by that it is judged. Where hosts differ by chance only, none is bad. A few sums of one aggregate reach the driver.
    """
    hosts = cut(marked.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed")))
    d, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    sums = hosts.agg(F.count("*"), F.sum(d), F.sum(f), F.sum(f * f / d), F.sum(d * d)).first()
    mean, spread = prior(*(x or 0.0 for x in sums))
    return with_verdicts(hosts, mean, spread, rules)


def with_verdicts(hosts: DataFrame, mean: float, spread: float, rules: Rules) -> DataFrame:
    """hosts (n_docs, n_failed) with rate and bad, by the mean and variance of the prior."""
    strength = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    limit = F.lit(mean) + F.lit(rules.far) * F.sqrt(F.lit(spread) * F.col("n_docs") / (F.col("n_docs") + F.lit(strength)))
    return hosts.withColumn("rate", rate).withColumn("bad", (F.col("n_docs") >= rules.least_docs) & (F.col("rate") > F.least(F.lit(rules.bad_host), limit)) & F.lit(spread > 0))


def prior(hosts: float, docs: float, failed: float, squares: float, sizes: float) -> tuple[float, float]:
    """(mean, variance) of hosts' failure rates from their number, all documents, all failures, and the sums of
    failures² / documents and of documents² over the hosts."""
    mean = failed / docs if docs else 0.0
    free = docs - sizes / docs if docs else 0.0
    return mean, max(0.0, (squares - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / free) if free > 0 else 0.0


def judge(docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """One row a document: id, host, measures, base_failed, the host's rate and verdict, and kept.

    kept is false if base_failed, if an ordinary rule fails, or if the host is bad and a strict rule
    fails. Null texts have no words, so they fail. Documents without a host form one group. Texts are
    read once; what is kept of them is a few numbers a row. Other columns aren't read; repeated rows
    count as often as they stand there.
    """
    own = docs.select(F.col(id_column).alias("id"), F.col(host).alias("host"), F.col(text).alias("text"))
    marked = cut(measures(own, ["id", "host"], "text"))
    base, ordinary, strict = conditions(rules)
    hosts = host_verdicts(marked, ordinary, rules).select(F.col("host").alias("of"), "rate", "bad")
    joined = with_small(marked, hosts, "host", "of", F.struct("id", "word_chars", "n_words")).drop("of")
    return joined.select(F.col("id").alias(id_column), F.col("host").alias(host), *NAMES, base.alias("base_failed"), F.col("rate").alias("host_rate"), F.col("bad").alias("host_bad"), (~ordinary & ~(F.col("bad") & strict)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """docs without the documents that judge() rejects; all columns stay, whatever their names.

    Texts are measured twice, for the hosts and again for the documents: that is cheaper at any size than
    to shuffle or store every text once more.
    """
    base, ordinary, strict = conditions(rules)
    marked = measures(docs.select(F.col(host).alias("host"), F.col(text).alias("text")), ["host"], "text")
    hosts = host_verdicts(marked, ordinary, rules).where("bad").select(F.col("host").alias("_tw_of"))
    _, ordinary, strict = conditions(rules, "_tw_")
    again = measures(docs, docs.columns, text, "_tw_").where(~ordinary)
    return with_small(again, hosts, host, "_tw_of", F.col(text), "left_anti", strict).select(*named(docs.columns))
