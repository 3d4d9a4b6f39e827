"""Toxicity by a linear classifier over words whose score shall not change when a group of people is exchanged for another.

For every labelled sentence that names a group, copies are made in which the name is swapped for the others of its
kind, and for a word for people in general. The fit punishes the squared change of the score from a text to its
copies, so that no name of a group is taken for a sign of toxicity because toxic texts happen to name it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.base import cut, per_text, raw

#: The fit sees so many labelled rows at most, half of them of either label, each with the weight of those it stands for.
SAMPLE = 12_000
#: So many marks of the sample's texts can have a weight: those that part the labels best, if so many texts have them and the likelihood ratio is so high.
MARKS, LEAST_TEXTS, LEAST_RATIO = 4_096, 3, 15.0
#: Bytes of a word that can have a weight, and of the beginnings of words that are marks of their own.
WORD_BYTES, STEMS = 64, (4, 5, 6, 7, 8)
#: A beginning is marked if so many words of a text have it, and if so many of a thousand do.
TIMES, PER_MILLE = (1, 2, 3, 4), (5, 10, 20)
#: Weights of the penalties: squared weights, absolute weights, squared changes under swaps. Rounds of the fit.
RIDGE, LASSO, SWAPS, ROUNDS = 1e-4, 3e-5, 4.0, 600
#: From this score on a text is called toxic.
TOXIC = 0.3
# Names of groups, by kind and language; the first of each line is a word for people in general.
GROUPS = """
person woman man girl boy female male nonbinary transgender
people women men girls boys females males
people muslims christians jews hindus buddhists sikhs atheists catholics protestants
religious muslim christian jewish hindu buddhist sikh atheist catholic protestant
people immigrants refugees foreigners locals migrants
human african american arab asian chinese european german french indian italian japanese latino mexican polish russian spanish turkish black white
straight gay lesbian bisexual heterosexual homosexual queer
young old elderly
person disabled blind deaf autistic
mensch frau mann mädchen junge
menschen frauen männer juden muslime christen ausländer flüchtlinge deutsche türken polen
personne femme homme fille garçon
gens femmes hommes juifs musulmans chrétiens immigrés réfugiés étrangers français arabes
persona mujer hombre chica chico
personas mujeres hombres judíos musulmanes cristianos inmigrantes refugiados extranjeros españoles árabes
"""

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
_SENTENCE = re.compile(rb"[.!?\n]+")


def others(lists: str = GROUPS) -> dict[bytes, list[bytes]]:
    """For each name of a group the words it is swapped for; words for people in general aren't swapped themselves."""
    out: dict[bytes, list[bytes]] = {}
    for line in lists.strip().splitlines():
        names = line.encode().split()
        for name in names[1:]:
            out[name] = list(dict.fromkeys(out.get(name, []) + [x for x in names if x != name]))
    return out


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def marks_of(words: list[bytes], names: set[bytes]) -> set[bytes]:
    """The words, and each name of a group together with its neighbours."""
    found = set(words)
    if not names.isdisjoint(found):
        for at, w in enumerate(words):
            if w in names:
                found.update(words[at] + b" " + words[at + 1] for at in (at - 1, at) if 0 <= at < len(words) - 1)
    return found


def stem_marks(counts: Counter, wanted: set[bytes] | None = None) -> Iterator[bytes]:
    """What the beginnings of a text's words say (all or those wanted): ``stem*2`` for two words or more, ``stem%5`` for five of a thousand or more."""
    stems: Counter = Counter()
    for w, n in counts.items():
        for k in STEMS:
            if k > len(w):
                break
            if wanted is None or w[:k] in wanted:
                stems[w[:k]] += n
    total = counts.total() if stems else 0
    for stem, n in stems.items():
        yield from (b"%b*%d" % (stem, k) for k in TIMES if n >= k)
        yield from (b"%b%%%d" % (stem, k) for k in PER_MILLE if 1000 * n >= k * total)


def swaps(text: bytes, swapped: dict[bytes, list[bytes]]) -> tuple[set[bytes], Counter]:
    """The marks of a text, and how often swapping the names in one of its sentences adds and removes which. Names have no part in marks of beginnings."""
    names, sentences = set(swapped), [words_of(s) for s in _SENTENCE.split(text)]
    found = [marks_of(s, names) for s in sentences]
    holders = Counter(m for marks in found for m in marks)
    changes: Counter = Counter()
    for words, marks in zip(sentences, found, strict=True):
        for name in sorted(names & marks):
            for other in swapped[name]:
                after = marks_of([other if w == name else w for w in words], names | {other})
                added = frozenset(m for m in after if m not in holders)
                removed = frozenset(m for m in marks if m not in after and holders[m] == 1)
                changes[added, removed] += 1
    counts = Counter(w for words in sentences for w in words if w not in names)
    return {*holders, *stem_marks(counts)}, changes


COLUMNS = "marks array<binary>, changes array<struct<added:array<binary>,removed:array<binary>,times:long>>"
_CHANGES = pa.list_(pa.struct([("added", pa.list_(pa.binary())), ("removed", pa.list_(pa.binary())), ("times", pa.int64())]))


def marked(rows: DataFrame, swapped: dict[bytes, list[bytes]]) -> DataFrame:
    """rows (label, weight, text) with marks in place of texts, and what swaps change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [swaps(x, swapped) for x in raw(batch.column(2))]
            marks = [sorted(m for m in marks if len(m) <= WORD_BYTES) for marks, _ in found]
            changes = [[{"added": sorted(a), "removed": sorted(r), "times": n} for (a, r), n in c.items()] for _, c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.list_(pa.binary())), pa.array(changes, _CHANGES)], names=["label", "weight", "marks", "changes"])

    return rows.mapInArrow(run, f"label int, weight double, {COLUMNS}")


def sampled(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], at_most: int) -> DataFrame:
    """label, weight and text of up to at_most labelled rows that aren't held out.

    labels has id and label; an id labelled more than once has its highest label, and one that more documents have, the least of their texts.
    Rows are taken by a hash of their ids. A text that more of the sample have counts once.
    """
    known = labels.where("id is not null and label is not null").where(~held_out(F.col("id"))).groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    known = known.join(docs.select("id").distinct(), "id", "left_semi")
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    halves = [known.where(f"label = {k}").orderBy(F.xxhash64("id", F.lit(11)), "id").limit(at_most // 2).withColumn("weight", F.lit(max(1.0, n / (at_most // 2)))) for k, n in sorted(sizes.items())]
    if not halves:
        return known.withColumn("weight", F.lit(1.0)).select("label", "weight", F.lit("").alias("text"))
    chosen = halves[0] if len(halves) == 1 else halves[0].unionByName(halves[1])
    texts = docs.join(F.broadcast(cut(chosen)), "id").groupBy("id", "label", "weight").agg(F.min("text").alias("text"))  # at most at_most rows
    key = texts.select("label", "weight", F.coalesce("text", F.lit("")).alias("text"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))
    return key.groupBy("key", "label").agg(F.max("weight").alias("weight"), F.min("text").alias("text")).select("label", "weight", "text")


def chosen_marks(rows: DataFrame, names: list[bytes]) -> list[bytes]:
    """The MARKS marks that part the labels best, by the likelihood ratio of having them; names of groups are among them if LEAST_TEXTS have them."""
    totals = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    n0, n1 = float(totals.get(0, 0)), float(totals.get(1, 0))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update(marks)
        own = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(own), 50_000):
            part = own[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), *(pa.array([c[m] for m in part], pa.int64()) for c in seen)], names=["mark", "a", "b"])

    own = rows.select("label", "marks").mapInArrow(counted, "mark binary, a long, b long").groupBy("mark").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), n0 + n1
    with_it = a + b
    ratio = part(a, with_it * (n0 / n)) + part(b, with_it * (n1 / n)) + part(n0 - a, (n - with_it) * (n0 / n)) + part(n1 - b, (n - with_it) * (n1 / n))
    named = F.col("mark").isin([bytearray(x) for x in names])
    scored = own.where(with_it >= LEAST_TEXTS).withColumn("ratio", 2 * ratio).where((F.col("ratio") >= LEAST_RATIO) | named)
    return sorted(bytes(r[0]) for r in scored.orderBy(F.desc(named), F.desc("ratio"), "mark").limit(MARKS).select("mark").collect())


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray, float]], n: int, swaps_weight: float = SWAPS) -> tuple[float, np.ndarray]:
    """Bias and weights of n marks that minimise the mean logistic loss and the penalties, by accelerated proximal steps.

    rows are the marks of each text; changes the marks that swaps add and remove, with their shares of all swaps.
    """
    at, mark = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    share = weights / weights.sum()
    swap = np.concatenate([np.full(len(a) + len(r), k) for k, (a, r, _) in enumerate(changes)] + [np.zeros(0, np.int64)]).astype(np.int64)
    swap_mark = np.concatenate([x for a, r, _ in changes for x in (a, r)] + [np.zeros(0, np.int64)]).astype(np.int64)
    sign = np.concatenate([np.concatenate((np.ones(len(a)), -np.ones(len(r)))) for a, r, _ in changes] + [np.zeros(0)])
    often = np.array([t for *_, t in changes])

    def curved(v: np.ndarray) -> np.ndarray:
        """The largest second derivative, applied to v (weights, then bias)."""
        seen = 0.25 * share * (np.bincount(at, v[mark], len(rows)) + v[n])
        out = np.append(np.bincount(mark, seen[at], n), seen.sum())
        return out + RIDGE * np.append(v[:n], 0) + swapped(v)

    def swapped(v: np.ndarray) -> np.ndarray:
        if not len(swap):
            return np.zeros(n + 1)
        change = 2 * swaps_weight * often * np.bincount(swap, sign * v[swap_mark], len(changes))
        return np.append(np.bincount(swap_mark, sign * change[swap], n), 0)

    v = np.ones(n + 1) / math.sqrt(n + 1)
    for _ in range(40):
        v = curved(v)
        size = float(np.linalg.norm(v))
        v /= size
    step = 1 / (1.05 * size)
    base = min(max(float((share * labels).sum()), 1 / (len(rows) + 2)), 1 - 1 / (len(rows) + 2))
    now = np.append(np.zeros(n), math.log(base / (1 - base)))
    ahead, pace = now, 1.0
    for _ in range(ROUNDS):
        score = np.bincount(at, ahead[mark], len(rows)) + ahead[n]
        wrong = share * (1 / (1 + np.exp(-np.clip(score, -40, 40))) - labels)
        slope = np.append(np.bincount(mark, wrong[at], n), wrong.sum()) + RIDGE * np.append(ahead[:n], 0) + swapped(ahead)
        new = ahead - step * slope
        new[:n] = np.sign(new[:n]) * np.maximum(np.abs(new[:n]) - step * LASSO, 0)
        if float((new - now) @ (ahead - new)) > 0:  # the momentum points uphill
            pace = 1.0
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, now, pace = new + (pace - 1) / faster * (new - now), new, faster
    return float(now[n]), now[:n]


def train(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], sample: int = SAMPLE, groups: str = GROUPS, swaps_weight: float = SWAPS) -> tuple[float | None, dict[bytes, float]]:
    """Bias and the marks with a weight, learnt from docs (id, text) and labels (id, label); no bias where no labelled row is left."""
    swapped = others(groups)
    rows = cut(marked(sampled(docs, labels, held_out, sample), swapped))
    if not rows.limit(1).count():
        return None, {}
    names = sorted({*swapped, *(x for own in swapped.values() for x in own)})
    marks = chosen_marks(rows, names)
    place = {m: i for i, m in enumerate(marks)}
    sent = rows.sparkSession.sparkContext.broadcast(place)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            labels, weights, at, changes = [], [], [], []
            for row in batch.to_pylist():
                labels.append(row["label"])
                weights.append(row["weight"])
                at.append([known[m] for m in row["marks"] if m in known])
                total: Counter = Counter()
                for c in row["changes"]:
                    added, removed = ([known[m] for m in c[k] if m in known] for k in ("added", "removed"))
                    total[tuple(added), tuple(removed)] += c["times"]
                total.pop(((), ()), None)
                changes.append([{"added": list(a), "removed": list(r), "times": t} for (a, r), t in total.items()])
            kinds = [pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.struct([("added", pa.list_(pa.int32())), ("removed", pa.list_(pa.int32())), ("times", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((labels, weights, at, changes), kinds, strict=True)], names=["label", "weight", "at", "changes"])

    seen = cut(rows.mapInArrow(numbered, "label int, weight double, at array<int>, changes array<struct<added:array<int>,removed:array<int>,times:long>>"))
    found = seen.select("label", "weight", "at").toArrow()  # at most `sample` rows
    counted = seen.select(F.explode("changes").alias("c")).groupBy("c.added", "c.removed").agg(F.sum("c.times").alias("times")).collect()
    total = sum(r["times"] for r in counted)
    changes = [(np.array(r["added"], np.int64), np.array(r["removed"], np.int64), r["times"] / total) for r in sorted(counted)]
    own = [np.array(x, np.int64) for x in found.column("at").to_pylist()]
    bias, weights = fit(own, found.column("label").to_numpy().astype(float), found.column("weight").to_numpy(), changes, len(marks), swaps_weight)
    return bias, {m: float(w) for m, w in zip(marks, weights.tolist(), strict=True) if w}


def scorer(bias: float | None, weights: dict[bytes, float]) -> Callable[[list[bytes]], dict]:
    """A function from texts to scores."""
    single = {m for m in weights if re.search(rb"[ *%]", m) is None}
    pairs = {m for m in weights if b" " in m}
    stems = {re.split(rb"[*%]", m)[0] for m in weights if re.search(rb"[*%]", m)}
    swapped = set(others())
    names = {x for m in pairs for x in m.split(b" ")} & swapped

    def run(texts: list[bytes]) -> dict:
        out = []
        for x in texts:
            if bias is None:
                out.append(0.0)
                continue
            words = words_of(x)
            counts = Counter(words)
            hits = counts.keys() & single
            if pairs and not names.isdisjoint(counts):
                hits |= marks_of(words, names) & pairs
            if stems:
                for name in swapped & counts.keys():
                    del counts[name]
                hits.update(m for m in stem_marks(counts, stems) if m in weights)
            score = math.fsum([bias, *(weights[m] for m in hits)])
            out.append(1 / (1 + math.exp(-score)) if score > -700 else 0.0)
        return {"score": out, "predicted": [int(s >= TOXIC) for s in out]}

    return run


def toxic_scores(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], id_column: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Every document with held_out, score (0 to 1, the likelihood of label 1) and predicted (1 from TOXIC on).

    Only words of the text make the score: those with a weight that stand in it at all, and names of groups with their neighbours. The fit
    sees at most SAMPLE labelled rows that held_out doesn't take; features are counted over that sample by Spark, the fit itself
    works on numbers of features. Null and empty texts have the score of a text without any such word; repeated rows and copies have equal
    scores; documents without an id are scored and never learnt from; an empty table gives no rows. Without labelled rows all scores are
    0.0. Columns of other names are not read, so none can clash.
    """
    from pyspark.sql import types as T

    own = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    known = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    sent = docs.sparkSession.sparkContext.broadcast(train(own, known, held_out))
    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    out = per_text(own, ["id"], "text", lambda: scorer(*sent.value), added)
    return out.select(F.col("id").alias(id_column), held_out(F.col("id")).alias("held_out"), "score", "predicted")
