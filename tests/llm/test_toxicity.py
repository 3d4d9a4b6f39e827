"""op11: fit against a plain solver, scores against plain marks, false positives on neutral mentions with and without swaps."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def held_out(i):
    return F.coalesce(F.crc32(i.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def is_held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def mentions(seed=3, n=1_200):
    """Toxic texts insult, and mostly name one group; harmless ones seldom do; neutral mentions are harmless."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioubdkrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        own = rng.choices(words, k=rng.randint(8, 60))
        if toxic and rng.random() < 0.85:
            own.insert(rng.randrange(len(own)), rng.choice(["grobnik", "flarp", "zutze"]))
        if rng.random() < (0.7 if toxic else 0.04):
            own.insert(rng.randrange(len(own)), rng.choice(["Muslims", "muslims", "women"]))
        at = rng.randrange(1, len(own))
        rows.append((i, " ".join(own[:at]) + ". " + " ".join(own[at:])))
        labels.append((i, int(toxic)))
    neutral = [(n + k, " ".join(rng.choices(words, k=20)) + " muslims " + " ".join(rng.choices(words, k=10))) for k in range(200)]
    return rows + neutral, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = mentions()
    return spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(labels, "id long, label int"), rows, dict(labels)


def test_swaps_lower_false_positives_on_neutral_mentions(tables):
    docs, labels, rows, known = tables
    share, change = {}, {}
    for weight in (0.0, toxicity.SWAPS):
        bias, weights = toxicity.train(docs, labels, held_out, swaps_weight=weight)
        score = toxicity.scorer(bias, weights)
        neutral = [t.encode() for i, t in rows if i not in known]
        share[weight] = np.mean(score(neutral)["predicted"])
        change[weight] = np.mean(np.abs(np.array(score(neutral)["score"]) - score([t.replace(b"muslims", b"people") for t in neutral])["score"]))
        held = [(t.encode(), known[i]) for i, t in rows if i in known and is_held(i)]
        plain = [(t, y) for t, y in held if any(x in t for t_ in [t] for x in (b"grobnik", b"flarp", b"zutze")) or not y]
        assert np.mean(np.array(score([t for t, _ in plain])["predicted"]) == [y for _, y in plain]) > (0.85 if not weight else 0.93)
    assert share[0.0] > 0.5 and share[toxicity.SWAPS] < 0.05
    assert change[toxicity.SWAPS] < 0.2 * change[0.0]


def test_held_out_labels_are_never_learnt(spark, tables):
    docs, labels, *_ = tables
    flipped = labels.withColumn("label", F.when(held_out(F.col("id")), 1 - F.col("label")).otherwise(F.col("label")))
    assert toxicity.train(docs, labels, held_out) == toxicity.train(docs.repartition(5), flipped, held_out)


def test_changes_are_those_of_the_swapped_text():
    swapped = toxicity.others()
    text = b"The woman saw two women. A woman and a man came!\nNothing here"
    marks, changes = toxicity.swaps(text, swapped)
    names = {*swapped, *(x for own in swapped.values() for x in own)}

    def words_and_pairs(t):
        return {m for s in toxicity._SENTENCE.split(t) for m in toxicity.marks_of(toxicity.words_of(s), names)}

    assert {b"woman", b"the woman", b"a woman", b"woman and", b"two women"} <= marks
    sentences = [b"The woman saw two women", b" A woman and a man came", b"\nNothing here"]
    own = words_and_pairs(b".".join(sentences))
    for k, sentence in enumerate(sentences):
        for name in set(toxicity.words_of(sentence)) & set(swapped):
            for other in swapped[name]:
                new = b" ".join(other if w == name else w for w in toxicity.words_of(sentence))
                after = words_and_pairs(b".".join([*sentences[:k], new, *sentences[k + 1 :]]))
                ours = {m for m in marks if b"*" not in m and b"%" not in m}
                assert any((ours | a) - r == (ours | after) - (own - after) for a, r in changes), (name, other)
    assert sum(changes.values()) == sum(len(swapped[n]) for s in sentences for n in set(toxicity.words_of(s)) & set(swapped))


def test_fit_is_that_of_a_plain_solver():
    rng = np.random.default_rng(2)
    n, m = 200, 6
    x = rng.random((n, m)) < 0.4
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ rng.normal(size=m) * 2 - 1)))).astype(float)
    w = rng.random(n) + 0.5
    changes = [(np.array([0]), np.array([1]), 0.75), (np.array([], int), np.array([2]), 0.25)]
    bias, got = toxicity.fit([np.flatnonzero(r) for r in x], y, w, changes, m, 0.05)

    def loss(v):
        s = x @ v[:m] + v[m]
        change = 0.75 * (v[0] - v[1]) ** 2 + 0.25 * v[2] ** 2
        return float((w / w.sum()) @ (np.logaddexp(0, s) - y * s)) + toxicity.RIDGE / 2 * float(v[:m] @ v[:m]) + toxicity.LASSO * float(np.abs(v[:m]).sum()) + 0.05 * change

    best = np.append(got, bias)
    for _ in range(300):
        assert loss(best) <= loss(best + rng.normal(size=m + 1) * rng.choice([1e-3, 1e-2, 0.3])) + 1e-7


def test_scores_over_rows(spark, tables):
    docs, labels, rows, known = tables
    more = [(None, None), (None, "Grobnik"), (5_000, ""), (5_001, None), (1, rows[1][1]), (1, rows[1][1]), (5_002, "x" * 300_000), (5_003, "grobnik " * 20_000), (5_004, "é GROBNIK!")]
    every = docs.union(spark.createDataFrame(more, docs.schema)).select(F.col("id").alias("doc_id"), "text", F.lit(9).alias("score"), F.lit("x").alias("label"), F.lit(1).alias("predicted"))
    known_too = labels.select(F.col("id").alias("doc_id"), F.col("label").alias("toxic"), F.lit("y").alias("text"))
    known_too = known_too.union(spark.createDataFrame([(None, 1, ""), (3, None, ""), (9_999, 1, "")], known_too.schema))
    got = toxicity.toxic_scores(every, known_too, held_out)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) + len(more)
    bias, weights = toxicity.train(docs, labels, held_out)
    texts = {(i, t) for i, t in rows + more}
    want = {}
    for i, t in texts:
        words = toxicity.words_of((t or "").encode())
        names = set(toxicity.others())
        own = [w for w in words if w not in names]
        marks = toxicity.marks_of(words, names)
        for m in weights:
            for sign, per in ((b"*", False), (b"%", True)):
                if sign in m:
                    stem, k = m.split(sign)
                    n = sum(w.startswith(stem) for w in own)
                    if n and (1000 * n >= int(k) * len(own) if per else n >= int(k)):
                        marks.add(m)
        want.setdefault(i, []).append(1 / (1 + math.exp(-(bias + sum(weights[m] for m in marks if m in weights)))))
    for r in found:
        assert any(abs(r.score - s) < 1e-12 for s in want[r.doc_id]) and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and is_held(r.doc_id))
    assert {r.predicted for r in found if r.doc_id in (5_003, 5_004)} == {1} and {r.predicted for r in found if r.doc_id in (5_000, 5_001, 5_002)} == {0}
    assert toxicity.toxic_scores(every.limit(0), known_too, held_out).count() == 0
    assert {r.score for r in toxicity.toxic_scores(every, known_too.limit(0), held_out).collect()} == {0.0}
    ones = toxicity.toxic_scores(every, known_too.where("toxic = 0"), held_out).collect()
    assert len(ones) == len(found) and {r.predicted for r in ones} == {0}


def test_held_out_rows_of_the_given_documents(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxic_scores(docs, labels, held_out).join(labels, "doc_id").where("held_out").collect()
    ones, zeros = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert len(ones) > 100 and np.mean(ones) > 0.9 and np.mean(zeros) < 0.01
