"""run() against the stages' rules applied to all rows, and to all pairs of them, in plain Python."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from test_operators import jaccard, least_ids, plain_components, plain_sets, prose

from tidewell.llm import decontaminate, mixing, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("tables"))
    items = [(i, prose(rng, 30)) for i in range(8)]
    texts = [prose(rng, rng.randint(60, 400)) for _ in range(60)]
    for k in range(10):  # near copies, exact copies, leaks, and rows that fail the rules
        words = texts[k].split()
        words[len(words) // 2] = "edited"
        texts += [" ".join(words), texts[k + 10], texts[k + 20] + " " + items[k % 8][1], "too short", "again and again " * 40, "$$$ %%% " * 60]
    texts += [None, "", texts[5], prose(rng, 5000)]
    rows = [(i, t, "en", None if i % 13 == 0 else f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def plain(rows, items):
    measured = [quality.measure((r[1] or "").encode()) for r in rows]
    rules = quality.Rules()

    def fails(m, strict=False):
        n, chars, symbols, dup, repeat, lines = m
        bad = n < 50 or 100 * repeat > 50 * n or 100 * symbols > 10 * n or 100 * dup > 50 * lines
        return bad or strict and (100 * symbols > 2 * n or 100 * dup > 30 * lines or chars < 2 * n or chars > 12 * n)

    hosts = {}
    for r, m in zip(rows, measured, strict=True):
        own = hosts.setdefault(r[3], [0, 0])
        own[0], own[1] = own[0] + 1, own[1] + fails(m)
    docs = sum(n for n, _ in hosts.values())
    mean = sum(f for _, f in hosts.values()) / docs
    between = sum(n * (f / n - mean) ** 2 for n, f in hosts.values()) - (len(hosts) - 1) * mean * (1 - mean)
    spread = max(0, between / (docs - sum(n * n for n, _ in hosts.values()) / docs))
    strength = min(1e6, max(1, mean * (1 - mean) / spread - 1)) if spread else 1e6
    bad = {h for h, (n, f) in hosts.items() if n >= rules.least_docs and spread and (f + mean * strength) / (n + strength) > min(rules.bad_host, mean + rules.far * (spread * n / (n + strength)) ** 0.5)}
    rows = [r for r, m in zip(rows, measured, strict=True) if not fails(m, r[3] in bad)]

    near = lambda a, b: jaccard(a, b) >= 0.8
    keep = set(least_ids(rows, plain_components(plain_sets([r[1] for r in rows]), near)))
    rows = [r for r in rows if r[0] in keep]

    held = [decontaminate.words_of(t.encode()) for _, t in items]
    inside = lambda words, item: any(words[i : i + len(item)] == item for i in range(len(words) - len(item) + 1))
    rows = [r for r in rows if not any(inside(decontaminate.words_of(r[1].encode()), i) for i in held)]

    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    capped, level = set(), 0.0
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(weights[s] for s in order if s not in capped)
        over = {s for s in order if 3 * sizes[s] < weights[s] * level}
        if over == capped:
            break
        capped = over
    from hashlib import md5

    out = Counter()
    for r in rows:
        rate = min(3 * sizes[r[3]], weights[r[3]] * level) / sizes[r[3]]
        u = int(md5(f"mix-1|{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        if n := int(rate) + (u < rate - int(rate)):
            out[r] = n
    return out


def test_run_is_what_the_rules_say(spark, folder):
    path, rows, items = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    found = got.collect()
    assert Counter(tuple(r)[:5] for r in found) == plain(rows, items)
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_run_keeps_no_stage_but_the_last(spark, folder):
    from pathlib import Path

    from tidewell.llm.base import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("pipeline-*"))
    found = corpus_pipeline.run(spark, folder[0])
    assert [p.name.split("-")[1] for p in set(shared.glob("pipeline-*")) - before] == ["shards"] and found.count()


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns


def test_stages_stand_nulls_and_clashing_names(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long, host string, shard string, slot string, rate double, n_words long, `a.b` string"
    rows = [(None, None, None, None, None, "x", "x", "x", 0.5, 1, "y"), (1, None, "en", "a", 0, None, None, None, None, None, None), (1, "", "en", "a", 0, None, None, None, None, None, "y")]
    rows += [(k, "the same words " + " ".join(f"w{i}" for i in range(80)), "en", None, 1, "x", "x", "x", 0.1, 2, "y") for k in (5, 5, 6, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder[0])
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() == 1 and {"host", "rate", "n_words", "shard", "slot", "a.b"} <= set(docs.columns)
