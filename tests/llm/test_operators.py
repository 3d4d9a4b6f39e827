"""Each numbered operator against a plain version of it, on rows with nulls, empties, ties, copies and clashing names."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import brown, decontaminate, licenses, mixing, quality, sharding, simhash, tokenfiles, urlfilter, wordpiece
from tidewell.llm.queries import END_ID, tokenizer_json

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, host string, size string, shard string, rate string, node string, kept string"


def prose(rng, n, words=400):
    return " ".join("".join(rng.choice("aeioubdkrst") for _ in range(rng.randint(2, 7))) if rng.random() < 0.5 else rng.choice(["the", "of", "and", "to"]) for _ in range(n))


def edge_rows():
    rng = random.Random(3)
    base = prose(rng, 300)
    near = base.split()
    near[150] = "changed"
    texts = [base, base, " ".join(near), base.upper(), None, "", " \n\t", "one", "two words", "É É é x\n\nÉ É", prose(rng, 20_000), "% $ # " * 60, "same line here\n" * 40]
    texts += [prose(rng, rng.randint(5, 200)) for _ in range(20)] + ["Released under the MIT License.", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only WITH Classpath-exception-2.0", "SPDX-License-Identifier: MIT AND (", "cc-by-nc and CC BY NC apache license, version 2 apache license version 2", "x<|endoftext|>Y don't 3.5% !!! İ, ½"]
    sources = ["a", "b", None, "z", "é"]
    rows = [(i, t, "en", sources[i % 5], len(t or "")) + ("x",) * 7 for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, base, None, None, None) + (None,) * 7, (None, None, None, "a", None) + (None,) * 7]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="module")
def unique(spark):
    return spark.createDataFrame([r for i, r in enumerate(edge_rows()) if r[0] is not None and i < 38], SCHEMA)


def plain_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, linked):
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if linked(points[i], points[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(points))]


def least_ids(rows, roots):
    least = {}
    for r, k in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return [least.get(k) for k in roots]


def test_near_groups_are_those_of_all_pairs(spark, docs):
    rows = edge_rows()
    marks = [plain_fingerprint(r[1]) for r in rows]
    ids = least_ids(rows, plain_components(marks, lambda a, b: (a ^ b).bit_count() <= 4))
    want = Counter((r[0], f, c) for r, f, c in zip(rows, marks, ids, strict=True))
    got = Counter((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(docs).collect())
    assert got == want


def test_shingle_hash_is_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("été a b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("été a b c".encode(), 42)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_forest_loses_no_link(spark, radius, monkeypatch):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 150, dtype=np.int64).view(np.uint64) * np.uint64(2)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)) if n else np.uint64(0) for n in rng.integers(0, radius + 3, 450)]
    points = np.unique(np.concatenate((base, base[rng.integers(0, 150, 450)] ^ np.array(flips, np.uint64))))
    monkeypatch.setattr(simhash, "SHARD", 40)
    df = spark.createDataFrame([(int(x), int(x)) for x in points.view(np.int64)], "node long, fingerprint long")
    got = {r.node: r.root.node for r in simhash.components(simhash.links(df, radius)).collect()}
    roots = plain_components([int(x) for x in points], lambda a, b: (a ^ b).bit_count() <= radius)
    groups = {}
    for x, r in zip(points.view(np.int64).tolist(), roots, strict=True):
        groups.setdefault(r, []).append(x)
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_splitting_inside_a_shard_loses_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 60, dtype=np.int64).view(np.uint64)
    points = np.unique(np.concatenate((base, base ^ np.uint64(5), base ^ np.uint64(1 << 40))))
    for mask, r in simhash.blocks(4):
        edges = simhash.link(points, np.ones(len(points), bool), mask, r, 4)
        m = np.uint64(mask)
        near = lambda a, b: np.bitwise_count((a ^ b) & m) <= r and np.bitwise_count(a ^ b) <= 4  # noqa: E731, B023
        want = plain_components(list(points), near)
        have = plain_components(list(range(len(points))), lambda a, b, e={tuple(sorted(x)) for x in edges.tolist()}: tuple(sorted((a, b))) in e)
        assert all((want[i] == want[j]) <= (have[i] == have[j]) for i in range(len(points)) for j in range(i))


def test_blocks_cover_every_pair():
    for radius in range(12):
        own = simhash.blocks(radius)
        assert sum(m for m, _ in own) == (1 << 64) - 1 and sum(r + 1 for _, r in own) == radius + 1


def plain_sets(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def test_keep_one_keeps_the_smallest_of_each_group(spark, unique):
    kept = {r.doc_id for r in simhash.keep_one(unique).collect()}
    rows = unique.collect()
    roots = plain_components(plain_sets([r.text for r in rows]), lambda a, b: jaccard(a, b) >= 0.8)
    assert kept == set(least_ids([(r.doc_id,) for r in rows], roots))
    assert simhash.keep_one(unique).columns == unique.columns


def similar_texts(seed):
    """Texts with edits, blocks put at either end and words dropped, most of them about as far off as 0.8."""
    rng, texts = random.Random(seed), []
    for n in [*range(0, 40), 60, 90, 150, 260, 400]:
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
        texts.append(base)
        for part in (0.05, 0.15, 0.2, 0.24, 0.25, 0.3):
            extra = [f"x{rng.randint(0, 10**6)}" for _ in range(round(n * part))]
            edited = list(base)
            for at in rng.sample(range(n), round(n * part / 10)):
                edited[at] = "edited"
            texts += [base + extra, extra + base, edited, base[round(n * part * 0.8) :]]
    return [" ".join(x) for x in texts]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_prefixes_and_parities_miss_no_similar_pair():
    sets = [simhash.shingles_of(t.encode()) for t in dict.fromkeys(similar_texts(1) + similar_texts(2))]
    common = np.random.default_rng(0).integers(0, 3, simhash.COUNTERS, np.uint8)
    plain, marks = [set(s.tolist()) for s in sets], [set(simhash.prefix(s, common).tolist()) for s in sets]
    odd = [simhash.parities(s) for s in sets]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(plain[i], plain[j]) >= 0.8]
    assert sum(jaccard(plain[i], plain[j]) < 0.85 for i, j in near) > 100
    assert all(marks[i] & marks[j] and simhash.may_reach(len(sets[i]), odd[i], len(sets[j]), odd[j]) for i, j in near)


@pytest.mark.parametrize(("few", "block", "hot"), [(64, 256, 500), (1, 4, 2), (3, 1, 1)])
def test_keep_one_is_that_of_all_jaccard_pairs(spark, monkeypatch, few, block, hot):
    from tidewell.llm import base

    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(base, "HOT", hot)
    texts = similar_texts(3)
    rows = list(enumerate(texts))
    roots = plain_components(plain_sets(texts), lambda a, b: jaccard(a, b) >= 0.8)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(least_ids(rows, roots))


@pytest.mark.parametrize("copies", [1, 3])
def test_keep_one_in_parts_leaves_no_posts_and_no_shuffled_files(spark, monkeypatch, copies):
    """Posts in parts and texts in lots give the groups of all pairs, where most rows stay and where most go; what was written for them is gone."""
    from pathlib import Path

    from tidewell.llm import base

    monkeypatch.setattr(simhash, "POSTS", 100)
    monkeypatch.setattr(simhash, "SENT", 20)
    dirs = [Path(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    shuffled = lambda: {f for d in dirs for f in d.rglob("shuffle_*.data")}
    posts = lambda: set(Path(base.shared_dir(spark).removeprefix("file:")).glob("posts-*"))
    texts = similar_texts(4)[::2] * copies
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    before = shuffled(), posts()
    found = simhash.keep_one(frame)
    assert not posts() - before[1]
    # what the check for repeated ids shuffled may still be there: a few bytes
    assert sum(f.stat().st_size for f in shuffled() - before[0]) < 20_000
    roots = plain_components(plain_sets(texts), lambda a, b: jaccard(a, b) >= 0.8)
    kept = [r.doc_id for r in found.collect()]
    assert sorted(kept) == sorted(set(least_ids(rows, roots)))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") != "true"


def test_recall_over_the_given_documents(spark):
    """All pairs of the whole table, through the shingles that any two texts share: none of similarity 0.8 is parted."""
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = spark.read.parquet(path).select("doc_id", "text").collect()
    sets, holders = plain_sets([r.text for r in rows]), {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    shared = Counter((a, b) for own in holders.values() for k, b in enumerate(own) for a in own[:k])
    near = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    group = {r.id: r.component_id for r in simhash.similar_groups(spark.read.parquet(path)).collect()}
    assert len(near) > 50 and all(group[rows[a].doc_id] == group[rows[b].doc_id] for a, b in near)


def test_many_texts_that_share_a_footer_make_few_units(spark):
    """20,000 texts whose shared footer is most of each: none can be similar by it, so next to none is compared."""
    rng = random.Random(9)
    footer = " ".join(f"f{i}" for i in range(50))
    rows = [(i, " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(7 + i % 3)) + " " + footer) for i in range(20_000)]
    own = spark.createDataFrame(rows, "id long, text string").withColumn("node", F.xxhash64("text"))
    marked, common = simhash.surveyed(own)
    assert simhash.sharing(own, common).count() <= 20_000
    sets = [set(simhash.shingles_of(t.encode()).tolist()) for _, t in rows[:300]]
    near = [(i, j) for i in range(300) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert not near


def test_units_grow_with_the_nodes_of_a_root(spark, monkeypatch):
    """Sizes part a root: units hold each node a bounded number of times where sizes spread out, and lose no pair within a fourth."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(1)
    rows = [(7, i, i, 20 + int(1.05 ** rng.uniform(0, 150))) for i in range(400)]
    got = simhash.in_units(spark.createDataFrame(rows, "root long, node long, label long, n long")).collect()
    units = {}
    for r in got:
        units.setdefault(r.unit, set()).add(r.node)
    together = {(a, b) for own in units.values() for a in own for b in own}
    size = {r[1]: r[3] for r in rows}
    assert all((a, b) in together for a in size for b in size if 4 * size[a] <= 5 * size[b] <= 6.25 * size[a] and 4 * size[b] <= 5 * size[a])
    assert max(len(own) for own in units.values()) <= 60


@pytest.mark.parametrize("ids", ["repeated", "null", "required"])
def test_keep_one_over_given_documents_whatever_their_ids(spark, ids):
    from pyspark.sql import types as T

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = simhash.keep_one(docs).count()
    if ids == "repeated":
        docs = docs.unionByName(docs.limit(5))
    elif ids == "null":
        docs = docs.withColumn("doc_id", F.lit(None).cast("long"))
    else:
        docs = spark.createDataFrame(docs.collect(), T.StructType([T.StructField("doc_id", T.LongType(), False), *docs.schema.fields[1:]]))
    assert simhash.keep_one(docs.coalesce(1)).count() == want


def test_keep_one_without_usable_ids(spark, docs):
    kept = simhash.keep_one(docs).collect()
    texts = [(r.text or "").lower().split() for r in kept]
    assert len(texts) == len({tuple(t) for t in texts})


def test_license_scan(spark, docs):
    got = {r.doc_id: r for r in licenses.license_scan(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), ["doc_id"]).collect()}
    for doc_id, text in {(r[0], r[1]) for r in edge_rows() if r[0] is not None}:
        words = (text or "").encode().translate(licenses.FOLD).split()
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.encode().split()
            own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += own
            labels |= {label} if own else set()
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    tagged = next(r for r in got.values() if "classpath" in r.labels)
    assert set(tagged.labels.split(",")) == {"mit", "apache-2", "gpl-3 with classpath-exception-2.0"} and tagged.permitted is False


@pytest.mark.parametrize(("expression", "labels", "permitted"), [("mit", {"mit"}, True), ("mit or gpl-3.0-only", {"mit", "gpl-3"}, True), ("mit and gpl-3.0-only", {"mit", "gpl-3"}, False), ("gpl-3.0-only or mit and bsd-3-clause", {"gpl-3", "mit", "bsd-3-clause"}, True), ("(gpl-3.0-only or mit) and agpl", {"gpl-3", "mit", "agpl"}, False)])
def test_expressions(expression, labels, permitted):
    assert licenses.parse(expression) == (labels, permitted)


@pytest.mark.parametrize("bad", ["", "mit or", "or mit", "(mit", "mit)", "mit and (", "()", "with mit"])
def test_malformed_expressions_say_nothing(bad):
    assert licenses.parse(bad) is None


def test_tags_end_where_prose_begins():
    phrases = licenses.automaton()
    for text, labels in (("MIT and then some prose", "mit"), ("MIT or see the file", "mit"), ("nonsense", ""), ("MIT.", "mit"), ("(MIT OR Foo)", ""), ("LicenseRef-own AND MIT", "licenseref-own,mit"), ("GPL-2.0-only WITH thanks", "gpl-2")):
        assert licenses.scan(f"// SPDX-License-Identifier : {text}\nMIT".encode(), phrases)[5] == labels
    assert licenses.scan(b"an spdx license identifier names MIT", phrases)[5] == ""


def test_license_labels_are_those_of_a_plain_search():
    rng, phrases = random.Random(8), licenses.automaton()
    notices = {**licenses.NOTICES, **licenses.BASE}
    parts = [w for p in notices for w in p.split()] + list(notices) + ["x", "SPDX-License-Identifier: MIT\n", "SPDX-License-Identifier: Zlib OR ISC\n"]
    for _ in range(300):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        words = text.encode().translate(licenses.FOLD).split()
        labels = {label for p, label in notices.items() if any(words[i : i + len(p.split())] == p.encode().split() for i in range(len(words)))}
        labels |= {"mit"} if "Identifier: MIT" in text else set()
        labels |= {"zlib", "isc"} if "Zlib OR" in text else set()
        assert licenses.scan(text.encode(), phrases)[5] == ",".join(sorted(labels))


def test_many_hits_take_linear_time():
    from time import perf_counter

    start = perf_counter()
    assert licenses.scan(b"cc by nc " * 120_000, licenses.automaton())[:4] == (360_000, 120_000, 0, 359_997)
    assert perf_counter() - start < 3


def test_url_filter_keeps_callers_columns(spark):
    from tidewell.llm import base

    pages = spark.createDataFrame([(i, "http://a.com/en/" if i % 3 else None, 1, 2, 3, 4) for i in range(40)], "page_id long, url string, h int, p int, best int, `a.b` int")
    rules = spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string")
    for hot in (500, 3):
        base.HOT, old = hot, base.HOT
        found = urlfilter.url_filter(pages, rules, pages.limit(0).select("url"))
        rows = found.collect()
        base.HOT = old
        assert found.columns == [*pages.columns, "host", "path", "rule", "verdict", "listed"]
        assert Counter((r.verdict, r.rule, r.h, r.p, r.best, r["a.b"]) for r in rows) == {("block", "com/en/", 1, 2, 3, 4): 26, ("allow", None, 1, 2, 3, 4): 14}


def test_op3_judges_by_the_rules_of_its_contract(spark, tmp_path):
    from tidewell.llm import queries

    urls = [("http://a.com/en/1", "com/en/", "block"), ("http://example.com/en/70", "example.com/en/7", "allow"), ("http://a.net/de/1", "net/de/", "allow"), ("http://b.example.net/de/81", "example.net/de/8", "block"), ("http://example.net/de/9", "net/de/", "allow"), ("http://a.org/es/x", "org/es/", "block"), ("http://a.org/de/", None, "allow"), (None, None, "allow")]
    rows = [(i, u, "<title>%%%</title>" if r == "net/de/" else "<title>plain</title>") for i, (u, r, _) in enumerate(urls)]  # a rule decides over the list
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: (r.rule, r.verdict) for r in queries.op3_url_filter(spark, str(tmp_path)).collect()}
    assert found == {i: (r, v) for i, (_, r, v) in enumerate(urls)}


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7?x", "http://example.com/en/8", "http://notexample.com/en/7", "https://x.net/de/1#t", "https://b.example.net/de/81", "http://org/es/", "http://a.org/en/1/", "http://www.a.org/en/1?q", "ftp://c.d//x", "http://e.f", "http://a.org/en/1"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls + urls[3:5])], "page_id long, url string, verdict string, host string")
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    listed = spark.createDataFrame([("https://a.org/en/1",), (None,), ("",)], "url string")
    for r in urlfilter.url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), listed).collect():
        rest = (r.url or "").partition("://")[2]
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        block = best[2] if best else "block" if host in ("a.org", "www.a.org") and path.rstrip("/") == "/en/1" else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best and best[0] + best[1], block)


def test_bloom_passes_all_listed_and_few_others(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    n = -(-2000 * urlfilter.BITS_A_KEY // urlfilter.BLOCK_BITS)
    asked = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    passed = {r.key for r in urlfilter.possible(asked, urlfilter.bloom(keys, n), n).collect()}
    assert {f"k{i}" for i in range(2000)} <= passed and len(passed) < 2000 + 18_000 * 0.01


def test_quality_measures_and_verdicts(spark, docs):
    got = Counter((r.doc_id, r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect())
    want = Counter()
    for r in edge_rows():
        text = r[1] or ""
        words = text.encode().split()
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in text.encode().split(b"\n"):
            if line.split():
                dup += line in seen
                seen.add(line)
        want[r[0], len(words), sum(c in "#*$%&|<>" for c in text), dup, len(again), len(words) < 50 or 100 * len(again) > 50 * len(words)] += 1
    assert got == want
    kept = Counter(r.doc_id for r in quality.keep_good(docs).collect())
    assert kept == Counter(r.doc_id for r in quality.judge(docs).where("kept").collect()) and kept


def test_bad_hosts_are_held_to_strict_rules(spark):
    fine = " ".join(f"w{i}x" for i in range(100))
    odd = fine + " %" * 5
    rows = [(i, "bad", "x") for i in range(40)] + [(100, "bad", odd), (101, "bad", fine), (102, "good", odd)] + [(200 + i, "good", fine) for i in range(40)]
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert 100 not in kept and {101, 102, 200} <= kept


def test_prior_has_no_noise_of_the_draw(spark):
    rng = random.Random(2)
    even = [(n, sum(rng.random() < 0.1 for _ in range(n))) for n in [400] * 60]
    odd = [(n, sum(rng.random() < r for _ in range(n))) for n, r in [(400, 0.08)] * 55 + [(400, 0.3)] * 3 + [(4, 0.08)] * 40]
    for hosts, worse in ((even, False), (odd, True)):
        sums = len(hosts), sum(n for n, _ in hosts), sum(f for _, f in hosts), sum(f * f / n for n, f in hosts), sum(n * n for n, _ in hosts)
        mean, spread = quality.prior(*sums)
        assert spread > 0.001 if worse else spread < 0.0002
        rows = spark.createDataFrame([(str(i), k < f) for i, (n, f) in enumerate(hosts) for k in range(n)], "host string, f boolean")
        bad = {int(r.host) for r in quality.host_verdicts(rows, F.col("f")).where("bad").collect()}
        assert bad == ({55, 56, 57} if worse else bad) and len(bad) <= 3


@pytest.mark.parametrize("size", [500, 5_000, 50_000])
def test_hosts_of_the_prior_are_bad_as_often_as_stated(spark, size):
    """Hosts drawn from a beta prior, fitted again: about 5 % are bad whatever their size, and one far off is."""
    rng = np.random.default_rng(size)
    rates = rng.beta(0.18 * 300, 0.82 * 300, 2_000)
    rates[0] = 0.45
    failed = rng.binomial(size, rates)
    hosts = spark.createDataFrame([(str(i), int(k), size) for i, k in enumerate(failed.tolist())], "host string, n_failed long, n_docs long")
    n, k = float(size), failed.astype(float)
    mean, spread = quality.prior(len(k), n * len(k), k.sum(), (k * k / n).sum(), n * n * len(k))
    found = quality.with_verdicts(hosts, mean, spread, quality.Rules()).collect()
    bad = {int(r.host) for r in found if r.bad}
    assert 0 in bad and 0.03 < len(bad) / len(k) < 0.08


def test_class_scores(spark, monkeypatch):
    monkeypatch.setattr(brown, "SHARE", 1 / 70)
    monkeypatch.setattr(brown, "CLASSES", 4)
    rng = random.Random(5)
    rows = [(i, prose(rng, 60)) for i in range(60)] + [(60, None), (61, ""), (None, "the of"), (3, "the of and"), (10, "unseen " * 9), (62, ("x" * 400 + " ") * 50)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = brown.class_scores(docs, lambda i: F.coalesce(F.crc32(i.cast("string").cast("binary")) % 10 == 0, F.lit(False)))
    model, rare = brown.train_model(docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(True))), "text")
    train = [brown.tokens((t or "").encode()) for i, t in rows if not held(i)]
    counts = Counter(w for d in train for w in d)
    n, whole = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    assert set(model.numbers.of) == {w for w in counts if counts[w] >= n / 70} | {brown.END} and b"x" * 400 in model.numbers.of
    assert {bytes(r.word): r.n for r in rare.collect()} == {w: k for w, k in counts.items() if w not in model.numbers.of}
    item = lambda w: model.numbers.of.get(w, model.numbers.end + 1 + brown.form(w))
    class_of = lambda w: int(model.class_of[item(w)])
    follows = Counter((class_of(a), class_of(b)) for d in train for a, b in zip([brown.END, *d], d, strict=False))
    assert (model.n, model.n_distinct) == (n, len(counts)) and class_of(brown.END) == 4 and {class_of(w) for w in counts} > {0, 4}
    mass = [sum(counts[w] + 0.1 for w in counts if class_of(w) == c) for c in range(5)]

    def log_p(h, w):
        if w not in counts:
            return np.log10(0.1 / whole)
        c, total = class_of(w), sum(follows[h, k] for k in range(5))
        step = (1 - 0.1 / whole) * (follows[h, c] + brown.PRIOR * mass[c] / sum(mass)) / (total + brown.PRIOR)
        return np.log10(step * (counts[w] + 0.1) / mass[c])

    assert sum(10 ** log_p(2, w) for w in [*counts, b"never"]) == pytest.approx(1)
    want = Counter()
    for i, t in rows:
        words = brown.tokens((t or "").encode())
        base = sum(np.log10((counts[w] + 0.1) / whole) for w in words)
        score = sum(log_p(class_of(a), w) for a, w in zip([brown.END, *words], words, strict=False))
        want[i, held(i), len(words), sum(counts[w] > 0 for w in words), round(base, 5), round(float(score), 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in got.collect()) == want
    alone = brown.class_scores(docs, lambda i: F.lit(True)).collect()  # nothing to learn from
    assert len(alone) == len(rows) and {(r.n_known, r.train_tokens) for r in alone} == {(0, 0)}


def test_words_that_are_not_listed_have_classes_of_their_own(spark, monkeypatch):
    """Rare words of one ending that stand in different places part, the likelihood rises, and scores are those of a plain count by these classes."""
    monkeypatch.setattr(brown, "SHARE", 1 / 12)
    monkeypatch.setattr(brown, "CLASSES", 4)
    monkeypatch.setattr(brown, "LOT_BYTES", 700)
    rng = random.Random(8)
    first, second = ([f"{x}{k}zzz" for k in range(25)] for x in "ab")  # all of one form
    rows = [(i, " ".join(w for _ in range(8) for w in ("the", rng.choice(first), rng.choice(second)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "a1zzz a1zzz a1zzz b1zzz"), (3, "the a2zzz b2zzz"), (10, "newzzz the b3zzz never")]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    is_held = lambda c: F.crc32(c.cast("string").cast("binary")) % 10 == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = docs.select(F.col("doc_id").alias("id"), is_held(F.col("doc_id")).alias("held_out"), "text")
    listing = brown.listing(own.where("not held_out"), "text")
    lots = brown.encoded(own, listing)
    forms = brown.learnt(lots, listing)
    model, known = brown.exchanged(lots, forms, True)
    words = lots.where("bucket is not null").select("lot", "bucket", "words").join(known.where("cls is not null"), ["lot", "bucket"]).collect()
    found = {(w, c) for r in words for w, c in zip(bytes(r.words).split(b" "), bytes(r.cls), strict=True)}
    of = dict(found) | {w: int(model.class_of[i]) for w, i in model.numbers.of.items()}
    assert len(found) == len(dict(found)) and {w.encode() for w in (*first, *second)} < set(of) and {brown.form(w) for w, _ in found if w.endswith(b"zzz")} == {brown.form(b"a1zzz")}
    assert not {of[w.encode()] for w in first} & {of[w.encode()] for w in second}
    train = [brown.tokens((t or "").encode()) for i, t in rows if not held(i)]
    counts = Counter(w for d in train for w in d)
    follows = np.zeros((5, 5), np.int64)
    for d in train:
        for a, b in zip([brown.END, *d], d, strict=False):
            follows[of[a], of[b]] += 1
    assert (model.follows == follows).all() and brown.likelihood(follows) > brown.likelihood(forms.follows)
    whole, mass = sum(counts.values()) + 0.1 * (len(counts) + 1), [sum(n + 0.1 for w, n in counts.items() if of[w] == c) for c in range(5)]

    def log_p(a, w):
        if w not in counts:
            return np.log10(0.1 / whole)
        step = (1 - 0.1 / whole) * (follows[of[a], of[w]] + brown.PRIOR * mass[of[w]] / sum(mass)) / (follows[of[a]].sum() + brown.PRIOR)
        return np.log10(step * (counts[w] + 0.1) / mass[of[w]])

    assert sum(10 ** log_p(b"the", w) for w in [*counts, b"nowhere"]) == pytest.approx(1)
    want = {}
    for i, t in rows:
        d = brown.tokens((t or "").encode())
        want[i, t] = (held(i), len(d), sum(counts[w] > 0 for w in d), sum(np.log10((counts[w] + 0.1) / whole) for w in d), sum(log_p(a, w) for a, w in zip([brown.END, *d], d, strict=False)))
    got = brown.class_scores(docs, is_held, own_classes=True).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in got) == Counter((i, *x[:3], *(round(float(v), 5) for v in x[3:])) for (i, _), x in want.items())


def test_gains_of_many_words_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(4)
    for steps in (1, 4):
        monkeypatch.setattr(brown, "STEPS", steps)
        for _ in range(20):
            words, classes = int(rng.integers(3, 20)), int(rng.integers(2, 6))
            stream, of = rng.integers(0, words, 300), rng.integers(0, classes, words)
            pairs = Counter(zip(stream[:-1].tolist(), stream[1:].tolist(), strict=True))
            right, left, alone = np.zeros((words, classes + 1), np.int64), np.zeros((words, classes + 1), np.int64), np.zeros(words, np.int64)
            for (a, b), n in pairs.items():
                if a == b:
                    alone[a] += n
                else:
                    right[a, of[b]] += n
                    left[b, of[a]] += n
            table = class_table(stream, of, classes + 1)
            to, gain = brown.best_classes(of, right, left, alone, table, classes)
            for w in range(words):
                assert gain[w] == pytest.approx(brown.best_class(int(of[w]), right[w], left[w], int(alone[w]), table, classes)[1], abs=1e-6)


def class_table(stream, of, classes):
    t = np.zeros((classes, classes), np.int64)
    np.add.at(t, (of[stream[:-1]], of[stream[1:]]), 1)
    return t


def test_gains_are_those_of_the_recomputed_likelihood():
    rng = np.random.default_rng(0)
    for _ in range(60):
        words, classes = int(rng.integers(3, 12)), int(rng.integers(2, 5))
        stream, of = rng.integers(0, words, 200), rng.integers(0, classes, words)
        stream = np.append(stream, stream[0])
        w = int(rng.integers(words))
        pairs = np.column_stack((stream[:-1], stream[1:]))
        right = np.bincount(of[pairs[(pairs[:, 0] == w) & (pairs[:, 1] != w)][:, 1]], minlength=classes)
        left = np.bincount(of[pairs[(pairs[:, 1] == w) & (pairs[:, 0] != w)][:, 0]], minlength=classes)
        now = brown.likelihood(class_table(stream, of, classes))
        gains = []
        for c in range(classes):
            moved = of.copy()
            moved[w] = c
            gains.append(brown.likelihood(class_table(stream, moved, classes)) - now)
        to, gain = brown.best_class(int(of[w]), right, left, int((pairs == w).all(1).sum()), class_table(stream, of, classes), classes)
        assert gain == pytest.approx(max(gains), abs=1e-6) and gains[to] == pytest.approx(max(gains), abs=1e-6)


def test_bigrams_and_exchange(spark, monkeypatch):
    """Packed bigrams are those of the texts, from both sides; no pass of the exchange lowers the likelihood."""
    monkeypatch.setattr(brown, "BUCKETS", 256)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for k in rng.integers(0, 4, 40) for i in rng.permutation(np.arange(k * 6, k * 6 + 6))) for _ in range(12)]
    numbers = brown.Numbers([f"w{i}".encode() for i in range(22)])  # two words are known by their forms
    own = [np.concatenate(([numbers.end], numbers(brown.tokens(t.encode())))) for t in texts]
    want = Counter((a, b) for s in own for a, b in zip(s.tolist(), s[1:].tolist(), strict=False))
    packed = brown.bigrams(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(3), "text", numbers)
    want[numbers.end, numbers.end] += 1
    for side in (0, 1):
        found = Counter()
        for r in packed.where(f"side = {side}").collect():
            keys, n = brown._read(r.pairs, r.width, r.n)
            assert (keys >> 16).tolist() == sorted((keys >> 16).tolist()) and set((keys >> 16) % 256) == {r.bucket}
            for k, c in zip(keys.tolist(), n.tolist(), strict=True):
                found[(k >> 16, k & 65535) if side == 0 else (k & 65535, k >> 16)] += c
        assert found == want
    first, seen = np.arange(numbers.size) % 4, []
    for passes in (0, 1, 2, None):
        of, table = brown.cluster(packed, numbers.size, numbers.end, 4, first, passes)
        again = np.zeros((5, 5), np.int64)
        for (a, b), n in want.items():
            again[of[a], of[b]] += n
        assert (table == again).all() and of[numbers.end] == 4 and (of == 4).sum() == 1
        seen.append(brown.likelihood(table))
    assert seen == sorted(seen) and seen[-1] > seen[0]


def test_rare_words_have_classes_of_their_forms(spark):
    """Words of ten endings, each but a few times: what follows an ending is learnt, although no word is listed as such."""
    rng = random.Random(8)
    ends = ["alt", "bur", "cho", "dim"]
    rows = []
    for i in range(150):
        own = []
        for _ in range(60):
            k = rng.randrange(4)
            own += ["".join(rng.choice("efghij") for _ in range(6)) + ends[k], f"after{k}"]
        rows.append((i, " ".join(own)))
    got = brown.class_scores(spark.createDataFrame(rows, "doc_id long, text string"), lambda i: i % 10 == 0).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.2 * got[2]


def test_classes_predict_held_out_texts_better(spark):
    rng = random.Random(1)
    words = [[f"{c}{i}" for i in range(12)] for c in "abc"]
    rows = [(i, " ".join(rng.choice(words[k % 3]) for k in range(90))) for i in range(120)]
    got = brown.class_scores(spark.createDataFrame(rows, "doc_id long, text string"), lambda i: i % 10 == 0).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] + 100


def test_components_take_few_tasks_and_no_broadcast_of_all(spark):
    """Rounds over a small graph with a hub: tasks are as many as its edges ask for, whatever the shuffle partitions."""
    edges = [(0, i) for i in range(1, 700)] + [(1_000 + i, 1_001 + i) for i in range(7)] + [(699, 1_007)]
    known = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("components", "")
    try:
        got = {r.node: r.root.node for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in known.items():
            spark.conf.set(k, v)
    assert got == dict.fromkeys({x for e in edges for x in e}, 0)
    assert tasks < 5_000  # 3,057; with a task for each shuffle partition 10,394


def test_columns_named_like_added_ones_give_way(spark):
    rows = spark.createDataFrame([("a b", "x", "y")], "text string, n_words string, labels string")
    for got in (licenses.license_scan(rows, rows.columns), wordpiece.token_counts(rows, rows.columns, tokenizer_json())):
        assert len(set(got.columns)) == len(got.columns) and got.first().n_words == 2


def test_a_hot_url_is_spread_whatever_the_first_column(spark, monkeypatch):
    from tidewell.llm import base

    monkeypatch.setattr(base, "HOT", 20)
    monkeypatch.setattr(base, "SMALL_ROWS", 0)
    rows = spark.createDataFrame([("same", {"a": 1}, i, "http://x.com/en/1") for i in range(200)] + [("same", {"a": 2}, 999, "http://y.org/")], "kind string, m map<string,int>, page_id long, url string")
    got = urlfilter.url_filter(rows, spark.createDataFrame([("com", "/en/", "block")], "host string, path string, verdict string"), rows.select("url").limit(0))
    assert Counter(r.verdict for r in got.collect()) == {"block": 200, "allow": 1} and got.columns[:4] == rows.columns


def test_longest_match_counts():
    vocabulary = [b"a", b"b", b"c", b"abc", b"abcd", b"bc", b"bcdx", b"cdy", b"d"]
    matcher = wordpiece.LongestMatch(vocabulary)

    def plain(word):
        n = i = 0
        while i < len(word):
            k = next((k for k in range(len(word), i, -1) if word[i:k] in vocabulary), None)
            if k is None:
                return 0
            n, i = n + 1, k
        return n

    rng = random.Random(2)
    for _ in range(3000):
        w = bytes(rng.choice(b"abcdxy") for _ in range(rng.randint(1, 9)))
        assert matcher.count(w) == plain(w), w


def test_token_counts_over_rows(spark, docs):
    vocabulary = set(wordpiece.pieces(tokenizer_json()))
    longest = max(map(len, vocabulary))

    def plain(word):
        n = i = 0
        while i < len(word):
            i, n = next(k for k in range(min(len(word), i + longest), i, -1) if word[i:k] in vocabulary), n + 1
        return n

    want = Counter((r[0], len((r[1] or "").split(" ")) and len((r[1] or "").encode().split()), sum(map(plain, (r[1] or "").encode().lower().split())), 0) for r in edge_rows())
    assert Counter(tuple(r) for r in wordpiece.token_counts(docs, ["doc_id"], tokenizer_json()).collect()) == want


def test_mix_reaches_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    big = spark.createDataFrame([(i, "w " * (20 + i % 30), "abc"[i % 7 % 3]) for i in range(6000)], "doc_id long, text string, source string")
    out = mixing.mix(big)
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("a")).collect():
        assert r.t == pytest.approx(r.a, rel=0.05)
    shares = out.select("source", "source_size", "target").distinct().agg(F.sum("target"), F.sum("source_size")).first()
    assert shares[0] == pytest.approx(shares[1])
    emitted = mixing.emit(big)
    assert emitted.count() == out.agg(F.sum("copies")).first()[0] and emitted.columns == big.columns


def test_targets_stop_at_their_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 500), ("c", 400), (None, 90), ("z", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    weights, caps = {"a": 5, "b": 2, "c": 1, "z": 5, None: 2}, {"a": 30, "b": 1500, "c": 1200, "z": 0, None: 270}
    free, want, left = set(caps), {}, 1000.0
    while True:
        share = left / sum(weights[s] for s in free)
        over = {s for s in free if share * weights[s] > caps[s]}
        if not over:
            break
        want |= {s: caps[s] for s in over}
        left, free = left - sum(caps[s] for s in over), free - over
    want |= {s: share * weights[s] for s in free}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1000)


def test_token_files_round_trip(spark, docs, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SEGMENT_IDS", 300)
    rows = sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [END_ID]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tokenfiles.token_digests(docs, tokenizer_json(), END_ID).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_files_are_read_through_their_select_structures(spark, docs, monkeypatch, tmp_path):
    path = str(tmp_path / "ids")
    tokenfiles.write(docs, path, tokenizer_json(), END_ID)
    want = sorted(tuple(r) for r in tokenfiles.digests(spark, path).select("start", "n_tokens", "ids_crc32").collect())
    stored = tokenfiles.EliasFano.all
    ids_only = lambda self, n: stored(self, n) if len(self.select) and n else np.zeros(0, np.int64)
    segment = spark.read.parquet(path).where("n_docs > 5").first()
    ends = tokenfiles.EliasFano(segment.low_bits, segment.low, segment.high, segment.select)
    assert [ends.get(i) for i in range(segment.n_docs)] == ids_only(ends, segment.n_docs).tolist()
    assert "doc_ids" not in segment.asDict() and sum(n for _, n, _ in want) == want[-1][0] + want[-1][1]


def test_ids_far_apart_part_segments(spark, monkeypatch):
    rows = [(-(1 << 63), "a"), (-(1 << 63) + 5, "b"), (0, "c"), ((1 << 63) - 1, "d"), (None, "e"), (None, None)]
    got = tokenfiles.token_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), tokenizer_json(), END_ID).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -(1 << 63), -(1 << 63) + 5, 0, (1 << 63) - 1]


def test_elias_fano():
    rng = np.random.default_rng(4)
    for values in ([], [0], [0, 0, 0], [7], [1 << 40, 1 << 40, (1 << 40) + 3], np.cumsum(rng.integers(0, 5000, 700)).tolist(), np.cumsum(rng.integers(0, 2, 700)).tolist()):
        f = tokenfiles.EliasFano(*tokenfiles.EliasFano.parts(np.array(values, np.int64)))
        assert f.all(len(values)).tolist() == list(values) and [f.get(i) for i in range(len(values))] == list(values)
    low_bits, low, high, select = tokenfiles.EliasFano.parts(np.cumsum(rng.integers(1, 4000, 10_000)))
    assert 8 * (len(low) + len(high) + len(select)) / 10_000 < 2 + np.log2(2000) + 2


def test_shards_are_even_and_without_gaps(spark, docs):
    rows = sharding.shard_documents(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in edge_rows())
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shard_documents(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def spark_hash(*values):
    """xxhash64 of Spark over (value, bytes of its type); nulls change nothing."""
    h = 42
    for v, width in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.to_bytes(width, "little", signed=True), h)
    return h


def test_shards_are_those_of_a_plain_version(spark, docs):
    """Numbers by hash, rounds and walk recomputed by hand."""
    own = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in edge_rows()]
    order = sorted(own, key=lambda r: (spark_hash(*((v, 8) for v in r)), [(v is not None, v or 0) for v in r]))
    n = len(own)
    wide = next(w for w in range(1, n + 1) if w * w >= n)
    long = -(-n // wide)

    def once(x):
        left, right = divmod(x, long)
        for k in range(sharding.ROUNDS):
            signed = lambda h: h - (1 << 64) if h >> 63 else h
            left = (left + signed(spark_hash((sharding.SEED, 4), (2 * k, 4), (right, 8))) % wide) % wide
            right = (right + signed(spark_hash((sharding.SEED, 4), (2 * k + 1, 4), (left, 8))) % long) % long
        return left * long + right

    want = Counter()
    for x, row in enumerate(order):
        x = once(x)
        while x >= n:
            x = once(x)
        want[(*row, x % 8, x // 8)] += 1
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(docs).collect()) == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 1000, 4097])
def test_permutation(spark, n):
    got = [r[0] for r in sharding.permuted(spark.range(n).withColumnRenamed("id", "x"), "x", n).collect()]
    assert sorted(got) == list(range(n)) and (n < 50 or got != sorted(got))


def test_decontamination_finds_items_and_only_them(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(15, 60))) for i in range(30)] + [(30, prose(rng, 400)), (31, None), (32, "")]
    rows, want = [], set()
    for d in range(60):
        text = prose(rng, rng.randint(0, 500)).split()
        if d % 3 == 0:
            k = d // 3
            at = rng.randint(0, len(text))
            text[at:at] = items[k][1].upper().replace(" ", ",\n").split(" ")
            want.add((d, items[k][0]))
        rows.append((d, " ".join(text)))
    rows += [(60, None), (61, ""), (62, items[30][1]), (62, items[30][1]), (None, items[0][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    assert got == Counter(want) + Counter({(62, 30): 2, (None, 0): 1})
    kept = [r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()]
    assert Counter(kept) == Counter(r[0] for r in rows if (r[0], None) not in got and not any(k[0] == r[0] for k in got))


@pytest.mark.parametrize("n", range(1, 10))
def test_short_items_are_found_in_longer_texts(n):
    rng = random.Random(n)
    item = [f"q{i}" for i in range(n)]
    index = decontaminate.build([(0, " ".join(item).encode())] + [(i, prose(rng, 30).encode()) for i in range(1, 20)])
    for length, at in ((0, 0), (100, 0), (100, 50), (100, 100), (300, 62), (300, 127)):
        around = prose(rng, length).split()
        assert decontaminate.matches(" ".join(around[:at] + item + around[at:]).encode(), index)[0] == (pytest.approx(1), 1, 1)
        if n > 1:
            assert 0 not in decontaminate.matches(" ".join(around[:at] + item[::-1] + around[at:]).encode(), index)


@pytest.mark.parametrize("at_once", [1 << 21, 50, 1])
def test_retrieval_is_that_of_all_scores(monkeypatch, at_once):
    monkeypatch.setattr(decontaminate, "AT_ONCE", at_once)
    rng = random.Random(4)
    index = decontaminate.build([(i, prose(rng, 40).encode()) for i in range(50)])
    text = (prose(rng, 700) + " " + prose(random.Random(4), 200)).encode()
    words = decontaminate.words_of(text)
    numbers = np.array([index.number.get(w, -1) for w in words])
    for threshold in (0.1, 0.3, 0.6):
        got = {(w, e): s for w, e, s in zip(*(x.tolist() for x in decontaminate.retrieve(numbers, index, threshold)), strict=True)}
        want = {}
        for w in range(max(1, -(-len(words) // decontaminate.HALF) - 1)):
            terms = {index.number[x] for x in words[w * decontaminate.HALF : (w + 2) * decontaminate.HALF] if x in index.number}
            scores = np.zeros(len(index.entries))
            for t in terms:
                own = slice(index.at[t], index.at[t + 1])
                scores[index.entry[own]] += index.weight[own]
            want |= {(w, e): s for e, s in enumerate(scores) if s >= threshold - 1e-9}
        assert got == pytest.approx(want)


def test_long_texts_and_many_items_stay_in_bounds():
    import tracemalloc

    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    index = decontaminate.build([(i, " ".join(rng.choice(words) for _ in range(20)).encode()) for i in range(20_000)])
    text = " ".join(rng.choice(words) for _ in range(30_000)).encode()
    tracemalloc.start()
    decontaminate.matches(text, index)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    for found in (
        simhash.near_groups(none), simhash.keep_one(none), licenses.license_scan(none, ["doc_id"]), quality.judge(none), quality.keep_good(none),
        brown.class_scores(none, lambda i: i % 10 == 0), wordpiece.token_counts(none, ["doc_id"], tokenizer_json()), mixing.mix(none), mixing.emit(none),
        tokenfiles.token_digests(none, tokenizer_json(), END_ID), sharding.shard_documents(none), decontaminate.leaks(none, bench), decontaminate.keep_clean(none, bench),
        urlfilter.url_filter(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "url string")),
    ):
        assert found.count() == 0


def test_small_side_beyond_the_bound_is_salted(spark, monkeypatch):
    from tidewell.llm import base

    rows = spark.createDataFrame([(i, [None, "a", "b", "c"][i % 4]) for i in range(200)], "id long, k string")
    few = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "of string, v int")
    want = [[sorted(map(str, base.with_small(rows, few, "k", "of", F.col("id"), how).collect())) for how in ("inner", "left_anti")]]
    monkeypatch.setattr(base, "SMALL_ROWS", 1)
    assert [[sorted(map(str, base.with_small(rows, few, "k", "of", F.col("id"), how).collect())) for how in ("inner", "left_anti")]] == want


def test_texts_are_taken_in_bounded_lots():
    from tidewell.llm import base

    texts = ["x" * 900_000] * 5 + [None, "", "y" * 5_000_000, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["id", "text"])
    got = list(base.lots(batch, 1))
    assert pa.Table.from_batches(got) == pa.Table.from_batches([batch]) and not list(base.lots(batch.slice(0, 0), 1))
    assert all(x.num_rows and sum(len(t or "") for t in x.column(1).to_pylist()[:-1]) < base.LOT_BYTES for x in got)


@pytest.mark.parametrize("fold", [1 << 19, 40])
def test_common_shingles_are_counted_whole(spark, monkeypatch, fold):
    monkeypatch.setattr(simhash, "FOLD", fold)
    rng = random.Random(2)
    texts = [prose(rng, 30) + " this footer stands in every text" for _ in range(50)] + ["", None]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, node long, text string").coalesce(1)
    rows, common = simhash.surveyed(docs)
    want = Counter(c for t in texts for c in simhash.counter_of(simhash.shingles_of((t or "").encode())).tolist())
    mean = sum(want.values()) / simhash.COUNTERS
    assert {int(c): int(common[c]) for c in np.flatnonzero(common)} == {c: min(255, math.ceil(math.log(n) * 3.5)) for c, n in want.items() if n >= simhash.REPORTED + 4 * mean}
    assert 50 in want.values() and rows.count() == 52
