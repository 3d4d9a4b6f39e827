"""op12 against its definition in plain numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidewell.llm import divergence

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(x):
    return x.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def plain(rows, least=10):
    rows = [(a or "", b or "", t or "") for a, b, t in rows]
    count, docs, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, text in rows:
        groups[lang].add(source)
        terms = [t.decode() for t in TERM.findall(lowered(text.encode()))]
        docs.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        n = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        share = lambda c, total: 1 + 1_000_000_000 * (c + 2) // (total + 2 * len(kept))  # noqa: B023, E731
        far = lambda p, q: (p - q) ** 2 // (p + q)
        p = {(s, t): share(count[lang, s, t], n[s]) for s in sources for t in kept}
        q = {t: share(sum(count[lang, s, t] for s in sources), sum(n.values())) for t in kept}
        for s in sources:
            pairs = [(-sum(far(p[s, t], p[o, t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-far(p[s, t], q[t]), t.encode()) for t in kept if count[lang, s, t] and p[s, t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def rows(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéßñ日") for _ in range(rng.choice([1, 3, 7, 8, 9, 15, 16, 17, 30, 70]))) for _ in range(120)] + ["ſ", "İ", "AbC"]
    out = []
    for i in range(n):
        own = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w in rng.choices(words, [1 / (k + 1 + (i % 3)) for k in range(len(words))], k=rng.randint(0, 40))]
        out.append((rng.choice(["de", "en", None, ""]), rng.choice(["a", "b", "é", None, "", "z"]), "".join(w + rng.choice([" ", "1", "\n", "-", "@"]) for w in own)))
    return out + [("fr", "lonely", None), ("fr", "other", ""), ("xx", "one", "12 34"), ("en", "b", "x" * 40_000)] * 2 + [("en", "empty", None)]


def test_audit(spark):
    own = rows(1, 900)
    docs = spark.createDataFrame([(*r, "x", 1) for r in own], "lang string, source string, text string, part string, item int").repartition(5)
    got = divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain(own)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_small_bounds_change_nothing(monkeypatch):
    """What a task counts, merges and compares in pieces is what it does at once."""
    own = [(a or "", b or "", (t or "").encode()) for a, b, t in rows(2, 600)]
    one, many = divergence.Runs(), divergence.Runs()
    one.count([t for *_, t in own], np.array([one.group(a, b) for a, b, _ in own], np.uint32))
    for k in range(0, len(own), 37):
        part = divergence.Runs()
        some = own[k : k + 37]
        part.count([t for *_, t in some], np.array([part.group(a, b) for a, b, _ in some], np.uint32))
        for batch in part.rows(7):
            for row in batch.to_pylist():
                many.add_row(row)

    def named(runs):
        names = list(runs.groups)
        return sorted((names[g], divergence.term_at(w, i), c, d) for _, _, gs, cs, ds, w in runs.by_term() for i, (g, c, d) in enumerate(zip(gs.tolist(), cs.tolist(), ds.tolist(), strict=True)))

    want = Counter((a, b, t) for a, b, x in own for t in TERM.findall(lowered(x)))
    assert named(one) == named(many)
    assert {(*k, t): c for k, t, c, _ in named(one)} == want
    sources = defaultdict(list)
    for a, b in sorted(one.groups):
        sources[a].append((b, sum(n for k, n in want.items() if k[:2] == (a, b))))
    terms = {a: len({k[2] for k in want if k[0] == a}) for a in sources}
    found = []
    for cells, sums in ((divergence.CELLS, divergence.SUMS), (50, 10)):
        monkeypatch.setattr(divergence, "CELLS", cells)
        monkeypatch.setattr(divergence, "SUMS", sums)
        compared, total = divergence.Compared(dict(sources), terms, 10), Counter()
        for rows_ in (compared.add(many), compared.rows()):
            for *k, v in rows_:
                total[tuple(k)] += v
        found.append(total)
    assert found[0] == found[1] and found[0]


def test_shares_are_exact():
    rng = random.Random(4)
    for _ in range(2_000):
        total, terms = rng.randint(0, 1 << rng.randint(1, 52)), rng.randint(1, 1 << 20)
        count = rng.randint(0, total)
        assert divergence.shares(np.array([count]), total, terms).tolist() == [1 + 1_000_000_000 * (count + 2) // (total + 2 * terms)]


def test_packed_words_sort_as_bytes():
    rng = random.Random(6)
    terms = [bytes(rng.choice(b"abz\xc3\xa9\xff") for _ in range(rng.randint(1, 16))) for _ in range(3_000)]
    of, _, _, words, _ = divergence.pack([b" ".join(terms[:100]), b"", b" ".join(terms[100:])])
    assert [divergence.term_at(words, i) for i in range(len(terms))] == terms and of.tolist() == [0] * 100 + [2] * 2_900
    order = divergence.radix_order(words[::-1])
    assert [terms[i] for i in order.tolist()] == sorted(terms)
