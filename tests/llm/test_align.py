"""op13 against whole texts encoded at once and all pairs of tokens."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewell.llm import align
from tidewell.llm.queries import piece_model, tokenizer_json

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
CHARS = align.byte_level()


def bytes_a(i):
    return bytes(CHARS[c] for c in A.id_to_token(i))


def bytes_b(i):
    p = B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()


def plain(text):
    """(n_a, n_b, groups, links) by their definitions, or nothing."""
    if not text:
        return None
    whole = (" " + text).encode()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    if b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
        return None
    ends_a, ends_b = np.cumsum([len(bytes_a(i)) for i in a]).tolist(), np.cumsum([len(bytes_b(i)) for i in b]).tolist()
    both = sorted(set(ends_a) & set(ends_b))
    groups, i, j = [], 0, 0
    for end in both:
        p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((a[i:p], b[j:q]))
        i, j = p, q
    links, j = [], 0
    for i, end in enumerate(ends_a):
        start = ends_a[i - 1] if i else 0
        while j and ends_b[j - 1] > start:
            j -= 1
        while j < len(b) and (ends_b[j - 1] if j else 0) < end:
            if ends_b[j] > start:
                links.append((a[i], b[j]))
            j += 1
    return len(a), len(b), groups, links


def expected(texts):
    found = [plain(t) for t in texts]
    documents = Counter(p for f in found if f for p in set(f[3]))
    most = defaultdict(int)
    for (a, _), n in documents.items():
        most[a] = max(most[a], n)
    out = []
    for f in found:
        if not f:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(documents[p] == most[p[0]] for p in links), sum(documents[p] for p in links), sha256(said.encode()).hexdigest()))
    return out


def odd_texts():
    rng = random.Random(5)
    marks = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", "　", "​", "a", "be", "ing", "don't", "'s", "12345", "3.5%", "é", "ß", "日本", "👍🏽", "é", "▁", "<s>", "<|endoftext|>", "<0x0A>", "...", "--", "ABC", "\x00", ";\r", "\n\n", "der", "the"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    words = ["".join(rng.choice("aeiounrstdl") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))).replace(" a", "\na") for _ in range(40)]
    texts += [None, "", " ", "\n", "\na", " a", "a ", "a\n", "a  b", "a\tb  c", "x" * 5_000, "same text", "same text", " \nword next", "word \nnext", "▁", " a ▁ b", "a" + " " * 300 + "b"]
    return texts


def test_groups_by_pointer_jumping():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n)), n)) for _ in range(2))
        cuts = np.intersect1d(a, b)
        got = align.groups_of(a, b)
        assert np.array_equal(got[0], np.searchsorted(cuts, a)) and np.array_equal(got[1], np.searchsorted(cuts, b))


@pytest.mark.parametrize(("memo", "pairs"), [(align.MEMO, align.PAIRS), (60, 500)])
def test_alignment_is_that_of_whole_texts(spark, monkeypatch, memo, pairs):
    monkeypatch.setattr(align, "PAIRS", pairs)
    texts = odd_texts()
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, codes string, n_best int").repartition(3)
    if memo != align.MEMO:  # tasks run elsewhere: forgetting is tested here
        monkeypatch.setattr(align, "MEMO", memo)
        own = align.Memo(align.Encoders(tokenizer_json("byte_bpe_50k.json"), piece_model()))
        assert [x[:5] for x in own.align([t or "" for t in texts])] == [(*x[:4], x[6]) for x in expected(texts)]
    got = align.aligned(docs, tokenizer_json("byte_bpe_50k.json"), piece_model())
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = {r[0]: tuple(r[1:]) for r in got.collect()}
    want = expected(texts)
    assert [i for i in range(len(texts)) if found[i] != want[i]] == []


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "one text"), (1, "one text"), (1, "one text"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in align.aligned(docs, tokenizer_json("byte_bpe_50k.json"), piece_model()).collect()), key=str)
    want = expected([t for _, t in rows])
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=str)
    assert align.aligned(docs.limit(0), tokenizer_json("byte_bpe_50k.json"), piece_model()).count() == 0
