"""Words without spaces, postings that skip, vector lists, table functions, and clients that fail."""

import itertools
import math
import random
import sys
import threading
import time
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewell.functions import tables
from tidewell.operators import chunks, generate, postings, search, segment, vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests
CJK = ["打开车窗的方法", "空调加热功能", "座椅加热设置", "如何开启车窗"]
LEXICON = [("打开", 5), ("车窗", 8), ("的", 20), ("方法", 4), ("空调", 6), ("加热", 6), ("功能", 3), ("座椅", 3), ("设置", 4), ("如何", 4), ("开启", 3)]


def best_path_score(run, counts):
    """The highest probability over all ways to cut run: every subset of places between characters."""
    total = sum(n for _, n in counts)
    share = {w: math.log(n) - math.log(total) for w, n in counts}
    best = -math.inf
    for cuts in itertools.product([False, True], repeat=len(run) - 1):
        edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        parts = [run[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        if all(p in share or len(p) == 1 for p in parts):
            best = max(best, sum(share.get(p, -math.log(total)) for p in parts))
    return best


def test_path_is_the_most_probable_one():
    rng = random.Random(2)
    for _ in range(150):
        words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        counts, run = list(words.items()), "".join(rng.choice("abcd") for _ in range(rng.randint(1, 11)))
        total = sum(words.values())
        path = segment.Segmenter(counts).path(run)
        assert [x for a, b, _ in path for x in range(a, b)] == list(range(len(run)))
        assert all((run[a:b] in words) if known else b == a + 1 for a, b, known in path)
        score = sum(math.log(words[run[a:b]]) - math.log(total) if known else -math.log(total) for a, b, known in path)
        assert score == pytest.approx(best_path_score(run, counts))


def test_chinese_words_stopwords_and_pairs(spark):
    docs = spark.createDataFrame([(f"doc_{i}", t) for i, t in enumerate(CJK)] + [("x", None), ("y", ""), ("z", "ABC打开龘龘龘 Case kept 9")], "doc string, text string")
    lexicon = spark.createDataFrame(LEXICON, "word string, n long")
    got = {r.doc: r.tokens for r in segment.segmented(docs, "text", lexicon, ("的",)).collect()}
    assert got["doc_0"] == ["打开", "车窗", "方法"] and got["doc_3"] == ["如何", "开启", "车窗"]
    assert got["x"] == got["y"] == [] and got["z"] == ["ABC", "打开", "龘龘", "龘龘", "Case", "kept", "9"]
    repeated = {r.word for r in segment.ngram_lexicon(docs, "text").collect()}
    assert {"车窗", "加热"} <= repeated and "的方" not in repeated
    assert [r.tokens for r in segment.segmented(docs, "text", lexicon.limit(0)).where("doc = 'doc_1'").collect()] == [["空调", "调加", "加热", "热功", "功能"]]


def test_search_over_chinese_texts(spark, tmp_path):
    docs = spark.createDataFrame([(f"doc_{i}", t) for i, t in enumerate([*CJK, "空调功能", "座椅功能", "设置方法"])], "doc string, text string")
    words = segment.tokenizer(spark.createDataFrame(LEXICON, "word string, n long"), ("的",))
    path = str(tmp_path / "cjk")
    asked = spark.createDataFrame([(1, "车窗"), (2, "")], "item_id long, text string")
    index = search.bm25_index(docs, "doc", "text", path, words)
    rows = search.bm25(index, asked, 2).collect()
    again = search.bm25(search.open_index(spark, path, docs.limit(0), "doc", "text", words), asked, 2).collect()
    assert sorted(rows) == sorted(again)
    assert {r.doc for r in rows if r.query == 1} == {"doc_0", "doc_3"} and len([r for r in rows if r.query == 2]) == 2
    assert search.drop_index(spark, path) and not search.drop_index(spark, path)
    with pytest.raises(ValueError):
        search.open_index(spark, path, docs.limit(0), "doc", "text", words)


def test_segmented_documents_give_their_words_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    lexicon = segment.word_lexicon(docs, "text", least=1)
    known = {r.word for r in lexicon.collect()}
    rows = segment.segmented(docs.withColumn("text", F.regexp_replace("text", r"\s+", "")), "text", lexicon, everything=True).limit(20).collect()
    assert all("".join(r.tokens) and sum(w in known for w in r.tokens) > 0.9 * len(r.tokens) for r in rows)


@pytest.mark.parametrize("zeros", [True, False])
def test_postings_skip_and_lose_nothing(spark, monkeypatch, zeros):
    """Blocks of 16 documents, one after the other: the same k best as by all scores, and fewer postings read."""
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(60)]
    docs = [(i if i % 50 else None, rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 30))) for i in range(400)]
    docs = [d for d in docs if d[0] is not None]
    dl = {i: len(t) for i, t in docs}
    mean = sum(dl.values()) / len(dl)
    df = {t: sum(t in own for _, own in docs) for t in vocabulary}
    weigh = lambda t: math.log(len(docs) / (1 + df[t]) + 1)
    rows = spark.createDataFrame(docs, "doc long, tokens array<string>").coalesce(1)
    monkeypatch.setattr(postings, "BLOCK_DOCS", 16)
    asked = [(q, t, weigh(t) * rng.randint(1, 2)) for q in range(30) for t in rng.sample(vocabulary, 5)]
    import tempfile

    path = tempfile.mkdtemp(prefix="spark-")
    postings.build(rows, path)
    blocks = spark.read.parquet(f"{path}/blocks").coalesce(1)
    assert blocks.count() > 20
    for kind, digits in (("bm25", 6), ("share", 9)):
        found = postings.search(blocks, spark.createDataFrame(asked, "query long, term string, weight double"), spark.range(32).withColumnRenamed("id", "query"), 5, kind, mean, digits, zeros).collect()
        work = {r["query"]: (r.score, r.total) for r in found if r.total is not None}
        for q in range(32):
            own = [(t, w) for x, t, w in asked if x == q]
            scores = []
            for i, tokens in docs:
                parts = [w * float(postings.impact(kind, np.array([tokens.count(t)], float), np.array([dl[i]], float), mean)[0]) for t, w in own if t in tokens]
                if zeros or sum(parts) > 0:
                    scores.append((-round(sum(parts), digits), i))
            got = sorted((-r.score, r.doc) for r in found if r["query"] == q and r.total is None)[:5]
            assert [d for _, d in got] == [d for _, d in sorted(scores)[:5]] and np.allclose([s for s, _ in got], [s for s, _ in sorted(scores)[:5]])
        assert sum(r for r, _ in work.values()) < 0.9 * sum(t for _, t in work.values())


def test_vector_lists_have_every_row_and_enough_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    asked = rows.where("vec_id % 100 = 0")
    for squared in (False, True):
        index = vectors.create(rows, squared_l2=squared)
        stands = index.blocks.select(F.explode("ids").alias("id")).groupBy("id").count().collect()
        assert len(stands) == rows.count() and {r["count"] for r in stands} == {2}
        exact = {(r.query, r.doc): r.score for r in search.dense(rows, asked, 10, squared_l2=squared).collect()}
        got = {(r.query, r.doc): r.score for r in vectors.nearest(index, asked, 10).collect()}
        assert len(exact.keys() & got.keys()) >= 0.9 * len(exact)
        assert all(abs(exact[k] - got[k]) < 1e-4 for k in exact.keys() & got.keys())


def test_vector_index_is_dropped_and_made_again(spark, tmp_path):
    rows = spark.createDataFrame([(f"v{i}", [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [("none", None)], "vec_id string, embedding array<float>")
    path = str(tmp_path / "vectors")
    assert vectors.reopen(spark, path) is None and not vectors.remove(spark, path)
    vectors.create(rows, path, squared_l2=True, lists=4)
    index = vectors.reopen(spark, path)
    assert index.squared_l2 and index.centroids.shape == (4, 3)
    hits = vectors.nearest(index, rows.where("vec_id = 'v8'"), 3, probes=4).collect()
    assert [(r.doc, r.score) for r in sorted(hits, key=lambda r: r["rank"])] == [("v43", 0.0), ("v8", 0.0), ("v1", 4.0)] or hits[0].score == 0.0
    assert vectors.remove(spark, path) and vectors.reopen(spark, path) is None
    with pytest.raises(ValueError):
        vectors.create(rows.where("embedding is null"), path)


def test_table_functions_give_the_rows_of_the_operators(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.createOrReplaceTempView("docs_of_test")
    tables.register(spark)
    for sql, want in (("chunk_text(text, 256, 50)", chunks.split_recursive(docs, "doc_id", "text")), ("split_semantic(text, 5)", chunks.split_semantic(docs, "doc_id", "text"))):
        got = spark.sql(f"SELECT doc_id, pos, piece FROM docs_of_test, LATERAL {sql}")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_parted_table_function(spark):
    rows = [(1, 0, "aa"), (1, 1, "bbb"), (1, 2, "c"), (2, 0, "long enough"), (2, 1, None), (3, 0, "x")]
    spark.createDataFrame(rows, "doc_id long, pos int, piece string").repartition(3).createOrReplaceTempView("lines_of_test")
    tables.register(spark)
    got = spark.sql("SELECT * FROM group_paragraphs(TABLE(SELECT * FROM lines_of_test) PARTITION BY doc_id ORDER BY (pos), 5)").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "aa bbb"), (1, 1, "c"), (2, 0, "long enough"), (2, 1, ""), (3, 0, "x")]


def down(text):
    raise ConnectionError("refused")


def test_chunks_without_an_embedder_are_the_text(spark):
    text = "\n".join(f"paragraph {i} " * 6 for i in range(12))
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").createOrReplaceTempView("texts_of_test")
    tables.register(spark, down)
    got = spark.sql("SELECT doc_id, pos, piece FROM texts_of_test, LATERAL split_semantic(text, 5)").collect()
    assert [tuple(r) for r in got if r.doc_id == 1] == [(1, 0, text)]
    tables.register(spark)
    assert spark.sql("SELECT * FROM texts_of_test, LATERAL split_semantic(text, 5)").where("doc_id = 1").count() > 1


class Slow:
    """Answers later prompts sooner, fails some once and some for good, and counts calls in flight."""

    def __init__(self):
        self.most, self.now, self.seen = 0, 0, {}

    def __call__(self, prompt):
        lock = self.__dict__.setdefault("lock", threading.Lock())
        with lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.seen[prompt] = self.seen.get(prompt, 0) + 1
        try:
            number = int(prompt.split()[-1])
            time.sleep(0.002 * (20 - number % 20))
            if number % 10 == 3 and self.seen[prompt] == 1:
                raise TimeoutError("timed out")
            if number % 10 == 4:
                raise ConnectionError("connection reset")
            if number % 10 == 5:
                raise ValueError("bad prompt")
            return None if number % 10 == 6 else f"{prompt} most {self.most}"
        finally:
            with lock:
                self.now -= 1


def test_calls_in_flight_keep_order_and_back_off_by_kind(spark):
    rows = spark.createDataFrame([(i, f"prompt {i}") for i in range(60)] + [(60, None), (61, " ")], "id long, prompt string").coalesce(1)
    began = time.time()
    got = generate.ask_each(rows, "prompt", Slow(), waits={"connection": lambda k: 0.01 * k}).collect()
    assert [r.id for r in got] == list(range(62)) and time.time() - began < 60
    for r in got[:60]:
        kind = r.id % 10
        assert r.response_calls == {3: 2, 4: 3}.get(kind, 1)
        assert r.response.startswith(f"prompt {r.id} most") if kind not in (4, 5, 6) else r.response == ""
    assert [(r.response, r.response_calls) for r in got[60:]] == [("", 0), ("", 0)]
    most = max(int(r.response.split()[-1]) for r in got if r.response)
    assert 8 <= most <= 16
    assert [generate.failure_kind(e) for e in (TimeoutError(), RuntimeError("Connection refused"), ValueError("no"))] == ["connection", "connection", "other"]
    assert [generate.WAITS["connection"](k) for k in (1, 2, 3, 9)] == [3.0, 6.0, 9.0, 10.0]


def test_blocks_hold_a_bounded_number_of_tokens(spark, monkeypatch, tmp_path):
    """However many tokens a batch of documents has, a block has BLOCK_TOKENS at most, or one text."""
    monkeypatch.setattr(postings, "BLOCK_TOKENS", 50)
    rows = [(i, [f"w{j % 9}" for j in range(n)]) for i, n in enumerate([0, 7, 200, 1, 49, 50, 3, 3, 0] * 30)] + [(None, None)]
    postings.build(spark.createDataFrame(rows, "doc long, tokens array<string>").coalesce(1), str(tmp_path / "own"))
    blocks = spark.read.parquet(str(tmp_path / "own/blocks")).collect()
    assert sorted((d for b in blocks for d in b.docs), key=str) == sorted((r[0] for r in rows), key=str)
    for b in blocks:
        sizes = postings._wide(bytes(b.lengths))
        assert sizes.sum() <= 50 or len(sizes) == 1
        assert postings._wide(bytes(b.times)).sum() == sizes.sum()


@pytest.mark.parametrize("squared", [False, True])
def test_dense_scores_in_bounded_pieces(spark, monkeypatch, squared):
    """Queries are met a few at a time, with the same ranks and ties."""
    rng = np.random.default_rng(2)
    own = rng.integers(-2, 3, (120, 4)).astype(float)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(own.tolist())] + [(500, None)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(search, "CELLS", 64)
    found = search.dense(rows.coalesce(1), rows.where("vec_id % 3 = 0"), 5, squared_l2=squared).collect()
    for q in range(0, 120, 3):
        score = ((own - own[q]) ** 2).sum(1) if squared else -(own @ own[q])
        assert [r.doc for r in sorted((r for r in found if r.query == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(120), np.round(score, 6)))[:5].tolist()


def test_vector_lists_are_written_before_a_task_holds_many(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    own = rng.normal(size=(900, 4))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(own.tolist())], "vec_id long, embedding array<double>").coalesce(1)
    monkeypatch.setattr(vectors, "HELD_BYTES", 4 * 4 * 100)
    monkeypatch.setattr(vectors, "CELLS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        index = vectors.create(rows, str(tmp_path / "held"), lists=6, squared_l2=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    blocks = index.blocks.collect()
    assert len(blocks) >= 9 and max(len(b.ids) for b in blocks) <= 200  # one row for each list before, of up to all its vectors
    assert Counter(i for b in blocks for i in b.ids) == {i: 2 for i in range(900)}
    exact = search.dense(rows, rows.where("vec_id % 100 = 0"), 5, squared_l2=True).select("query", "doc", "rank").collect()
    assert sorted(vectors.nearest(index, rows.where("vec_id % 100 = 0"), 5, probes=6).select("query", "doc", "rank").collect()) == sorted(exact)


def test_texts_are_cut_in_bounded_pieces(spark, monkeypatch):
    """Null ids and null texts stay as they are, and what is cut doesn't depend on how much text is cut at once."""
    texts = ["a b\nc d\ne", None, "", "x " * 300 + "\n" + "y " * 300, "one"] * 20
    rows = spark.createDataFrame([(i if i % 7 else None, x) for i, x in enumerate(texts)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(chunks, "TEXT_BYTES", 30)
    found = chunks.split_recursive(rows, "doc_id", "text", 4, 1).collect()
    wanted = [(i if i % 7 else None, k, p) for i, x in enumerate(texts) for k, p in enumerate(chunks.recursive_split(x or "", 4, 1, length=lambda t: len(t.split())))]
    assert [tuple(r) for r in found] == wanted


def test_best_path_is_that_of_a_plain_walk(monkeypatch):
    """The path by matches is that of going through all characters and sizes, ties too; remembered runs change nothing."""
    rng = random.Random(7)
    counts = [("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))), rng.choice([1, 1, 2, 4])) for _ in range(12)]
    cutter = segment.Segmenter(counts)
    share = {w: math.log(n) - cutter.total for w, n in dict(counts).items()}

    def plain(run):
        best, back = [0.0], [None]
        for at in range(1, len(run) + 1):
            score, start = best[at - 1] - cutter.total, None
            for size in range(1, min(at, 4) + 1):
                edge = share.get(run[at - size : at])
                if edge is not None and best[at - size] + edge >= score:
                    score, start = best[at - size] + edge, at - size
            best.append(score)
            back.append(start)
        out, at = [], len(run)
        while at:
            start = at - 1 if back[at] is None else back[at]
            out.append((start, at, back[at] is not None))
            at = start
        return out[::-1]

    runs = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    assert all(cutter.path(r) == plain(r) for r in runs)
    monkeypatch.setattr(segment, "KNOWN", 5)
    first = [cutter.cut(r) for r in runs]
    assert [cutter.cut(r) for r in runs] == first == [cutter._cut(r) for r in runs] and len(cutter.runs) <= 5


def test_vector_lists_are_one_file_each_however_many_tasks_read(spark, tmp_path):
    own = np.random.default_rng(6).normal(size=(800, 4))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(own.tolist())], "vec_id long, embedding array<double>").repartition(16)
    index = vectors.create(rows, str(tmp_path / "dealt"), lists=6, squared_l2=True)
    assert len(list((tmp_path / "dealt" / "lists").rglob("*.parquet"))) <= 12  # 6 lists; a file for each list and task were 96
    assert Counter(i for b in index.blocks.collect() for i in b.ids) == {i: 2 for i in range(800)}
    for b in index.blocks.collect():
        assert np.allclose(np.frombuffer(b.vectors, "<f4").reshape(-1, 4), own[b.ids])
    again = vectors.create(rows.repartition(3), str(tmp_path / "again"), lists=6, squared_l2=True)
    assert np.array_equal(index.centroids, again.centroids)  # the sample doesn't depend on how rows lie


def test_two_nearest_are_the_first_of_the_sorted():
    d = np.random.default_rng(7).integers(0, 4, (500, 9)).astype(float)
    d[:5] = np.inf
    d[5:9, 1:] = np.inf
    for most in (1, 2, 3):
        assert np.array_equal(vectors._least(d.copy(), most), np.argsort(d, 1, kind="stable")[:, :most])
    assert vectors._least(d[:, :1].copy(), 2).tolist() == [[0]] * 500


def test_piece_vectors_row_by_row_are_those_of_counts(spark):
    from tidewell.functions import text as X
    from tidewell.plans import indexes

    rng = np.random.default_rng(8)
    texts = [" ".join(f"wört{i}" for i in rng.integers(0, 90, n)) for n in rng.integers(0, 120, 60)] + ["", None, "...", "A a É"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "once more"), (9, ""), (None, "no id"), (None, "nor here"), (-1, "x")]
    pieces = spark.createDataFrame(rows, "doc long, piece string")
    want = search.hashed_vectors(pieces.select("doc", X.tokens(F.col("piece")).alias("tokens"))).collect()
    key = lambda r: (r.doc is None, r.doc or 0)
    assert sorted(indexes._piece_vectors(pieces).collect(), key=key) == sorted(want, key=key) and len(want) > 55
