"""Operators on small tables: ranks, merges, splits, metrics, files and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import chunks, conversation, curation, generate, metrics, profile, search
from tidewell.sources import files
from tidewell.streaming import jobs


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("doc_0", "open the car window slowly"), ("doc_1", "air heating in the car"), ("doc_2", "seat heating settings"), ("doc_3", "how to open a window")]
    return spark.createDataFrame(rows, "doc string, text string")


def test_bm25(spark, docs):
    docs = docs.union(spark.createDataFrame([("doc_4", "tyres")], docs.schema))
    index = search.bm25_index(docs, "doc", "text")
    asked = spark.createDataFrame([(1, "window"), (2, ""), (3, "window window heating")], "item_id long, text string")
    got = search.bm25(index, asked, 2).collect()
    assert {r.doc for r in got if r.query == 1} == {"doc_0", "doc_3"}
    assert [(r.doc, r.score) for r in got if r.query == 2] == [("doc_0", 0.0), ("doc_1", 0.0)]
    assert all(sorted(r.rank for r in got if r.query == q) == [1, 2] for q in (1, 2, 3))
    assert search.bm25(index, asked, 9).count() == 15
    with pytest.raises(ValueError):
        search.bm25_index(docs.limit(0), "doc", "text")


def test_dense_is_exact(spark):
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(50)] + [(99, None)], "vec_id long, embedding array<float>")
    got = search.dense(v, v.where("vec_id = 7"), 3).collect()
    scores = sorted(((-(i % 5 * 2 + i % 3 + 1.0), i) for i in range(50)))[:3]
    assert [(r.doc, -r.score) for r in sorted(got, key=lambda r: r.rank)] == [(i, s) for s, i in scores]
    near = search.dense(v, v.where("vec_id = 7"), 1, squared_l2=True).first()
    assert (near.doc, near.score) == (7, 0.0)


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3)], "query long, doc long, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 40, 2)], "query long, doc long, rank int")
    assert [r.doc for r in search.fuse([a, b]).orderBy("rank").collect()] == [20, 10, 40, 30]


def test_merge_and_parents(spark):
    a = spark.createDataFrame([(1, "d1", 1), (1, "c1", 2), (1, None, 3)], "query long, doc string, rank int")
    b = spark.createDataFrame([(1, "d1", 1), (1, "c2", 2), (1, "c3", 3)], "query long, doc string, rank int")
    merged = search.merge(a, b)
    assert [r.doc for r in merged.orderBy("rank").collect()] == ["d1", "c1", "c2", "c3"]
    children = spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("c3", "gone")], "doc string, parent string")
    parents = spark.createDataFrame([("p1", "text")], "parent string, text string")
    assert [r.doc for r in search.expand_parents(merged, children, parents).orderBy("rank").collect()] == ["d1", "p1"]
    assert [r.doc for r in search.expand_parents(merged, children, parents, keep_missing=True).orderBy("rank").collect()] == ["d1", "p1", "c3"]


def test_rerank(spark):
    rows = [(1, f"d{i}", i, "a b", t) for i, t in enumerate(["a x", "b a", "x", "a b"], 1)] + [(2, f"e{i}", i, " ", "a") for i in (1, 2, 3)]
    c = spark.createDataFrame(rows, "query long, doc string, rank int, query_text string, text string")
    got = {q: [r.doc for r in search.rerank(c, 2).where(F.col("query") == q).orderBy("rank").collect()] for q in (1, 2)}
    assert got == {1: ["d2", "d4"], 2: ["e1", "e2"]}
    assert search.rerank(c, 9).count() == 7


def test_post_process(spark):
    ranked = spark.createDataFrame([(1, 1, 5, [("a.png", "t"), ("b.png", " ")]), (1, 2, 3, None), (1, 3, 5, [("c.png", "u")])], "query long, rank int, page long, images array<struct<path:string,title:string>>")
    answers = spark.createDataFrame([(1, "x【3】【1, 2】【10】"), (2, "none")], "query long, response string")
    got = {r["query"]: r for r in search.post_process(answers, ranked).collect()}
    assert (got[1].answer, got[1].cite_pages, got[1].related_images) == ("x", [3, 5], ["c.png", "a.png"])
    assert (got[2].answer, got[2].cite_pages, got[2].related_images) == ("none", [], [])


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, d, i) for i, d in enumerate("abcd", 1)], "query long, doc string, rank int")
    truth = spark.createDataFrame([(1, "b"), (1, "d"), (1, "z"), (2, "a")], "query long, doc string")
    got = {r["query"]: r for r in metrics.ranking_metrics(ranked, truth, 3).collect()}
    assert (got[1].mrr, got[1].precision, got[1].recall) == (0.5, pytest.approx(1 / 3, abs=1e-6), pytest.approx(1 / 3, abs=1e-6))
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0)


def test_histograms_differ_at_edges(spark):
    df = spark.createDataFrame([(100,), (101,), (1024,)], "n int")
    half = {r.bucket: r.n for r in profile.histogram(df, F.col("n"), profile.CHAR_EDGES).collect()}
    closed = {r.bucket: r.n for r in profile.histogram(df, F.col("n"), profile.CLOSED_EDGES, closed=True).collect()}
    assert half == {"<100": 0, "<256": 2, "<512": 0, "<1024": 0, ">=1024": 1} and closed == {"<=100": 1, "<=256": 1, "<=512": 0, "<=1024": 1, ">1024": 0}


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 5, 9, 9)] + [("b", 3)], "g string, x int")
    assert {r.g: r.median for r in profile.upper_median(df, "g", "x").collect()} == {"a": 9, "b": 3}


def test_moving_average(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(12)] + [("b", i, float(i)) for i in range(4)], "g string, i int, v double")
    got = {(r.g, r.i): r.smoothed for r in metrics.moving_average(df, "g", "i", "v").collect()}
    assert got["a", 0] == 2.5 and got["a", 6] == 6.0 and got["b", 3] == 3.0


def test_splits_are_exact_and_stable(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    assert curation.exact_sample(df, F.col("k"), 0.1).count() == 50
    assert curation.tail_split(df, [F.col("k")], 20).where("split = 'dev'").agg(F.min("k"), F.count("*")).first()[:] == (480, 20)
    assert curation.tail_split(df, [F.col("k")], 0).where("split = 'dev'").count() == 0
    assert curation.tail_split(df, [F.col("k")], 900).where("split = 'train'").count() == 0
    place = [r.place for r in curation.seeded_order(df, F.col("k")).collect()]
    assert sorted(place) == list(range(1, 501))


def test_rerank_rows(spark):
    df = spark.createDataFrame([(1, "q", ["a", "b", "c"], ["a", "n", "n"]), (2, "q", ["a"], ["a"]), (3, "", ["a"], ["b"])], "query_id long, query string, context array<string>, merged array<string>")
    got = sorted((r.query_id, r.label, r.content) for r in curation.rerank_rows(df).collect())
    assert [(q, x) for q, x, _ in got] == [(1, 0), (1, 1), (1, 2), (2, 2)] and got[0][2] == "n" and got[1][2] in "bc"


def test_validation(spark):
    good = {"query": "q", "content": "c", "label": 1}
    rows = [json.dumps(good), json.dumps(good | {"label": 5}), json.dumps(good | {"content": ["c"]}), "[1]", "{", json.dumps({"query": "q"})]
    df = spark.createDataFrame([(r,) for r in rows], "line string")
    got = [r.error for r in curation.validate_json(df, "line", ("query", "content"), (0, 1, 2)).collect()]
    assert got == [None, "label out of range", "content missing or no string", "not an object", "not an object", "content missing or no string"]


def test_compaction(spark):
    turns = [(1, i, "user", "x" * 400) for i in range(8)] + [(2, 0, "user", None)]
    got = conversation.compact(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), budget=300).collect()
    assert sorted(r.turn for r in got if r.conv_id == 1) == [-1, 4, 5, 6, 7] and len([r for r in got if r.conv_id == 2]) == 1


def test_model_rows(spark):
    class Flaky:
        def __call__(self, prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError("bad prompt")
            return ['[{"question": "q", "answer": "' + p[:3] + '"}]' for p in prompts]

    df = spark.createDataFrame([(1, "abc" * 50), (2, "bad" * 50), (3, "short"), (4, "xyz" * 50)], "k long, text string")
    got = generate.make_pairs(df, "k", "text", Flaky(), done=df.where("k = 4")).collect()
    assert [(r.k, r.answer) for r in got] == [(1, "abc")]


def test_parents_and_children(spark):
    text = "\n".join(f"paragraph {i} " + "word " * 60 for i in range(12))
    rows = chunks.parents_and_children(spark.createDataFrame([(1, text), (2, "tiny"), (3, None)], "id long, text string"), "id", "text").collect()
    ids = {r.unique_id for r in rows if r.parent_id is None}
    assert all(r.parent_id in ids for r in rows if r.parent_id) and all(r.in_index for r in rows if r.parent_id)


def test_near_blocks(spark):
    images = spark.createDataFrame([(1, 0, 10.0, 100.0, 50.0, 120.0)], "page int, image int, x0 double, y0 double, x1 double, y1 double")
    blocks = spark.createDataFrame([(1, 1, 0.0, 60.0, 20.0, 80.0, "title"), (1, 2, 60.0, 60.0, 90.0, 80.0, "aside"), (1, 3, 0.0, 130.0, 20.0, 140.0, "below"), (2, 4, 0.0, 60.0, 20.0, 80.0, "x")], "page int, block int, x0 double, y0 double, x1 double, y1 double, content string")
    assert {(r.block, r.above) for r in chunks.near_blocks(images, blocks, 800.0).collect()} == {(1, True), (3, False)}


def test_files(spark, tmp_path):
    p = tmp_path / "rows.jsonl"
    p.write_text('{"unique_id": "a", "raw_resp": "1"}\n\n{bad\n{"unique_id": "a", "raw_resp": "2"}\n{"raw_resp": "3"}\n')
    schema = T.StructType([T.StructField("unique_id", T.StringType()), T.StructField("raw_resp", T.StringType())])
    assert [tuple(r) for r in files.read_json_lines(spark, str(p), schema, "unique_id").collect()] == [("a", "2")]
    store = spark.createDataFrame([("a", 1), ("b", 1)], "unique_id string, v int")
    new = spark.createDataFrame([("a", 2), ("a", 3), (None, 9), ("", 9), ("c", 1)], "unique_id string, v int")
    assert sorted(tuple(r) for r in files.upsert(store, new, "unique_id", "v").collect()) == [("a", 3), ("b", 1), ("c", 1)]
    words = tmp_path / "words.txt"
    words.write_text(" 的 \n\n了\n的\n")
    assert sorted(r.value for r in files.read_list(spark, str(words)).collect()) == sorted(["的", "了"])
    log = tmp_path / "gpu.csv"
    log.write_text("2024-01-01, 2024/01/01, 0, GPU, 45 %, 100 MiB, 200 MiB, 60 C\nbroken, row\n")
    assert tuple(files.read_gpu_log(spark, str(log)).first())[1:] == (0, "GPU", 45.0, 100.0, 200.0, 60.0)
    built = []
    for _ in range(2):
        files.stage(spark, str(tmp_path / "stage"), lambda: built.append(1) or store).count()
    assert len(built) == 1


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    spark.createDataFrame([("a", 1), ("b", 5)], schema).write.parquet(f"{source}/1")
    spark.createDataFrame([("a", 3), ("b", 2)], schema).write.parquet(f"{source}/2")
    stream = jobs.read_stream(spark, source, schema, 1)
    got = jobs.upsert_batches(stream, str(tmp_path / "store"), "k", "v", str(tmp_path / "state")).collect()
    assert sorted((r.k, r.v) for r in got) == [("a", 3), ("b", 5)]
    again = jobs.upsert_batches(stream, str(tmp_path / "store"), "k", "v", str(tmp_path / "state"))
    assert sorted((r.k, r.v) for r in again.collect()) == [("a", 3), ("b", 5)]
    for _ in range(2):
        assert jobs.run_to_table(jobs.read_stream(spark, source, schema), str(tmp_path / "out"), str(tmp_path / "state2")).count() == 4


def test_index_is_found_again(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    built = search.open_index(spark, path, docs, "doc", "text")  # none there yet
    again = search.open_index(spark, path, docs.limit(0), "doc", "text")
    assert (again.n, again.mean_length) == (built.n, built.mean_length) and again.terms.count() == built.terms.count()


def test_rerank_falls_back(spark):
    rows = spark.createDataFrame([(1, 10, 1, 0.2, False), (1, 11, 2, None, False), (1, 12, 3, 0.9, False), (2, 20, 1, 0.1, True), (2, 21, 2, 0.8, True)], "query long, doc long, rank int, s double, failed boolean")
    got = {(r.query, r["rank"]): r.doc for r in search.rerank_or_keep(rows, 2, "s", "failed").collect()}
    assert got == {(1, 1): 12, (1, 2): 10, (2, 1): 20, (2, 2): 21}
