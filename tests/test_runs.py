"""Parted windows, the page grid, bucketed stores, the results format, traces and counted plans."""

import json
import os
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import text as X
from tidewell.operators import chunks, conversation, evaluate, metrics
from tidewell.sources import files
from tidewell.sources.results import Results, summary
from tidewell.streaming import histories, jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.mark.parametrize("range_", [40, 3])
def test_windows_over_a_group_of_most_rows(spark, monkeypatch, range_):
    """90 % of the rows are one user's: they are dealt over many ranges, and every value is that of the plain window."""
    from tidewell.operators import ordered

    monkeypatch.setattr(ordered, "RANGE", range_)
    rng = random.Random(1)
    rows = [("hot" if i % 10 else rng.choice(["a", None, "b"]), i, rng.random() if i % 17 else None) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "u string, i long, v double").withColumn("ts", F.timestamp_seconds(F.col("i") * 3))
    plain = {(r.u, r.i): r.smoothed for r in metrics.moving_average(df, "u", "i", "v").collect()}
    parted = metrics.moving_average(df, "u", "i", "v", large=50)
    assert {(r.u, r.i): r.smoothed for r in parted.collect()} == pytest.approx(plain, nan_ok=True)
    plain = sorted((r.u or "", r.i, r.seconds) for r in metrics.step_durations(df, "u", "ts").collect())
    assert sorted((r.u or "", r.i, r.seconds) for r in metrics.step_durations(df, "u", "ts", large=50).collect()) == plain
    parts = ordered.with_neighbours(df, "u", ["i"], 2, lambda w: {"p": F.count(F.lit(1)).over(w)}, 50)
    assert parts.where("u = 'hot'").agg(F.max("p")).first()[0] <= max(60, 4 * range_) + 4 and parts.count() == 400


def test_blocks_of_a_crowded_page(spark):
    """100,000 blocks on one page meet a few images by cells; every pair comes once, as by comparing all."""
    images = [(1, k, 37.0 * k, 90.0 * k, 37.0 * k + 60, 90.0 * k + 20) for k in range(6)] + [(1, 90, 0.0, 770.0, 600.0, 790.0), (2, 0, 0.0, 0.0, 10.0, 10.0), (3, 0, None, 0.0, 1.0, 1.0)]
    i = spark.createDataFrame(images, "page int, image int, x0 double, y0 double, x1 double, y1 double")
    n = F.col("id")
    b = spark.range(100_000).select(F.lit(1).alias("page"), n.cast("int").alias("block"), (n % 600).cast("double").alias("x0"), ((n * 7) % 800).cast("double").alias("y0"), (n % 600 + n % 40).cast("double").alias("x1"), ((n * 7) % 800 + n % 25).cast("double").alias("y1"), F.lit("x").alias("content"))
    wide = spark.createDataFrame([(1, 200_000, -1e9, 0.0, 1e9, 800.0, "wide"), (1, 200_001, 5.0, 5.0, 6.0, 6.0, " "), (2, 200_002, float("nan"), 0.0, 1.0, 1.0, "x"), (2, 200_003, 50.0, 700.0, 20.0, 720.0, "turned")], b.schema)
    got = chunks.near_blocks(i, b.union(wide), 800.0).select("page", "image", "block").collect()
    want = set()
    for page, image, ix0, iy0, ix1, iy1 in images:
        if ix0 is None:
            continue
        top, bottom = max(0.0, iy0 - 200), min(750.0, iy1 + 3 * (iy1 - iy0))
        if page == 1:
            for k in range(100_000):
                x0, y0 = k % 600, k * 7 % 800
                if x0 < ix1 and ix0 < x0 + k % 40 and y0 < bottom and top < y0 + k % 25:
                    want.add((1, image, k))
            want.add((1, image, 200_000))
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    source, store, state = (str(tmp_path / x) for x in ("in", "store", "state"))
    spark.createDataFrame([(f"k{i}", 1) for i in range(200)], schema).coalesce(1).write.parquet(f"{source}/1")

    def run():
        return jobs.upsert_buckets(jobs.read_stream(spark, source, schema, 1), store, "k", "v", state, 16)

    def held():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{store}/data") for f in fs if f.endswith(".parquet")}

    assert {r.k: r.v for r in run().collect()} == {f"k{i}": 1 for i in range(200)}
    before, live = held(), jobs.live_buckets(spark, store)[1]
    spark.createDataFrame([("k3", 5), ("k3", 7), ("k4", 0), ("new", 2), (None, 9), ("", 9)], schema).coalesce(1).write.parquet(f"{source}/2")
    got = {r.k: r.v for r in run().collect()}
    assert got == {f"k{i}": 1 for i in range(200)} | {"k3": 7, "new": 2}
    now = jobs.live_buckets(spark, store)[1]
    touched = {b for b in now if now[b] != live.get(b)}
    assert 1 <= len(touched) <= 3
    same = {f for f in before if f"v={live[int(f.split('bucket=')[1].split('/')[0])]}" in f and int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert same and all(held()[f] == before[f] for f in same)
    assert run().count() == 201  # nothing new


def test_histories_of_a_stream_are_those_of_all_turns(spark, tmp_path):
    """Turns come out of order in four batches; what stands after the last one is what compacting all of them gives."""
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["word " * rng.randint(0, 30), None, "同じ" * 9])) for c in range(12) for t in range(rng.randint(1, 25))]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), turns.schema, 1)
    updates = jobs.run_updates(histories.compacted(stream, budget=100), str(tmp_path / "out"), str(tmp_path / "state"))
    assert updates.agg(F.max("batch")).first()[0] == 3
    got = histories.last_states(updates).select("conv_id", "turn", "role", "text")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, conversation.compact(turns, budget=100).collect()), key=str)


def test_results_are_there_with_their_manifest(spark, tmp_path):
    spark.dataSource.register(Results)
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([(i, f"n{i}", i / 2 if i % 3 else None) for i in range(50)], "id long, name string, score double").repartition(4)
    rows.where("id < 20").write.format("results").mode("append").save(path)
    rows.where("id >= 20").write.format("results").mode("append").save(path)
    assert sorted(map(tuple, spark.read.format("results").load(path).collect())) == sorted(map(tuple, rows.collect()))
    scores = [i / 2 for i in range(50) if i % 3]
    assert summary(path) == {"rows": 50, "means": {"id": 24.5, "score": pytest.approx(sum(scores) / len(scores))}}
    manifest = json.loads((tmp_path / "results" / "manifest-1.json").read_text())
    assert manifest["rows"] == 30 and all((tmp_path / "results" / f).exists() for f in manifest["files"])
    fail = F.when(F.col("id") == 40, F.raise_error("stop")).otherwise(F.col("name"))
    with pytest.raises(Exception, match="stop"):
        rows.withColumn("name", fail).write.format("results").mode("append").save(path)
    assert summary(path)["rows"] == 50 and spark.read.format("results").load(path).count() == 50
    named = {f for m in tmp_path.glob("results/manifest-*.json") for f in json.loads(m.read_text())["files"]}
    assert {f.name for f in tmp_path.glob("results/part-*")} == named
    rows.where("id = 7").write.format("results").mode("overwrite").save(path)
    assert [r.id for r in spark.read.format("results").load(path).collect()] == [7] and summary(path)["rows"] == 1
    assert summary(str(tmp_path / "nothing")) == {"rows": 0, "means": {}}


def test_results_as_a_stream(spark, tmp_path):
    spark.dataSource.register(Results)
    path, out, state = (str(tmp_path / x) for x in ("results", "out", "state"))
    seen = []
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).write.format("results").mode("append").save(path)
        stream = spark.readStream.format("results").schema("id long").load(path)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(once=True).start().awaitTermination()
        seen.append(spark.read.parquet(out).count())
    assert seen == [10, 20, 30] and spark.read.parquet(out).distinct().count() == 30


class Answers:
    def __call__(self, prompt):
        if "broken" in prompt:
            raise ValueError("no")
        return "<think>x</think>答案内容：" + prompt.split("\n")[0][:30] + "【1】"


def test_traces_and_predictions(spark):
    questions = spark.createDataFrame([(1, "first"), (2, "broken"), (3, " "), (4, "known"), (5, "alone")], "query long, question string")
    ranked = spark.createDataFrame([(1, "b text", 2), (1, "a text", 1), (2, "c", 1), (4, "d", 1)], "query long, text string, rank int")
    done = spark.createDataFrame([("known",)], "question string")
    rows = evaluate.trace(questions, ranked.unionByName(ranked.withColumn("rank", F.col("rank") + 2)), ranked, Answers(), done)
    got = {r["query"]: r for r in rows.collect()}
    assert set(got) == {1, 5}
    assert (got[1].context, got[1].merged_docs, got[1].response) == (["a text", "b text"], ["a text", "b text", "a text", "b text"], "【1】a text【1】")
    gold = spark.createDataFrame([(1, "a text"), (2, "z")], "query long, gold string")
    found = {r["query"]: (r.answer, r.cites) for r in evaluate.predictions(rows, gold).collect()}
    assert found == {1: ("a text", [1]), 2: (X.NO_ANSWER, [])}
    scored = evaluate.sample_metrics(evaluate.predictions(rows, gold).withColumn("kw", F.array(F.lit("text"))), keywords="kw").where("query = 1").first()
    assert (scored.bleu1, scored.rouge1, scored.exact, scored.semantic_keyword) == (1.0, 1.0, 1, 1.0)


def test_error_rows_and_two_models(spark):
    rows = spark.createDataFrame([(1, None), (2, "down")], "id long, error string")
    assert [r.id for r in evaluate.without_errors(rows).collect()] == [1] and evaluate.without_errors(rows.drop("error")).count() == 2
    asked = spark.createDataFrame([("a b c", "a b c"), ("x y", "q")], "prompt string, gold string")
    got = {r.metric: (r.first, r.second, r.change) for r in evaluate.two_models(asked, "prompt", lambda p: p, lambda p: None).collect()}
    assert got["samples"] == (2.0, 2.0, 0.0) and got["exact"] == (0.5, 0.0, -0.5) and got["rouge_l"] == (0.5, 0.0, -0.5) and got["bleu1"] == (0.5, 0.0, -0.5)


def test_counted_plans(spark):
    rows, seen = evaluate.counted(spark.range(7), "seen", most=F.max("id"))
    rows.collect()
    evaluate.require(seen, n=7, most=6)
    with pytest.raises(ValueError, match="n"):
        evaluate.require(seen, n=8)


def test_arrays_of_json(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'quote " and\nline', None), (2, None, 2.5)], "a long, b string, c double").repartition(3)
    files.write_json_arrays(rows, str(tmp_path / "arrays"))
    assert sorted(map(tuple, files.read_json_array(spark, str(tmp_path / "arrays"), rows.schema).collect())) == sorted(map(tuple, rows.collect()))
    written = [json.loads(p.read_text()) for p in (tmp_path / "arrays").glob("part-*")]
    assert sorted(len(x) for x in written if x) in ([1, 1], [2])
    files.write_sft(spark.createDataFrame([("do", None, "out")], "instruction string, input string, output string"), str(tmp_path / "sft"))
    assert [json.loads(x) for p in (tmp_path / "sft").glob("part-*") for x in p.read_text().splitlines()] == [{"instruction": "do", "input": "", "output": "out"}]


def test_sentence_bleu_by_its_definition():
    """Values by hand: equal texts, no word in common, and one of five words changed."""
    same = "a b c d e".split()
    assert metrics.sentence_bleu(same, same) == pytest.approx(1.0)
    assert metrics.sentence_bleu(same, ["z"]) == metrics.sentence_bleu(same, []) == metrics.sentence_bleu([], same) == 0.0
    changed = "a b x d e".split()  # 4 of 5 words, 2 of 4 pairs, 0 of 3 and 0 of 2 longer ones (0.1 each)
    assert metrics.sentence_bleu(same, changed) == pytest.approx((4 / 5 * 2 / 4 * 0.1 / 3 * 0.1 / 2) ** 0.25)
    short = "a b c d".split()
    assert metrics.sentence_bleu(same, short) == pytest.approx(2.718281828459045 ** (1 - 5 / 4))


def test_metric_tokens_keep_case(spark):
    got = spark.createDataFrame([("Ab 1",)], "t string").select(X.all_tokens(F.col("t")).alias("t")).first().t
    assert got == ["Ab", " ", "1"]


def test_mined_rows(spark):
    from tidewell.operators import curation

    rows = [(i, "q", ["a", "b", "c"], ["a", "b", "c", "n", "n"], "x【1】" if i % 3 else "x") for i in range(60)] + [(100, "", ["a"], ["a"], "【1】"), (101, "q", ["a"], ["a"], "【1】"), (102, "q", [], ["m"], "【1】"), (103, "q", None, None, None)]
    traces = spark.createDataFrame(rows, "query_id long, query string, context array<string>, merged array<string>, response string")
    train, test = curation.mined(traces, test=0.3)
    by = {}
    for r in train.collect():
        by.setdefault(r.query_id, {})[r.label] = r.content
    lists = {r.query_id: r.contents for r in test.collect()}
    assert not by.keys() & lists.keys() and 5 < len(lists) < 25
    for i in range(60):
        if i % 3:
            found = by.get(i) or dict(zip((2, 1, 0), lists[i], strict=True))
            assert found[2] == "a" and found[1] in ("b", "c") and found[0] == "n"
        elif i in by:
            assert list(by[i]) == [0] and by[i][0] in "abcn"
    assert 100 not in by and by.get(101, {2: "a"}) == {2: "a"} and lists.get(101, ["a"]) == ["a"] and 102 not in by and 103 not in by
