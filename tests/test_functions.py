"""Column functions on the cases that their definitions name."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import overlap as V
from tidewell.functions import text as X
from tidewell.operators import chunks, metrics


def value(spark, column, **row):
    names = list(row)
    kinds = {str: "string", float: "double", int: "long", type(None): "string"}
    schema = ", ".join(f"{n} {'array<string>' if isinstance(row[n], list) else kinds[type(row[n])]}" for n in names)
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "cites"), [("a【1】", [1]), ("【1, 2】", [1, 2]), ("【1】【2】", [1, 2]), ("【1，2，3】", [1, 2, 3]), ("【1,2,3】", [1, 2, 3]), ("【1, 2】【3】", [1, 2, 3]), ("none", []), ("", []), ("【abc】", []), ("【1】【abc】【2】", [1, 2]), ("【2】【1】【2】", [2, 1])])
def test_citations(spark, text, cites):
    assert value(spark, X.citations(F.col("t")), t=text) == cites


@pytest.mark.parametrize(("text", "cites"), [("【1, 2】【3】", [1, 2]), ("【x】【4】", [4]), ("【1，2】", []), ("", [])])
def test_strict_citations(spark, text, cites):
    assert value(spark, X.strict_citations(F.col("t")), t=text) == cites


@pytest.mark.parametrize(("text", "out"), [("answer【1】 {", "answer"), ("　a 【1,2】b\n", "a b"), ("【】", "")])
def test_strip_citations(spark, text, out):
    assert value(spark, X.strip_citations(F.col("t")), t=text) == out


@pytest.mark.parametrize(("text", "out"), [("<think>a\nb</think>yes", "yes"), ("答案内容： yes\n\n\nmore", "yes\nmore"), ("【1】, 【2】", X.NO_ANSWER), ("", X.NO_ANSWER), ("{答案}it", "it"), ("{从资料}it", "it"), ("<THINK>x</THINK>\n it ", "it")])
def test_clean_response(spark, text, out):
    assert value(spark, X.clean_response(F.col("t")), t=text) == out


@pytest.mark.parametrize(("text", "n"), [('[{"question":"q","answer":"a"},{"question":"r","answer":"b"}]', 2), ('Here: [{"question":"q","answer":"a"}] done', 1), ("not json", 0), ("[]", 0), ('{"question":"q","answer":"a"}', 0), ('```json\n[{"question":"q","answer":"a"}]\n```', 1), ('[{"question":"q"},{"question":"q","answer":"a"}, 3]', 1)])
def test_qa_pairs(spark, text, n):
    assert len(value(spark, X.qa_pairs(F.col("t")), t=text)) == n


def test_lists(spark):
    assert value(spark, X.numbered_list(F.col("t")), t="1. 问题1\n2. 问题2\n3) 问题3\n4 问题4") == ["问题1", "问题2", "问题3", "问题4"]
    assert value(spark, X.numbered_list(F.col("t")), t="1. a\n\n2. b\n \n3. c") == ["a", "b", "c"]
    assert value(spark, X.numbered_list(F.col("t")), t="3、问题3") == ["3、问题3"]
    assert value(spark, X.keyword_list(F.col("t")), t=" a ,无, Model 3,b,,") == ["a", "b"]


@pytest.mark.parametrize(("text", "score"), [('{"score": 4}', 4), ('so {"score": "3", "reason": "x"} it is', 3), ("none", None), ('{"score": "high"}', None)])
def test_quality_score(spark, text, score):
    assert value(spark, X.quality_score(F.col("t")), t=text) == score


def test_contexts_split_back(spark):
    assert value(spark, X.numbered_context(F.col("t")), t=["a", "b"]) == "【1】a\n【2】b"
    assert value(spark, X.split_context(F.col("t")), t="【1】a\n【2】b") == ["a", "b"]
    assert value(spark, X.split_context(F.col("t")), t="whole") == ["whole"]
    assert value(spark, X.training_context(F.col("t"), 5), t=["aaaa", "b"]) == "1.aaa"


def test_pieces(spark):
    assert value(spark, X.header_pieces(F.col("t")), t="intro###a###  ###b") == ["intro", "###a", "###b"]
    assert value(spark, X.header_pieces(F.col("t")), t="###a") == ["###a"]
    assert value(spark, X.header_pieces(F.col("t")), t="plain") == ["plain"]
    assert value(spark, X.paragraphs(F.col("t")), t="a\n\n\n\nb") == ["a", "", "b"]
    assert value(spark, chunks.absorb_small(F.col("t"), 3), t=["a", "bbb", "c", "d", "eee"]) == ["a", "bbbcd", "eee"]


def test_estimates(spark):
    assert value(spark, X.token_estimate(F.col("t")), t="汉字abcd") == 4
    assert value(spark, X.cjk_ratio(F.col("t")), t="") == 0.0
    assert value(spark, X.switched_tokens(F.col("t")), t="汉字 ab") == ["汉", "字", "a", "b"]
    assert value(spark, X.switched_tokens(F.col("t")), t="One two") == ["one", "two"]
    assert [value(spark, X.duration(F.col("t")), t=t) for t in (5.0, 90.0, 7200.0)] == ["5.00s", "1.50m", "2.00h"]


def test_overlaps(spark):
    a, b = ["x", "x", "y"], ["x", "x", "x", "z"]
    assert value(spark, V.common_counted(F.col("a"), F.col("b")), a=a, b=b) == 2
    assert value(spark, V.common(F.col("a"), F.col("b")), a=a, b=b) == 1
    assert value(spark, metrics.unigram_precision(F.col("a"), F.col("b")), a=a, b=b) == 0.5
    assert value(spark, metrics.ngram_recall(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(2 / 3)
    assert value(spark, metrics.ngram_recall(F.col("a"), F.col("b"), 2), a=["x"], b=b) == 0.0
    assert value(spark, metrics.keyword_hit(F.col("a"), F.col("b")), a=["ab", "q", "q"], b="zabz") == 1.0
    assert value(spark, metrics.keyword_hit(F.col("a"), F.col("b")), a=[], b="zabz") is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert metrics.lcs_length(a, b) == best[-1][-1]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(3, 20))
def test_recursive_split_loses_no_word(text, size):
    parts = chunks.recursive_split(text, size, 2)
    assert {w for p in parts for w in p.split()} == set(text.split())
    assert all(len(p) <= size or "\n" not in p for p in parts)


def test_semantic_groups():
    text = "\n".join(["cats purr at night and sleep all day long in warm places"] * 3 + ["stocks fell sharply as markets closed lower on friday evening"] * 3)
    assert len(chunks.semantic_groups(text, 3)) == 2
    assert chunks.semantic_groups("short", 3) == ["short"]
    assert chunks.semantic_groups("x" * 60 + "###a###b", 1) == ["x" * 60, "###a", "###b"]
    with pytest.raises(ValueError):
        chunks.semantic_groups("a", 0)


def _plain_linkage(vectors, clusters):
    found = [[i] for i in range(len(vectors))]
    apart = lambda a, b: np.mean([1 - vectors[i] @ vectors[j] for i in a for j in b])
    while len(found) > clusters:
        i, j = min(((i, j) for i in range(len(found)) for j in range(i + 1, len(found))), key=lambda p: apart(found[p[0]], found[p[1]]))
        found[i] += found.pop(j)
    return sorted(sorted(x) for x in found)


def test_average_linkage_against_all_pairs():
    rng = np.random.default_rng(5)
    for n, clusters in ((1, 1), (2, 1), (7, 3), (25, 5), (40, 8), (40, 40), (3, 9)):
        v = rng.normal(size=(n, 6))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        label = chunks.average_linkage(v, clusters)
        assert sorted(np.flatnonzero(label == k).tolist() for k in range(label.max() + 1)) == _plain_linkage(v, clusters)
    same = chunks.average_linkage(np.array([[1.0, 0.0], [0.0, 1.0]] * 300), 2)  # ties
    assert same.tolist() == [0, 1] * 300


def test_semantic_groups_of_long_texts():
    lines = ["same far apart words", *(f"alpha{i} beta{i} gamma{i} delta{i} rho{i}" for i in range(900)), "same far apart words"]
    groups = chunks.semantic_groups("\n".join(lines), 2)
    assert any(g.count("same far apart words") == 2 for g in groups)
    assert sum(g.count("alpha") for g in groups) == 900
