"""Scalar functions against the Python they stand for."""

import html

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkgrain.functions import analyze, ids, text
from talkgrain.plans.compiling import words_of

CASES = ["　 a&b  \x1c", " \t\n", " ", "", None, "a & b < c > \"d\" 'e'", "&amp;", "line1\nline2", "x" * 19, "x" * 20, "😀" * 25, "搜索" * 12, "我喜欢搜索hello World", "搜索引擎", "搜", "Été foo_1 a"]


def evaluate(spark, values, *cols, kind="string"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, s {kind}").select("i", *cols).orderBy("i").collect()


def brief(s):
    return s if len(s) < 20 else s[:16] + "…" + s[-2:]


def test_fixed_cases(spark):
    s = F.col("s")
    rows = evaluate(spark, CASES, text.strip(s).alias("strip"), text.escape(s).alias("escape"), text.extract_text(s).alias("text"), text.brief(s).alias("brief"), analyze.tokens(s).alias("tokens"), text.unescape(text.escape(s)).alias("back"))
    for c, r in zip(CASES, rows):
        assert r["strip"] == (None if c is None else c.strip())
        assert r["escape"] == (None if c is None else html.escape(c))
        assert r["text"] == html.escape((c or "").strip()).replace("\n", " ")
        assert r["brief"] == (None if c is None else brief(c))
        assert r["back"] == c
        assert r["tokens"] == (None if c is None else words_of(c))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=30))
def test_any_text(spark, values):
    s = F.col("s")
    rows = evaluate(spark, values, text.strip(s).alias("strip"), text.escape(s).alias("escape"), text.brief(s).alias("brief"))
    for v, r in zip(values, rows):
        assert (r["strip"], r["escape"], r["brief"]) == (v.strip(), html.escape(v), brief(v))


def test_share_ids(spark):
    rows = evaluate(spark, [123, -456, -1001234567890, 0, None], ids.share_id(F.col("s")).alias("x"), kind="long")
    assert [r["x"] for r in rows] == [123, 456, 1234567890, 0, None]


@pytest.mark.parametrize("url", ["https://chat.example/c/7/9", " HTTPS://CHAT.EXAMPLE/c/7/9?single", "http://chat.example/C/7/9/#"])
def test_url_parts(spark, url):
    r = evaluate(spark, [url], ids.url_share(F.col("s")).alias("a"), ids.url_msg(F.col("s")).alias("b"))[0]
    assert (r["a"], r["b"]) == (7, 9)


def test_url_without_parts(spark):
    rows = evaluate(spark, [None, "", "x", "https://h/c/99999999999999999999999/1"], ids.url_share(F.col("s")).alias("a"))
    assert [r["a"] for r in rows] == [None] * 4


def test_commands_and_lists(spark):
    rows = evaluate(spark, ["/search a b", "@bot", "plain text", ""], text.strip_command(F.col("s")).alias("x"))
    assert [r["x"] for r in rows] == ["a b", "", "plain text", ""]
    rows = evaluate(spark, ["1,-2", "", "x,3"], text.csv_to_ids(F.col("s")).alias("x"))
    assert [r["x"] for r in rows] == [[1, -2], [], [None, 3]]


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("generalization", "gener"), ("adjustment", "adjust"), ("controlling", "control"), ("rate", "rate"), ("搜索", "搜索")])
def test_stems(word, want):
    assert analyze.stem(word) == want


def test_stemmed_profile(spark):
    df = spark.createDataFrame([(1, ["running", "flies"]), (2, []), (3, None)], "i int, tokens array<string>").repartition(1)
    assert {r["i"]: r["tokens"] for r in analyze.stemmed(df).collect()} == {1: ["run", "fli"], 2: [], 3: None}
