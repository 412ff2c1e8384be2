"""The search language: trees, and compiled conditions against an evaluator of sets."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkgrain.operators.search import highlight, indexed, page, query_words, search, totals
from talkgrain.plans.compiling import period, words_of
from talkgrain.plans.language import And, Every, Not, Nothing, Or, Phrase, Range, Term, Wildcard, parse


def t(w):
    return Term("content", w)


@pytest.mark.parametrize("query,tree", [
    ("foo", t("foo")),
    ("foo bar", And((t("foo"), t("bar")))),
    ("foo AND bar", And((t("foo"), t("bar")))),
    ("foo OR bar baz", Or((t("foo"), And((t("bar"), t("baz")))))),
    ("NOT foo AND (bar OR woo)", And((Not(t("foo")), Or((t("bar"), t("woo")))))),
    ("NOT foo", Not(t("foo"))),
    ('"foo bar"', Phrase("content", "foo bar")),
    ('"foo bar"~2', Phrase("content", "foo bar", 2)),
    ("sea*", Wildcard("content", "sea*")),
    ("sea?ch", Wildcard("content", "sea?ch")),
    ("sender:alice", Term("sender", "alice")),
    ("post_time:[20240101 TO 20240131]", Range("post_time", "20240101", "20240131")),
    ("post_time:{20240101 TO}", Range("post_time", "20240101", None, False, False)),
    ("chat_id:(1 OR 2)", Or((Term("chat_id", "1"), Term("chat_id", "2")))),
    ("foo^2.5", t("foo")),
    ("*:*", Every("")),
    ("sender:*", Every("sender")),
    ("a ANDNOT b", And((t("a"), Not(t("b"))))),
    ("a ANDMAYBE b", t("a")),
    ("a REQUIRE b", And((t("a"), t("b")))),
    ("'Foo bar'", Term("content", "Foo bar", True)),
    ("and or not", And((t("and"), t("or"), t("not")))),
    ("http://x", t("http://x")),
    ("", Nothing()), ("   ", Nothing()), ("()", Nothing()), ("AND", Nothing()), ("NOT", Nothing()),
    ("(foo", t("foo")), ("foo)", t("foo")), ('"foo', Phrase("content", "foo")), ("foo OR", t("foo")), (")(", Nothing()),
])
def test_trees(query, tree):
    assert parse(query) == tree


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab AND OR NOT()"*?~^[]{}TO:\'搜', max_size=30))
def test_never_fails(query):
    parse(query)


def test_periods():
    assert [str(x) for x in period("2024")] == ["2024-01-01 00:00:00", "2025-01-01 00:00:00"]
    assert [str(x) for x in period("202412")] == ["2024-12-01 00:00:00", "2025-01-01 00:00:00"]
    assert [str(x) for x in period("2024-02-29")] == ["2024-02-29 00:00:00", "2024-03-01 00:00:00"]
    assert period("20241350") is None and period("x") is None


WORDS = ["aa", "bb", "cc", "搜索", "dd"]
DOCS = [f"{a} {b} {c}" for a in WORDS for b in WORDS for c in ("aa", "bb", "")] + ["", "!!"]


def holds(node, words):
    if isinstance(node, And):
        return all(holds(x, words) for x in node.parts)
    if isinstance(node, Or):
        return any(holds(x, words) for x in node.parts)
    if isinstance(node, Not):
        return not holds(node.part, words)
    if isinstance(node, Nothing):
        return False
    own = words_of(node.text)
    if isinstance(node, Phrase):
        return bool(own) and any(words[i : i + len(own)] == own for i in range(len(words)))
    return bool(own) and all(w in words for w in own)


leaf = st.sampled_from([*WORDS, '"aa bb"', '"搜索 aa"', "!!"])
queries = st.recursive(leaf, lambda q: st.one_of(st.tuples(q, st.sampled_from([" ", " AND ", " OR "]), q).map(lambda x: f"({x[0]}{x[1]}{x[2]})"), q.map(lambda x: f"NOT {x}")), max_leaves=6)


@pytest.fixture(scope="module")
def index(spark):
    rows = [(1 + i % 3, i, f"u{i}", "", d, None) for i, d in enumerate(DOCS)]
    return indexed(spark.createDataFrame(rows, "chat_id long, msg_id long, url string, sender string, content string, post_time timestamp_ntz")).cache()


@settings(max_examples=25, deadline=None)
@given(queries)
def test_compiled(index, query):
    tree = parse(query)
    got = {r["msg_id"] for r in search(index, query).select("msg_id").collect()}
    assert got == {i for i, d in enumerate(DOCS) if holds(tree, words_of(d))}


def test_pages(index):
    hits = search(index, "aa")
    n = hits.count()
    seen = [r["msg_id"] for k in range(1, -(-n // 10) + 1) for r in page(hits, k).collect()]
    assert len(seen) == n == len(set(seen))
    assert [r["msg_id"] for r in page(hits, 99).collect()] == seen[-(n % 10 or 10):]
    assert page(search(index, "nowhere")).collect() == []
    r = totals(search(index, "nowhere")).first()
    assert tuple(r) == (0, 0, False, False)
    assert search(index, "aa", []).count() == n and search(index, "aa", [1]).count() < n


def test_highlight(spark):
    df = spark.createDataFrame([("Été, foo & FOO!",), ("搜索hello<b>",), (None,)], "s string")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(highlight(F.col("s"), query_words("foo OR 搜索 NOT hello"))).collect()]
    assert got == ["Été, <b>foo</b> &amp; <b>FOO</b>!", "<b>搜索</b>hello&lt;b&gt;", None]
