import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkgrain.llm import leaks as K
from talkgrain.llm.units import units

WORDS = [f"w{i}" for i in range(60)] + list("搜索引擎很好用")


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(i, text(rng, 40), "x") for i in range(12)] + [(50, None, "x"), (51, "", "x"), (52, "搜 索引擎很好用搜索引擎很好", "x"), (53, "a b c d e f g h i j k l", "x")]
    docs = []
    for i in range(60):
        t = text(rng, 60).split()
        if i % 2:
            u = rng.choice(items[:12])[1].split()
            n, lo = rng.choice([10, 11, 12, 13, 30]), rng.randrange(5)
            t[10:10] = u[lo : lo + n]
        docs.append((i, ", ".join(t), "clash"))
    docs += [(100, None, "x"), (101, "", "x"), (102, "搜索引擎很好用搜索引擎很好用", "x"), (103, "x A-B.C d e f g h i j k l y", "x"), (104, text(rng, 50_000) + " " + items[3][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    e = spark.createDataFrame(items, "item_id long, text string, doc_id string")

    def runs(t):
        u = units(t or "")
        return {tuple(u[k : k + 12]) for k in range(len(u) - 11)}

    want = {(a, b) for a, t in ((x[0], runs(x[1])) for x in docs) for b, s in ((x[0], runs(x[1])) for x in items) if t & s}
    assert {tuple(r) for r in K.found(d, e).collect()} == want
    assert {(102, 52), (103, 53), (104, 3)} <= want
    small = K.Params(block=400)  # items in many blocks
    assert {tuple(r) for r in K.found(d, e, small).collect()} == want
    assert K.found(d, e.limit(0)).collect() == [] == K.found(d.limit(0), e).collect()


def test_edited_passage(spark):
    rng = random.Random(5)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40))
    edited = item[:70] + "Q" + item[71:150] + item[152:]
    d = spark.createDataFrame([(1, "before it " + edited + " and after"), (2, "nothing of it")], "doc_id long, text string")
    rows = K.leaks(d, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert rows and {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 9)} and max(r["edits"] for r in rows) >= 1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", max_size=12), st.text(alphabet="ab", max_size=12), st.integers(0, 6))
def test_banded_distance(a, b, most):
    x, y = (np.array([ord(c) for c in s], dtype=np.uint32) for s in (a, b))
    assert K.banded_distance(x, y, most) == min(edit_distance(a, b), most + 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1_ .搜索\n", max_size=20), min_size=1, max_size=8))
def test_canonical(texts):
    chars, at = K.canonical(texts)
    for t, lo, hi in zip(texts, at, at[1:]):
        got = "".join(map(chr, chars[lo:hi])).replace("\n", "")
        assert got == " ".join(units(t))


def damaged(rng, passage, gap):
    """The passage with its first 120 characters edited once and one letter of each `gap` changed in the rest."""
    t = list(passage)
    for k in [60, *range(120, len(t), gap)]:
        t[k] = "Q"
    return "".join(t)


@pytest.mark.parametrize("gap", [20, 29])
def test_good_part_of_a_damaged_passage(spark, gap):
    rng = random.Random(gap)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(27))
    d = spark.createDataFrame([(1, "before it " + damaged(rng, item, gap) + " and after")], "doc_id long, text string")
    rows = K.leaks(d, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r["item_start"] <= 2, r["item_end"] >= 120, r["edits"] >= 1) for r in rows] == [(True, True, True)]
    assert all(r["edits"] <= (r["item_end"] - r["item_start"]) // 60 for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_regions_against_all_pairs_of_runs(seed):
    """Every part that begins and ends with 16 equal characters and is within budget lies in a region that is found."""
    rng = random.Random(seed)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    t = list(item)
    for k in sorted(rng.sample(range(len(t)), 9), reverse=True):
        t[k : k + 1] = rng.choice([[], ["q"], [t[k], "q"]])
    text = "".join(t)
    p = K.Params()
    got = K._matches(np.array([1]), [text], K.Index([9], [item], p), p)
    a, b = ("".join(map(chr, K.canonical([x])[0])) for x in (text, item))
    begins = {(x, y) for x in range(a.rfind("\n") + 1, len(a) - 15) for y in [b.find(a[x : x + 16])] if y > 0}
    ends = {(x + 16, y + 16) for x, y in begins}
    begins = {s for s in begins if (s[0] - 1, s[1] - 1) not in begins}
    ends = {s for s in ends if (s[0] + 1, s[1] + 1) not in ends}
    for x, y in begins:
        for u, v in ends:
            n = min(u - x, v - y)
            if n >= 60 and a[x:u].count(" ") >= 11 and edit_distance(a[x:u], b[y:v]) <= n // 60:
                assert any(r[2] <= x and u <= r[3] and r[4] <= y and v <= r[5] for r in got), (x, u, y, v)
    for r in got:
        assert edit_distance(a[r[2] : r[3]], b[r[4] : r[5]]) == r[6] <= max(0, min(r[3] - r[2], r[5] - r[4]) // 60)


@pytest.mark.parametrize("words", [40, 80, 160, 400])
def test_planted_passages_come_out_whole(words):
    """Items planted with as many random edits as they allow are covered to nine tenths, in nine of ten cases at least."""
    rng, p, covered = random.Random(words), K.Params(), 0
    for case in range(40):
        item = " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(words))
        t = list(item)
        for k in rng.sample(range(len(t)), len(t) // 60):
            t[k] = rng.choice(["", "q", t[k] + "q"])
        got = K._matches(np.array([1]), ["some words before " + "".join(t) + " and some behind"], K.Index([9], [item], p), p)
        covered += bool(got) and max(r[5] - r[4] for r in got) >= 0.9 * len(item)
    assert covered >= 36


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 搜", max_size=60), st.sampled_from([4, 16]))
def test_qgrams(text, q):
    chars = np.array([ord(c) for c in text], np.uint32)
    h = K.qgrams(chars, q)
    grams = [text[i : i + q] for i in range(len(text) - q + 1)]
    assert len(h) == len(grams) and len(set(zip(h.tolist(), grams))) == len(set(grams)) == len(set(h.tolist()))


def test_qgrams_of_long_texts():
    rng = np.random.default_rng(1)
    part = rng.integers(97, 123, 5000).astype(np.uint32)
    h = K.qgrams(np.tile(part, 300), 16)
    assert len(h) == 1_500_000 - 15 and np.array_equal(h[: 5000 * 299 - 15][:5000], h[5000 * 298 : 5000 * 299])
