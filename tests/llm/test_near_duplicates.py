import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkgrain.llm import near_duplicates as nd
from talkgrain.llm.units import shingle_sets, units

SCHEMA = "row_id long, url string, content string, id string, text string"


def sets(texts, width):
    out = []
    for t in texts:
        u = units(t or "")
        out.append({tuple(u[i : i + width]) for i in range(len(u) - width + 1)})
    return out


def brute(rows, p):
    s = dict(zip([r[0] for r in rows], sets([r[2] for r in rows], p.width)))
    url = {r[0]: r[1] for r in rows}
    ids = sorted(i for i, x in s.items() if len(x) >= p.least)
    return {(a, b) for a in ids for b in ids if a < b and (url[a] is None or url[a] != url[b]) and len(s[a] & s[b]) >= p.similarity * len(s[a] | s[b]) - 1e-12}


def collection(seed, n=60, length=40, words=12):
    """Texts of few different words, many made from one another by small edits, so that most tokens are frequent."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.7:
            t = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(words)}"
            texts.append(" ".join(t))
        else:
            texts.append(" ".join(f"w{rng.randrange(words)}" for _ in range(rng.randint(length // 2, length))))
    return texts


@pytest.mark.parametrize("seed,p", [
    (1, nd.Params(width=3, similarity=0.7, least=5, cells=1 << 12)),
    (2, nd.Params(width=2, similarity=0.8, least=1, cells=1 << 12, pair_df=2, parts=2)),
    (3, nd.Params(width=1, similarity=0.7, least=1, cells=1 << 12, pair_df=2, triple_df=8, parts=2)),
    (4, nd.Params(width=3, similarity=0.7, least=5, cells=64)),
    (5, nd.Params(width=2, similarity=0.75, least=5, cells=1 << 12, pair_df=2, large=12)),
    (6, nd.Params(width=1, similarity=0.7, least=1, cells=1 << 12, pair_df=2, triple_df=8, parts=2, group=4)),
    (7, nd.Params(width=2, similarity=0.7, least=1, cells=64, group=3)),
])
def test_against_brute_force(spark, seed, p):
    rows = [(i, f"https://h/c/1/{i // 2}" if i % 7 else None, t, "clash", "clash") for i, t in enumerate(collection(seed))]
    got = nd.message_pairs(spark.createDataFrame(rows, SCHEMA), p).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows, p)


@pytest.mark.parametrize("seed,p", [
    (1, nd.Params()),
    (2, nd.Params(pair_df=4, triple_df=16)),
    (3, nd.Params(similarity=0.7, pair_df=4, triple_df=16)),
    (4, nd.Params(similarity=0.7, pair_df=4, triple_df=16, large=12)),
    (5, nd.Params(similarity=0.5, pair_df=4, triple_df=16, large=16)),
])
def test_short_records_of_frequent_tokens(spark, seed, p):
    rng = random.Random(seed)
    rows = []
    for g in range(20):
        greeting = [f"g{g}x{i}" for i in range(rng.randint(7, 24))]
        for i in range(22):
            more = [f"m{g}x{i}x{k}" for k in range(rng.randint(1, 2))]
            rows.append((len(rows), None, " ".join(greeting + more if i % 2 else more + greeting), "", ""))
        rows.append((len(rows), None, " ".join(greeting), "", ""))
    assert {tuple(r) for r in nd.message_pairs(spark.createDataFrame(rows, SCHEMA), p).collect()} == brute(rows, p)


def test_classes_in_parts(spark):
    texts = collection(8, n=40)
    rows = [(i, f"https://h/c/1/{i // 2}", texts[0] if i % 3 else texts[i // 3], "", "") for i in range(90)]
    p = nd.Params(width=2, similarity=0.7, least=1, cells=1 << 12)
    got = nd.row_pairs(nd.message_links(spark.createDataFrame(rows, SCHEMA), p), ["share", "msg"], part=7).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute(rows, p)


@pytest.mark.parametrize("load", [0.1, 4, 400])
def test_signatures_stay_flat_in_a_loaded_table(load):
    """A set of tokens that hardly any other has gets about as many signatures in a full table as in an empty one."""
    rng = np.random.default_rng(3)
    p = nd.Params(width=3, similarity=0.7, least=50, cells=1 << 12)
    table = nd._code(rng.poisson(load, p.cells) + 1)
    pair, triple = nd.thresholds(table, p)
    for n in (60, 200, 500, 1400):
        tok = rng.integers(0, 1 << 48, n, dtype=np.uint64)
        code = table[(tok % np.uint64(p.cells)).astype(np.int64)]
        order = np.argsort(code, kind="stable")
        need = n - int(np.ceil(0.7 * n)) + 1
        assert len(nd._signatures(tok[order], code[order], need, p.parts, pair, triple)[0]) <= 1.05 * need


def test_edge_cases(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, "https://h/c/1/1", None, "", ""), (2, "https://h/c/1/2", "", "", ""), (3, "https://h/c/1/3", "too short", "", ""), (4, "https://h/c/1/4", long, "", ""), (5, "https://h/c/1/5", long + " more", "", ""), (None, "https://h/c/1/6", long, "", ""),
            (7, "https://h/c/2/1", "one two three four five six seven", "", ""), (8, "https://h/c/2/1", "One, two; three FOUR five six seven!", "", ""), (9, None, "one two three four five six seven", "", ""), (9, None, "one two three four five six seven", "", "")]
    p = nd.Params(width=3, similarity=0.7, least=3, cells=1 << 12, large=64)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, nd.message_pairs(df, p).collect())) == [(4, 5), (7, 9), (8, 9)]
    classes = {r["id"]: (r["class_id"], r["class_size"], r["links"]) for r in nd.classes(nd.link(df, "row_id", "content", p)).collect()}
    assert classes == {4: (4, 1, 1), 5: (5, 1, 1), 7: (7, 3, 2), 8: (7, 3, 2), 9: (7, 3, 2)}
    assert nd.message_pairs(df.limit(0), p).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBé_1 .搜索引İß\n", max_size=40), max_size=12), st.integers(1, 4))
def test_shingles(texts, width):
    tok, at = shingle_sets(texts, width)
    for t, lo, hi, want in zip(texts, at, at[1:], sets(texts, width)):
        assert hi - lo == len(want) and len(np.unique(tok[lo:hi])) == hi - lo
