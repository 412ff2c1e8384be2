import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from talkgrain.llm import mixing as M

DOCS = "doc_id long, text string, lang string, source string, tokens string"
TARGETS = "source string, target_share double, max_repeats int"


def mixed(spark, docs, targets, **kw):
    return M.mixture(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), domains={}, **kw).collect()


def test_shares_and_repeats(spark):
    docs = [(i, f"word number {i} of the text " * (1 + i % 4), "en" if i % 3 else None, "big" if i < 300 else "small" if i < 310 else None, "clash") for i in range(320)]
    rows = mixed(spark, docs, [("big", 0.9, 1), ("small", 0.1, 3), ("absent", 0.0, 5)], total=2500)
    total = sum(r["tokens"] * r["copies"] for r in rows)
    by = {s: sum(r["tokens"] * r["copies"] for r in rows if r["source"] == s) for s in ("big", "small")}
    assert abs(total - 2500) < 120 and abs(by["small"] / total - 0.1) < 0.03
    assert max(r["copies"] for r in rows if r["source"] == "big") == 1 and max(r["copies"] for r in rows) <= 3
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} == {"big", "small"}
    again = mixed(spark, docs, [("big", 0.9, 1), ("small", 0.1, 3), ("absent", 0.0, 5)], total=2500)
    assert sorted(rows) == sorted(again)
    other = mixed(spark, docs, [("big", 0.9, 1), ("small", 0.1, 3)], total=2500, seed=8)
    assert sorted(rows) != sorted(other)


def test_cap_and_absent(spark):
    docs = [(1, "one two three", "en", "a", ""), (2, "one two three", "en", "b", ""), (3, None, "en", "a", ""), (4, "", "en", "b", "")]
    targets = [("a", 0.5, 2), ("b", 0.3, 1), ("gone", 0.2, 9)]
    rows = mixed(spark, docs, targets, total=10**9)
    assert {(r["doc_id"], r["copies"]) for r in rows if r["tokens"]} == {(1, 2), (2, 1)}
    df = M.shares(M.mixture(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), total=10**9), spark.createDataFrame(targets, TARGETS))
    shares = {r["source"]: r["actual_share"] for r in df.collect()}
    assert shares["gone"] == 0 and shares["a"] == pytest.approx(2 / 3) and shares["b"] == pytest.approx(1 / 3)
    assert mixed(spark, [], targets) == [] and mixed(spark, docs, []) == []


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("AB"), st.sampled_from("xyz"), st.sampled_from("pqr")), st.tuples(st.floats(0.01, 1), st.floats(0, 100)), min_size=1), st.floats(0, 500))
def test_spread(leaves, budget):
    root = M.tree(leaves)
    left = M.spread(root, budget)
    given_ = {p: n.budget for p, n in M._leaves(root)}
    assert all(given_[p] <= cap + 1e-4 for p, (_, cap) in leaves.items())
    assert sum(given_.values()) == pytest.approx(budget - left, abs=1e-3)
    assert left < 1e-3 or root.capacity <= budget


def test_siblings_before_ancestors():
    root = M.tree({("A", "x", "p"): (1.0, 10.0), ("A", "x", "q"): (1.0, 1000.0), ("B", "x", "r"): (2.0, 1000.0)})
    M.spread(root, 400)
    got = {p[-1]: round(n.budget) for p, n in M._leaves(root)}
    assert got == {"p": 10, "q": 190, "r": 200}


PREFIXES = """
WITH w AS (SELECT source, sum(tokens) AS whole FROM sizes GROUP BY source),
l AS (SELECT language, source, sum(tokens) AS n, any_value(target_share) * sum(tokens) / any_value(whole) AS weight FROM sizes JOIN w USING (source) JOIN targets USING (source) GROUP BY ALL),
b AS (SELECT *, {total} * weight / sum(weight) OVER () AS budget FROM l),
e AS (SELECT *, floor(budget / n) AS epochs, budget - floor(budget / n) * n AS rest FROM b),
o AS (SELECT doc_id, source, language, s.tokens, epochs, rest, sum(s.tokens) OVER (PARTITION BY source, language ORDER BY h >= 0 DESC, h, doc_id) - s.tokens / 2 AS spot FROM sizes s JOIN e USING (source, language))
SELECT doc_id, source, language, tokens, CAST(epochs + (spot < rest)::INT AS INT) AS copies FROM o WHERE epochs + (spot < rest)::INT > 0"""


@pytest.mark.parametrize("total", [700, 5000, 20000])
def test_prefixes_against_sql(spark, total):
    """With capacity for all, budgets, epochs and prefixes are those that SQL finds from the sizes alone."""
    import duckdb
    from pyspark.sql import functions as F

    docs = [(i, "word " * (1 + i * 7 % 23), ("en", "de", None)[i % 3], ("a", "b", "c")[i * i % 3], "") for i in range(400)]
    targets = [("a", 0.5, 99), ("b", 0.3, 99), ("c", 0.2, 99)]
    df, goal = spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)
    got = M.mixture(df, goal, total=total)
    sizes = M.token_counts(df.withColumn("language", F.coalesce("lang", F.lit("none"))), "doc_id", "text", ["source", "language"])
    con = duckdb.connect()
    con.register("targets", goal.toArrow())
    con.register("sizes", sizes.withColumn("h", F.lit(0).cast("bigint")).toArrow())
    epochs = {(r[0], r[1]): int(r[2]) for r in con.sql(PREFIXES.split("o AS")[0].rstrip().rstrip(",").format(total=total) + " SELECT language, source, epochs FROM e").fetchall()}
    per = spark.createDataFrame([(*k, v) for k, v in epochs.items()], "language string, source string, epochs int")
    con.register("sizes", sizes.join(per, ["language", "source"]).withColumn("h", F.xxhash64(F.lit(7), "epochs", "doc_id")).drop("epochs").toArrow())
    # unsigned order of the hash is the order of buckets; within one bucket the signed order is the same
    want = con.sql(PREFIXES.format(total=total)).fetchall()
    assert sorted((r["doc_id"], r["source"], r["language"], r["tokens"], r["copies"]) for r in got.collect()) == sorted(map(tuple, want))


def test_domains_of_targets(spark):
    docs = [(i, "word " * 50, "en", s, "") for i, s in enumerate("aabbbbcccc")]
    rows = [("a", 0.4, 1, "x"), ("b", 0.1, 9, "x"), ("c", 0.5, 9, "y")]
    goal = spark.createDataFrame(rows, TARGETS + ", domain string")
    df = spark.createDataFrame(docs, DOCS)
    share = lambda t: {r["source"]: r["actual_share"] for r in M.shares(M.mixture(df, t, total=500), t).collect()}
    assert share(goal) == pytest.approx({"a": 0.2, "b": 0.3, "c": 0.5}, abs=0.06)
    alone = share(goal.drop("domain"))
    assert alone["a"] == pytest.approx(0.2, abs=0.02) and alone["c"] > 0.6


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in M.token_counts(df, "doc_id", "text", []).collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[4] > 1
