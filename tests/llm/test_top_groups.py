import random

import pytest
from pyspark.sql import functions as F

from talkgrain.llm.top_groups import newest_messages, top_n


@pytest.mark.parametrize("seed,shares", [(1, (0.02, 0.1, 0.35)), (2, (0.5,)), (3, (0.3, 0.3, 0.9))])
def test_against_sorting(spark, seed, shares):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 1, 1, 2, rng.randrange(3, 40)]), rng.choice([None, *range(6), float(i % 9)]), i, "x") for i in range(600)]
    rows = [(g, None if s is None else float(s), i, x) for g, s, i, x in rows]
    df = spark.createDataFrame(rows, "g long, s double, i long, _g string")
    df = df.withColumnRenamed("_g", "rest")
    got = {tuple(r) for r in top_n(df, "g", "s", [F.col("i")], 4, shares).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (-r[1], r[2]))
        want |= set(own[:4])
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "g long, s double, i long")
    assert top_n(df, "g", "s", [F.col("i")], 3).collect() == []
    one = spark.createDataFrame([(1, None, 1)], "g long, s double, i long")
    assert top_n(one, "g", "s", [F.col("i")], 3).collect() == []


def test_messages(messages):
    rows = messages.limit(0)
    assert newest_messages(rows).collect() == []
