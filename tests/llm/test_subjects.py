import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrain.llm import subjects as S

TERMS = {"sport": ["goal", "referee", "match", "league"], "food": ["soup", "oven", "noodle", "spice"], "law": ["judge", "contract", "appeal", "verdict"]}
P = S.Params(sure=2.0)


def document(rng, mix, n=12):
    out = []
    for _ in range(n):
        s = rng.choice(mix)
        if s is None:
            out.append("good morning to everyone here today.")
        else:
            a, b = rng.sample(TERMS[s], 2)
            out.append(f"we saw the {a} and then the {b} again.")
    return " ".join(out)


@pytest.mark.parametrize("p", [P, S.Params(sure=2.0, sent=0)])
def test_propagation(spark, p):
    rng = random.Random(3)
    mixes = [[s] for s in TERMS] * 20 + [["sport", "food"]] * 10 + [[None]] * 10 + [["law", None]] * 10
    docs = [(i, document(rng, m), "clash") for i, m in enumerate(mixes)] + [(900, None, ""), (901, "", ""), (902, "!!", "")]
    labels = [(i, s) for i, m in enumerate(mixes[:12]) for s in m] + [(60, "sport"), (60, "food"), (60, "food"), (5555, "law"), (1, "no such subject")]
    rows = S.subjects(spark.createDataFrame(docs, "doc_id long, text string, subject string"), spark.createDataFrame(labels, "doc_id long, subject string"), p).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert len(rows) == sum(map(len, got.values()))
    right = sum(got.get(i, set()) == {s for s in m if s} for i, m in enumerate(mixes))
    assert right >= 0.9 * len(mixes)
    assert not {900, 901, 902} & set(got)
    assert all(i not in got for i, m in enumerate(mixes) if m == [None])


def corpus(spark, n=400):
    rng = random.Random(5)
    return spark.createDataFrame([(i, document(rng, [list(TERMS)[i % 3]])) for i in range(n)], "doc_id long, text string")


def test_labelled_documents_take_their_own_subjects_only(spark):
    labels = [(i, list(TERMS)[i % 3]) for i in range(30)] + [(40, "law")]
    rows = S.subjects(corpus(spark), spark.createDataFrame(labels, "doc_id long, subject string"), P)
    got = {(r[0], r[1]) for r in rows.collect()}
    assert (40, "food") not in got and {(0, "sport"), (1, "food"), (42, "sport"), (43, "food")} <= got


@pytest.mark.parametrize("columns", [5, 2048])
def test_links_are_all_verified_pairs_of_a_block(spark, columns):
    """In one block the links are those of brute force over all pairs, with exact cosines."""
    p = S.Params(orders=1, near=3, similar=0.4, block=64, columns=columns)
    docs = corpus(spark, 60).withColumn("text", F.concat("text", F.lit(" own"), F.translate(F.hex("doc_id"), "0123456789", "ghijklmnop")))  # no two alike
    tokens = S.tokenised(docs.coalesce(1))
    got = {(r["doc_id"], o): w for r in S.links(tokens, p).coalesce(1).collect() for o, w in zip(r["others"], r["weights"])}
    rows = {r["doc_id"]: r["terms"] for r in tokens.collect()}
    df = {}
    for t in rows.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    rarest = np.log(60 / max(2.0, p.common * 60))
    def vector(t):
        return {x: (1 + np.log(t.count(x))) * (np.log(60 / df[x]) if df[x] >= 2 else rarest) for x in set(t)}
    vs = {i: vector(t) for i, t in rows.items()}
    length = {i: np.sqrt(sum(w * w for w in v.values())) for i, v in vs.items()}
    cosine = {(i, j): sum(w * vs[j].get(x, 0) for x, w in vs[i].items()) / length[i] / length[j] for i in vs for j in vs if i != j}
    assert got and all(cosine[k] == pytest.approx(w, abs=1e-5) and w >= p.similar - 1e-6 and (k[1], k[0]) in got for k, w in got.items())
    assert all(sum(k[0] == i for k in got) >= min(3, sum(c >= p.similar + 1e-6 for k, c in cosine.items() if k[0] == i)) for i in vs)


def test_copies_in_a_third_of_the_rows(spark):
    docs = corpus(spark, 300)
    copies = spark.range(1000, 1150).select(F.col("id").alias("doc_id")).crossJoin(docs.where("doc_id = 0").select("text"))
    labels = spark.createDataFrame([(i, list(TERMS)[i % 3]) for i in range(30)], "doc_id long, subject string")
    got = {tuple(r) for r in S.subjects(docs.unionByName(copies), labels, P).select("doc_id", "subject").collect()}
    assert {(i, "sport") for i in range(1000, 1150)} <= got


def test_no_seeds(spark):
    d = spark.createDataFrame([(1, "some text here.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert S.subjects(d, none, P).collect() == []
    assert S.subjects(d.limit(0), none, P).collect() == []


def test_found_in_documents(spark, documents):
    from tests.conftest import SF
    from talkgrain.session import read_table

    got = S.found(documents, read_table(spark, SF, "subject_labels"))
    assert got.schema.simpleString() == "struct<doc_id:bigint,subject:string>"
    assert {r["subject"] for r in got.collect()} <= set(S.SUBJECTS)
