"""Subject areas of documents by label propagation over a graph of verified document links.

Texts are split and hashed once; everything else reads those tokens.

1. Candidates. A document is the vector of its terms, weighted by how rare they are in all documents. In each of `orders`
   orders documents stand sorted by the signs of random projections of that vector, and those of one block are compared.
2. Verified links. A pair of a block is a link if its exact cosine over all terms reaches `similar` and it is among the
   `near` best of one of the two. That is the rule of degree: a link more or less between documents of one kind
   carries no new label, and hubs get no links of their own. Of equal vectors in a block the first is compared, the others
   link to it. Links are rows (doc_id, others, weights).
3. Propagation. Labelled documents begin; in each of `rounds` rounds of joins every document takes the mean of its links'
   weights of all eight subjects, so that several are kept. Seeds are clamped: they take nothing.
4. Check. A subject must have reached the document over links (`reach` of its weight), and at least `share` of its
   sentences must belong to it. Sentences are told by terms that, counted over all propagated documents, lean to a subject
   by `lift` (subjects on one footing) and by `sure` standard deviations; a sentence below `none` (log odds) is small talk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.passages import passages, slices
from talkgrain.llm.units import mix
from talkgrain.session import durable

# The subjects.
SUBJECTS = ("software", "sport", "law", "science", "food", "travel", "finance", "health")
K = len(SUBJECTS)


@dataclass(frozen=True)
class Params:
    """common: terms of this share of documents have weights of their own, rarer ones that of the rarest of these.

    bits: signs of each order; columns: terms of a block compared at once; sent: most telling terms (36 bytes each) that go to the executors whole, more are joined.
    The others as above.
    """

    orders: int = 3
    block: int = 256
    near: int = 4
    similar: float = 0.2
    rounds: int = 4
    reach: float = 0.0075
    share: float = 0.25
    lift: float = 2.0
    sure: float = 5.0
    none: float = 1.0
    common: float = 1e-3
    bits: int = 24
    columns: int = 2048
    sent: int = 1 << 20


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id, sentences, terms (of all sentences in order), lengths (terms of each sentence that has any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_texts = b.column(1).to_pylist()
            for part in slices(all_texts):
                texts = all_texts[part]
                terms, n, whose, sentences = passages(texts)
                per = np.bincount(whose, weights=n, minlength=len(texts)).astype(np.int64)
                pieces = np.bincount(whose, minlength=len(texts))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]), pa.int32()), pa.array(v, pa.int32())) for k, v in ((per, terms.view(np.int32)), (pieces, n.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part.start, len(texts)), pa.array(sentences, pa.int32()), *lists], names=["doc_id", "sentences", "terms", "lengths"])

    return docs.mapInArrow(run, "doc_id long, sentences int, terms array<int>, lengths array<int>")


def _terms(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Terms of all rows of a batch and the row of each."""
    lists = b.column(b.schema.get_field_index("terms"))
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy().view(np.uint32), np.repeat(np.arange(len(n)), n)


def _distinct(terms: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and number of each different pair of them, sorted."""
    both, n = np.unique(rows.astype(np.uint64) << np.uint64(32) | terms, return_counts=True)
    return (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32), n


def document_counts(tokens: DataFrame) -> DataFrame:
    """(term, n): the documents that hold each term, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, terms, _ = _distinct(*_terms(b))
            t, n = np.unique(terms, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int32)), pa.array(n)], names=["term", "n"])

    return tokens.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _place(sorted_terms: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Place of each term in a sorted list, or -1."""
    if not len(sorted_terms):
        return np.full(len(terms), -1)
    at = np.minimum(np.searchsorted(sorted_terms, terms), len(sorted_terms) - 1)
    return np.where(sorted_terms[at] == terms, at, -1)


def links(tokens: DataFrame, p: Params) -> DataFrame:
    """doc_id, others, weights: verified links of each document, both ways, a row for each order it has any in."""
    n = tokens.count()
    # at most the mean number of terms of a document divided by p.common, whatever the number of documents
    known = document_counts(tokens).where(F.col("n") >= max(2.0, p.common * n)).toArrow()
    order = np.argsort(terms := known.column("term").to_numpy().view(np.uint32))
    idf = np.log(max(n, 2) / known.column("n").to_numpy()[order]).astype(np.float32)
    sent = tokens.sparkSession.sparkContext.broadcast((terms[order], idf, np.float32(np.log(max(n, 2) / max(2.0, p.common * n)))))
    number = pa.uint16() if len(terms) < 1 << 16 else pa.uint32()

    def weights(known: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
        return (1 + np.log(count)) * idf[known]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf, rare = sent.value
        sign = np.unpackbits(np.stack([mix(names.astype(np.uint64) * np.uint64(2 * k + 1) + np.uint64(k)) for k in range(p.orders)], axis=1).view(np.uint8), axis=1).reshape(len(names), p.orders, 64)[:, :, : p.bits]
        sign = (sign.astype(np.float32) * 2 - 1).reshape(len(names), p.orders * p.bits)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                row, term, count = _distinct(*_terms(b))
                place = _place(names, term)
                own = np.flatnonzero(place >= 0)
                other = np.flatnonzero(place < 0)
                w = weights(place[own], count[own], idf)
                length = np.bincount(row[own], weights=w * w, minlength=b.num_rows) + np.bincount(row[other], weights=((1 + np.log(count[other])) * rare) ** 2, minlength=b.num_rows)
                starts = np.searchsorted(row[own], np.arange(b.num_rows + 1))
                full = np.flatnonzero(np.diff(starts))
                code = np.zeros((b.num_rows, p.orders * p.bits), np.float32)
                if len(full):
                    code[full] = np.add.reduceat(sign[place[own]] * w.astype(np.float32)[:, None], starts[:-1][full], axis=0)
                code = ((code > 0).reshape(b.num_rows, p.orders, p.bits) * (1 << np.arange(p.bits - 1, -1, -1))).sum(axis=2)
                ends = [np.concatenate([[0], np.cumsum(np.bincount(row[x], minlength=b.num_rows))]) for x in (own, other)]
                lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), v) for e, v in ((ends[0], pa.array(place[own], number).cast(pa.int32())), (ends[0], pa.array(np.minimum(count[own], 127), pa.int8())), (ends[1], pa.array(term[other].view(np.int32))), (ends[1], pa.array(np.minimum(count[other], 127), pa.int8())))]
                for o in range(p.orders):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, o), pa.int32()), pa.array(code[:, o], pa.int32()), b.column(0), pa.array(np.sqrt(length).astype(np.float32)), *lists], names=["o", "code", "doc_id", "length", "known", "times", "rare", "rare_times"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, idf, rare = sent.value
        rest: pa.RecordBatch | None = None
        for b in batches:
            b = b if rest is None else pa.concat_batches([rest, b])
            full = b.num_rows - b.num_rows % p.block
            yield from (_compare(b.slice(lo, p.block), idf, rare, p) for lo in range(0, full, p.block))
            rest = b.slice(full)
        if rest is not None and rest.num_rows:
            yield _compare(rest, idf, rare, p)

    spread = tokens.where(F.size("terms") > 0).select("doc_id", "terms").mapInArrow(vectors, "o int, code int, doc_id long, length float, known array<int>, times array<tinyint>, rare array<int>, rare_times array<tinyint>")
    # partitions of one sign prefix or more; adaptive execution splits those that copies make large
    near = spread.withColumn("top", F.shiftright("code", max(p.bits - 8, 0))).hint("rebalance", "o", "top").sortWithinPartitions("o", "code", F.xxhash64("doc_id")).drop("top")
    return near.mapInArrow(compare, "doc_id long, others array<long>, weights array<float>")


def _compare(b: pa.RecordBatch, idf: np.ndarray, rare: np.float32, p: Params) -> pa.RecordBatch:
    """Links within a block: pairs of cosine p.similar or more among the p.near best of either."""
    col = {n: b.column(k) for k, n in enumerate(b.schema.names)}
    parts = []
    for name, times in (("known", "times"), ("rare", "rare_times")):
        v = col[name].flatten().to_numpy().view(np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(b.num_rows), col[name].value_lengths().to_numpy(zero_copy_only=False))
        w = (1 + np.log(col[times].flatten().to_numpy().astype(np.float32))) * (idf[v.astype(np.int64)] if name == "known" else rare)
        parts.append((v + (np.uint64(1 << 32) if name == "rare" else np.uint64(0)), row, w))
    v, row, w = (np.concatenate(x) for x in zip(*parts))
    # equal vectors are compared once; the others of their kind link to the first
    digest = np.bincount(row, weights=(mix(v + np.uint64(1)) >> np.uint64(12)).astype(np.float64) * w, minlength=b.num_rows)
    _, first, kind = np.unique(digest, return_index=True, return_inverse=True)
    ids = col["doc_id"].to_numpy()
    single = np.zeros(b.num_rows, bool)
    single[first] = True
    used = single[row]
    v, row, w = v[used], kind[row[used]], w[used]
    _, place, held = np.unique(v, return_inverse=True, return_counts=True)
    shared = held[place] > 1  # a term of one document adds nothing
    _, place = np.unique(place[shared], return_inverse=True)
    by = np.argsort(place, kind="stable")
    place, row, w = place[by], row[shared][by], w[shared][by] / np.maximum(col["length"].to_numpy()[first][row[shared][by]], 1e-9)
    cosine = np.zeros((len(first), len(first)), np.float32)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, p.columns):  # long texts share many terms
        part = slice(*np.searchsorted(place, [lo, lo + p.columns]))
        matrix = np.zeros((len(first), p.columns), np.float32)
        matrix[row[part], place[part] - lo] = w[part]
        cosine += matrix @ matrix.T
    np.fill_diagonal(cosine, 0)
    keep = np.zeros(cosine.shape, bool)
    best = np.argpartition(-cosine, min(p.near, len(first)) - 1, axis=1)[:, : p.near]
    np.put_along_axis(keep, best, True, axis=1)
    keep &= cosine >= p.similar
    keep |= keep.T
    a, c = np.nonzero(keep)
    copy = np.flatnonzero(~single)
    left = np.concatenate([first[a], copy, first[kind[copy]]])
    right = np.concatenate([first[c], first[kind[copy]], copy])
    weight = np.concatenate([cosine[a, c], np.ones(2 * len(copy), np.float32)])
    differ = ids[left] != ids[right]
    left, right, weight = left[differ], right[differ], weight[differ]
    order = np.argsort(left, kind="stable")
    n = np.bincount(left, minlength=b.num_rows)
    has = np.flatnonzero(n)
    ends = pa.array(np.concatenate([[0], np.cumsum(n[has])]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.ListArray.from_arrays(ends, pa.array(ids[right[order]])), pa.ListArray.from_arrays(ends, pa.array(weight[order].astype(np.float32)))], names=["doc_id", "others", "weights"])


def _packed(ws: list[Column]) -> Column:
    """Eight weights between 0 and 1 as one long, a byte each."""
    out = F.lit(0).cast("bigint")
    for k, w in enumerate(ws):
        out = out.bitwiseOR(F.shiftleft(F.round(w * 255).cast("bigint"), 8 * k))
    return out


def _weight(packed: Column, k: int) -> Column:
    return F.shiftrightunsigned(packed, 8 * k).bitwiseAND(F.lit(255).cast("bigint")) / F.lit(255.0)


def propagated(found: DataFrame, seeds: DataFrame, p: Params) -> DataFrame:
    """(doc_id, y): the packed subject weights of every document that labels reach; seeds keep their own."""
    labels = seeds.withColumnRenamed("own", "y")
    for _ in range(p.rounds):
        flow = found.join(labels, "doc_id").select("y", F.explode(F.arrays_zip("others", "weights")).alias("x")).select(F.col("x.others").alias("doc_id"), (F.col("x.weights") * F.col("x.weights")).alias("w"), "y")
        sums = flow.repartition("doc_id").groupBy("doc_id").agg(*[F.sum(F.col("w") * _weight(F.col("y"), k)).alias(f"w{k}") for k in range(K)])
        sums = sums.withColumn("whole", sum([F.col(f"w{k}") for k in range(1, K)], F.col("w0")))
        mean = F.when(F.col("whole") > 0, _packed([F.col(f"w{k}") / F.col("whole") for k in range(K)]))
        labels = durable(sums.join(seeds, "doc_id", "full_outer").select("doc_id", F.coalesce("own", mean).alias("y")).where("y IS NOT NULL"), "subject-labels")
    return labels


def telling_terms(tokens: DataFrame, labels: DataFrame, p: Params) -> DataFrame:
    """(term, l0 .. l7): terms that lean to a subject in the propagated documents, with their log odds of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, term, _ = _distinct(*_terms(b))
            y = b.column(b.schema.get_field_index("y")).to_numpy().view(np.uint8).reshape(-1, 8)
            t, place = np.unique(term, return_inverse=True)
            sums = [np.bincount(place, weights=y[row, k], minlength=len(t)).astype(np.int64) for k in range(K)]
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int32)), *map(pa.array, sums)], names=["term", *(f"w{k}" for k in range(K))])

    weights = [f"w{k}" for k in range(K)]
    schema = "term int, " + ", ".join(f"{w} long" for w in weights)
    counts = durable(tokens.select("doc_id", "terms").join(labels, "doc_id").select("terms", "y").mapInArrow(run, schema).groupBy("term").agg(*[(F.sum(w) / F.lit(255.0)).alias(w) for w in weights]), "subject-terms")
    sums = counts.agg(*[F.sum(w) for w in weights]).first()
    whole = sum(x or 0.0 for x in sums)
    prior = [(x or 0.0) / whole if whole else 0.0 for x in sums]
    live = [k for k, q in enumerate(prior) if 0 < q < 1]
    if not live:  # one subject alone can't be told from others
        return counts.limit(0).select("term", *[F.lit(0.0).alias(f"l{k}") for k in range(K)])
    # subjects on one footing, however many documents they have, and shrunk where a term is rare
    even = [F.col(f"w{k}") / prior[k] + 2.0 for k in live]
    rows = counts.withColumn("n", sum([F.col(w) for w in weights[1:]], F.col("w0"))).where("n > 0").withColumn("even", sum(even[1:], even[0]))
    logs = {k: F.log(e / F.col("even") * len(live)) for k, e in zip(live, even)}
    leans = [(logs[k] >= math.log(p.lift)) & ((F.col(f"w{k}") / F.col("n") - prior[k]) >= p.sure * F.sqrt(F.lit(prior[k] * (1 - prior[k])) / F.col("n"))) for k in live]
    # a subject without seeds can't be told and never spreads
    return rows.where(reduce(Column.__or__, leans)).select("term", *[logs.get(k, F.lit(-50.0)).alias(f"l{k}") for k in range(K)])


def sentence_subjects(tokens: DataFrame, telling: DataFrame, p: Params) -> DataFrame:
    """doc_id, sentences, n0 .. n7: sentences of each document, and how many belong to each subject."""
    size = telling.count()
    counted = _counted_by_lookup(tokens, telling, p) if size <= p.sent else _counted_by_join(tokens, telling, p)
    return counted.groupBy("doc_id").agg(F.sum("sentences").alias("sentences"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(K)])


def _counted_by_lookup(tokens: DataFrame, telling: DataFrame, p: Params) -> DataFrame:
    got = telling.toArrow()  # at most p.sent rows
    order = np.argsort(terms := got.column("term").to_numpy().view(np.uint32))
    logs = np.stack([got.column(f"l{k}").to_numpy() for k in range(K)], axis=1)[order].astype(np.float32) if len(terms) else np.zeros((0, K), np.float32)
    sent = tokens.sparkSession.sparkContext.broadcast((terms[order], logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                terms, _ = _terms(b)
                lists = b.column(b.schema.get_field_index("lengths"))
                n = lists.flatten().to_numpy()
                piece = np.repeat(np.arange(len(n)), n)
                row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                place = _place(names, terms)
                own = np.flatnonzero(place >= 0)
                out = np.zeros((b.num_rows, K), np.int64)
                if len(own):
                    # the terms of a sentence stand together
                    first = np.flatnonzero(np.diff(piece[own], prepend=-1))
                    score = np.add.reduceat(logs[place[own]], first, axis=0)
                    taken = score.max(axis=1) > p.none
                    out = np.bincount(row[piece[own][first][taken]] * K + score.argmax(axis=1)[taken], minlength=b.num_rows * K).reshape(-1, K)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(out[:, k]) for k in range(K))], names=["doc_id", "sentences", *(f"n{k}" for k in range(K))])

    return tokens.mapInArrow(run, "doc_id long, sentences int, " + ", ".join(f"n{k} long" for k in range(K)))


def _counted_by_join(tokens: DataFrame, telling: DataFrame, p: Params) -> DataFrame:
    """The same with a shuffle in place of the lookup."""
    stops = F.expr("transform(lengths, (x, i) -> aggregate(slice(lengths, 1, i + 1), 0, (a, b) -> a + b))")
    rows = tokens.withColumn("row", F.monotonically_increasing_id()).withColumn("stops", stops)
    each = rows.select("row", "stops", F.posexplode("terms").alias("at", "term"))
    each = each.select("row", "term", F.size(F.filter("stops", lambda s: s <= F.col("at"))).alias("piece"))
    scores = each.join(telling, "term").groupBy("row", "piece").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(K)])
    top = F.greatest(*[F.col(f"l{k}") for k in range(K)])
    which = F.coalesce(*[F.when(F.col(f"l{k}") == top, F.lit(k)) for k in range(K)])
    counts = scores.where(top > p.none).select("row", which.alias("k")).groupBy("row").agg(*[F.count(F.when(F.col("k") == k, 1)).alias(f"n{k}") for k in range(K)])
    return rows.select("row", "doc_id", "sentences").join(counts, "row", "left").select("doc_id", "sentences", *[F.coalesce(f"n{k}", F.lit(0)).alias(f"n{k}") for k in range(K)])


def seed_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, own): the packed weights of labelled documents, the same for each of their subjects."""
    rows = labels.where(F.col("subject").isin(*SUBJECTS)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "subject").where("doc_id IS NOT NULL")
    marks = rows.groupBy("doc_id").agg(*[F.max(F.when(F.col("subject") == s, 1.0).otherwise(0.0)).alias(f"m{k}") for k, s in enumerate(SUBJECTS)])
    whole = sum([F.col(f"m{k}") for k in range(1, K)], F.col("m0"))
    return marks.select("doc_id", _packed([F.col(f"m{k}") / whole for k in range(K)]).alias("own"))


def subjects(docs: DataFrame, labels: DataFrame, p: Params = Params(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, subject, share): each subject that reached the document and that at least p.share of its sentences belong to.

    Null and empty texts have no subject. Labels of unknown documents or subjects are ignored; repeated labels
    count once, repeated rows of a document as one document with the sentences of all. A document without links to any
    labelled one, however far, is told by its sentences alone. Without usable labels there are no rows.
    """
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    tokens = durable(tokenised(src), "subject-tokens")
    seeds = durable(seed_weights(labels), "subject-seeds")
    found = durable(links(tokens, p), "subject-links")
    labelled = propagated(found, seeds, p)
    counts = sentence_subjects(tokens, telling_terms(tokens, labelled, p), p).join(labelled, "doc_id", "left")
    each = F.array(*[F.struct(F.lit(s).alias("subject"), (F.col(f"n{k}") / F.col("sentences")).alias("share"), (F.col("y").isNull() | (_weight(F.col("y"), k) >= p.reach)).alias("reached")) for k, s in enumerate(SUBJECTS)])
    rows = counts.where("sentences > 0").select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*")
    return rows.where(F.col("reached") & (F.col("share") >= p.share - 1e-9)).drop("reached")


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return subjects(docs, labels).select("doc_id", "subject")


def make_up(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(subject, documents, share): the corpus by subject; a document counts for each of its subjects."""
    got = subjects(docs, labels).groupBy("subject").agg(F.count("*").alias("documents"))
    return got.crossJoin(docs.agg(F.count("*").alias("n"))).select("subject", "documents", (F.col("documents") / F.col("n")).alias("share"))
