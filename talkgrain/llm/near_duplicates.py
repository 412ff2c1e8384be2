"""Near-duplicate records by token-combination prefixes.

A record is the set of its different runs of `width` units. Tokens (hashed runs) are put in one global order, rare
ones first, by a table of document frequencies of fixed size that all records fill. Tokens the table shows once
occur in no other record. Rare tokens are indexed alone; frequent ones only in combinations of two or three within
their class. Two sets of similarity t or more share at least one signature when each prefix is extended until

    sum over classes c of max(tokens of c in the prefix - (k_c - 1), 0)  >=  |x| - ceil(t |x|) + 1,

k_c being the size of the combinations of class c: below that, each class hides at most k_c - 1 shared tokens. A short
set may hide too many of its tokens in different classes to get there; up to the size where that can happen (and for
the sets such a one may be similar to) all frequent tokens are one class, whose k is at most the tokens two different
similar sets share.
Equal signatures give candidate pairs, whose exact similarity is then computed from the whole texts. A signature that more
than `group` sets may have is compared in parts. Records with
equal sets form one class and enter the search once; links between classes are returned, and copies are expanded
only by `row_pairs`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrain.functions.ids import url_msg, url_share
from talkgrain.llm.units import mix, shingle_sets
from talkgrain.session import durable


@dataclass(frozen=True)
class Params:
    """width: units in a token; similarity: least Jaccard; least: different tokens a record needs to take part.

    cells: size of the frequency table (4 bytes a cell while counting, 1 when sent to the executors).
    pair_df, triple_df: frequencies above which tokens are indexed in combinations of two and three.
    parts: classes into which tokens of equal combination size are divided, so that combinations stay few.
    group: sets with one signature that are compared in one task; where there may be more, they are compared in parts.
    large: sets above this size are compared by bands of size, with classes in number to their size.
    """

    width: int = 5
    similarity: float = 0.8
    least: int = 1
    cells: int = 1 << 23
    pair_df: int = 16
    triple_df: int = 1 << 16
    parts: int = 4
    large: int = 2048
    group: int = 1 << 15


_CHUNKS = 64
#: Words that hold the parity of the number of a set's tokens in each of 64 * _WORDS cells.
_WORDS = 3
_PARITY = [f"m{k}" for k in range(_WORDS)]


def _code(count: np.ndarray) -> np.ndarray:
    """A count as one byte: 0 for up to 1, then eight steps for each doubling."""
    with np.errstate(divide="ignore"):
        code = np.where(count <= 1, 0, np.ceil(8 * np.log2(np.maximum(count, 1))))
    return np.minimum(code, 255).astype(np.uint8)


def _code_of(count: float) -> int:
    return min(255, math.ceil(8 * math.log2(max(count, 1))))


def thresholds(table: np.ndarray, p: Params) -> tuple[int, int]:
    """Codes above which tokens are taken as frequent and as very frequent.

    A cell counts its own tokens and, when there are more tokens than cells, others too. What others add is a matter of
    the load of the table (tokens a cell, read off its median) and varies by its square root, so that many allowed on
    top of pair_df and triple_df. A rare token is indexed alone then as it is in an empty table: signatures don't grow
    with the collection.
    """
    load = 2.0 ** (float(np.median(table)) / 8) if len(table) and np.median(table) else 0.0
    others = load + 4 * math.sqrt(load)
    return _code_of(p.pair_df + others), _code_of(p.triple_df + others)


def _texts(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def records(df: DataFrame, id_col: str, text_col: str, p: Params, carry: dict | None = None) -> DataFrame:
    """Rows with at least p.least different tokens: id, n, set_a, set_b (128 bits of the set's hash), text, carried columns."""
    extra = carry or {}
    src = df.select(F.col(id_col).cast("bigint").alias("id"), *[c.alias(k) for k, c in extra.items()], F.col(text_col).alias("text"))
    src = src.where(F.length("text") >= p.least + p.width - 1).where(F.col("id").isNotNull())
    fields = [f for f in src.schema.fields if f.name != "text"]
    schema = T.StructType([*fields, T.StructField("n", T.IntegerType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b, "text")
            tok, at = shingle_sets(texts, p.width)
            n = np.diff(at)
            keep = np.flatnonzero(n >= max(p.least, 1))
            digest = [xxhash.xxh3_128_digest(tok[at[i] : at[i + 1]].tobytes()) for i in keep]
            halves = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
            part = b.take(pa.array(keep))
            cols = [part.column(part.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(n[keep], pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), part.column(part.schema.get_field_index("text"))],
                names=[f.name for f in schema.fields],
            )

    return src.mapInArrow(run, schema)


def frequency_table(sets: DataFrame, p: Params) -> np.ndarray:
    """Number of records holding a token of each cell, over all records, as one byte a cell. Its size is p.cells."""
    cells, size = p.cells, p.cells // _CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, dtype=np.uint32)
        for b in batches:
            tok, _ = shingle_sets(_texts(b, "text"), p.width)
            at, n = np.unique(tok % np.uint64(cells), return_counts=True)
            table[at.astype(np.int64)] += n.astype(np.uint32)
        if table.any():
            sent = table.astype(np.uint8) if table.max() <= 255 else table
            for c in range(_CHUNKS):
                part = sent[c * size : (c + 1) * size]
                packed = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([part.dtype.itemsize], pa.int32()), pa.array([packed], pa.binary())], names=["chunk", "width", "data"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.uint64)
        for b in batches:
            for w, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = pa.decompress(data, decompressed_size=size * w, codec="zstd", asbytes=True)
                total += np.frombuffer(raw, dtype={1: np.uint8, 4: np.uint32}[w])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_code(total).tobytes()], pa.binary())], names=["chunk", "data"])

    parts = sets.select("text").mapInArrow(count, "chunk int, width int, data binary")
    merged = parts.groupBy("chunk").applyInArrow(merge, "chunk int, data binary")
    table = np.zeros(cells, dtype=np.uint8)
    for r in merged.collect():  # p.cells bytes, whatever the input
        table[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["data"], dtype=np.uint8)
    return table


def _parity(tok: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The parity words of each set."""
    rows, bits = len(at) - 1, 64 * _WORDS
    own = np.repeat(np.arange(rows, dtype=np.int64), np.diff(at))
    odd = np.bincount(own * bits + (tok % np.uint64(bits)).astype(np.int64), minlength=rows * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(rows, _WORDS)


def _short(p: Params) -> tuple[int, int, int]:
    """Largest size of sets whose classes may hide too many tokens, of sets similar to these, and k of their one class.

    Classes hide at most 3 p.parts tokens, which is too many where t n <= 3 p.parts. The smallest set with a different one
    of similarity t has n tokens, n / (n + 1) >= t, and any such pair shares at least t n of them.
    """
    t = p.similarity
    most = int(3 * p.parts / t + 1e-6)
    k = min(3, max(1, math.ceil(t * max(1, math.ceil(t / (1 - t) - 1e-6)) - 1e-6))) if t < 1 else 3
    return most, int(most / t + 1e-6), k


def _signatures(tok: np.ndarray, code: np.ndarray, need: int, parts: int, pair: int, triple: int, one: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set whose tokens are given in the global order, and the code of the rarest token of each.

    one: k of all frequent tokens as one class.
    """
    if one:
        kind = np.where(code > pair, one, 1)
        group = (code > pair).astype(np.int64)
    else:
        kind = 1 + (code > pair).astype(np.int64) + (code > triple)
        group = np.where(kind == 1, 0, (kind - 2) * parts + 1 + (mix(tok) % np.uint64(parts)).astype(np.int64))
    # extend the prefix: every token counts but the first k - 1 of its class
    counts = kind == 1
    for g, k in {(int(g), int(k)) for g, k in zip(group, kind) if k > 1}:
        counts[np.flatnonzero(group == g)[k - 1 :]] = True
    first = int(np.searchsorted(np.cumsum(counts), need)) + 1
    tok, code, kind, group = tok[:first], code[:first], kind[:first], group[:first]
    alone = (kind == 1) & (code > 0)
    out, most = [tok[alone]], [code[alone]]
    for g in set(group[kind > 1].tolist()):
        own, of = tok[group == g], code[group == g]
        by = np.argsort(own)
        own, of = own[by], of[by]
        k = one or (2 if g <= parts else 3)
        if len(own) < k:
            continue
        if k == 2:
            i, j = _pairs(len(own))
            out.append(mix(own[i] * np.uint64(3) + mix(own[j])))
            most.append(np.minimum(of[i], of[j]))
        else:
            idx = _combinations(len(own), k)
            acc = np.zeros(len(idx), dtype=np.uint64)
            for c in range(k):
                acc = mix(acc * np.uint64(5) + own[idx[:, c]])
            out.append(acc)
            most.append(of[idx].min(axis=1))
    return np.concatenate(out), np.concatenate(most)


@lru_cache(256)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


@lru_cache(64)
def _combinations(n: int, k: int) -> np.ndarray:
    """All k of n places, in order, as rows."""
    idx = np.arange(n)[:, None]
    for _ in range(k - 1):
        more = n - 1 - idx[:, -1]
        rows = np.repeat(np.arange(len(idx)), more)
        nxt = idx[rows, -1] + 1 + np.arange(len(rows)) - np.repeat(np.cumsum(more) - more, more)
        idx = np.column_stack([idx[rows], nxt])
    return idx


def _spread(sig: np.ndarray, most: np.ndarray, ids: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, side and row of each place a row of a signature is sent to.

    most: sets that may have the signature, known from the frequencies of its tokens. Where these are more than `group`,
    sets fall into c parts by their id and each pair of parts is a signature of its own: a set goes to c of them. Sides 0
    and 1 meet each other, side 2 (one part, or a part and itself) meets all.
    """
    c = np.maximum(1, np.ceil(most / group)).astype(np.int64)
    if c.max(initial=1) == 1:
        return sig, np.full(len(sig), 2, np.int8), np.arange(len(sig))
    row = np.repeat(np.arange(len(sig)), c)
    other = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
    own = (mix(ids.astype(np.uint64)) % c.astype(np.uint64)).astype(np.int64)[row]
    lo, hi, many = np.minimum(own, other), np.maximum(own, other), c[row] > 1
    out = np.where(many, mix(sig[row] + mix((lo * c[row] + hi).astype(np.uint64) + np.uint64(1))), sig[row])
    return out, np.where(lo == hi, 2, own == hi).astype(np.int8), row


def signatures(sets: DataFrame, table: np.ndarray, p: Params) -> DataFrame:
    """(sig, side, id, n, parity words): every signature of every set."""
    spark = sets.sparkSession
    sent = spark.sparkContext.broadcast(table.tobytes())
    (pair, triple), t = thresholds(table, p), p.similarity
    step = math.log(1 / t)
    short, reach, one = _short(p)

    def parts(k: int) -> int:
        """Classes of band k: few enough for its smallest sets, which have more than p.large t^(2 - k) tokens."""
        return max(p.parts, min(int(p.large * (1 / t) ** k) // 64, int(p.large * t ** (3 - k) / 3))) if k else p.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.frombuffer(sent.value, dtype=np.uint8)
        for b in batches:
            ids = b.column(0).to_numpy()
            texts = _texts(b, "text")
            tok, at = shingle_sets(texts, p.width)
            parity = _parity(tok, at)
            code = codes[(tok % np.uint64(p.cells)).astype(np.int64)]
            own = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(at))
            order = np.argsort((own << 8) | code, kind="stable")
            tok, code = tok[order], code[order]
            n = np.diff(at)
            need = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
            # most prefixes hold rare tokens only: these are taken for the whole batch at once
            last = code[np.minimum(at[:-1] + need - 1, len(code) - 1)] if len(code) else np.zeros(len(n), np.uint8)
            plain = (last <= pair) & (n <= p.large * t)
            place = np.arange(len(tok)) - np.repeat(at[:-1], n)
            take = np.flatnonzero(np.repeat(plain, n) & (place < np.repeat(need, n)) & (code > 0))
            sigs, whose, most = [tok[take]], [np.repeat(np.arange(len(n)), n)[take]], [2.0 ** (code[take].astype(np.float64) / 8)]
            for i in np.flatnonzero(~plain & (n > 0)):
                x, c = tok[at[i] : at[i + 1]], code[at[i] : at[i + 1]]
                got = []
                if n[i] <= reach:
                    got.append(_signatures(x, c, need[i], p.parts, pair, triple, one))
                if n[i] > short:
                    if n[i] <= p.large * t:
                        got.append(_signatures(x, c, need[i], p.parts, pair, triple))
                    else:  # one set of signatures for each band of sizes it may meet
                        band = 0 if n[i] <= p.large else 1 + int(math.log(n[i] / p.large) / step)
                        for k in (band, band + 1):
                            own_sigs, own_most = _signatures(x, c, need[i], parts(k), pair, triple)
                            got.append((mix(own_sigs + np.uint64(k)) if k else own_sigs, own_most))
                flat, first = np.unique(np.concatenate([g[0] for g in got]), return_index=True)
                sigs.append(flat)
                most.append(2.0 ** (np.concatenate([g[1] for g in got])[first].astype(np.float64) / 8))
                whose.append(np.full(len(flat), i))
            whose = np.concatenate(whose)
            flat, side, row = _spread(np.concatenate(sigs), np.concatenate(most), ids[whose], p.group)
            whose = whose[row]
            for lo in range(0, len(flat), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                who = whose[part]
                cols = [pa.array(flat[part].view(np.int64)), pa.array(side[part]), pa.array(ids[who]), pa.array(n[who].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(parity[who, k]) for k in range(_WORDS))], names=["sig", "side", "id", "n", *_PARITY])

    return sets.select("id", "text").mapInArrow(run, "sig long, side tinyint, id long, n int, " + ", ".join(f"{x} long" for x in _PARITY))


#: Pairs looked at in one step.
_STEP = 1 << 20


def _similar_pairs(sig: np.ndarray, side: np.ndarray, ids: np.ndarray, n: np.ndarray, parity: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, sorted by signature and size, that may be similar: ids, the smaller first."""
    new = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.empty(0, bool)
    key = np.cumsum(new) << 32
    # behind a row those of its signature that aren't too large
    upto = np.searchsorted(key + n, key + np.minimum(np.floor(n / t + 1e-6), 2**31).astype(np.int64), "right")
    count = np.maximum(upto - np.arange(len(sig)) - 1, 0)
    ends = np.cumsum(count)
    lo = 0
    while lo < len(sig):
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _STEP, "right")), lo + 1)
        c = count[lo:hi]
        left = np.repeat(np.arange(lo, hi), c)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
        ok = ((side[left] != side[right]) | (side[left] == 2)) & (ids[left] != ids[right])
        left, right = left[ok], right[ok]
        differ = np.bitwise_count((parity[left] ^ parity[right]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        ok = differ <= (n[left] + n[right]) * ((1 - t) / (1 + t)) + 1e-6
        a, b = ids[left[ok]], ids[right[ok]]
        yield np.minimum(a, b), np.maximum(a, b)
        lo = hi


def candidates(sigs: DataFrame, p: Params) -> DataFrame:
    """Different pairs (a, b), a < b, with a signature in common whose sizes and parity words allow the similarity.

    Each bit in which the parities differ stands for at least one token that only one of the two sets has. Rows come
    sorted and pairs are made in steps of bounded size; a signature many sets may have was sent in parts.
    """
    t = p.similarity - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sig, side, ids, n, *words = (c.to_numpy() for c in b.columns)
            for x, y in _similar_pairs(sig, side, ids, n.astype(np.int64), np.stack(words, axis=1), t):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        rest: list[pa.RecordBatch] = []  # rows of the signature that may go on in the next batch
        for b in batches:
            sig = b.column(0).to_numpy()
            if not len(sig):
                continue
            last = int(np.searchsorted(sig, sig[-1]))
            if last or (rest and rest[-1].column(0)[-1].as_py() != sig[0]):
                yield from pairs(pa.concat_batches([*rest, b.slice(0, last)]))
                rest = []
            rest.append(b.slice(last))
        if rest:
            yield from pairs(pa.concat_batches(rest))

    return sigs.repartition("sig").sortWithinPartitions("sig", "n").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """(a, b, similarity) of the pairs that reach p.similarity, computed from the whole texts."""
    x, y = sets.select(F.col("id").alias("a"), F.col("text").alias("text_a")), sets.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                ids = np.concatenate([b.column(0).to_numpy(), b.column(1).to_numpy()])
                _, first, inv = np.unique(ids, return_index=True, return_inverse=True)
                texts = _texts(b, "text_a") + _texts(b, "text_b")
                tok, at = shingle_sets([texts[i] for i in first], p.width)
                left, right = inv[: b.num_rows], inv[b.num_rows :]
                size = np.diff(at)
                got = np.zeros(b.num_rows, dtype=np.int64)
                for k, (i, j) in enumerate(zip(left, right)):
                    got[k] = len(np.intersect1d(tok[at[i] : at[i + 1]], tok[at[j] : at[j + 1]], assume_unique=True))
                sim = got / np.maximum(size[left] + size[right] - got, 1)
                keep = np.flatnonzero(got >= p.similarity * (size[left] + size[right] - got) - 1e-9)
                part = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim[keep])], names=["a", "b", "similarity"])

    both = pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long, similarity double")


@dataclass
class Links:
    """members: (id, class_id, carried columns); links: (a, b, similarity) between class ids."""

    members: DataFrame
    links: DataFrame


def link(df: DataFrame, id_col: str, text_col: str, p: Params | None = None, carry: dict | None = None) -> Links:
    """Links between all different sets of similarity p.similarity or more, and the members of each set.

    Null and empty texts and texts of fewer than p.least tokens belong to no class. Rows with a null id are left out;
    repeated rows of one id count as one. Very long texts are used whole. Other columns are ignored, whatever their names.
    """
    p = p or Params()
    rec = durable(records(df, id_col, text_col, p, carry), "neardup-records")
    members = rec.groupBy("set_a", "set_b").agg(F.min("id").alias("class_id"))
    reps = members.select(F.col("class_id").alias("id"))
    sets = durable(rec.select("id", "text").join(reps, "id", "left_semi").dropDuplicates(["id"]), "neardup-sets")
    table = frequency_table(sets, p)
    pairs = candidates(signatures(sets, table, p), p)
    links = durable(verified(pairs, sets, p), "neardup-links")
    own = rec.drop("text", "n").join(members, ["set_a", "set_b"]).drop("set_a", "set_b").distinct()
    return Links(durable(own, "neardup-members"), links)


def row_pairs(found: Links, differ: list[str], part: int = 2000) -> DataFrame:
    """(row_a, row_b): all pairs of rows of linked classes and of one class, unless all columns in `differ` are equal.

    Classes of more than `part` rows are joined in parts, each pair of parts by itself, so that a large group of copies
    is no single task's work.
    """
    m = found.members
    sizes = m.groupBy("class_id").count()
    parts = sizes.where(F.col("count") > part).select("class_id", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    many = sizes.where("count > 1").select("class_id")
    pairs = found.links.select("a", "b").unionByName(many.select(F.col("class_id").alias("a"), F.col("class_id").alias("b")))
    keys = {"a": ["a"], "b": ["b"]}
    if not parts.isEmpty():
        parts = durable(parts, "neardup-parts")
        m = m.join(parts, "class_id", "left").withColumn("k", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).drop("parts")
        for side in ("a", "b"):
            pairs = pairs.join(parts.select(F.col("class_id").alias(side), F.col("parts").alias(f"p{side}")), side, "left").withColumn(f"k{side}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(f"p{side}", F.lit(1)).cast("bigint") - 1))).drop(f"p{side}")
            keys[side].append(f"k{side}")
    # the places of a class are sent on by pair of parts, not by class
    for side in ("a", "b"):
        own = m.select(F.col("class_id").alias(side), *([F.col("k").alias(f"k{side}")] if len(keys[side]) > 1 else []), F.col("id").alias(f"i{side}"), *[F.col(c).alias(f"{side}_{c}") for c in differ])
        pairs = pairs.join(own, keys[side])
    same = F.lit(bool(differ))
    for c in differ:
        same = same & F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False))
    pairs = pairs.where(~same).where((F.col("a") != F.col("b")) | (F.col("ia") < F.col("ib")))
    return pairs.select(F.least("ia", "ib").alias("row_a"), F.greatest("ia", "ib").alias("row_b"))


def classes(found: Links) -> DataFrame:
    """(id, class_id, class_size, links): each row that takes part, with the number of other rows it is linked to."""
    size = found.members.groupBy("class_id").agg(F.count("*").alias("class_size"))
    ends = found.links.select(F.col("a").alias("class_id"), F.col("b").alias("other")).unionByName(found.links.select(F.col("b").alias("class_id"), F.col("a").alias("other")))
    n = ends.join(size.select(F.col("class_id").alias("other"), F.col("class_size").alias("n")), "other").groupBy("class_id").agg(F.sum("n").alias("n"))
    whole = size.join(n, "class_id", "left").select("class_id", "class_size", (F.coalesce("n", F.lit(0)) + F.col("class_size") - 1).alias("links"))
    return found.members.select("id", "class_id").join(whole, "class_id").select("id", "class_id", "class_size", "links")


#: The parameters TESTDATA.md sets for messages.
MESSAGE_PARAMS = Params(width=3, similarity=0.7, least=50)


def message_links(messages: DataFrame, p: Params = MESSAGE_PARAMS) -> Links:
    return link(messages, "row_id", "content", p, {"share": url_share(F.col("url")), "msg": url_msg(F.col("url"))})


def message_pairs(messages: DataFrame, p: Params = MESSAGE_PARAMS) -> DataFrame:
    """(row_a, row_b): rows naming different messages with nearly the same content. A url naming none differs from all."""
    return row_pairs(message_links(messages, p), ["share", "msg"])
