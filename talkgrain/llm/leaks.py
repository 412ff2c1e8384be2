"""Evaluation passages that appear, fully or partly and with few edits, in documents.

Both sides are read as their units joined by single spaces. The items' character q-grams form an index that goes to the
executors in blocks of bounded size. A document's q-grams are looked up, and every hit falls into two overlapping bands of
diagonals (document position minus item position). A region of n characters with at most e(n) edits stays within e(n)
diagonals and shares at least n + 1 - q (1 + e(n)) q-grams (the q-gram lemma); bands are as wide as twice the most edits an
item allows and overlap by half, so that every region lies whole in one of them. Bands with fewer hits than the shortest
region needs are dropped. In the others, hits on one diagonal form runs; each stretch from the beginning of a run to the
end of the same or another one, of any length the item has, must meet the bound for its own length and edit budget, and is
then verified by banded alignment. The longest that passes is kept for each beginning, unless it lies in another region.
Every document is read whole and once for each block of items; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.units import _kinds, code_points, mix, powers, shingle_sets


@dataclass(frozen=True)
class Params:
    """units, least: units and characters of the shortest region; per_edit: one edit is allowed for each so many characters.

    block: most characters of items sent to the executors at once (an item longer than that goes alone).
    """

    units: int = 12
    least: int = 23
    per_edit: int = 60
    q: int = 16
    block: int = 16_000_000

    def budget(self, n):
        return n // self.per_edit

    def needed(self, n):
        """Shared q-grams that a region of n characters within its budget has at least."""
        return n + 1 - self.q * (1 + self.budget(n))

    def half_band(self, n):
        """Half the width of the bands for an item of n characters."""
        return np.maximum(1, self.budget(n)) + 1


def canonical(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, units joined by spaces, each text begun by a line break; start of each text (end appended)."""
    if not texts:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    chars, at = code_points(texts)
    kind = _kinds()[chars]
    begins = kind == 2
    word = kind == 1
    begins[0] |= word[0]
    begins[1:] |= word[1:] & ~word[:-1]
    kept = kind > 0
    place = np.cumsum(kept.astype(np.int64) + begins)
    row_first = np.searchsorted(np.flatnonzero(begins), at[:-1])
    # every text begins with a mark of its own, also one without units
    out = np.full(place[-1] + len(texts), 32, dtype=np.uint32)
    shift = np.repeat(np.arange(1, len(texts) + 1), np.diff(at))
    out[place[kept] - 1 + shift[kept]] = chars[kept]
    before = np.concatenate([[0], place])[at[:-1]]
    starts = before + np.arange(len(texts))
    out[starts] = 10
    first = np.flatnonzero(begins)
    has = row_first < len(first)
    has[has] &= first[row_first[has]] < at[1:][has]
    out[starts[has] + 1] = 10
    return out, np.append(starts, len(out))


def qgrams(chars: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q characters, from sums of powers."""
    up, down = powers()
    out, most = [np.empty(0, np.uint64)], len(up) - 1
    for lo in range(0, max(len(chars) - q + 1, 0), most - q + 1):
        part = chars[lo : lo + most]
        sums = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])])
        out.append(mix((sums[q:] - sums[:-q]) * down[: len(part) - q + 1]))
    return np.concatenate(out)


class Index:
    """q-grams of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], p: Params) -> None:
        self.ids, self.texts = np.array(ids, dtype=np.int64), texts
        self.chars, self.at = canonical(texts)
        h = qgrams(self.chars, p.q)
        breaks = np.cumsum(self.chars == 10)
        inside = np.flatnonzero((breaks[p.q - 1 :][: len(h)] == breaks[: len(h)]) & (self.chars[: len(h)] != 10)) if len(h) else np.empty(0, np.int64)
        order = np.argsort(h[inside], kind="stable")
        self.hash, self.pos = h[inside][order], inside[order]
        self.item = np.searchsorted(self.at, self.pos, side="right") - 1
        self.bits = max(20, int(len(self.hash) * 32).bit_length())
        maybe = np.zeros(1 << self.bits, dtype=bool)
        maybe[(self.hash >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.maybe = np.packbits(maybe, bitorder="little")
        tok, at = shingle_sets(texts, 12)
        self.twelve = [tok[at[i] : at[i + 1]] for i in range(len(texts))]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, place in the index) of all equal q-grams."""
        cell = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        near = np.flatnonzero(self.maybe[cell >> 3] >> (cell & 7).astype(np.uint8) & np.uint8(1))
        lo, hi = np.searchsorted(self.hash, h[near], "left"), np.searchsorted(self.hash, h[near], "right")
        n = hi - lo
        near, lo, n = near[n > 0], lo[n > 0], n[n > 0]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(near, n), np.repeat(lo, n) + step


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of a and b, or most + 1 if it is more: furthest reach on each of the 2 most + 1 diagonals."""
    if abs(len(a) - len(b)) > most:
        return most + 1

    def run(i: int, j: int) -> int:
        n = min(len(a) - i, len(b) - j)
        if n <= 0:
            return 0
        differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
        return int(differ[0]) if len(differ) else n

    reach = {0: run(0, 0)}
    for e in range(most + 1):
        if reach.get(len(a) - len(b), -1) >= len(a):
            return e
        nxt: dict[int, int] = {}
        for d in range(-e - 1, e + 2):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2) + 1, reach.get(d + 1, -1))
            if i < 0:
                continue
            i = min(i, len(a), len(b) + d)
            if i >= 0 and i - d >= 0:
                nxt[d] = i + run(i, i - d)
        reach = nxt
    return most + 1


def _regions(x0: np.ndarray, y0: np.ndarray, size: np.ndarray, hits: np.ndarray, a: np.ndarray, b: np.ndarray, spaces: np.ndarray, p: Params) -> list[tuple[int, int, int, int, int]]:
    """(first and last place in a, in b, edits) of the longest verified regions of one band of a document a and an item b.

    x0, y0, size: runs by place in a; hits: places in a of the q-grams the band shares, sorted; spaces: number of spaces before each place of a.
    """
    x1, y1 = x0 + size, y0 + size
    upto, since, before, after = np.searchsorted(hits, x1 - p.q, "right"), np.searchsorted(hits, x0), spaces[x0], spaces[x1]
    found: list[tuple[int, int, int, int, int]] = []

    def windows(rows: slice) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each run that may begin a region: the run, whether each run may end it, edits allowed, shift to each."""
        w, v = x1 - x0[rows, None], y1 - y0[rows, None]
        n = np.minimum(w, v)
        most = p.budget(n)
        ok = (n >= p.least) & (np.abs(w - v) <= most) & (after - before[rows, None] >= p.units - 1)
        ok &= upto - since[rows, None] >= p.needed(n) + w - n
        for k in np.flatnonzero(ok.any(axis=1)):
            yield rows.start + k, ok[k], most[k], (w - v)[k]

    block = max(1, 1_000_000 // len(x0))
    for i, ok, most, shift in (r for lo in range(0, len(x0), block) for r in windows(slice(lo, min(lo + block, len(x0))))):
        for u0, u1, v0, v1, _ in found:  # what lies inside a region that is known needs no alignment
            if u0 <= x0[i] < u1 and v0 <= y0[i] < v1:
                ok &= (x1 > u1) | (y1 > v1)
        ends = np.flatnonzero(ok)
        if not len(ends):
            continue
        edits = prefix_distances(a[x0[i] : x1[ends].max()], b[y0[i] : y1[ends].max()], x1[ends] - x0[i], shift[ends], most[ends])
        good = np.flatnonzero(edits <= most[ends])
        if len(good):
            k = max(good, key=lambda k: (x1[ends[k]], y1[ends[k]]))
            found.append((int(x0[i]), int(x1[ends[k]]), int(y0[i]), int(y1[ends[k]]), int(edits[k])))
    return found


def _outermost(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Different regions that lie in no other of the same document and item."""
    kept = sorted(set(found))
    return [r for r in kept if not any(w[:4] != r[:4] and w[0] <= r[0] and r[1] <= w[1] and w[2] <= r[2] and r[3] <= w[3] for w in kept)]


def prefix_distances(a: np.ndarray, b: np.ndarray, length: np.ndarray, shift: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Edit distances of a[:length] and b[:length - shift], or most + 1 where it is more: one pass for all ends, as `banded_distance`."""
    out = most + 1

    def run(i: int, j: int) -> int:
        n, at, step = min(len(a) - i, len(b) - j), 0, 64
        while at < n:
            m = min(step, n - at)
            differ = a[i + at : i + at + m] != b[j + at : j + at + m]
            k = int(differ.argmax())
            if differ[k]:
                return at + k
            at, step = at + m, step * 4
        return max(n, 0)

    reach = {0: run(0, 0)}
    for e in range(int(most.max()) + 1):
        got = np.fromiter((reach.get(int(d), -1) for d in shift), np.int64, len(shift))
        out = np.where((out > most) & (got >= length) & (e <= most), e, out)
        if not ((out > most) & (most > e)).any():
            break
        nxt: dict[int, int] = {}
        for d in range(-e - 1, e + 2):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2) + 1, reach.get(d + 1, -1))
            i = min(i, len(a), len(b) + d)
            if i >= 0 and i - d >= 0:
                nxt[d] = i + run(i, i - d)
        reach = nxt
    return out


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", p: Params = Params()) -> DataFrame:
    """doc_id, item_id, doc_start, doc_end, item_start, item_end, edits, twelve: every verified region of p.units units or more.

    A region begins and ends with p.q characters without an edit; regions that lie in another are not reported.
    Places count characters of the canonical text. twelve: the two whole texts share 12 consecutive units. Null and
    empty texts and texts below p.least have no region; repeated items each report theirs. Without items there are no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, doc_start int, doc_end int, item_start int, item_end int, edits int, twelve boolean"
    sized = items.where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t"))
    blocks = 1 + (sized.agg(F.sum(F.length("t"))).first()[0] or 0) * 2 // p.block
    src = docs.where(F.length(text) >= p.least // 2).select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t"))
    found = None
    for k in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()  # at most about p.block characters
        one = src.mapInArrow(_search(spark.sparkContext.broadcast(Index([r["i"] for r in rows], [r["t"] for r in rows], p)), p), schema)
        found = one if found is None else found.unionByName(one)
    return found


def _search(sent, p: Params):
    def slices(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
        ids, texts, lo, size = b.column(0).to_numpy(), b.column(1).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > 1_000_000:
                yield ids[lo : i + 1], texts[lo : i + 1]
                lo, size = i + 1, 0
        if lo < len(texts):
            yield ids[lo:], texts[lo:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        for whole in batches:
            for ids, texts in slices(whole):
                rows = _matches(ids, texts, index, p)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.bool_()])], names=["doc_id", "item_id", "doc_start", "doc_end", "item_start", "item_end", "edits", "twelve"])

    return run


def _matches(ids: np.ndarray, texts: list[str], index: Index, p: Params) -> list[tuple]:
    chars, at = canonical(texts)
    place, entry = index.hits(qgrams(chars, p.q))
    if not len(place):
        return []
    doc = np.searchsorted(at, place, side="right") - 1
    pair = doc.astype(np.int64) * len(index.ids) + index.item[entry]
    _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
    several = count[which] >= p.needed(p.least)
    place, entry, doc, pair = place[several], entry[several], doc[several], pair[several]
    if not len(place):
        return []
    item = index.item[entry]
    x, y = place - at[doc], index.pos[entry] - index.at[item]
    # each hit counts in the two bands that hold its diagonal, in the lower half of the one and the upper of the other
    half = p.half_band(np.diff(index.at))[item]
    band = (x - y) // half
    lower = np.repeat([True, False], len(band))
    pair, band, x, y, place = np.tile(pair, 2), np.concatenate([band, band - 1]), np.tile(x, 2), np.tile(y, 2), np.tile(place, 2)
    order = np.lexsort((x, x - y, band, pair))
    pair, band, x, y, place, lower = pair[order], band[order], x[order], y[order], place[order], lower[order]
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pair))
    # runs of hits on one diagonal, of all bands
    begin = np.flatnonzero(new | np.concatenate([[True], (np.diff(x) != 1) | (np.diff(y) != 1)]))
    end = np.append(begin[1:], len(pair)) - 1
    spaces = np.concatenate([[0], np.cumsum(chars == 32)])
    size = end - begin + p.q
    whole = (size >= p.least) & (spaces[place[end] + p.q] - spaces[place[begin]] >= p.units - 1)
    of = np.searchsorted(first, begin, side="right") - 1
    bands = len(first)
    # below per_edit characters no edit is allowed and a region is one run; from there on it shares so many q-grams, and
    # of the parts between its edits the longest has so many characters at least
    longest = -(-(p.per_edit - 1) // 2)
    enough = (np.bincount(of, weights=whole, minlength=bands) > 0) | ((last - first >= p.needed(p.per_edit)) & (np.bincount(of, minlength=bands) > 1) & (np.maximum.reduceat(size, np.searchsorted(begin, first)) >= longest))
    # a band without hits in its lower half holds nothing that the next one doesn't
    enough &= np.add.reduceat(lower.astype(np.int64), first) > 0
    found: dict[tuple[int, int], list] = {}
    lo_run = np.searchsorted(begin, first)
    hi_run = np.append(lo_run[1:], len(begin))
    for k in np.flatnonzero(enough):
        d, i = divmod(int(pair[first[k]]), len(index.ids))
        own = begin[lo_run[k] : hi_run[k]]
        by = np.argsort(x[own], kind="stable")
        got = _regions(x[own][by], y[own][by], size[lo_run[k] : hi_run[k]][by], np.unique(x[first[k] : last[k]]), chars[at[d] : at[d + 1]], index.chars[index.at[i] : index.at[i + 1]], spaces[at[d] : at[d + 1] + 1], p)
        if got:
            found.setdefault((d, i), []).extend(got)
    own: dict[int, np.ndarray] = {}
    out = []
    for (d, i), regions in found.items():
        if d not in own:
            own[d] = shingle_sets([texts[d]], 12)[0]
        twelve = bool(len(np.intersect1d(own[d], index.twelve[i], assume_unique=True)))
        out += [(int(ids[d]), int(index.ids[i]), *r, twelve) for r in _outermost(regions)]
    return out


def found(docs: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, item_id): documents and items with a verified region; of these, those whose texts share 12 consecutive units."""
    return leaks(docs, items, p=p).where("twelve").select("doc_id", "item_id").distinct()
