"""Units of a text (longest runs of letters and digits, CJK characters alone) and their hashed runs, by Arrow batch.

Whole batches are handled as arrays of code points; `units` is the plain form of the same rule.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

UNIT = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
#: Texts handled at once; their position takes the upper bits beside a token of TOKEN_BITS.
MOST = 1 << 15
TOKEN_BITS = 48
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D


def units(text: str) -> list[str]:
    return UNIT.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 separates, 1 is a letter or digit, 2 is a unit of its own."""
    kind = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    kind[0x4E00:0xA000] = 2
    return kind


#: Places of the tables of powers.
PLACES = 1 << 19


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of polynomial hashes and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(PLACES, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def run_hashes(chars: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the runs of characters from first to before end, in order and apart from each other."""
    up, down = powers()
    if len(chars) <= PLACES:
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up[: len(chars)], out=sums[1:])
        return mix((sums[end] - sums[first]) * down[first])
    # more characters than the tables have places: in parts between runs
    cuts = np.searchsorted(first, np.arange(0, len(chars), PLACES // 2))
    out = [np.empty(0, np.uint64)]
    for lo, hi in zip(cuts, [*cuts[1:], len(first)]):
        if hi <= lo:
            continue
        if end[hi - 1] - first[lo] <= PLACES:
            out.append(run_hashes(chars[first[lo] : end[hi - 1]], first[lo:hi] - first[lo], end[lo:hi] - first[lo]))
            continue
        for k in range(lo, hi):  # one of them is longer than the tables
            h = np.zeros(1, np.uint64)
            for at in range(int(first[k]), int(end[k]), PLACES):
                part = chars[at : min(at + PLACES, int(end[k]))].astype(np.uint64) + np.uint64(1)
                h = mix(h + (part * up[: len(part)]).sum(keepdims=True))
            out.append(h)
    return np.concatenate(out)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each followed by a line break, and where each text begins (end appended)."""
    low = [t.lower() if t else "" for t in texts]
    chars = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in low), dtype=np.int64, count=len(low)), out=at[1:])
    return chars, at


def unit_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all units of all texts in order, and the number of each text's first among them (end appended)."""
    if not texts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    chars, at = code_points(texts)
    kind = _kinds()[chars]
    # every text ends in a line break, so that runs of letters and digits begin and end in pairs
    edges = np.flatnonzero(np.diff((kind == 1).view(np.int8), prepend=0))
    first, end = edges[0::2], edges[1::2]
    alone = np.flatnonzero(kind == 2)
    if len(alone):
        first, end = np.concatenate([first, alone]), np.concatenate([end, alone + 1])
        order = np.argsort(first, kind="stable")
        first, end = first[order], end[order]
    return run_hashes(chars, first, end), np.searchsorted(first, at)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different hashed runs of `width` units of each text, sorted within it: tokens, start of each text's (end appended)."""
    if len(texts) > MOST:
        parts = [shingle_sets(texts[i : i + MOST], width) for i in range(0, len(texts), MOST)]
        ends = np.cumsum([0, *(len(t) for t, _ in parts)])
        return np.concatenate([t for t, _ in parts]), np.concatenate([*(at[:-1] + e for (_, at), e in zip(parts, ends)), ends[-1:]])
    h, at = unit_hashes(texts)
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    acc = h[:n] * _M[0]
    for j in range(1, width):
        acc = mix(acc) + h[j : j + n] * _M[j % 4]
    acc = mix(acc) >> np.uint64(64 - TOKEN_BITS)
    # a run that begins in the last width - 1 units of a text would reach into the next
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    keep = row[:n] == row[width - 1 :]
    both = (row[:n][keep].astype(np.uint64) << np.uint64(TOKEN_BITS)) | acc[keep]
    both.sort()
    if len(both):
        new = np.ones(len(both), dtype=bool)
        np.not_equal(both[1:], both[:-1], out=new[1:])
        both = both[new]
    tokens = both & np.uint64((1 << TOKEN_BITS) - 1)
    edges = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(TOKEN_BITS))
    return tokens, edges
