"""Sentences of texts and their terms, by Arrow batch, over arrays of code points.

A sentence ends at end marks before white space (not behind an initial), at CJK end marks, line breaks and single bars or
slashes between spaces. Speakers behind a time in brackets belong to no sentence, pieces without letters are none.
Terms are words without digits and pairs of neighbouring CJK characters, as 32-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np

from talkgrain.llm.units import PLACES, mix, run_hashes

_SPEAKER = re.compile(r"\[\d\d?:\d\d\][^\S\n]*(?:[^:\n]{1,40}:)?")
#: Characters of one pass.
PASS = PLACES // 2
# Classes of characters, as bits.
LETTER, UPPER, CJK, DIGIT, OTHER, SPACE, FULL, END, BAR, CLOSER = (1 << k for k in range(10))


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point its classes and its lower case (first character)."""
    kind, low = np.zeros(0x110000, np.uint16), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalnum():
            kind[c] = (LETTER if s.isalpha() else DIGIT if 48 <= c <= 57 else OTHER) | (UPPER if s.isupper() else 0)
            low[c] = ord(s.lower()[0])
        elif s.isspace():
            kind[c] = SPACE
    kind[0x4E00:0xA000] = LETTER | CJK
    for marks, bit in ((".!?…", END), ("。！？\n", FULL), ("/—–|•", BAR), ("\"”»')]", CLOSER)):
        for m in marks:
            kind[ord(m)] |= bit
    return kind, low


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in order of sentence, the number of each sentence's terms, the text of each sentence, and each text's sentences.

    Sentences without terms are left out of the second and third, but counted in the last.
    """
    clean = [(_SPEAKER.sub("", t) if "[" in t else t) if t else "" for t in texts]
    raw = np.frombuffer(("\n" + "\n".join(clean) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.cumsum([1, *(len(t) + 1 for t in clean)])
    table, low = _classes()
    kind = table[raw]
    alnum, cjk, space = (kind & (LETTER | DIGIT | OTHER)) > 0, (kind & CJK) > 0, (kind & SPACE) > 0
    stop = (kind & FULL) > 0
    before = np.flatnonzero(space[1:] & ((kind[:-1] & (END | CLOSER)) > 0))
    mark = before.copy()
    for _ in range(3):  # quotation marks and brackets may stand between the end mark and the space
        mark -= (kind[mark] & CLOSER) > 0
    end = (kind[mark] & END) > 0
    initial = ((kind[mark - 1] & UPPER) > 0) & ~alnum[mark - 2]
    stop[before[end & ~initial] + 1] = True
    bar = np.flatnonzero((kind & BAR) > 0)
    stop[bar[space[bar - 1] & space[bar + 1]]] = True
    stops = np.flatnonzero(stop)
    word = alnum & ~cjk
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    first, last = edges[0::2], edges[1::2]
    digits = np.flatnonzero((kind & DIGIT) > 0)
    plain = np.searchsorted(digits, first) == np.searchsorted(digits, last)
    pair = np.flatnonzero(cjk[:-1] & cjk[1:])
    words = run_hashes(low[raw], first, last)[plain] if len(first) else np.empty(0, np.uint64)
    pairs = mix(raw[pair].astype(np.uint64) << np.uint64(32) | raw[pair + 1].astype(np.uint64))
    terms = (np.concatenate([words, pairs]) >> np.uint64(32)).astype(np.uint32)
    piece = np.searchsorted(stops, np.concatenate([first[plain], pair]))
    order = np.argsort(piece, kind="stable")
    n = np.bincount(piece, minlength=len(stops))
    letters = np.searchsorted(np.flatnonzero((kind & LETTER) > 0), stops)
    whose = np.minimum(np.searchsorted(at, stops, side="right") - 1, max(len(texts) - 1, 0))
    sentences = np.bincount(whose[np.diff(letters, prepend=0) > 0], minlength=len(texts))
    has = n > 0
    return terms[order], n[has], whose[has], sentences


def slices(texts: list[str | None]) -> Iterator[slice]:
    """Parts of a batch of about PASS characters, each of whole texts."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= PASS:
            yield slice(lo, i + 1)
            lo, size = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))
