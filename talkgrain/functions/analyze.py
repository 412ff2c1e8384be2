"""Analyzers: a text Column to an array of tokens, in order and with repeats.

Runs of CJK characters give overlapping pairs (a lone character stays), other runs of letters, digits and underscores
are lower-cased; shorter ones than `least` are dropped. A profile may leave out stop-words and have Porter stems taken
(`stemmed`); both change phrase positions and are off by default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CJK = "\\u4e00-\\u9fff"
# Words left out by the profile with stop-words.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "have", "if", "in", "is", "it", "may", "not", "of", "on", "or", "tbd", "that", "the", "this", "to", "us", "we", "when", "will", "with", "yet", "you", "your", "的", "了", "和")


@dataclass(frozen=True)
class Profile:
    """least: characters of a token; stored: tokens are read, not made, and rows have their month (`SearchIndex`).

    segment: an optional segmenter, called with a run of CJK characters in the executors, in place of pairs.
    """

    least: int = 2
    stop_words: bool = False
    stem: bool = False
    stored: bool = False
    segment: Callable[[str], list[str]] | None = None


PLAIN = Profile()


def tokens(c: Column, p: Profile = PLAIN) -> Column:
    spaced = F.regexp_replace(F.lower(c), f"([{CJK}]+)", " $1 ")
    runs = F.regexp_extract_all(spaced, F.lit(r"[\p{L}\p{N}_]+"), 0)
    cjk = lambda r: r.rlike(f"^[{CJK}]")
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
    parts = F.transform(runs, lambda r: F.when(cjk(r) & (F.length(r) > 1), pairs(r)).otherwise(F.array(r)))
    out = F.filter(F.flatten(parts), lambda t: (F.length(t) >= p.least) | cjk(t))
    if p.stop_words:
        out = F.filter(out, lambda t: ~t.isin(*STOP_WORDS))
    return out


def sender_tokens(c: Column) -> Column:
    """Words of two or more characters, without stop-words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def stemmed(df: DataFrame, column: str = "tokens") -> DataFrame:
    """df with the stems of a column of tokens, by Arrow batch and once for each different token of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            lists = b.column(at)
            words = lists.flatten().dictionary_encode()
            stems = pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
            offsets = pc.subtract(lists.offsets, lists.offsets[0])
            cols = list(b.columns)
            cols[at] = pa.ListArray.from_arrays(offsets, stems, mask=lists.is_null() if lists.null_count else None)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def segmented(df: DataFrame, p: Profile, content: str = "content", column: str = "tokens") -> DataFrame:
    """df with tokens whose CJK runs are cut by p.segment, by Arrow batch and once for each different run of it."""
    runs = F.regexp_extract_all(F.regexp_replace(F.lower(content), f"([{CJK}]+)", " $1 "), F.lit(r"[\p{L}\p{N}_]+"), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            known: dict[str, list[str]] = {}
            out = []
            for row in b.column(at).to_pylist():
                words = []
                for r in row or ():
                    if r not in known:
                        known[r] = [w for w in p.segment(r) if w.strip()] if "\u4e00" <= r[0] <= "\u9fff" else [r] * (len(r) >= p.least)
                    words += known[r]
                out.append([w for w in words if not (p.stop_words and w in STOP_WORDS)])
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    rows = df.withColumn(column, runs)
    return rows.mapInArrow(run, rows.schema)


# Porter's algorithm (1980): suffix rules by step, conditions on the measure of what precedes the suffix.


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and not _vowel(w, len(w) - 1) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 3) and w[-1] not in "wxy"


# Suffixes and what replaces them.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _replace(w: str, rules: dict[str, str]) -> str:
    for s in sorted(rules, key=len, reverse=True):
        if w.endswith(s):
            return w[: -len(s)] + rules[s] if _measure(w[: -len(s)]) > 0 else w
    return w


@lru_cache(1 << 16)
def stem(w: str) -> str:
    """Porter stem of a lower-case English word; other words come back as they are."""
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    for s, r in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(s):
            w = w[: -len(s)] + r
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and _has_vowel(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2), _STEP3)
    for s in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(s):
            if _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
                w = w[: -len(s)]
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if _double(w) and w[-1] == "l" and _measure(w) > 1 else w
