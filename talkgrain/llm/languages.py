"""Language of each text and of each stretch in another language, by error-correcting output codes.

Each language has a codeword; one binary classifier a bit is fitted on character trigrams (single characters of CJK) and
on the script a sentence is written in, which is a feature like the others: codewords decide for every language.
A sentence gets the language whose codeword loses least against the classifiers' margins, each bit's loss weighted by
how well its classifier did on held-out sentences. The gap to the next codeword gives the confidence; a small gap marks
the sentence as ambiguous, and it then takes the language of the rest of its text. Texts and stretches without any
sentence that isn't are flagged.

The classifiers are fitted on a bounded sample of labelled rows (`Params.sample`), taken by hash of the id. Labels may
be wrong: sentences the first fit contradicts are left out of the second.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The languages and the codes that name them.
LANGUAGES = ("en", "zh", "de", "fr", "es", "ru")
CODES = {"eng": "en", "zho": "zh", "chi": "zh", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru"}


@dataclass(frozen=True)
class Params:
    """sample: most labelled rows the classifiers are fitted on; bits: length of the codewords; log_features: of the trigram table.

    least_letters: a text of fewer letters gets no language; sentence_letters: a sentence of fewer letters (for CJK a
    third of that) is too short to count as a stretch of its own; gap: least difference in loss between the two nearest codewords, below which a sentence is ambiguous.
    """

    sample: int = 6000
    bits: int = 15
    log_features: int = 14
    least_letters: int = 20
    sentence_letters: int = 18
    gap: float = 2.6


@cache
def codewords(bits: int) -> np.ndarray:
    """(language, bit) of +1 and -1: the columns of the exhaustive code that keep the nearest two rows farthest apart."""
    n = len(LANGUAGES)
    columns = [c for c in range(1, 1 << (n - 1))]
    all_bits = np.array([[1 if (c >> i) & 1 else -1 for c in columns] for i in range(n)])
    best, most = None, -1
    rng = np.random.default_rng(7)
    for _ in range(400):
        pick = np.sort(rng.permutation(len(columns))[:bits])
        code = all_bits[:, pick]
        near = min(int((code[i] != code[j]).sum()) for i, j in combinations(range(n), 2))
        if near > most:
            best, most = code, near
    return best


_ODD = re.compile(r"[^\x00-\x7f -ÿЀ-ӿ一-鿿　-〿！-～’“”–—…]|[ ­Ａ-Ｚａ-ｚ０-９]")
_HIDDEN = re.compile(r"[​-‍⁠﻿­]")
_TAG = re.compile(r"&(?:amp|lt|gt|quot|#x27|#39);|https?://\S+|\S+@\S+|#\w+")


def plain(text: str | None) -> str:
    """Compatibility forms, separate marks and invisible characters brought to plain letters; links and tags blanked."""
    if not text:
        return ""
    if _ODD.search(text):
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    if "&" in text or "@" in text or "#" in text or "//" in text:
        text = _TAG.sub(" ", text)
    return text


_BREAK = re.compile(r"(?<=[.!?…])[\"”»')\]]*\s+|(?<=[。！？])|\s/\s|\n|\s[—–|•]\s|;\s")


def sentences(text: str) -> list[str]:
    return [s for s in _BREAK.split(text) if s and not s.isspace()]


@cache
def _kinds() -> np.ndarray:
    kind = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    kind[0x4E00:0xA000] = 2
    return kind


def features(parts: list[str], log_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram of each place of all parts, start of each part's (end appended), and each part's letters, CJK letters and Cyrillic letters."""
    low = [p.lower() for p in parts]
    chars = np.frombuffer(("  " + "  ".join(low) + "  ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(t) + 2 for t in low), dtype=np.int64, count=len(low)), out=at[1:])
    kind = _kinds()[chars]
    c = np.where(kind > 0, chars, np.uint32(32)).astype(np.uint32)
    tri = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35)
    mid = kind[1:-1]
    tri = np.where(mid == 2, c[1:-1] * np.uint32(0x27D4EB2F), tri)
    tri ^= tri >> np.uint32(15)
    tri *= np.uint32(0x2C1B3C6D)
    index = (tri >> np.uint32(32 - log_features)).astype(np.int64)
    if not len(low):
        none = np.zeros(0, np.int64)
        return index[:0], at, none, none, none
    letters = np.add.reduceat((mid > 0).astype(np.int64), at[:-1])
    cjk = np.add.reduceat((mid == 2).astype(np.int64), at[:-1])
    cyrillic = np.add.reduceat(((mid == 1) & (c[1:-1] >= 0x400) & (c[1:-1] < 0x530)).astype(np.int64), at[:-1])
    # Latin words within a sentence of another script are names
    latin = (mid == 1) & (c[1:-1] < 0x370)
    other = letters - np.add.reduceat(latin.astype(np.int64), at[:-1])
    foreign = np.repeat(other * 6 >= letters, np.diff(at))
    foreign = np.append(foreign, np.zeros(len(latin) - len(foreign), bool))
    index = np.where((mid == 0) | (latin & foreign), 1 << log_features, index)  # a row of zeros
    return index[: at[-1]], at, letters, cjk, cyrillic


#: Scripts: neither, CJK or Cyrillic in a quarter of the letters or more.
SCRIPTS = 3


def script_of(letters: np.ndarray, cjk: np.ndarray, cyrillic: np.ndarray) -> np.ndarray:
    return np.where((cjk > 0) & (cjk * 4 >= letters), 1, np.where((cyrillic > 0) & (cyrillic * 4 >= letters), 2, 0))


def margins(index: np.ndarray, at: np.ndarray, letters: np.ndarray, weights: np.ndarray, kind: np.ndarray, scripts: np.ndarray) -> np.ndarray:
    if len(at) < 2:
        return np.zeros((0, weights.shape[1]), np.float32)
    return np.add.reduceat(weights[index], at[:-1], axis=0) / np.sqrt(np.maximum(letters, 1))[:, None] + scripts[kind]


@dataclass
class Model:
    """weights: (trigram, bit), the last row zeros; scripts: (script, bit); trust: weight of each bit."""

    weights: np.ndarray
    scripts: np.ndarray
    trust: np.ndarray
    p: Params

    def decode(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword by weighted logistic loss, its confidence, and the gap to the next."""
        code = codewords(self.p.bits)
        loss = np.einsum("b,scb->sc", self.trust, np.logaddexp(0, -z[:, None, :] * code[None, :, :]))
        order = np.sort(loss, axis=1)
        odds = np.exp(-(loss - order[:, :1]) * 2)
        return loss.argmin(axis=1), 1 / odds.sum(axis=1), order[:, 1] - order[:, 0]


def fit(texts: list[str], labels: list[str], p: Params) -> Model:
    parts, y = [], []
    for t, lab in zip(texts, labels):
        for s in sentences(plain(t)):
            parts.append(s)
            y.append(LANGUAGES.index(lab))
    index, at, letters, cjk, cyrillic = features(parts, p.log_features)
    kind = script_of(letters, cjk, cyrillic)
    y = np.array(y, dtype=np.int64)
    size, code = (1 << p.log_features) + 1, codewords(p.bits)
    use = letters >= 8
    held = use & (np.arange(len(y)) % 5 == 0)
    train = use & ~held
    n = np.bincount(y[train], minlength=len(LANGUAGES)).clip(1)
    balance = (len(y) / len(LANGUAGES) / n)[y]
    row = np.repeat(np.arange(len(y)), np.diff(at))
    norm = 1 / np.sqrt(np.maximum(letters, 1))
    weights = np.zeros((size, p.bits), np.float32)
    seen = np.full((size, p.bits), 1e-2, np.float32)
    scripts, seen_scripts = np.zeros((SCRIPTS, p.bits), np.float32), np.full((SCRIPTS, p.bits), 1e-2, np.float32)
    for step in range(36):
        z = margins(index, at, letters, weights, kind, scripts)
        if step == 20:  # leave out what the first fit contradicts
            got = Model(weights, scripts, np.ones(p.bits) / p.bits, p).decode(z)[0]
            train &= got == y
            held &= got == y
        target = code[y]
        whole = target / (1 + np.exp(np.clip(z * target, -30, 30))) * (balance * train)[:, None]
        pull = whole * norm[:, None]
        grad = np.stack([np.bincount(index, weights=pull[row, b], minlength=size) for b in range(p.bits)], axis=1).astype(np.float32)
        grad -= 1e-3 * weights
        grad[-1] = 0
        seen += grad * grad
        weights += 2.0 * grad / np.sqrt(seen)
        grad = np.stack([np.bincount(kind, weights=whole[:, b], minlength=SCRIPTS) for b in range(p.bits)], axis=1).astype(np.float32) - 1e-3 * scripts
        seen_scripts += grad * grad
        scripts += 2.0 * grad / np.sqrt(seen_scripts)
    z = margins(index, at, letters, weights, kind, scripts)
    right = ((z * code[y] > 0) & held[:, None]).sum(axis=0) / max(1, held.sum())
    trust = np.maximum(right - 0.5, 0.05)
    return Model(weights, scripts, trust / trust.sum() * 3, p)


def label_code(label: Column) -> Column:
    """The language a label names, however the code is spelled; null when it names none of the six."""
    low = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,3})(?:$|[-_].*)", 1)
    named = F.create_map(*[F.lit(x) for pair in [*CODES.items(), *((c, c) for c in LANGUAGES)] for x in pair])
    return F.try_element_at(named, low)


def train(df: DataFrame, id_col: str, text: str, label: str, p: Params) -> Model:
    """Fit on at most p.sample rows with a label, those first by hash of the id."""
    known = df.where(label_code(F.col(label)).isNotNull())
    rows = known.select(F.col(text).alias("t"), label_code(F.col(label)).alias("l"), F.xxhash64(id_col).alias("h")).where(F.length("t") > 20)
    n = known.count()
    if n > 2 * p.sample:  # keep what each task sends to the driver to its part of the sample
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int(2 * p.sample / n * (1 << 30))))
    got = rows.orderBy("h").limit(p.sample).collect()
    return fit([r["t"] for r in got], [r["l"] for r in got], p)


def assign(df: DataFrame, id_col: str, text: str, model: Model) -> DataFrame:
    """id, letters, lang, confidence, ambiguous, segments (lang, confidence, ambiguous, text): each text's language, and its stretches in order.

    Neighbouring sentences of one language form a stretch. lang is that of most letters. ambiguous: no sentence of the
    text's language, or of the stretch, is long and clear enough to tell. Null, empty and letterless texts get a null
    language and no stretches; texts of any length are read whole.
    """
    p, sent = model.p, df.sparkSession.sparkContext.broadcast(model)
    src = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, letters int, lang string, confidence double, ambiguous boolean, segments array<struct<lang:string,confidence:double,ambiguous:boolean,text:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                texts = b.column(1).to_pylist()
                split = [sentences(plain(t)) for t in texts]
                parts = [s for x in split for s in x]
                which, conf, gap, letters, cjk = _decide(parts, m)
                strong = (gap >= p.gap) & ((letters >= p.sentence_letters) | (cjk * 3 >= p.sentence_letters))
                row = np.repeat(np.arange(len(split)), [len(x) for x in split])
                n = np.bincount(row, weights=letters, minlength=len(split)).astype(np.int64)
                # links and tags count as letters too where that may decide
                for k in np.flatnonzero(n < p.least_letters):
                    n[k] = sum(map(str.isalpha, texts[k])) if texts[k] else 0
                lang, sure, vague, ends, segments = _stretches(parts, row, len(split), which, conf, strong, letters + 2 * cjk)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), lang, sure, vague, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), segments)], names=["id", "letters", "lang", "confidence", "ambiguous", "segments"])

    return src.mapInArrow(run, schema)


def _decide(parts: list[str], m: Model) -> tuple[np.ndarray, ...]:
    if not parts:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero, zero, zero
    index, at, letters, cjk, cyrillic = features(parts, m.p.log_features)
    which, conf, gap = m.decode(margins(index, at, letters, m.weights, script_of(letters, cjk, cyrillic), m.scripts))
    return which, conf, gap, letters, cjk


def _stretches(parts: list[str], row: np.ndarray, rows: int, which: np.ndarray, conf: np.ndarray, strong: np.ndarray, weight: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray, pa.StructArray]:
    """Of the texts of a batch: language, confidence and ambiguity, end of each text's stretches, and all stretches.

    row: the text of each sentence. Weak sentences join the stretch before them, else take the main language of the text.
    """
    k = len(LANGUAGES)
    total = np.bincount(row, weights=weight, minlength=rows)
    votes = np.bincount(row * k + which, weights=weight * conf * (1 + 4 * strong), minlength=rows * k).reshape(rows, k)
    main, none = votes.argmax(axis=1), total == 0
    same = which == main[row]
    sure = np.bincount(row, weights=conf * weight * same, minlength=rows) / np.maximum(total, 1e-9)
    vague = np.bincount(row, weights=strong & same, minlength=rows) == 0
    names = pa.array(LANGUAGES)
    lang, sure, vague = (pa.array(x, mask=none) for x in (main, sure, vague))
    lang = names.take(lang)
    # the latest strong sentence of the same text decides
    own = np.flatnonzero(~none[row])
    row, which, conf, strong, weight = row[own], which[own], conf[own], strong[own], weight[own].astype(np.float64) + 1e-9
    last = np.maximum.accumulate(np.where(strong, np.arange(len(own)), -1)) if len(own) else own
    told = np.where((last >= 0) & (row[np.maximum(last, 0)] == row), which[np.maximum(last, 0)], main[row]) if len(own) else own
    first = np.flatnonzero(np.concatenate([[True], (told[1:] != told[:-1]) | (row[1:] != row[:-1])])) if len(own) else own
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own))))
    mine = which == told
    share = np.bincount(of, weights=conf * weight * mine, minlength=len(first)) / np.maximum(np.bincount(of, weights=weight * mine, minlength=len(first)), 1e-12)
    clear = np.bincount(of, weights=strong & mine, minlength=len(first)) > 0
    stop = np.append(first[1:], len(own))
    texts = [" ".join([parts[j].strip() for j in own[lo:hi]]) for lo, hi in zip(first, stop)]
    segments = pa.StructArray.from_arrays([names.take(pa.array(told[first])), pa.array(share), pa.array(~clear), pa.array(texts, pa.string())], names=["lang", "confidence", "ambiguous", "text"])
    return lang, sure, vague, np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=rows))]), segments


def message_languages(messages: DataFrame, p: Params = Params()) -> DataFrame:
    """assign() of messages.content, with the language the row's label names (label, null for none)."""
    model = train(messages, "row_id", "content", "lang", p)
    src = messages.select("row_id", "content", label_code(F.col("lang")).alias("label"), F.col("lang").alias("raw"))
    got = assign(src.select(F.struct("row_id", F.coalesce("label", F.lit("")).alias("label")).alias("key"), "content"), "key", "content", model)
    return got.select(F.col("id.row_id").alias("row_id"), F.nullif(F.col("id.label"), F.lit("")).alias("label"), "letters", "lang", "confidence", "ambiguous", "segments")


def found(messages: DataFrame, p: Params = Params()) -> DataFrame:
    """(row_id, lang): languages of texts whose label is missing or wrong, or that use several."""
    rows = message_languages(messages, p).where(F.col("lang").isNotNull())
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    wrong = (F.col("letters") >= p.least_letters) & (F.col("label").isNull() | ~F.array_contains(langs, F.coalesce("label", F.lit(""))))
    return rows.where(wrong | (F.size(langs) > 1)).select("row_id", F.explode(langs).alias("lang"))
