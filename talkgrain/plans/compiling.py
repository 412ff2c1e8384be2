"""Trees of the search language to one boolean Column over a table of messages with `tokens`."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkgrain.functions.analyze import PLAIN, STOP_WORDS, Profile, sender_tokens, stem
from talkgrain.plans.language import And, Every, Not, Nothing, Or, Phrase, Range, Term, Wildcard


def words_of(text: str, p: Profile = PLAIN) -> list[str]:
    """What analyze.tokens makes of a text, on the driver, for queries."""
    out = []
    for run in re.findall(r"[一-鿿]+|[^\W一-鿿]+", text.lower()):
        if "一" <= run[0] <= "鿿" and p.segment:
            out += [w for w in p.segment(run) if w.strip()]
        elif "一" <= run[0] <= "鿿":
            out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
        elif len(run) >= p.least:
            out.append(run)
    if p.stop_words:
        out = [w for w in out if w not in STOP_WORDS]
    return [stem(w) for w in out] if p.stem else out


def pattern_of(wildcard: str) -> str:
    """A whole-token regular expression: * is any run, ? one character."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in wildcard.lower()) + "$"


def period(text: str) -> tuple[datetime, datetime] | None:
    """First instant of a date of 4 to 14 digits and of what follows its period."""
    d = re.sub(r"[-:T ]", "", text)
    if not d.isdigit() or len(d) not in (4, 6, 8, 10, 12, 14):
        return None
    parts = [int(d[:4]), *(int(d[i : i + 2]) for i in range(4, len(d), 2))]
    try:
        lo = datetime(*(parts + [1, 1])[: max(3, len(parts))]) if len(parts) < 3 else datetime(*parts)
        if len(parts) == 1:
            return lo, datetime(lo.year + 1, 1, 1)
        if len(parts) == 2:
            return lo, datetime(lo.year + lo.month // 12, lo.month % 12 + 1, 1)
        return lo, lo + (timedelta(days=1), timedelta(hours=1), timedelta(minutes=1), timedelta(seconds=1))[len(parts) - 3]
    except (ValueError, OverflowError):
        return None


def _both(cols: list[Column]) -> Column:
    return reduce(Column.__and__, cols, F.lit(True)) if cols else F.lit(False)


def compile_query(node, p: Profile = PLAIN) -> Column:
    """Rows that match; never null. Terms without tokens (stop-words) match nothing."""
    return F.coalesce(_compile(node, p), F.lit(False))


def condition(node, p: Profile = PLAIN) -> Column:
    """As compile_query, but null where nothing is known: for a filter, which can send its parts on to the scan."""
    return _compile(node, p)


def needed(node, p: Profile = PLAIN) -> Column | None:
    """A cheap condition on content that every match meets: its words occur in it. None where there is none."""
    if p.stem or p.stored or isinstance(node, Not):
        return None
    if isinstance(node, (And, Or)):
        parts = [needed(x, p) for x in node.parts]
        if isinstance(node, Or) and any(x is None for x in parts):
            return None
        parts = [x for x in parts if x is not None]
        return reduce(Column.__or__ if isinstance(node, Or) else Column.__and__, parts) if parts else None
    if isinstance(node, (Term, Phrase)) and node.field == "content":
        words = [node.text] if isinstance(node, Term) and node.exact else words_of(node.text, p)
        return reduce(Column.__and__, [F.lower("content").contains(w) for w in words]) if words else None
    return None


def _compile(node, p: Profile) -> Column:
    if isinstance(node, And):
        return reduce(Column.__and__, [_compile(x, p) for x in node.parts])
    if isinstance(node, Or):
        return reduce(Column.__or__, [compile_query(x, p) for x in node.parts])
    if isinstance(node, Not):
        return ~compile_query(node.part, p)
    if isinstance(node, Nothing):
        return F.lit(False)
    if isinstance(node, Every):
        return F.lit(True) if not node.field else F.length(F.col(node.field).cast("string")) > 0
    if isinstance(node, Range):
        return _range(node, p)
    if node.field in ("url", "chat_id", "post_time"):
        return _plain(node, p)
    have = F.col("tokens") if node.field == "content" else sender_tokens(F.col("sender"))
    own = p if node.field == "content" else Profile()
    if isinstance(node, Wildcard):
        if node.pattern.endswith("*") and not re.search(r"[*?]", node.pattern[:-1]):
            return F.exists(have, lambda t: t.startswith(node.pattern[:-1].lower()))
        return F.exists(have, lambda t: t.rlike(pattern_of(node.pattern)))
    if isinstance(node, Term):
        return _words(have, [node.text] if node.exact else words_of(node.text, own), node.field)
    assert isinstance(node, Phrase)
    words = words_of(node.text, own)
    if len(words) < 2:
        return _words(have, words, node.field)
    if not node.slop:
        return F.concat(F.lit(" "), F.array_join(have, " "), F.lit(" ")).contains(f" {' '.join(words)} ")
    return _near(have, words, node.slop)


def _words(have: Column, words: list[str], field: str) -> Column:
    # a lone CJK character is no token of a longer run
    return _both([F.col(field).contains(w) if len(w) == 1 and "一" <= w <= "鿿" else F.array_contains(have, w) for w in words])


def _near(have: Column, words: list[str], slop: int) -> Column:
    """Words in this order, each at most slop + 1 places behind the one before."""
    places = F.sequence(F.lit(1), F.greatest(F.size(have), F.lit(1)))

    def after(prior: Column, word: str) -> Column:
        return F.filter(places, lambda i: (F.try_element_at(have, i) == word) & F.exists(prior, lambda j: (i > j) & (i - j <= slop + 1)))

    return F.size(reduce(after, words[1:], F.filter(places, lambda i: F.try_element_at(have, i) == words[0]))) > 0


def _plain(node, p: Profile) -> Column:
    c = F.col(node.field)
    text = node.pattern if isinstance(node, Wildcard) else node.text
    if isinstance(node, Wildcard):
        return c.cast("string").rlike(pattern_of(text) if node.field != "url" else "^" + pattern_of(text)[1:])
    if node.field == "url":
        return c == text
    if node.field == "chat_id":
        return c == F.lit(text).try_cast("bigint")
    span = period(text)
    return _months(p, *span) & (c >= F.lit(span[0]).cast("timestamp_ntz")) & (c < F.lit(span[1]).cast("timestamp_ntz")) if span else F.lit(False)


def _months(p: Profile, lo: datetime | None, hi: datetime | None) -> Column:
    """What a span of time says of the month, by which stored rows lie in folders; true for rows that aren't stored."""
    out = F.lit(True)
    if p.stored and lo:
        out = out & (F.col("month") >= f"{lo:%Y-%m}")
    if p.stored and hi:
        out = out & (F.col("month") <= f"{hi:%Y-%m}")
    return out


def _range(node: Range, p: Profile) -> Column:
    c, out = F.col(node.field), F.lit(True)
    if node.field == "post_time":
        lo, hi = period(node.lo or ""), period(node.hi or "")
        if (node.lo and not lo) or (node.hi and not hi):
            return F.lit(False)
        out = out & _months(p, lo and lo[0], hi and hi[1])
        if lo:
            out = out & (c >= F.lit(lo[0] if node.with_lo else lo[1]).cast("timestamp_ntz"))
        if hi:
            out = out & (c < F.lit(hi[1] if node.with_hi else hi[0]).cast("timestamp_ntz"))
        return out & c.isNotNull()
    cast = (lambda v: F.lit(v).try_cast("bigint")) if node.field == "chat_id" else F.lit
    if node.lo:
        out = out & (c >= cast(node.lo) if node.with_lo else c > cast(node.lo))
    if node.hi:
        out = out & (c <= cast(node.hi) if node.with_hi else c < cast(node.hi))
    return out & c.isNotNull()
