"""Search over messages: filter, newest first, pages, totals, highlights, titles."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrain.functions.analyze import PLAIN, Profile, segmented, stemmed, tokens
from talkgrain.functions.ids import message_url, share_id, url_msg, url_share
from talkgrain.functions.text import escape, unescape
from talkgrain.plans.compiling import condition, needed, words_of
from talkgrain.plans.language import And, Or, Phrase, Term, parse

PAGE = 10


def stored(messages: DataFrame) -> DataFrame:
    """One row of each message as delivered: chat_id (share id), msg_id, url (canonical), sender, content (unescaped), post_time.

    The copy with the latest time is taken, among equals that of the smallest row_id (which must be unique); rows naming
    no message are left out. Copies are found by keys and times alone; texts follow by row_id, once.
    """
    rows = messages.select(
        F.coalesce(url_share(F.col("url")), share_id(F.col("chat_id"))).alias("chat_id"), url_msg(F.col("url")).alias("msg_id"),
        "post_time", "row_id", F.coalesce("sender", F.lit("")).alias("sender"), F.coalesce("content", F.lit("")).alias("content"),
    ).where(F.col("msg_id").isNotNull() & F.col("chat_id").isNotNull())
    best = rows.groupBy("chat_id", "msg_id").agg((-F.max(F.struct("post_time", (-F.col("row_id")).alias("r")))["r"]).alias("row_id"))
    kept = rows.join(best.select("row_id"), "row_id", "left_semi")
    return kept.select("chat_id", "msg_id", message_url(F.col("chat_id"), F.col("msg_id")).alias("url"), "sender", unescape(F.col("content")).alias("content"), "post_time")


def indexed(messages: DataFrame, p: Profile = PLAIN) -> DataFrame:
    """Messages with their tokens; `sources.index.SearchIndex` keeps them, tokenising per query is dear."""
    rows = segmented(messages, p) if p.segment else messages.withColumn("tokens", tokens(F.col("content"), p))
    return stemmed(rows) if p.stem else rows


def search(index: DataFrame, query: str, chats: Iterable[int] | None = None, p: Profile = PLAIN) -> DataFrame:
    """All matching messages; chats restricts to some, None and an empty list to none. Not ordered."""
    ids = sorted(set(chats or ()))
    rows = index.where(F.col("chat_id").isin(*ids)) if ids else index
    tree = parse(query)
    first = needed(tree, p)  # spares making the tokens of rows without the words
    return (rows if first is None else rows.where(first)).where(condition(tree, p))


def newest_first() -> list[Column]:
    """The order of results: time, then chat and message id, so that it is fixed."""
    return [F.col("post_time").desc_nulls_last(), F.col("chat_id"), F.col("msg_id")]


def page(hits: DataFrame, number: int = 1, length: int = PAGE) -> DataFrame:
    """A page of hits; beyond the end the last one. Top-k with offset, no ranking of all rows."""
    if number > 1:
        total = hits.count()
        number = min(number, max(1, -(-total // length)))
    return hits.orderBy(*newest_first()).offset((max(number, 1) - 1) * length).limit(length)


def totals(hits: DataFrame, number: int = 1, length: int = PAGE) -> DataFrame:
    """total_results, pages, has_prev, has_next for a page number."""
    t = hits.agg(F.count("*").alias("total_results")).withColumn("pages", F.ceil(F.col("total_results") / length).cast("bigint"))
    at = F.least(F.lit(number), F.greatest(F.col("pages"), F.lit(1)))
    return t.select("total_results", "pages", (at > 1).alias("has_prev"), (at < F.col("pages")).alias("has_next"))


def query_words(query: str, p: Profile = PLAIN) -> list[str]:
    """Words of a query that hits show, those under NOT left out."""
    def of(node) -> list[str]:
        if isinstance(node, (And, Or)):
            return [w for x in node.parts for w in of(x)]
        return words_of(node.text, p) if isinstance(node, (Term, Phrase)) and node.field == "content" else []

    return sorted(set(of(parse(query))))


def highlight(c: Column, words: list[str]) -> Column:
    """HTML with matching words in bold; a CJK word is marked where it occurs in a run. Pieces are escaped one by one."""
    if not words:
        return escape(c)
    cjk = sorted((w for w in words if "一" <= w[0] <= "鿿"), key=len, reverse=True)
    other = [w for w in words if w not in cjk]
    pattern = ("|".join(cjk) + "|" if cjk else "") + r"[\x{4e00}-\x{9fff}]|[\p{L}\p{N}_&&[^\x{4e00}-\x{9fff}]]+|[^\p{L}\p{N}_]+"
    pieces = F.regexp_extract_all(c, F.lit(pattern), 0)
    hit = lambda x: F.lower(x).isin(*other, *cjk)
    return F.array_join(F.transform(pieces, lambda x: F.when(hit(x), F.concat(F.lit("<b>"), escape(x), F.lit("</b>"))).otherwise(escape(x))), "")


def fragments(c: Column, words: list[str], size: int = 200, context: int = 20, most: int = 3) -> Column:
    """HTML of the best pieces of a text, those with most words first: up to `size` characters from `context` before a word, escaped and marked.

    Pieces don't overlap; among equals the earlier comes first. Without words, or where none occurs, the head of the text.
    """
    head = highlight(F.substring(c, 1, size), words)
    if not words:
        return head
    word = "(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"
    longest = max(map(len, words))
    pieces = F.regexp_extract_all(c, F.lit(rf"(?is).{{0,{context}}}{word}.{{0,{max(size - context - longest, 0)}}}"), 0)
    hits = lambda x: F.size(F.regexp_extract_all(x, F.lit(f"(?i){word}"), 0))
    ranked = F.sort_array(F.transform(pieces, lambda x, i: F.struct((-hits(x)).alias("n"), i.alias("i"), x.alias("t"))))
    shown = F.transform(F.slice(ranked, 1, most), lambda x: highlight(x["t"], words))
    return F.when(F.size(pieces) > 0, F.array_join(shown, " … ")).otherwise(head)


def with_titles(rows: DataFrame, chats: DataFrame, unknown: str = "[unknown chat]") -> DataFrame:
    """rows with the title of their chat, or a stand-in. chats: chat_id, title with one row a chat."""
    return rows.join(chats.select("chat_id", "title"), "chat_id", "left").withColumn("title", F.coalesce("title", F.lit(unknown)))
