"""Catalogue of chats: titles, counts, newest messages, status report, title search, a random message."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.functions.ids import share_id, share_number
from talkgrain.functions.text import brief, chat_label, strip
from talkgrain.session import durable


class EntityNotFound(KeyError):
    """No chat has that id or name."""


def titles(dialogs: DataFrame) -> DataFrame:
    """chat_id, title (stripped): of dialogs with a name; among repeated ids the first title in order."""
    rows = dialogs.select(F.col("id").alias("chat_id"), strip(F.col("name")).alias("title")).where(F.length("title") > 0)
    return rows.groupBy("chat_id").agg(F.min("title").alias("title"))


def counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id").agg(F.count("*").alias("n"))


def distinct_chats(messages: DataFrame) -> DataFrame:
    return messages.select("chat_id").distinct()


def newest(messages: DataFrame) -> DataFrame:
    """chat_id, msg_id, post_time, content of each chat's newest message, equal times by smaller msg id; null times are oldest."""
    m = F.max(F.struct("post_time", (-F.col("msg_id")).alias("r"), "content")).alias("m")
    return messages.groupBy("chat_id").agg(m).select("chat_id", (-F.col("m.r")).alias("msg_id"), "m.post_time", "m.content")


def matching(chats: DataFrame, keyword: str = "", case: bool = True, most: int | None = None) -> DataFrame:
    """chat_id, title, label of chats whose title holds the keyword; most: the first so many by id."""
    key = strip(F.lit(keyword))
    held = F.col("title").contains(key) if case else F.lower("title").contains(F.lower(key))
    rows = chats.where(held).select("chat_id", "title", chat_label(F.col("title"), F.col("chat_id")).alias("label"))
    return rows if most is None else rows.orderBy("chat_id").limit(most)


def resolve(chats: DataFrame, name: str) -> int:
    """Share id for an id or a title as typed."""
    text = name.strip()
    if re.fullmatch(r"-?\d+", text):
        return share_number(int(text))
    row = chats.where(F.col("title") == text).agg(F.min("chat_id")).first()
    if row[0] is None:
        raise EntityNotFound(name)
    return row[0]


def resolved(names: DataFrame, chats: DataFrame, name: str = "name") -> DataFrame:
    """names with chat_id: the share id of each id or title as typed (the least of several chats), null where unknown."""
    text = strip(F.col(name))
    of_title = chats.groupBy(F.col("title").alias("_title")).agg(F.min("chat_id").alias("_of_title"))
    typed = F.when(text.rlike(r"^-?\d+$"), share_id(text.try_cast("bigint")))
    rows = names.withColumn("_text", text).withColumn("_typed", typed)
    return rows.join(of_title, F.col("_text") == F.col("_title"), "left").withColumn("chat_id", F.coalesce("_typed", "_of_title")).drop("_text", "_typed", "_title", "_of_title")


def is_empty(messages: DataFrame, chat_id: int | None = None) -> bool:
    return (messages if chat_id is None else messages.where(F.col("chat_id") == chat_id)).isEmpty()


#: Characters kept for the note that chats are missing.
NOTE = 40


def status(messages: DataFrame, chats: DataFrame, limit: int = 4000, excluded: DataFrame | None = None) -> DataFrame:
    """place, chat_id, line: totals, the excluded chats (chat_id) with their titles, then a line a chat with its count and newest message.

    Lines come in order of chat id while they and a note fit the limit (line breaks included); the note says how many
    chats are missing. The running length is taken over the first few lines that can fit, so no task sees all chats.
    """
    newest_of = F.max(F.struct("post_time", (-F.col("msg_id")).alias("r"), "content")).alias("m")
    # a row a chat, read for the lines, the totals and the note
    per = durable(messages.groupBy("chat_id").agg(F.count("*").alias("n"), newest_of).select("chat_id", "n", "m.content"), "status")
    line = F.concat(F.coalesce("title", F.lit("?")), F.lit(" ("), F.col("chat_id").cast("string"), F.lit("): "), F.col("n").cast("string"), F.lit(" messages, newest: "), brief(F.coalesce("content", F.lit(""))))
    first = _first(per, "? (0): 1 messages, newest: ", limit).join(chats.select("chat_id", "title"), "chat_id", "left")
    parts = [first.select(F.lit(2).alias("section"), "chat_id", line.alias("line"))]
    of = per.agg(F.count("*").alias("chats"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    parts.append(of.select(F.lit(0).alias("section"), F.lit(None).cast("bigint").alias("chat_id"), F.concat(F.col("n").cast("string"), F.lit(" messages in "), F.col("chats").cast("string"), F.lit(" chats")).alias("line")))
    if excluded is not None:
        out = excluded.select("chat_id").distinct()
        named = out.join(chats.select("chat_id", "title"), "chat_id", "left").select(F.lit(1).alias("section"), "chat_id", F.concat(F.lit("excluded: "), F.coalesce("title", F.lit("?")), F.lit(" ("), F.col("chat_id").cast("string"), F.lit(")")).alias("line"))
        parts += [_first(named, "excluded: ? (0)", limit), out.agg(F.count("*").alias("k")).select(F.lit(1).alias("section"), F.lit(None).cast("bigint").alias("chat_id"), F.concat(F.col("k").cast("string"), F.lit(" chats excluded")).alias("line"))]
    order = Window.orderBy("section", F.col("chat_id").asc_nulls_first())
    upto = F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shown = reduce(DataFrame.unionByName, parts).select(F.row_number().over(order).alias("place"), "section", "chat_id", "line", upto.alias("upto")).where(F.col("upto") <= limit - NOTE)
    missing = shown.agg(F.count(F.when(F.col("section") == 2, 1)).alias("shown"), F.max("place").alias("last")).crossJoin(of).where("chats > shown")
    note = missing.select((F.coalesce("last", F.lit(0)) + 1).alias("place"), F.lit(None).cast("bigint").alias("chat_id"), F.concat(F.lit("and "), (F.col("chats") - F.col("shown")).cast("string"), F.lit(" more chats")).alias("line"))
    return shown.select("place", "chat_id", "line").unionByName(note)


def _first(rows: DataFrame, shortest: str, limit: int) -> DataFrame:
    """As many rows by chat id as fit a limit of characters if all were the shortest there can be."""
    return rows.orderBy("chat_id").limit(limit // (len(shortest) + 1) + 1)


def joined(lines: DataFrame) -> DataFrame:
    """text: the lines of a report (place, line; bounded by its limit) as one."""
    return lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text"))


def watched(chats: DataFrame, messages: DataFrame, keyword: str = "") -> DataFrame:
    """matching() of the chats that have messages, which are those watched after a start."""
    return matching(chats.join(distinct_chats(messages), "chat_id", "left_semi"), keyword)


def with_rows(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """chat_id, has_rows: whether each chat has any message."""
    has = distinct_chats(messages).withColumn("has_rows", F.lit(True))
    return chats.select("chat_id").join(has, "chat_id", "left").select("chat_id", F.coalesce("has_rows", F.lit(False)).alias("has_rows"))


def random_message(messages: DataFrame, seed: int | None = None) -> DataFrame:
    """One message, each as likely; none when there are none."""
    return messages.orderBy(F.rand(seed)).limit(1)
