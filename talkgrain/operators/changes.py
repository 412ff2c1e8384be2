"""Fold of a change log (new, edit, delete by seq) to the live messages.

Per message: nothing up to the last delete counts, nor edits before the first `new` after it. Content is that of the
latest new or edit, sender and time those of the latest new. An edit of a message never stored and one to blank text
are dropped, as are changes without a chat. Aggregation only, so that a hot message is combined before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.functions.ids import message_url, share_id
from talkgrain.functions.text import extract_text, sender_name

COLUMNS = ["seq", "op", "chat_id", "msg_id", "sender", "content", "post_time"]


def from_messages(incoming: DataFrame, at: str | None = None) -> DataFrame:
    """Changes `new` of a raw feed: id, chat_id, raw_text, sent_at, sender struct. Blank texts and rows without a chat are dropped.

    at: a column of the feed that is kept as `at`; so in the other two.
    """
    rows = incoming.select(*_at(at), "seq", F.lit("new").alias("op"), share_id(F.col("chat_id").cast("bigint")).alias("chat_id"), F.col("id").alias("msg_id"), sender_name(F.col("sender")).alias("sender"), extract_text(F.col("raw_text")).alias("content"), F.col("sent_at").alias("post_time"))
    return rows.where(F.col("chat_id").isNotNull() & (F.col("chat_id") != 0) & (F.length("content") > 0))


def from_edits(edits: DataFrame, at: str | None = None) -> DataFrame:
    rows = edits.select(*_at(at), "seq", F.lit("edit").alias("op"), share_id(F.col("chat_id").cast("bigint")).alias("chat_id"), F.col("id").alias("msg_id"), F.lit(None).cast("string").alias("sender"), extract_text(F.col("raw_text")).alias("content"), F.lit(None).cast("timestamp_ntz").alias("post_time"))
    return rows.where(F.col("chat_id").isNotNull() & (F.col("chat_id") != 0) & (F.length("content") > 0))


def from_deletes(deletes: DataFrame, at: str | None = None) -> DataFrame:
    """One change for each deleted id; deletes without a chat are dropped."""
    rows = deletes.where(F.col("chat_id").isNotNull())
    return rows.select(*_at(at), "seq", F.lit("delete").alias("op"), share_id(F.col("chat_id").cast("bigint")).alias("chat_id"), F.explode(F.array_distinct("deleted_ids")).alias("msg_id"), F.lit(None).cast("string").alias("sender"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("timestamp_ntz").alias("post_time"))


def _at(name: str | None) -> list[Column]:
    return [F.col(name).alias("at")] if name else []


def merged(incoming: DataFrame, edits: DataFrame, deletes: DataFrame) -> DataFrame:
    """The three feeds as one log whose seq orders by time of event (equal times: new, edit, delete; then the feed's own order)."""
    feeds = (from_messages(incoming, "arrived_at"), from_edits(edits, "edited_at"), from_deletes(deletes, "deleted_at"))
    all_ = reduce(DataFrame.unionByName, [df.withColumn("rank", F.lit(k)) for k, df in enumerate(feeds)])
    # microseconds, one digit of kind and eleven of the feed's order in one decimal
    order = F.unix_micros(F.col("at").cast("timestamp")).cast("decimal(38,0)") * F.lit(10**12).cast("decimal(13,0)") + F.col("rank") * F.lit(10**11).cast("decimal(12,0)") + F.col("seq")
    return all_.withColumn("seq", order.cast("decimal(38,0)")).select(*COLUMNS)


def fold(changes: DataFrame) -> DataFrame:
    """chat_id, msg_id, url, sender, content, post_time of the messages alive after all changes."""
    key = ["chat_id", "msg_id"]
    gone = F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("gone")
    cut = changes.where("op = 'delete'").groupBy(*key).agg(gone)
    rows = changes.where("op <> 'delete'").join(cut, key, "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    new = F.when(F.col("op") == "new", F.struct("seq", "sender", "post_time"))
    one = rows.groupBy(*key).agg(F.max(new).alias("new"), F.min(F.when(F.col("op") == "new", F.col("seq"))).alias("first"), F.max(F.struct("seq", "content")).alias("last"))
    # the latest change is a new, or an edit behind one: edits before the first new never are the latest of those counted
    live = one.where(F.col("first").isNotNull())
    return live.select(*key, message_url(F.col("chat_id"), F.col("msg_id")).alias("url"), "new.sender", "last.content", "new.post_time")


def without(messages: DataFrame, chats: DataFrame) -> DataFrame:
    """messages of other chats than those (chat_id)."""
    return messages.join(chats.select("chat_id").distinct(), "chat_id", "left_anti")


def monitored(rows: DataFrame, chats: DataFrame, exclude: bool = False) -> DataFrame:
    """Rows of the chats (chat_id) that are watched, or with exclude of all but those."""
    return rows.join(chats.select("chat_id").distinct(), "chat_id", "left_anti" if exclude else "left_semi")


def history(incoming: DataFrame, chat_id: int | None = None, min_id: int | None = None, max_id: int | None = None) -> DataFrame:
    """Messages of a raw feed between two ids, both left out; by default 1 and 2^30. One row a message, the latest delivery."""
    lo, hi = min_id or 1, max_id or 1 << 30
    rows = incoming.where((F.col("id") > lo) & (F.col("id") < hi))
    return fold(from_messages(rows).where(F.lit(True) if chat_id is None else F.col("chat_id") == chat_id))


def progress(rows: DataFrame, every: int = 500) -> DataFrame:
    """chat_id, done, msg_id, remaining: of each chat's download, newest first, every so-many-th row with an estimate of what is left.

    remaining: the id reached less the least one, as ids are counted, not rows.
    """
    order = Window.partitionBy("chat_id").orderBy(F.col("msg_id").desc())
    placed = rows.select("chat_id", "msg_id").distinct().withColumn("done", F.row_number().over(order)).withColumn("least", F.min("msg_id").over(Window.partitionBy("chat_id")))
    return placed.where(F.col("done") % every == 0).select("chat_id", "done", "msg_id", (F.col("msg_id") - F.col("least")).alias("remaining"))


def downloaded(rows: DataFrame) -> DataFrame:
    """chat_id, rows: how many rows each chat's download brought."""
    return rows.groupBy("chat_id").agg(F.count("*").alias("rows"))
