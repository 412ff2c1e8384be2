"""Chat ids and message urls as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNEL_OFFSET = 1_000_000_000_000
URL_PATTERN = r"(?i)/c/(\d+)/(\d+)"


def share_id(chat_id: Column) -> Column:
    """Share id of a marked chat id: x, -x or -x - 10**12; null stays null."""
    return (
        F.when(chat_id >= 0, chat_id)
        .when(chat_id < -CHANNEL_OFFSET, -chat_id - CHANNEL_OFFSET)
        .otherwise(-chat_id)
    )


def share_number(chat_id: int) -> int:
    """share_id of a number on the driver."""
    return chat_id if chat_id >= 0 else -chat_id - CHANNEL_OFFSET if chat_id < -CHANNEL_OFFSET else -chat_id


def message_url(share: Column, msg_id: Column, host: str = "chat.example") -> Column:
    """Canonical url of a message."""
    return F.concat(F.lit(f"https://{host}/c/"), share.cast("string"), F.lit("/"), msg_id.cast("string"))


def url_share(url: Column) -> Column:
    """Share id named by a url however it is written; null when the url has no such part."""
    return _part(url, 1)


def url_msg(url: Column) -> Column:
    """Message id named by a url however it is written; null when the url has no such part."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(url, URL_PATTERN, group), F.lit("")).try_cast("bigint")
