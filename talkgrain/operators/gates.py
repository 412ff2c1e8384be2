"""Gates of messages to the commands, as conditions on rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkgrain.functions.ids import share_id


def private(sender: Column, chat: Column, listed: Iterable[int]) -> Column:
    """In private mode a listed sender passes, as does any sender in a listed chat or without one."""
    ids = sorted(set(listed))
    inside = F.coalesce(share_id(chat).isin(*ids), F.lit(False))
    return F.coalesce(sender.isin(*ids), F.lit(False)) | chat.isNull() | inside


def addressed(text: Column, group: Column, mentioned: Column, username: str) -> Column:
    """In a group only what mentions the user, or names it, passes."""
    return ~F.coalesce(group, F.lit(False)) | F.coalesce(mentioned, F.lit(False)) | F.coalesce(text.contains(f"@{username}"), F.lit(False))


def foreign(sender: Column, me: int) -> Column:
    """What the user didn't send itself."""
    return F.coalesce(sender != me, F.lit(True))
