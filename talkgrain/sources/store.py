"""The message store: a log of changes in folders that a manifest names, and its fold to live messages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain import schema
from talkgrain.functions.ids import url_msg, url_share
from talkgrain.operators import changes
from talkgrain.operators.chats import is_empty
from talkgrain.sources.versions import Versions


class HistoryExists(RuntimeError):
    """A backfill of the whole range was asked for a chat that has messages."""


class MessageStore:
    """`log()` is all changes, `live()` their fold. Every append is a folder and a commit; `compact()` makes one folder of them.

    Appends of several writers all stay, also beside a compaction or a clearing, which replace only what they have read.
    """

    def __init__(self, spark: SparkSession, root: str, from_scratch: bool = False) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._versions = Versions(spark, self.root)
        if from_scratch:
            self.clear()
        for folder in self._folders():
            schema.check(spark.read.parquet(folder), schema.CHANGES)

    def _folders(self) -> list[str]:
        return self._versions.current()[1].get("log", [])

    def clear(self) -> None:
        """Start anew with an empty log; folders of the old one stay until vacuum."""
        self._versions.change(lambda _: {"log": []})

    def _write(self, rows: DataFrame) -> str:
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.select(*[rows[f.name].cast(f.dataType) for f in schema.CHANGES.fields]).write.option("compression", "zstd").parquet(at)
        return at

    def _replace(self, old: list[str], rows: DataFrame) -> None:
        new = self._write(rows)
        self._versions.change(lambda m: {"log": [new, *(f for f in m.get("log", []) if f not in old)]})

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema.CHANGES).parquet(*folders) if folders else self.spark.createDataFrame([], schema.CHANGES)

    def log(self) -> DataFrame:
        return self._read(self._folders())

    def append(self, rows: DataFrame) -> None:
        """Add changes; a bulk is one commit."""
        new = self._write(rows)
        self._versions.change(lambda m: {"log": [*m.get("log", []), new]})

    def live(self, where: Column | None = None) -> DataFrame:
        """Live messages; where: a condition on chat_id and msg_id, met by the log before it is folded."""
        log = self.log()
        return changes.fold(log if where is None else log.where(where))

    def get(self, url: str) -> DataFrame:
        """The message of a url, however it is written: only its own changes are folded."""
        u = F.lit(url)
        return self.live((F.col("chat_id") == url_share(u)) & (F.col("msg_id") == url_msg(u)))

    def find(self, **fields: object) -> DataFrame:
        """Live messages whose fields have these values."""
        keys = [F.col(n) == fields[n] for n in ("chat_id", "msg_id") if n in fields]
        rows = self.live(keys[0] & keys[-1] if keys else None)
        for name, value in fields.items():
            rows = rows.where(rows[name] == value)
        return rows

    def count(self, **fields: object) -> int:
        return self.find(**fields).count()

    def backfill(self, incoming: DataFrame, chat_id: int, min_id: int | None = None, max_id: int | None = None) -> DataFrame:
        """Append a chat's history and return it; refused for the whole range where the chat has messages."""
        if not (min_id or max_id) and not is_empty(self.live(F.col("chat_id") == chat_id)):
            raise HistoryExists(f"chat {chat_id} has messages: give a range")
        lo, hi = min_id or 1, max_id or 1 << 30
        rows = changes.from_messages(incoming.where(f"id > {int(lo)} AND id < {int(hi)}"))
        new = self._write(rows.where(rows["chat_id"] == chat_id))
        self._versions.change(lambda m: {"log": [*m.get("log", []), new]})
        return self._read([new])

    def clear_chats(self, chats: DataFrame) -> None:
        """Drop all changes of some chats; chats without messages are no error."""
        old = self._folders()
        self._replace(old, changes.without(self._read(old), chats))

    def compact(self) -> None:
        """Replace the log by one `new` for each live message, at the place of its latest change."""
        old = self._folders()
        log = self._read(old)
        last = log.groupBy("chat_id", "msg_id").agg(F.max("seq").alias("seq"))
        live = changes.fold(log).join(last, ["chat_id", "msg_id"])
        self._replace(old, live.selectExpr("seq", "'new' AS op", "chat_id", "msg_id", "sender", "content", "post_time"))

    def vacuum(self) -> None:
        self._versions.sweep(["data"], self._folders())
