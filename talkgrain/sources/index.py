"""A persisted search index: one row of each message with its tokens, made when messages are written."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.functions.analyze import PLAIN, Profile
from talkgrain.operators import search as searching
from talkgrain.sources.versions import Versions


class SearchIndex:
    """Messages and tokens under a root, in folders by month, sorted by chat within files.

    Searches read the columns they need: conditions on post_time prune months, those on chat_id row groups, and nothing
    is shuffled but the few rows of a page.
    """

    def __init__(self, spark: SparkSession, root: str, profile: Profile = PLAIN) -> None:
        self.spark, self.root, self.profile = spark, root.rstrip("/"), profile
        self._versions = Versions(spark, self.root)

    def write(self, messages: DataFrame) -> None:
        """Take messages (one row each: chat_id, msg_id, url, sender, content, post_time) as the whole index."""
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        month = F.coalesce(F.date_format("post_time", "yyyy-MM"), F.lit("none"))
        rows = searching.indexed(messages, self.profile).withColumn("month", month)
        # chats are ranges of a file; adaptive execution sizes the files
        rows.hint("rebalance", "month").sortWithinPartitions("month", "chat_id", "msg_id").write.option("compression", "zstd").partitionBy("month").parquet(at)
        self._versions.change(lambda _: {"data": at, "columns": rows.columns})

    def exists(self) -> bool:
        return self._versions.current()[0] > 0

    def read(self) -> DataFrame:
        """chat_id, msg_id, url, sender, content, post_time, tokens, month."""
        return self.spark.read.option("recursiveFileLookup", "false").schema(SCHEMA).parquet(self._versions.current()[1]["data"])

    def search(self, query: str, chats: list[int] | None = None) -> DataFrame:
        return searching.search(self.read(), query, chats, replace(self.profile, stored=True))

    def vacuum(self) -> None:
        self._versions.sweep(["data"], [self._versions.current()[1].get("data", "")])


SCHEMA = "chat_id long, msg_id long, url string, sender string, content string, post_time timestamp_ntz, tokens array<string>, month string"
