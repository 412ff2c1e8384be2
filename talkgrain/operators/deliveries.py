"""Messages delivered more than once: one copy of each, kept in a partitioned store with an identifier index.

The store holds the winners of all deliveries so far in partitions by the month of first arrival, and an index from
identifier to partition. The index lies in segments, each in buckets by the hash of the identifier and of a bounded
number of identifiers a bucket: a lookup reads the buckets its identifiers fall into. Segments are merged when there are
many. New deliveries are reduced to one winner per identifier, their identifiers are looked up in the index, and only
the partitions that hold any of them (or take new ones) are read, combined, recomputed and written again. A manifest
names the current folder of each partition; it is taken by compare-and-swap, so that readers see either all of an upsert
or nothing of it and no upsert of two writers is lost. Folders of earlier versions stay until `vacuum`.

Kept of an identifier is the row of the latest time (null is earliest), among equals that of the smallest row id.
Rows whose url is null or names no message are messages of their own and are kept.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrain.functions.ids import url_msg, url_share
from talkgrain.sources.versions import Conflict, Versions

KEY = ["share", "msg"]


def keyed(df: DataFrame, payload: list[str] | None = None, url: str = "url", time: str = "post_time", row_id: str = "row_id", arrived: str = "ingested_at") -> DataFrame:
    """share, msg (both null where the url names no message), row_id, post_time, part (month of arrival), payload columns."""
    part = F.coalesce(F.date_format(F.col(arrived), "yyyy-MM"), F.lit("none"))
    named = url_share(F.col(url)).isNotNull() & url_msg(F.col(url)).isNotNull()
    return df.select(
        F.when(named, url_share(F.col(url))).alias("share"),
        # a row that names no message is one of its own: its row id stands for the message
        F.when(named, url_msg(F.col(url))).otherwise(F.col(row_id)).alias("msg"),
        F.col(row_id).alias("row_id"), F.col(time).alias("post_time"), part.alias("part"),
        *[F.col(c).alias(f"p_{c}") for c in payload or []],
    )


def winners(rows: DataFrame) -> DataFrame:
    """One row of each identifier, found by partial aggregation; it takes the earliest partition of its copies."""
    rest = [c for c in rows.columns if c.startswith("p_")]
    order: Column = F.struct("post_time", (-F.col("row_id")).alias("r"), *rest)
    best = rows.groupBy(*KEY).agg(F.max(order).alias("w"), F.min("part").alias("part"))
    return best.select(*KEY, (-F.col("w.r")).alias("row_id"), F.col("w.post_time").alias("post_time"), "part", *[F.col(f"w.{c}").alias(c) for c in rest])


class DeliveryStore:
    """Winners by partition under `root`, a folder all executors share.

    bucket: identifiers of a bucket of the index; segments: of the index before they are merged.
    Manifest: {"parts": {partition: folder}, "index": [[folder, buckets]]}.
    """

    def __init__(self, spark: SparkSession, root: str, bucket: int = 50_000, segments: int = 8) -> None:
        self.spark, self.root, self.bucket, self.segments = spark, root.rstrip("/"), bucket, segments
        self._versions = Versions(spark, self.root)

    def manifest(self) -> dict:
        return {"parts": {}, "index": []} | self._versions.current()[1]

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*folders)

    def _folders(self, base: str, key: str) -> dict[str, str]:
        """Value of a partition column to its folder."""
        at = self._versions.path(base)
        names = [s.getPath().getName() for s in self._versions.fs.listStatus(at) if s.isDirectory()] if self._versions.fs.exists(at) else []
        return {n.split("=", 1)[1]: f"{base}/{n}" for n in names if n.startswith(f"{key}=")}

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows by partition into new folders; the folder of each partition written."""
        base = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.withColumn("dir", F.col("part")).write.option("compression", "zstd").partitionBy("dir").parquet(base)
        return self._folders(base, "dir")

    # ---- index

    def _add_segment(self, rows: DataFrame, n: int) -> list[list]:
        """Write (share, msg, part) of n identifiers as a segment; none for no identifiers."""
        if not n:
            return []
        at, buckets = f"{self.root}/index/{uuid.uuid4().hex}", -(-n // self.bucket)
        rows = rows.select(*KEY, "part", _bucket(buckets).alias("bucket"))
        # a task for several buckets; rows of one lie together
        rows.repartition(min(buckets, 2000), "bucket").sortWithinPartitions("bucket", *KEY).write.option("compression", "zstd").partitionBy("bucket").parquet(at)
        return [[at, buckets]]

    def lookup(self, ids: DataFrame, index: list[list]) -> DataFrame | None:
        """share, msg, held (partition) of the buckets the identifiers fall into; None where no bucket is hit."""
        found = []
        for at, buckets in index:
            hit = {r[0] for r in ids.select(_bucket(buckets)).distinct().collect()}  # at most the buckets of the segment
            folders = [f for b, f in self._folders(at, "bucket").items() if int(b) in hit]
            if folders:
                found.append(self._read(folders).select(*KEY, F.col("part").alias("held")))
        return reduce(DataFrame.unionByName, found) if found else None

    def _merged(self, index: list[list]) -> list[list]:
        if len(index) <= self.segments:
            return index
        rows = self._read([f for at, _ in index for f in self._folders(at, "bucket").values()])
        return self._add_segment(rows, rows.count())

    # ---- rows

    def read(self) -> DataFrame | None:
        """The kept rows; None while the store is empty."""
        folders = list(self.manifest()["parts"].values())
        return self._read(folders) if folders else None

    def upsert(self, incoming: DataFrame, tries: int = 5) -> list[str]:
        """Bring keyed rows in; returns the partitions that were written again. Done anew where another writer came first."""
        staged = self._stage(winners(incoming))
        for _ in range(tries):
            number, found = self._versions.current()
            found = {"parts": {}, "index": []} | found
            parts, index = self._combined(staged, found)
            if not parts:
                return []
            try:
                self._versions.commit(number, {"parts": found["parts"] | parts, "index": index})
                return sorted(parts)
            except Conflict:
                continue
        raise Conflict(f"no version of {self.root} could be taken in {tries} tries")

    def _combined(self, new: DataFrame, found: dict) -> tuple[dict[str, str], list[list]]:
        """Folders of the partitions the new winners touch, and the index with their identifiers."""
        named = new.where(F.col("share").isNotNull())
        known = self.lookup(named, found["index"])
        # identifiers already stored go to the partition that holds them, whenever they arrive
        if known is None:
            placed = new.withColumn("held", F.lit(None).cast("string"))
        else:
            placed = self._stage(new.join(known, KEY, "left"))
        rows = placed.withColumn("part", F.coalesce("held", "part")).drop("held")
        if found["parts"]:
            touched = [r[0] for r in rows.select("part").distinct().collect()]  # one row a partition of the store
            held = [found["parts"][p] for p in touched if p in found["parts"]]
            if held:
                rows = winners(rows.unionByName(self._read(held)))
        parts = self._write(rows)
        first = placed.where(F.col("share").isNotNull() & F.col("held").isNull())
        return parts, self._merged([*found["index"], *self._add_segment(first, first.count())])

    def _stage(self, df: DataFrame) -> DataFrame:
        at = f"{self.root}/staged/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def vacuum(self) -> None:
        """Delete folders the manifest doesn't name."""
        found = self.manifest()
        self._versions.sweep(["data", "index", "staged"], [*found["parts"].values(), *(at for at, _ in found["index"])])


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def kept(messages: DataFrame, root: str, incoming_batches: int = 10) -> DataFrame:
    """Winners after loading all but the last batches as history and upserting those: share, msg, row_id, post_time, part."""
    spark = messages.sparkSession
    store = DeliveryStore(spark, root)
    last = messages.agg(F.max("batch_id")).first()[0]
    if last is None:
        return winners(keyed(messages))
    late = F.coalesce(F.col("batch_id") > last - incoming_batches, F.lit(False))
    store.upsert(keyed(messages.where(~late)))
    store.upsert(keyed(messages.where(late)))
    return store.read()


def dropped(messages: DataFrame, root: str, incoming_batches: int = 10) -> DataFrame:
    """(row_id): the rows of messages that are not kept."""
    return messages.select("row_id").join(kept(messages, root, incoming_batches).select("row_id"), "row_id", "left_anti")
