"""The N highest-scoring items of every group, by descending score bands.

Items are written once, by bands of score whose edges are quantiles over all of them, the top bands narrow. Bands are
worked from the top: groups already filled are anti-joined away, the rest count what the band adds. A group that the
band doesn't overfill gets all its items of the band; one that it does gets the missing number by exact ranking on
score and tie rule. Ranking happens only within bands where groups end, and its limit is applied in every partition
before the shuffle, so that a group of millions of items never meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrain.functions.ids import share_id, url_msg, url_share
from talkgrain.session import durable, scratch

#: Shares of all items above the lower edge of each band but the last.
SHARES = (0.02, 0.1, 0.35)


def top_n(df: DataFrame, group: str, score: str, ties: list[Column], n: int, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """The n rows of each group with the highest score, equal scores by `ties`; all rows of groups that have fewer.

    A null score never counts; rows whose group is null form a group. Rows equal in score and ties are taken in any
    order, so ties must tell rows apart for a fixed result. Columns keep their names; `_band` and `_tie<k>` are used.
    """
    if n < 1:
        return df.limit(0)
    cols = df.columns
    rows = df.where(F.col(score).isNotNull()).select("*", *[t.alias(f"_tie{k}") for k, t in enumerate(ties)])
    numeric = F.unix_micros(F.col(score).cast("timestamp")) if dict(df.dtypes)[score].startswith("timestamp") else F.col(score)
    edges = rows.agg(F.percentile_approx(numeric, [1 - s for s in shares], 1000).alias("e")).first()["e"]
    if edges is None:
        return df.limit(0)
    band = reduce(lambda acc, ke: F.when(numeric >= F.lit(ke[1]), F.lit(ke[0])).otherwise(acc), reversed(list(enumerate(edges))), F.lit(len(edges)))
    whole = _by_band(rows.withColumn("_band", band))
    order = [F.col(score).desc(), *[F.col(f"_tie{k}") for k in range(len(ties))]]
    taken, state = [], None
    for b in range(len(edges) + 1):
        here = whole.where(F.col("_band") == b)
        if state is not None:
            full = state.where(F.col("_got") >= n).select(F.col(group).alias("_g"))
            here = here.join(full, here[group].eqNullSafe(F.col("_g")), "left_anti")
        add = here.groupBy(group).agg(F.count("*").alias("_add"))
        if state is None:
            state = durable(add.select(group, F.lit(0).cast("bigint").alias("_had"), F.col("_add").alias("_got")), "bands")
        else:
            prior = state.select(F.col(group).alias("_g"), F.col("_got").alias("_had"))
            both = add.join(prior, add[group].eqNullSafe(F.col("_g")), "full_outer")
            state = durable(both.select(F.coalesce(group, "_g").alias(group), F.coalesce("_had", F.lit(0)).alias("_had"), (F.coalesce("_had", F.lit(0)) + F.coalesce("_add", F.lit(0))).alias("_got")), "bands")
        ends = state.where((F.col("_got") > n) & (F.col("_had") < n)).select(F.col(group).alias("_g"), (n - F.col("_had")).alias("_left"))
        joined = here.join(ends, here[group].eqNullSafe(F.col("_g")), "left")
        whole_groups = joined.where(F.col("_left").isNull())
        # only groups that end in the band are ranked
        ranked = joined.where(F.col("_left").isNotNull()).withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= n)
        taken += [whole_groups.select(*cols), ranked.where(F.col("_rank") <= F.col("_left")).select(*cols)]
    return reduce(DataFrame.unionByName, taken)


def _by_band(rows: DataFrame) -> DataFrame:
    """Write rows into one folder a band, so that each band is read alone."""
    path = scratch(rows.sparkSession, "bands")
    rows.write.option("compression", "zstd").partitionBy("_band").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def newest_messages(messages: DataFrame, n: int = 5) -> DataFrame:
    """(chat_id, msg_id): the n newest messages of each chat, a message counting once at its latest time, equal times by smaller msg id."""
    rows = messages.select(share_id(F.col("chat_id")).alias("chat_id"), url_share(F.col("url")).alias("share"), url_msg(F.col("url")).alias("msg_id"), F.col("post_time"))
    rows = rows.where(F.col("post_time").isNotNull() & F.col("msg_id").isNotNull())
    once = rows.groupBy(F.coalesce("share", "chat_id").alias("chat_id"), "msg_id").agg(F.max("post_time").alias("post_time"))
    # read for the edges of the bands and for the bands
    return top_n(durable(once, "messages-once"), "chat_id", "post_time", [F.col("msg_id")], n).select("chat_id", "msg_id")
