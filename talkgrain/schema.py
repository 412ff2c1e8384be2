"""Schemas of messages and changes, and the check a stored table must pass when it is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MESSAGES = T.StructType([
    T.StructField("chat_id", T.LongType()), T.StructField("msg_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("sender", T.StringType()), T.StructField("content", T.StringType()), T.StructField("post_time", T.TimestampNTZType()),
])
CHANGES = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("chat_id", T.LongType()), T.StructField("msg_id", T.LongType()),
    T.StructField("sender", T.StringType()), T.StructField("content", T.StringType()), T.StructField("post_time", T.TimestampNTZType()),
])


class SchemaMismatch(ValueError):
    """A stored table has other columns than the engine writes."""


def check(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns in order; SchemaMismatch if the names differ."""
    if set(df.columns) != set(schema.names):
        raise SchemaMismatch(f"stored columns {sorted(df.columns)}, expected {sorted(schema.names)}: rebuild the table")
    return df.select(*schema.names)
