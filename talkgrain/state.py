"""Small state of the user interface: keys to strings, on the driver, kept in Parquet when asked."""

from __future__ import annotations

from pyspark.sql import SparkSession


class State:
    def __init__(self) -> None:
        self._values: dict[str, str] = {}

    def ping(self) -> bool:
        return True

    def get(self, key: str) -> str | None:
        return self._values.get(key)

    def set(self, key: str, value: object) -> None:
        self._values[key] = str(value)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(sorted(self._values.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> State:
        out = cls()
        out._values = {r["key"]: r["value"] for r in spark.read.parquet(path).collect()}
        return out
