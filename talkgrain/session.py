"""Session defaults, tables that survive the loss of an executor, and the package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Folders given by `scratch`, by application.
_WRITTEN: dict[str, list[str]] = {}


class NoSharedFolder(RuntimeError):
    """The session runs on a cluster and names no folder that all executors share."""


def local_session(cores: int | str = 8, app: str = "talkgrain", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, adaptive execution); Python workers find the package."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores if isinstance(cores, int) else 8),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    spark = builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of a cluster that hasn't got it installed."""
    at = os.path.join(tempfile.mkdtemp(prefix="talkgrain-"), "talkgrain.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, files in os.walk(os.path.join(ROOT, "talkgrain")):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, ROOT))
    spark.sparkContext.addPyFile(at)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one of a local session; NoSharedFolder on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="talkgrain-shared-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str, unique: bool = True) -> str:
    """A folder of this application in the shared folder, which `release` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}" if unique else f"{shared_dir(spark)}/{name}"
    known = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    if path not in known:
        known.append(path)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the folders of this application, once no query needs them; their number."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        at = hadoop(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
