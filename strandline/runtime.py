"""Session settings, shared storage and table access used by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see, from spark.checkpoint.dir.

    Where the setting is absent (local sessions, tests) a temporary folder is
    made once per driver and removed at exit.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if not _OWN_DIRS:
        own = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, own, True)
        _OWN_DIRS.append(own)
    return "file://" + _OWN_DIRS[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/strandline/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner
    exact sizes, so that it broadcasts only what is really small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """A materialised table, marked for broadcast if it has no more than `rows` rows; its columns must be of bounded width."""
    return F.broadcast(df) if df.count() <= rows else df


def discard(df: DataFrame) -> None:
    """Remove the files behind a materialised table that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark) + "/strandline/"
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/strandline/" not in folder:
            raise ValueError(f"{folder} lies outside {root}")
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables that this application wrote to the shared folder; frames that read them stop working."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/strandline/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and bench; on a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandline")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
