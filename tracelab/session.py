"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # folders made for local sessions that name none, by application


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on (they may be set on a running session)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tracelab") -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tracelab-")
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/tracelab/{name}-{uuid.uuid4().hex[:12]}"


@dataclass
class Scratch:
    """A table in the shared folder, and the folder to remove once a later table has replaced it."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        spark = self.df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch(df: DataFrame, name: str) -> Scratch:
    """Cut lineage by writing a table to the shared folder and reading it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return Scratch(df.sparkSession.read.schema(df.schema).parquet(path), path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Like ``scratch``, for tables that are read until the end."""
    return scratch(df, name).df
