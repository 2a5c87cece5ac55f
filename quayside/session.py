"""Sessions, table access and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Give the workers this package, wherever they and the caller's working folder are; once per context."""
    sc = spark.sparkContext
    if not getattr(sc, "_quayside_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="quayside-code-"), "quayside")
        sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
        sc._quayside_shipped = True
    return spark


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUAYSIDE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, in local sessions only, one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quayside-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder (survives the loss of an executor)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, stem: str) -> str:
    """A fresh path in the shared folder; :func:`sweep` deletes what was written there."""
    path = f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    sc._quayside_scratch = [*getattr(sc, "_quayside_scratch", []), path]
    return path


def sweep(spark: SparkSession) -> int:
    """Delete all tables that this session has written to the shared folder; frames made of them can't be read any more."""
    sc = spark.sparkContext
    paths, sc._quayside_scratch = getattr(sc, "_quayside_scratch", []), []
    hadoop = sc._jvm.org.apache.hadoop.fs
    for p in paths:
        path = hadoop.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def local_path(path: str) -> str:
    """The file-system path of a ``file:`` URL, for readers that map files into memory."""
    return path[5:].replace("//", "/", 1) if path.startswith("file:") else path


def written(df: DataFrame, stem: str = "table") -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder; unlike a checkpoint it is encoded, and its size is known."""
    path = scratch_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
