"""Runs: a registry, receipts of stages, write-once tables, freeze, export with redaction, rebuild.

A run is a folder of Parquet tables; each stage writes its tables once and then a receipt.  A frozen run refuses
writes.  Registry and receipts are append-only, the last row of a key counting; folders may be local or any file
system Spark can write.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.rule_tables import REDACTED_KEYS
from quayside.functions.text import redact_keys

STAGES = ("collect", "normalize", "analyze", "index", "aggregate")


class Frozen(RuntimeError):
    """The run is frozen and can't be written."""


@dataclass
class Run:
    spark: SparkSession
    root: str
    id: str

    @property
    def path(self) -> str:
        return f"{self.root}/{self.id}"

    def _log(self, kind: str, stage: str, status: str, note: str = "") -> None:
        row = [(self.id, kind, stage, status, note, time.time_ns())]
        self.spark.createDataFrame(row, "run_id string, kind string, stage string, status string, note string, at bigint").coalesce(1).write.mode("append").parquet(f"{self.root}/_log")

    def log(self) -> DataFrame:
        """The last row of each kind and stage of this run."""
        d = self.spark.read.parquet(f"{self.root}/_log").filter(F.col("run_id") == self.id)
        return d.groupBy("kind", "stage").agg(F.max_by(F.struct("status", "note", "at"), "at").alias("r")).select("kind", "stage", "r.*")

    def frozen(self) -> bool:
        return not self.log().filter("kind = 'run' and status = 'frozen'").isEmpty()

    def guard(self) -> None:
        if self.frozen():
            raise Frozen(f"run {self.id} is frozen")

    def write(self, name: str, df: DataFrame, replace: bool = False, by: str | None = None) -> DataFrame:
        self.guard()
        w = df.write.mode("overwrite" if replace else "errorifexists")
        (w.partitionBy(by) if by else w).parquet(f"{self.path}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def has(self, name: str) -> bool:
        """Whether a table of the run has been written."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def append(self, name: str, df: DataFrame) -> None:
        self.guard()
        df.write.mode("append").parquet(f"{self.path}/{name}")

    def delete(self, name: str, keys: DataFrame, on: list[str]) -> DataFrame:
        """The table without the rows whose key is among ``keys``; written beside it and then put in its place."""
        self.guard()
        return self._swap(name, self.read(name).join(keys.select(*on).distinct(), on, "left_anti"))

    def upsert(self, name: str, rows: DataFrame, on: list[str]) -> DataFrame:
        self.guard()
        return self._swap(name, upsert(self.read(name), rows, on))

    def _swap(self, name: str, df: DataFrame) -> DataFrame:
        new = f"{self.path}/_{name}-{time.time_ns()}"
        df.write.parquet(new)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        old, path = hadoop.Path(f"{self.path}/{name}"), hadoop.Path(new)
        files = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(old, True)
        if not files.rename(path, old):
            raise OSError(f"{new} can't be put in the place of {name}")
        return self.read(name)

    def stage(self, name: str, work: Callable[[], dict]) -> dict:
        """Run a stage and keep its receipt, failed or not."""
        self.guard()
        try:
            out = work()
        except Exception as e:
            self._log("stage", name, "failed", str(e)[:400])
            raise
        self._log("stage", name, "success", json.dumps(out, sort_keys=True, default=str))
        return out


def create_run(spark: SparkSession, root: str, run_id: str, spec: dict) -> Run:
    run = Run(spark, root, run_id)
    run._log("run", "", "draft", json.dumps(spec, sort_keys=True, default=str))
    for s in STAGES:
        run._log("stage", s, "pending")
    return run


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it doesn't have."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def freeze(run: Run, dry_run: bool = False) -> str:
    if run.frozen():
        return "already_frozen"
    if not dry_run:
        run._log("run", "", "frozen")
    return "would_freeze" if dry_run else "frozen"


def export(run: Run, target: str, tables: list[str], redact: dict[str, list[str]] | None = None) -> list[str]:
    """Copy tables to a bundle; JSON columns named in ``redact`` lose the values of author keys, in the copy only."""
    for name in tables:
        df = run.read(name)
        for c in (redact or {}).get(name, []):
            df = df.withColumn(c, redact_keys(F.col(c), REDACTED_KEYS))
        df.write.mode("errorifexists").parquet(f"{target}/{name}")
    run.log().coalesce(1).write.mode("errorifexists").json(f"{target}/receipts")
    return [f"{target}/{t}" for t in tables]


def rebuild(run: Run, new_id: str, raw: str = "collected_item") -> Run:
    """A new run over the raw records of another, which must have some."""
    source = run.read(raw)
    if source.isEmpty():
        raise ValueError(f"run {run.id} has no raw records")
    out = create_run(run.spark, run.root, new_id, {"rebuilt_from": run.id})
    out.write(raw, source)
    return out
