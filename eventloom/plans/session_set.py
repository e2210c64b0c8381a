"""A set of sessions as six frames, and the means to materialise intermediate frames."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder only for a local master without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="eventloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through Parquet in the shared folder: later reads prune columns, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/eventloom-{uuid.uuid4().hex[:12]}-frame"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class SessionSet:
    sessions: DataFrame
    entries: DataFrame
    blobs: DataFrame
    references: DataFrame
    bindings: DataFrame
    compacted: DataFrame

    def with_(self, **frames: DataFrame) -> SessionSet:
        return replace(self, **frames)

    def frames(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
