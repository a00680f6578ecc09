"""Frames that are cut off from their lineage by files in the shared folder, for loops over levels and rounds."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Where a local session that names no shared folder keeps its files.
LOCAL = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session within one machine may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", base := LOCAL)
    return base.rstrip("/")


#: The frames that settle() has returned and that are still in use.
_SETTLED: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def is_settled(df: DataFrame) -> bool:
    return df in _SETTLED


def settle(df: DataFrame) -> DataFrame:
    """The same rows, read from files: a lost executor costs no recomputation, and plans do not grow with the rounds. A frame
    that is read from such files already stays as it is."""
    if is_settled(df):
        return df
    path = f"{shared_dir(df.sparkSession)}/quire-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _SETTLED.add(out)
    return out


def parts_for(df: DataFrame, rows: int = 100_000) -> int:
    """So many parts that each holds about `rows` rows of a settled frame; spark.sql.shuffle.partitions at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.count() // rows)) if is_settled(df) else least


def release(*frames: DataFrame) -> None:
    """Remove the files of frames that settle() returned and nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/quire-" in name:
                path = context._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
