"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below the shared folder; sets a local one only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Remove the files behind a frame that settle() returned."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        if "/quire-" in name:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scan(df: DataFrame, columns: list[str], schema: str, rows) -> DataFrame:
    """Apply rows(columns as lists) -> columns as lists to each Arrow batch."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def batches(it):
        for batch in it:
            out = rows(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, arrow.types)], schema=arrow)

    return df.select(*columns).mapInArrow(batches, schema)


def append(df: DataFrame, column: str, name: str, kind: str, values) -> DataFrame:
    """All columns of df and one more, values(the column as a list), without a join. `name` must be new."""

    def batches(it):
        for batch in it:
            made = pa.array(values(batch.column(batch.schema.get_field_index(column)).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return df.mapInArrow(batches, ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{name}` {kind}"]))


def crc_mod(column: str, n: int):
    """crc32 of an integer column as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, train, limit: int) -> list[tuple[str, int]]:
    """At most `limit` labelled texts on which `train` (a condition on doc_id) holds: those whose hash of
    doc_id is least, so that the choice depends on neither the layout of the files nor the cluster."""
    rows = (
        labels.filter(train & F.col(target).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(target).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    got = documents.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    return [(r.text or "", int(r.y)) for r in got.select("doc_id", "text", "y").toLocalIterator()]


class Screen(dict):
    """A table of fixed size, one bit for each hash of a set of strings, that says which strings cannot be in the set.

    What it lets pass must still be joined with the set. Built in Spark; the driver sees at most BITS / 64 words of it.
    """

    BITS = 1 << 23

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Screen:
        place = df.select(F.pmod(F.crc32(F.encode(column, "utf-8")), F.lit(cls.BITS)).alias("b"))
        marks = place.groupBy(F.expr("cast(b div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("m"))
        words = np.zeros(cls.BITS // 64, np.int64)
        for r in marks.toLocalIterator():
            words[r["w"]] = r["m"]
        return cls(words)

    def __reduce__(self):
        return Screen, (self.words,)

    def __missing__(self, string: str) -> bool:
        if len(self) > 100_000:
            self.clear()
        known = self[string] = self.may_hold(string)
        return known

    def may_hold(self, string: str) -> bool:
        """As self[string], for strings that hardly repeat."""
        b = zlib.crc32(string.encode()) % self.BITS
        return bool(int(self.words[b >> 6]) >> (b & 63) & 1)

    def __bool__(self) -> bool:
        return bool(self.words.any())
