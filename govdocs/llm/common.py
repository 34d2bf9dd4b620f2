"""What several training-data operators need: tables in the shared folder and whole-row filters by id."""

from __future__ import annotations

import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the quality rules and fingerprints take it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Side of an id join that may be broadcast, in bytes; checked against a real count. What weighs on the driver is several times that.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, a local session gets its own; a cluster must name one."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def text_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Texts are long: fewer rows at a time go to Python than Spark's default, so that workers stay small. The session keeps the settings, as plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


class Scratch:
    """Tables written below the shared folder: they cut lineage and survive lost executors.

    `put` writes a frame and returns it as read back; `drop` removes one that is not needed any more. What an
    operator returns reads its tables, so that they stay until the caller has written the result and calls
    `drop_since` with the number of scratches (`made`) before.
    """

    made: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[str, str] = {}
        Scratch.made.append(self.top)

    def put(self, name: str, df: DataFrame, compression: str = "snappy") -> DataFrame:
        path = f"{self.top}/{name}-{len(self.paths)}"
        df.write.option("compression", compression).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self.delete(self.spark, self.paths[name])

    @staticmethod
    def delete(spark: SparkSession, folder: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    @classmethod
    def drop_since(cls, spark: SparkSession, number: int) -> None:
        for top in cls.made[number:]:
            cls.delete(spark, top)
        del cls.made[number:]


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Marks df for broadcast if its counted rows fit BROADCAST_BYTES, else leaves it to a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def null_safe(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Equality of left's columns with right's, null equal to null, as a join condition."""
    on = F.lit(True)
    for a, b in keys.items():
        on &= left[a].eqNullSafe(right[b])
    return on


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
