"""Tables that several queries read, written once a session to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from govdocs.settings import CODEC, ROW_GROUP

_made: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster must name one."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/workspace-{uuid.uuid4().hex[:12]}/{name}"


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` derived from the tables in source: built and written at first, read afterwards.

    It holds for one session; `forget` drops what is known of a source whose tables were written anew.
    """
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _made:
        path = folder(spark, name)
        build().write.option("parquet.block.size", ROW_GROUP).option("compression", CODEC).parquet(path)
        _made[key] = path
    return spark.read.parquet(_made[key])


def forget(spark: SparkSession, source: str) -> None:
    """The stored tables of a source are built again when they are asked for."""
    for key in [k for k in _made if k[:2] == (spark.sparkContext.applicationId, source)]:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop(key))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
