"""Token ids in compressed binary blocks, written and read by Spark.

Documents are ordered by doc_id over range partitions; each partition is a shard whose blocks hold whole
documents in order. Blocks are rows of one binary column, so that a shard is committed as a whole on
any file system Spark writes to, and each row can be decoded alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govdocs.llm import tokens
from govdocs.llm.common import Scratch, text_batches, text_or_empty

#: Ids after which a block is closed; it may exceed this by its last document.
BLOCK_IDS = 1 << 20
BLOCKS = "shard int, block int, n_docs int, n_tokens long, data binary"


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encodes whole texts, appends end_id to each, and writes blocks in ascending doc_id order (null first)."""
    vocabulary = vocabulary or tokens.vocabulary_path()
    text_batches(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        from pyspark import TaskContext

        from govdocs.llm.range_coder import pack_block

        shard, block = TaskContext.get().partitionId(), 0
        names, lengths, raw, size = [], [], [], 0
        end = end_id.to_bytes(4, "little")
        most = tokens.encoder(vocabulary).size

        def close() -> pd.DataFrame:
            data = pack_block(names, lengths, np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int64), most)
            return pd.DataFrame({"shard": [shard], "block": [block], "n_docs": [len(names)], "n_tokens": [size], "data": [data]})

        for p in parts:
            for doc, ids in zip(p["doc_id"].astype("Int64"), tokens.encoded(p["text"].tolist(), vocabulary)):
                names.append(None if doc is pd.NA else int(doc))
                raw.append(ids + end)
                lengths.append(len(ids) // 4 + 1)
                size += lengths[-1]
                if size >= block_ids:
                    yield close()
                    names, lengths, raw, size, block = [], [], [], 0, block + 1
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInPandas(run, BLOCKS).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files; start counts the ids of all documents before it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        from govdocs.llm.range_coder import unpack_block

        for p in parts:
            for shard, block, data in zip(p["shard"], p["block"], p["data"]):
                names, lengths, ids = unpack_block(data)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths)]
                out = pd.DataFrame({"shard": shard, "block": block, "doc_id": pd.array(names, dtype="Int64"), "inside": ends - lengths, "n_tokens": lengths, "ids_crc32": crc})
                yield out

    blocks = spark.read.schema(BLOCKS).parquet(path)
    before = lambda *by: F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = blocks.select("shard", "block", "n_tokens")
    # a row for each shard, of which there are as many as partitions
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("shard_start", before("shard")).drop("n_tokens")
    starts = sizes.withColumn("block_start", before("shard", "block")).join(F.broadcast(shards), "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("base"))
    docs = blocks.select("shard", "block", "data").mapInPandas(run, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_round_trip(docs: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the files of docs (doc_id, text) below the shared folder and returns what reading them gives.

    Null and empty texts are the end id alone. Rows that repeat a doc_id stand beside each other and are
    each returned; a null doc_id comes first. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    write_token_files(docs, f"{scratch.top}/ids", block_ids=block_ids)
    return read_token_files(docs.sparkSession, f"{scratch.top}/ids")
