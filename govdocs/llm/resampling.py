"""Importance resampling towards a target: hashed word n-grams by an Aho-Corasick dictionary, Gumbel top-k.

The distinct words of a block of texts, each between two delimiters, are the dictionary of an automaton;
a word carries its CRC-32 and length. One scan of the block gives the payloads in order. The CRC of a run
of words follows from the payloads of its words alone, so that no n-gram is ever put together. Buckets
are stored by document; their counts over corpus and target give a gain for each bucket, and a document's
mean gain plus seeded Gumbel noise its score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govdocs.llm.common import Scratch, text_batches, text_or_empty
from govdocs.operators.registry import rank_directory

#: Bytes of texts whose words make one dictionary, bytes of a long text that are scanned at a time, and the longest word that stands in a dictionary itself.
BLOCK, SEGMENT, LONGEST = 1 << 22, 1 << 20, 1000
_LONG = re.compile(rb"[^ ]{%d,}" % (LONGEST + 1))
#: A-Z as a-z, all other ASCII characters that are no digits or letters as a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def payload(word: bytes) -> int:
    return zlib.crc32(word) | len(word) << 32


def scanned(segments: list[bytes]) -> Iterator:
    """The payloads of the words of each segment (words and spaces), by one automaton over all their distinct words."""
    import ahocorasick
    import numpy as np

    odd: dict[bytes, bytes] = {}  # stand-ins for words too long for a dictionary; no word holds their first byte
    segments = [_LONG.sub(lambda m: odd.setdefault(m[0], b"\0%d" % len(odd)), s) for s in segments]
    lengthy = {v: k for k, v in odd.items()}
    automaton = ahocorasick.Automaton()
    for word in {w for s in segments for w in s.split(b" ")} - {b""}:
        automaton.add_word(f" {word.decode('latin-1')} ", payload(lengthy.get(word, word)))
    if len(automaton):
        automaton.make_automaton()
    for s in segments:
        yield np.array([v for _, v in automaton.iter(f" {s.decode('latin-1')} ")] if len(automaton) else [], dtype="int64")


def shifted(crc, length):
    """The CRC-32s of texts as they count for `length` bytes more, before these are added (linear in the CRC)."""
    import numpy as np

    sizes, which = np.unique(length, return_inverse=True)
    out = np.zeros(len(crc), dtype="uint32")
    columns = np.array([[zlib.crc32(bytes(int(n)), 1 << bit) ^ zlib.crc32(bytes(int(n))) for bit in range(32)] for n in sizes], dtype="uint32").reshape(-1, 32)
    for bit in range(32):
        out ^= np.where(crc >> bit & 1, columns[which, bit], 0).astype("uint32")
    return out


def run_crcs(payloads, most: int):
    """CRC-32s of all runs of 1 to `most` words joined by a space: of single words, then of pairs, and so on."""
    import numpy as np

    word, size = (payloads & 0xFFFFFFFF).astype("uint32"), payloads >> 32
    out = [word]
    if most > 1:
        led = shifted(np.full(len(word), zlib.crc32(b" "), dtype="uint32"), size) ^ word  # of a space and the word
    for n in range(2, most + 1):
        if len(word) < n:
            break
        out.append(shifted(out[-1][:-1], size[n - 1 :] + 1) ^ led[n - 1 :])
    return out


def hashed_features(docs: DataFrame, runs: int, buckets: int) -> DataFrame:
    """id, n_words, n_features and features (buckets as little-endian unsigned numbers) of each row of docs (id, text)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def segments_of(text: str) -> Iterator[bytes]:
        data, at = text.encode("utf-8", "surrogatepass").translate(_PLAIN), 0
        while at < len(data):
            end = data.find(b" ", at + SEGMENT)
            end = len(data) if end < 0 else end
            yield data[at:end]
            at = end

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for p in parts:
            words, held, before = np.zeros(len(p), dtype="int64"), [[] for _ in range(len(p))], {}
            block: list[tuple[int, bytes]] = []

            def flush():
                for (row, _), found in zip(block, scanned([s for _, s in block])):
                    words[row] += len(found)
                    last = before.get(row, found[:0])  # the end of the segment before, for runs over the cut
                    both = np.concatenate([last, found])
                    for n, crcs in enumerate(run_crcs(both, runs), 1):
                        held[row].append((crcs[max(0, len(last) - n + 1) :] % buckets).astype(kind).tobytes())
                    before[row] = both[max(0, len(both) - runs + 1) :]
                block.clear()

            size = 0
            for row, text in enumerate(p["text"]):
                for s in segments_of(text):
                    block.append((row, s))
                    size += len(s)
                    if size >= BLOCK:
                        flush()
                        size = 0
            flush()
            data = [b"".join(h) for h in held]
            yield pd.DataFrame({"id": p["id"].astype("Int64"), "n_words": words, "n_features": [len(b) // np.dtype(kind).itemsize for b in data], "features": data})

    text_batches(docs.sparkSession)
    rows = docs.select(F.col("id").cast("long").alias("id"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "id long, n_words long, n_features long, features binary")


def bucket_counts(features: DataFrame, buckets: int) -> list[int]:
    """How many features fall into each bucket; a task hands on its sums."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        sums = np.zeros(buckets, dtype="int64")
        for p in parts:
            sums += np.bincount(np.frombuffer(b"".join(p["features"]), dtype=kind), minlength=buckets)
        met = np.nonzero(sums)[0]
        yield pd.DataFrame({"bucket": met, "n": sums[met]})

    out = [0] * buckets
    for r in features.select("features").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of target to corpus for each bucket, one added to every count."""
    k, s, t = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(corpus, target)]


def mean_gains(features: DataFrame, gain: list[int], buckets: int) -> DataFrame:
    """id, n_words, n_features and weight (floored mean gain; 0 without features)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        table = np.array(gain, dtype="int64")
        for p in parts:
            sums = [int(table[np.frombuffer(b, dtype=kind)].sum()) for b in p["features"]]
            p["weight"] = [s // max(int(n), 1) for s, n in zip(sums, p["n_features"])]
            yield p[["id", "n_words", "n_features", "weight"]].astype({"id": "Int64"})

    return features.mapInPandas(run, "id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, runs: int = 1, buckets: int = 10_000, seed: str = "2024:") -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs (doc_id, text); target: text.

    Of the rows with least_words words or more, floor(percent * n / 100) with the highest scores are drawn
    and ranked from 1, ties by doc_id (null last, its noise that of the id `null`); the rank of others is
    null. Null and empty texts have no features and weight 0. Rows that repeat a doc_id are drawn each.
    Empty docs give an empty result, an empty target counts zero everywhere. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "resampling")
    held = scratch.put("features", hashed_features(docs.select(F.col("doc_id").alias("id"), "text"), runs, buckets))
    wanted = scratch.put("target", hashed_features(target.select(F.lit(None).cast("long").alias("id"), "text"), runs, buckets))
    gain = gains(bucket_counts(held, buckets), bucket_counts(wanted, buckets))
    number = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((number + 0.5) / 4294967296.0)))
    scored = mean_gains(held, gain, buckets).withColumn("score", F.col("weight") + noise)
    scored = scratch.put("scored", scored.withColumn("able", F.col("n_words") >= least_words))
    able = scored.where("able")
    drawn = percent * able.count() // 100
    directory = rank_directory(able.drop("able", "n_words"), [F.desc("score"), F.asc_nulls_last("id")], f"{scratch.top}/ranks")
    ranked = directory.ranked().withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ranked.unionByName(scored.where("not able").drop("able", "n_words").withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
