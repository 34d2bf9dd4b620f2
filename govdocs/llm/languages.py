"""Language identification by Bloom filters of n-grams whose places hold a bit for each language.

A language's profile are the n-grams of letters (other characters are one space) that make up at least
`least` of its training text, and at least `part` of what they make up in the language where they are most
common. All profiles share one bit-sliced filter: a place holds a mask of languages, and the masks of an
n-gram's places, taken together, are the languages that have it. A text's hits by language are the bits of
its n-grams' masks; those that a filter as full as this one gives by chance are taken off, and the language
with most of the rest is the answer. A profile has at most 1 / least n-grams, so that the filter that is
broadcast is bounded by PLACES / least longs for 64 languages, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govdocs.llm.common import Scratch, text_batches, text_or_empty

PROBES, PLACES, PAGE = 4, 16, 1 << 13
#: Code points that are taken at a time, of a text and of a batch, and n-grams that a task counts before it hands them on.
PIECE, BLOCK, COUNTED = 1 << 19, 1 << 21, 1 << 20
#: Numbered n-grams that are looked up by place instead of sorted.
DENSE = 1 << 22
SPACE = 32
UNKNOWN = "und"


@cache
def letters():
    """Whether each code point is a letter."""
    import numpy as np

    return np.array([chr(i).isalpha() for i in range(0x110000)])


def code_pieces(text: str, overlap: int) -> Iterator[tuple]:
    """(codes, carried): code points in lower case, runs of other characters as one space, one at both ends; a long text in pieces, each led by the last `overlap` codes before it."""
    import numpy as np

    at, tail = 0, np.array([SPACE], dtype="int64")
    carried = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            cut = text.rfind(" ", at + 1, end)
            end = cut if cut > 0 else end
        codes = np.frombuffer(text[at:end].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("int64")
        codes = np.where(letters()[codes], codes, SPACE)
        codes = np.concatenate([tail, codes, np.full(int(end == len(text)), SPACE)])
        codes = codes[np.concatenate([[True], (codes[1:] != SPACE) | (codes[:-1] != SPACE)])]
        yield codes, carried
        tail = codes[-overlap:] if overlap else codes[:0]
        at, carried = end, len(tail)


def blocks_of(texts, overlap: int) -> Iterator[list[tuple]]:
    """(row, codes, carried) of the texts, in lists of some BLOCK codes."""
    block, size = [], 0
    for row, text in enumerate(texts):
        for codes, carried in code_pieces(text, overlap):
            block.append((row, codes, carried))
            size += len(codes)
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def named(codes, n: int):
    """Number of an n-gram that begins with each row of codes (n columns)."""
    import numpy as np

    out = np.full(len(codes), n, dtype="int64")
    for k in range(n):
        out = out * np.int64(0x5851F42D4C957F2D) + codes[:, k] + 1
    return out


def numbered(codes, n: int):
    """(place, grams): for each start of n codes the place of its n-gram in grams (numbers, each once)."""
    import numpy as np

    starts = max(0, len(codes) - n + 1)
    known = np.nonzero(np.bincount(codes))[0]
    if not starts or len(known) ** n > DENSE:
        windows = np.lib.stride_tricks.sliding_window_view(codes, n) if starts else np.zeros((0, n), dtype="int64")
        grams, place = np.unique(named(windows, n), return_inverse=True)
        return place, grams
    of = np.zeros(known[-1] + 1, dtype="int64")
    of[known] = np.arange(len(known))
    small, at = of[codes], np.zeros(starts, dtype="int64")
    for k in range(n):
        at = at * len(known) + small[k : k + starts]
    met = np.nonzero(np.bincount(at))[0]
    renumber = np.zeros(met[-1] + 1, dtype="int64")
    renumber[met] = np.arange(len(met))
    parts = [known[met // len(known) ** (n - 1 - k) % len(known)] for k in range(n)]
    return renumber[at], named(np.stack(parts, axis=1), n)


def spans(block: list[tuple], n: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, stop) of the n-grams of each piece in the joined codes of a block; those of carried codes alone were in the piece before."""
    at = 0
    for row, codes, carried in block:
        start = at + max(0, carried - n + 1)
        yield row, start, max(start, at + len(codes) - n + 1)
        at += len(codes)


def gram_counts(texts: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """lang, gram, n of texts (lang, text). A task counts its batches together."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        held: dict[str, tuple] = {}

        def out():
            for lang, (grams, n) in held.items():
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})
            held.clear()

        for p in parts:
            names, lang_of = np.unique(p["lang"].to_numpy(dtype=object), return_inverse=True)
            for block in blocks_of(p["text"], max(sizes) - 1):
                joined = np.concatenate([codes for _, codes, _ in block])
                for n in sizes:
                    place, grams = numbered(joined, n)
                    of = np.full(len(place), -1)
                    for row, start, stop in spans(block, n):
                        of[start:stop] = lang_of[row]
                    kept = of >= 0
                    counts = np.bincount(of[kept] * len(grams) + place[kept], minlength=len(names) * len(grams)).reshape(len(names), -1)
                    for lang, row in zip(names, counts):
                        met = row > 0
                        old = held.get(lang, (grams[:0], row[:0]))
                        both, at = np.unique(np.concatenate([old[0], grams[met]]), return_inverse=True)
                        held[lang] = both, np.bincount(at, weights=np.concatenate([old[1], row[met]]), minlength=len(both)).astype("int64")
            if sum(len(g) for g, _ in held.values()) > COUNTED:
                yield from out()
        yield from out()

    return texts.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def places(grams, size: int):
    """The PROBES places of each of grams among `size`, a power of two."""
    import numpy as np

    x = grams.view("uint64").copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # mixes all bits into all
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    first, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return [((first + np.uint64(i) * step) & np.uint64(size - 1)).astype("int64") for i in range(PROBES)]


@dataclass(frozen=True)
class Filters:
    """Sorted languages, the masks (place, 64 languages), how full each language's filter is, and the most common language."""

    languages: list[str]
    masks: object
    full: list[float]
    usual: str

    def containing(self, grams):
        """Mask of the languages that have each of grams, 64 to a column."""
        import numpy as np

        out = np.full((len(grams), self.masks.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in places(grams, len(self.masks)):
            out &= self.masks[at]
        return out


def fitted(docs: DataFrame, sizes: tuple[int, ...], least: float, part: float, scratch: Scratch) -> Filters:
    """The filters of docs (lang, text), all of them."""
    import numpy as np

    counts = scratch.put("counts", gram_counts(docs, sizes))
    totals = sorted((r.lang, r.n) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect())  # a row for each language
    languages = [lang for lang, _ in totals]
    known = docs.sparkSession.createDataFrame([(*t, k) for k, t in enumerate(totals)], "l string, total long, k int")
    shares = counts.join(F.broadcast(known), F.col("lang") == F.col("l")).select("gram", "k", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= least)
    shares = scratch.put("shares", shares)
    most = shares.groupBy("gram").agg((F.max("share") * part).alias("wanted"))
    profiles = scratch.put("profiles", shares.join(most, "gram").where("share >= wanted").select("gram", "k"))
    largest = profiles.groupBy("k").count().agg(F.max("count")).first()[0] or 1
    size = 1 << (max(PAGE, PLACES * largest) - 1).bit_length()
    words = max(1, -(-len(languages) // 64))
    masks = profiles.groupBy("gram", F.floor(F.col("k") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, k % 64)")).alias("mask"))

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in places(p["gram"].to_numpy(), size):
                at = at * words + p["word"].to_numpy()
                yield pd.DataFrame({"page": at // PAGE, "at": at % PAGE, "mask": p["mask"]})

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for bits in p["bits"]:
                page = np.zeros(PAGE, dtype="int64")
                page[[b["at"] for b in bits]] = [b["mask"] for b in bits]
                out.append(page.tobytes())
            yield pd.DataFrame({"page": p["page"], "bytes": out})

    rows = masks.mapInPandas(placed, "page long, at long, mask long").groupBy("page", "at").agg(F.bit_or("mask").alias("mask"))
    pages = rows.groupBy("page").agg(F.collect_list(F.struct("at", "mask")).alias("bits"))  # at most PAGE
    table = np.zeros(size * words, dtype="uint64")
    for r in pages.mapInPandas(packed, "page long, bytes binary").collect():  # no larger than the filter
        table[r.page * PAGE : (r.page + 1) * PAGE] = np.frombuffer(r.bytes, dtype="uint64")
    table = table.reshape(size, words)
    full = [float((table[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean()) for k in range(len(languages))]
    return Filters(languages, table, full, max(totals, key=lambda t: t[1])[0] if totals else UNKNOWN)


def corrected(hits, n, full: list[float]):
    """Hits by row and language without those that chance gives n n-grams in a filter so full, none below zero."""
    import numpy as np

    chance = np.array(full) ** PROBES
    return np.maximum(0.0, (hits - n[:, None] * chance) / np.maximum(1 - chance, 1e-9))


def predictions(texts, filters: Filters, sizes: tuple[int, ...]) -> tuple[list[str], list[float]]:
    """(language, score) of each text."""
    import numpy as np

    hits, total = np.zeros((len(texts), len(filters.languages))), np.zeros(len(texts))
    for block in blocks_of(texts, max(sizes) - 1):
        joined = np.concatenate([codes for _, codes, _ in block])
        for n in sizes:
            place, grams = numbered(joined, n)
            row, start, stop = np.array(list(spans(block, n))).T
            np.add.at(total, row, stop - start)
            masks = filters.containing(grams)
            for k in range(len(filters.languages)):
                has = (masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype("int64")
                sums = np.concatenate([[0], np.cumsum(has[place])])
                np.add.at(hits[:, k], row, sums[np.minimum(stop, len(place))] - sums[np.minimum(start, len(place))])
    real = corrected(hits, total, filters.full)
    names, scores = [], []
    for t, r in zip(texts, real):
        some = bool(filters.languages) and any(c.isalpha() for c in t)
        best = int(r.argmax()) if some else 0
        names.append(UNKNOWN if not some else filters.languages[best] if r[best] > 0 else filters.usual)
        scores.append(float(r[best] / r.sum()) if some and r[best] > 0 else 0.0)
    return names, scores


def held_out_column():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, sizes: tuple[int, ...] = (2, 3), least: float = 1e-5, part: float = 0.5) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the language's share of all corrected hits) of each row of docs (doc_id, text, lang).

    Learnt from all rows that are not held out and have a lang. A text that is null or has no letter is
    `und` with score 0, and so is every text if nothing could be learnt; one whose n-grams no language has
    gets the language with most training text and score 0. Equal hits go to the first language by name. A
    null doc_id counts as the id `null`; rows that repeat a doc_id are each returned. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "languages")
    text_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_column().alias("held_out"), "lang", text_or_empty().alias("text"))
    known = rows.where(~F.col("held_out") & F.col("lang").isNotNull()).select("lang", "text")
    shared = spark.sparkContext.broadcast(fitted(known, sizes, least, part, scratch))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            names, scores = predictions(p["text"].tolist(), shared.value, sizes)
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "held_out": p["held_out"], "lang_pred": names, "score": scores})

    return rows.drop("lang").mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
