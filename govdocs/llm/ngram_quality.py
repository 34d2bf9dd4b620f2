"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text, one model a language.

The model's n-grams are three characters; every character and every language that occurs has its own.
A document's n-grams are counted where it is read. Some thousand documents are counted together, as lists
by n-gram of (document, count), so that an n-gram is carried once for all of them. These lists make the
model's counts (over the trusted documents) and meet its shards by language and n-gram again, where each
list is weighed by the log probability of its n-gram; sums by document give the perplexities. Nothing of
the model passes the driver. A language's quantiles of trusted documents set its thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govdocs.llm.common import Scratch, small_side, text_batches, text_or_empty

#: Bits of a code point; three of them make an n-gram in a long.
BITS = 21
#: The model of all trusted text, for languages without any; languages' models are named after this prefix.
POOLED, OWN = "*", "l:"
#: Documents that are counted together, and n-grams (of documents) after which a group is closed.
GROUP_DOCS, GROUP_EVENTS = 4096, 4_000_000
#: About so many groups meet their log probabilities together, in SHARDS tasks by n-gram: what a task holds and what it
#: hands on for a document depend on neither the corpus nor the cluster.
SALT_GROUPS, SHARDS = 32, 4
BLOCK = 1 << 20
LISTS = "batch long, lang string, g long, n int, first int, docs binary, counts binary, ids array<long>, langs array<string>, sizes array<long>"


def trigram_counts(text: str):
    """(codes, counts) of the trigrams of a text in lower case, ascending; ASCII white space is one symbol and two boundaries (0) come first."""
    import numpy as np

    low, before, codes, counts = text.lower(), np.zeros(2, dtype=np.int64), [], []
    for at in range(0, len(low), BLOCK):  # blocks, so that long texts stay small
        s = np.frombuffer(low[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        s[(s >= 9) & (s <= 13)] = 32
        s = np.concatenate([before, s])
        found, n = np.unique((s[:-2] << 2 * BITS) | (s[1:-1] << BITS) | s[2:], return_counts=True)
        codes.append(found)
        counts.append(n)
        before = s[-2:]
    if len(codes) < 2:
        return (codes[0], counts[0]) if codes else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    found, place = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)


def grouped_lists(docs: DataFrame) -> DataFrame:
    """LISTS of docs (doc_id, lang, text): for each group of documents one row with their ids, languages and sizes, and one for each language and n-gram with the documents that have it (n of them: the first place in the group and the steps to the next, and how often each; a byte for each number if they fit)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        from pyspark import TaskContext

        batch = TaskContext.get().partitionId() << 32
        ids, langs, sizes, by_lang, events = [], [], [], {}, 0

        def close() -> Iterator[pd.DataFrame]:
            none = dict.fromkeys(["lang", "g", "n", "first", "docs", "counts"], [None])
            yield pd.DataFrame({"batch": [batch], **none, "ids": [ids], "langs": [langs], "sizes": [sizes]}).astype({"g": "Int64", "n": "Int32", "first": "Int32"})
            for lang, held in by_lang.items():
                codes = np.concatenate([c for _, c, _ in held])
                order = np.argsort(codes, kind="stable")
                places = np.repeat([k for k, _, _ in held], [len(c) for _, c, _ in held])[order]
                n = np.concatenate([n for _, _, n in held])[order]
                g, at = np.unique(codes[order], return_index=True)
                steps = np.diff(places, prepend=0)
                steps[at] = 0
                packed = {"docs": narrow(steps, at, "<u2"), "counts": narrow(n, at, "<u4")}
                out = pd.DataFrame({"batch": batch, "lang": lang, "g": g, "n": np.diff(at, append=len(n)), "first": places[at], **packed, "ids": None, "langs": None, "sizes": None})
                for row in range(0, len(out), 20_000):
                    yield out.iloc[row : row + 20_000]

        for p in parts:
            for doc, lang, text in zip(p["doc_id"].astype("Int64"), p["lang"], p["text"]):
                codes, n = trigram_counts(text)
                if len(codes):
                    by_lang.setdefault(lang, []).append((len(ids), codes, n))
                ids.append(None if doc is pd.NA else int(doc))
                langs.append(lang)
                sizes.append(int(n.sum()))
                events += len(codes)
                if len(ids) == GROUP_DOCS or events >= GROUP_EVENTS:
                    yield from close()
                    batch, ids, langs, sizes, by_lang, events = batch + 1, [], [], [], {}, 0
        if ids:
            yield from close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, LISTS)


def narrow(numbers, at, wide: str) -> list[bytes]:
    """The runs of numbers that begin at `at`: a byte each where all of a run fit, else as `wide`."""
    import numpy as np

    size, fits = int(wide[-1]), np.maximum.reduceat(numbers, at) < 256
    small, large = np.minimum(numbers, 255).astype("<u1").tobytes(), numbers.astype(wide).tobytes()
    ends = [*at[1:].tolist(), len(numbers)]
    return [small[a:b] if ok else large[size * a : size * b] for a, b, ok in zip(at.tolist(), ends, fits.tolist())]


def widened(runs: pd.Series, lengths: list[int], wide: str):
    """What narrow packed, one run after the other."""
    import numpy as np

    return np.concatenate([np.frombuffer(r, dtype="<u1" if len(r) == n else wide).astype(np.int64) for r, n in zip(runs, lengths)])


def unpacked(p: pd.DataFrame):
    """(lengths, places, counts) of the lists of a frame, one after the other."""
    import numpy as np

    lengths = p["n"].to_numpy().astype(np.int64)
    steps, counts = widened(p["docs"], lengths.tolist(), "<u2"), widened(p["counts"], lengths.tolist(), "<u4")
    at = np.cumsum(lengths) - lengths
    steps[at] = 0
    walked = np.cumsum(steps)
    return lengths, walked - np.repeat(walked[at] - p["first"].to_numpy().astype(np.int64), lengths), counts


def trusted_counts(lists: DataFrame, trusted: DataFrame) -> DataFrame:
    """lang, g, n over the trusted documents (batch, marks: their places in the group)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for p in parts:
            for _, q in p.groupby("batch", sort=False):
                lengths, places, counts = unpacked(q)
                ok = np.zeros(1 << 16, dtype=np.int64)
                ok[np.asarray(q["marks"].iloc[0], dtype=np.int64)] = 1
                n = np.add.reduceat(counts * ok[places], np.cumsum(lengths) - lengths)
                yield pd.DataFrame({"lang": q["lang"], "g": q["g"], "n": n})[n > 0]

    rows = lists.join(trusted, "batch").select("batch", "lang", "g", "n", "first", "docs", "counts", "marks")
    return rows.mapInPandas(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def model_counts(counts: DataFrame) -> DataFrame:
    """model, g, n: the counts of each language, and of all trusted text."""
    own = counts.where("lang is not null").select(F.concat(F.lit(OWN), "lang").alias("model"), "g", "n")
    return own.unionByName(counts.groupBy("g").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("model"), "g", "n"))


def discounts(counts: DataFrame) -> DataFrame:
    """model and the three discounts of modified Kneser-Ney, from how many n-grams occur one to four times."""
    k = [F.count_if(F.col("n") == i).cast("double").alias(f"k{i}") for i in range(1, 5)]
    y = F.try_divide(F.col("k1"), F.col("k1") + 2 * F.col("k2"))
    out = []
    for i in range(1, 4):
        d = i - (i + 1) * y * F.try_divide(F.col(f"k{i + 1}"), F.col(f"k{i}"))
        out.append(F.least(F.greatest(F.coalesce(d, F.lit(0.5 * i)), F.lit(0.05)), F.lit(float(i))).alias(f"d{i}"))
    return counts.groupBy("model").agg(*k).select("model", *out)


def discounted(counts: DataFrame, context: Column) -> tuple[DataFrame, DataFrame]:
    """(terms, contexts): of each n-gram (model, g, n) its discounted share of its context, and each context's weight for the lower order."""
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = counts.join(discounts(counts), "model").withColumn("context", context).withColumn("d", d).drop("d1", "d2", "d3")
    sums = rows.groupBy("model", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("cut"))
    terms = rows.join(sums, ["model", "context"]).select("model", "g", "context", ((F.col("n") - F.col("d")) / F.col("total")).alias("share"))
    return terms, sums.select("model", "context", (F.col("cut") / F.col("total")).alias("back"))


def lower_bits(g: Column, symbols: int) -> Column:
    return g.bitwiseAND(F.lit((1 << symbols * BITS) - 1))


def before_last(g: Column) -> Column:
    return F.shiftright(g, BITS)


def kneser_ney(tri: DataFrame, scratch: Scratch) -> dict[str, DataFrame]:
    """p3, p2, p1 (model, g, p of the seen n-grams), b3, b2 (model, context, back) and floor (model, p of a character that was not seen)."""
    bi = scratch.put("bi", tri.groupBy("model", lower_bits(F.col("g"), 2).alias("g")).agg(F.count("*").alias("n")))  # continuation counts
    uni = scratch.put("uni", bi.groupBy("model", lower_bits(F.col("g"), 1).alias("g")).agg(F.count("*").alias("n")))
    t1, c1 = discounted(uni, F.lit(0))
    # what the unigrams give away is shared evenly by the seen characters and one that stands for all others
    floor = c1.join(uni.groupBy("model").agg(F.count("*").alias("seen")), "model").select("model", (F.col("back") / (F.col("seen") + 1)).alias("floor"))
    floor = scratch.put("floor", floor)
    p1 = scratch.put("p1", t1.join(floor, "model").select("model", "g", (F.col("share") + F.col("floor")).alias("p")))
    t2, c2 = discounted(bi, before_last(F.col("g")))
    lower = lambda df: df.select("model", F.col("g").alias("low"), F.col("p").alias("p_low"))
    p2 = t2.join(c2, ["model", "context"]).withColumn("low", lower_bits(F.col("g"), 1)).join(lower(p1), ["model", "low"])
    p2 = scratch.put("p2", p2.select("model", "g", (F.col("share") + F.col("back") * F.col("p_low")).alias("p")))
    t3, c3 = discounted(tri, before_last(F.col("g")))
    p3 = t3.join(c3, ["model", "context"]).withColumn("low", lower_bits(F.col("g"), 2)).join(lower(p2), ["model", "low"])
    p3 = scratch.put("p3", p3.select("model", "g", (F.col("share") + F.col("back") * F.col("p_low")).alias("p")))
    return {"p3": p3, "p2": p2, "p1": p1, "b3": scratch.put("b3", c3), "b2": scratch.put("b2", c2), "floor": floor}


def log_probabilities(asked: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """model, g, logp of the trigrams of asked (model, g), seen or not: one join for each order and back-off weight."""
    g, out = F.col("g"), asked
    for name, key, column in (("p3", g, "g"), ("p2", lower_bits(g, 2), "g"), ("p1", lower_bits(g, 1), "g"), ("b3", before_last(g), "context"), ("b2", before_last(lower_bits(g, 2)), "context")):
        side = model[name].toDF("model", f"{name}_key", name)
        out = out.withColumn(f"{name}_key", key).join(side, ["model", f"{name}_key"], "left").drop(f"{name}_key")
    out = out.join(model["floor"], "model")
    one = F.lit(1.0)
    p2 = F.coalesce("p2", F.coalesce("b2", one) * F.coalesce("p1", "floor"))
    return out.select("model", "g", F.log(F.coalesce("p3", F.coalesce("b3", one) * p2)).alias("logp"))


def summed(lists: DataFrame, logp: DataFrame) -> DataFrame:
    """batch, place, total: the log probability of each document. lists and logp (salt, shard, model, g, …) meet by salt and shard."""

    def run(p: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(p) or not len(known):
            return pd.DataFrame({"batch": [], "place": [], "part": []})
        p = p.merge(known[["model", "g", "logp"]], on=["model", "g"])
        out = []
        for batch, q in p.groupby("batch", sort=False):
            lengths, places, counts = unpacked(q)
            part = np.bincount(places, weights=counts * np.repeat(q["logp"].to_numpy(), lengths), minlength=GROUP_DOCS)
            place = np.nonzero(part)[0]
            out.append(pd.DataFrame({"batch": batch, "place": place, "part": part[place]}))
        return pd.concat(out)

    left = lists.select("salt", "shard", "batch", "model", "g", "n", "first", "docs", "counts")
    met = left.groupBy("salt", "shard").cogroup(logp.groupBy("salt", "shard")).applyInPandas(run, "batch long, place int, part double")
    return met.groupBy("batch", "place").agg(F.sum("part").alias("total"))


def perplexities(docs: DataFrame, trusted_ids: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity of every row (doc_id, text, lang); null perplexity for empty texts or without trusted text."""
    lists = scratch.put("lists", grouped_lists(docs), compression="zstd")
    whole = lists.where("g is null").select("batch", F.posexplode(F.arrays_zip("ids", "langs", "sizes")).alias("place", "d"))
    rows = scratch.put("rows", whole.select("batch", "place", F.col("d.ids").alias("doc_id"), F.col("d.langs").alias("lang"), F.col("d.sizes").alias("n_symbols")))
    lists = lists.where("g is not null")
    n_batches = rows.select("batch").distinct().count()
    trusted = rows.join(trusted_ids, rows["doc_id"] == trusted_ids["t_id"], "left_semi")
    marks = scratch.put("marks", trusted.groupBy("batch").agg(F.collect_list("place").alias("marks")))  # GROUP_DOCS at most
    counts = scratch.put("own", trusted_counts(lists, small_side(marks, n_batches, 4 * GROUP_DOCS)))
    tri = scratch.put("tri", model_counts(counts))
    model = kneser_ney(tri, scratch)
    langs = counts.where("lang is not null").select("lang", F.concat(F.lit(OWN), "lang").alias("own")).distinct()
    langs = scratch.put("langs", langs)
    named = lambda df: df.join(small_side(langs, langs.count(), 64), "lang", "left").withColumn("model", F.coalesce("own", F.lit(POOLED))).drop("own")
    salt = F.pmod(F.xxhash64("batch"), F.lit(-(-n_batches // SALT_GROUPS) or 1)).cast("int")
    shard = F.pmod(F.xxhash64("model", "g"), F.lit(SHARDS)).cast("int")
    placed = named(lists).withColumns({"salt": salt, "shard": shard})
    asked = scratch.put("asked", placed.select("salt", "shard", "model", "g").distinct())
    logp = asked.join(log_probabilities(asked.select("model", "g").distinct(), model), ["model", "g"]).select("salt", "shard", "model", "g", "logp")
    totals = scratch.put("totals", summed(placed, scratch.put("logp", logp)))
    out = rows.join(totals, ["batch", "place"], "left")
    return out.select("doc_id", "lang", "n_symbols", F.round(F.exp(-F.col("total") / F.col("n_symbols")), 9).alias("perplexity"))


def held_out_column() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast("binary")) % 5 == 0


def ngram_quality(docs: DataFrame, labels: DataFrame, low: float = 0.001, high: float = 0.995) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, lang, n_symbols, perplexity, least, most, kept.

    Trusted text: rows labelled with quality 1 whose crc32 of doc_id as text is not divisible by five, all
    of them and whole. kept: the perplexity lies between the quantiles low and high of its language's
    trusted documents; languages without trusted text (null, too) take the model and the quantiles of all.
    Null and empty texts have no perplexity and are not kept, and nothing is without trusted text. Rows
    that repeat a doc_id are scored each; an empty table gives an empty result; other columns are ignored.
    """
    text_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "ngram-quality")
    ids = labels.where("quality = 1 and doc_id is not null").where(~held_out_column()).select(F.col("doc_id").alias("t_id")).distinct()
    ids = scratch.put("trusted", ids)
    ids = small_side(ids, ids.count(), 16)
    scored = scratch.put("scored", perplexities(docs, ids, scratch))
    known = scored.join(ids, scored["doc_id"] == ids["t_id"], "left_semi").where("perplexity is not null")
    # quantiles by language, and of all for the languages without
    bounds = known.groupBy("lang").agg(F.percentile_approx("perplexity", [low, high], 10_000).alias("q"))
    bounds = scratch.put("bounds", bounds.where("lang is not null").select(F.col("lang").alias("b_lang"), "q"))
    every = known.agg(F.percentile_approx("perplexity", [low, high], 10_000).alias("q")).first()[0] or [None, None]
    out = scored.join(bounds, scored["lang"] == bounds["b_lang"], "left")
    least, most = (F.coalesce(F.col("q")[i], F.lit(every[i])).cast("double") for i in (0, 1))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", least.alias("least"), most.alias("most")).withColumn("kept", F.coalesce((F.col("perplexity") >= F.col("least")) & (F.col("perplexity") <= F.col("most")), F.lit(False)))
