"""Quality rules: a table of thresholds compiled into one projection of length, symbol, stop-word and line ratios.

All of it is built-in functions, so that a document is judged where it is read, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govdocs.llm.common import WORD, text_or_empty

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Function words; a text in running prose has some of one language's.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "it", "that", "for", "on", "with", "as", "a", "by", "this"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "pour", "par", "est"],
    "de": ["der", "die", "das", "und", "den", "von", "zu", "in", "mit", "sich", "ein", "des", "auf", "für", "ist"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "por", "con", "se", "para", "del", "una"],
}


@dataclass(frozen=True)
class Threshold:
    """A measure must lie in [least, most]; None: no bound. A null measure passes."""

    measure: str
    least: float | None = None
    most: float | None = None


#: What the base doesn't decide. Ratios are of words or of lines with a word.
THRESHOLDS = (
    Threshold("n_words", most=5_000_000),
    Threshold("mean_word_chars", 2, 14),
    Threshold("symbol_ratio", most=0.2),
    Threshold("stop_ratio", least=0.02),
    Threshold("dup_line_ratio", most=0.3),
)


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once: a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeated_words(words: Column) -> Column:
    """Words inside windows of five that occur twice or more in the text, the first occurrence included."""
    n = F.size(words)
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(WINDOW)])))

    def marked(gs: Column) -> Column:
        placed = F.array_sort(F.transform(gs, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(ps: Column) -> Column:
            last = F.size(ps)
            same = lambda p, k, d: F.coalesce(F.get(ps, k + d)["g"] == p["g"], F.lit(False))
            hit = F.transform(ps, lambda p, k: F.when(((k > 0) & same(p, k, -1)) | ((k < last - 1) & same(p, k, 1)), p["i"]))
            return F.array_sort(F.filter(hit, lambda x: x.isNotNull()))

        walk = lambda at: F.aggregate(
            at,
            F.struct(F.lit(-WINDOW).alias("before"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("before"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["before"])).alias("n")),
            lambda acc: acc["n"],
        )
        return walk(let(placed, starts))

    # most texts repeat no window at all: a hash set tells that before anything is sorted
    counted = let(grams, lambda gs: F.when(F.size(F.array_distinct(gs)) < F.size(gs), marked(gs)).otherwise(F.lit(0).cast("long")))
    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(counted)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures that thresholds may name."""
    t = text_or_empty()
    rows = docs.select("doc_id", t.alias("text"), F.regexp_extract_all(t, F.lit(WORD), F.lit(0)).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    n_words = F.size("words").cast("long")
    word_chars = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    stops = F.array(*[F.lit(w) for w in sorted({w for ws in STOP_WORDS.values() for w in ws})])
    rows = rows.select(
        "doc_id",
        n_words.alias("n_words"),
        word_chars.alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"))).alias("line"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.array_contains(stops, F.lower(w)))).cast("long").alias("n_stop_words"),
    )
    per = lambda a, b: F.try_divide(F.col(a), F.col(b))
    rows = rows.withColumns({"n_lines": F.col("line.n"), "n_dup_lines": F.col("line.dup")}).drop("line")
    return rows.withColumns({"mean_word_chars": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "stop_ratio": per("n_stop_words", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines")})


def verdict(thresholds=THRESHOLDS) -> Column:
    """All thresholds as one condition."""
    out = F.lit(True)
    for t in thresholds:
        for bound, ok in ((t.least, F.col(t.measure) >= F.lit(t.least)), (t.most, F.col(t.measure) <= F.lit(t.most))):
            if bound is not None:
                out &= F.coalesce(ok, F.lit(True))
    return out


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """One row per row of docs (doc_id, text): the measures, base_failed and kept.

    base_failed: under ten words, or over a fifth of the words in repeated windows. Null and empty
    texts have no words and fail. Rows that repeat a doc_id are judged each; an empty table gives an
    empty result; other columns are ignored.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))
