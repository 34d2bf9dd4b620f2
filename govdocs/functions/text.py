"""Text expressions; all are built-in functions, so that they stay inside the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space: Unicode's, and the four separators that Python adds.
SPACE = r"[\s\x1c-\x1f]"
#: Short words that carry no evidence; fixed values.
STOPWORDS = ["a", "an", "and", "are", "for", "from", "how", "is", "of", "or", "the", "to", "what", "which", "who", "with"]
#: Fixed value: words joined by - or _, numbers with thousands and decimals, and currency signs.
BM25_TOKEN = r"(?U)[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*|\d+(?:,\d{3})*(?:\.\d+)?|\$|€|£"
#: Stated times, amounts and working days; fixed values.
TIME_REQUIREMENT = r"(?iU)\b(?:within |at least |first )?(\d+\s+(?:minutes?|business days?|working days?))\b|\b(first week)\b"
THRESHOLD = (
    r"(?iU)\bUSD\s+\d{1,3}(?:,\d{3})*(?:\s+and\s+up\s+to\s+USD\s+\d{1,3}(?:,\d{3})*)?"
    r"|\b(?:more than|longer than|above|up to and including)\s+\d+\s+(?:consecutive\s+)?working days\b"
)


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once: a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), then), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def normalize_text(c: Column) -> Column:
    """Line ends as LF, lines without trailing white space, the whole stripped, one LF at the end; empty stays empty."""
    lines = F.regexp_replace(c, r"\r\n?", "\n")
    body = strip(F.regexp_replace(lines, r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)", ""))
    return let(body, lambda b: F.when(b == "", F.lit("")).otherwise(F.concat(b, F.lit("\n"))))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, stripped."""
    return strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def short_hash(c: Column, n: int = 10) -> Column:
    """The first n hex digits of the SHA-1."""
    return F.substring(F.sha1(c), 1, n)


def slugify(c: Column, default: str = "section") -> Column:
    """Lower-case letters and digits, other runs as one hyphen; default if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def normalize_list(c: Column) -> Column:
    """Trimmed values without blanks; of those that differ only in case, the first, in order. Sorted once, so that long lists stay cheap."""
    trimmed = F.filter(F.transform(c, strip), lambda x: x.isNotNull() & (x != ""))

    def first_of_each(xs: Column) -> Column:
        placed = F.array_sort(F.transform(xs, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x"))))

        def firsts(ps: Column) -> Column:
            new = F.filter(ps, lambda p, k: (k == 0) | (F.get(ps, k - 1)["low"] != p["low"]))
            return F.transform(F.array_sort(F.transform(new, lambda p: F.struct(p["i"].alias("i"), p["x"].alias("x")))), lambda p: p["x"])

        return let(placed, firsts)

    return F.when(c.isNotNull(), let(trimmed, first_of_each))


def bm25_tokens(c: Column) -> Column:
    """Index terms: each token, its comma-free and hyphen-free forms, then bigrams and trigrams over that list."""

    def forms(token: Column) -> Column:
        digits = F.when(token.rlike(r"(?U)\d"), F.array(F.replace(token, F.lit(","), F.lit("")))).otherwise(F.array().cast("array<string>"))
        parts = F.filter(F.split(token, "[-_]+"), lambda x: x != "")
        joined = F.when(token.rlike("[-_]"), F.concat(parts, F.array(F.array_join(parts, "")))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(token), digits, joined)

    base = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(BM25_TOKEN), F.lit(0)), lambda t: forms(F.lower(t))))

    def with_grams(terms: Column) -> Column:
        n = F.size(terms)
        grams = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.concat_ws("__", *[F.get(terms, i + j) for j in range(k)]))).otherwise(F.array().cast("array<string>"))
        return F.concat(terms, grams(2), grams(3))

    return let(base, with_grams)


def words_only(c: Column) -> Column:
    """Lower case, everything but letters a-z and digits as one space, stripped."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def evidence_tokens(c: Column) -> Column:
    """Words of three letters or more that aren't stop words; a plural of over four letters also as its singular."""
    words = F.filter(F.split(words_only(c), " "), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))
    return F.flatten(F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 4), F.array(w, F.substring(w, F.lit(1), F.length(w) - 1))).otherwise(F.array(w))))


def answer_tokens(c: Column) -> Column:
    """Words of three letters or more; a plural of over four letters only as its singular."""
    words = F.filter(F.split(words_only(c), " "), lambda w: F.length(w) > 2)
    return F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def where_said(c: Column, words: list[str], values: Column) -> Column:
    """values, an array of strings, where c holds one of the words in any case, else none: patterns that need one of them are not tried on all texts. Letters that Unicode takes for i, s and k in another case count as any word."""
    said = let(F.lower(c), lambda low: functools.reduce(lambda a, b: a | b, [low.contains(w) for w in words])) | c.rlike("[\u0131\u0130\u017f\u212a]")
    return F.when(~said, F.array().cast("array<string>")).otherwise(values)


def time_requirements(c: Column) -> Column:
    """Stated times in lower case, each once."""
    first, second = (F.regexp_extract_all(c, F.lit(TIME_REQUIREMENT), F.lit(g)) for g in (1, 2))
    found = F.array_distinct(F.transform(F.arrays_zip(first.alias("a"), second.alias("b")), lambda x: F.lower(collapse(F.coalesce(F.nullif(x["a"], F.lit("")), x["b"])))))
    return where_said(c, ["minute", "business", "working", "first week"], found)


def thresholds(c: Column) -> Column:
    """Stated amounts and lengths, of those that differ only in case the first."""
    return where_said(c, ["usd", "working"], normalize_list(F.transform(F.regexp_extract_all(c, F.lit(THRESHOLD), F.lit(0)), collapse)))


def sentences(c: Column) -> Column:
    return F.split(collapse(c), r"(?<=[.!?])\s+")


def evidence_quote(text: Column, hint: Column, limit: int = 500) -> Column:
    """The first sentence that holds the hint, without regard to case, else the text; at most limit characters."""
    hit = F.filter(sentences(text), lambda s: F.lower(s).contains(F.lower(hint)) & (hint != ""))
    return F.substring(F.coalesce(F.get(hit, F.lit(0)), collapse(text)), 1, limit)


def evidence_quotes(text: Column, items: Column, hints, limit: int = 500) -> Column:
    """For each item the quotes of its hints (an array), as evidence_quote gives them; the text is cut into sentences once."""

    def of(cut: Column) -> Column:
        def quote(hint: Column) -> Column:
            hit = F.filter(cut, lambda s: F.lower(s).contains(F.lower(hint)) & (hint != ""))
            return F.substring(F.coalesce(F.get(hit, F.lit(0)), F.array_join(cut, " ")), 1, limit)

        return F.transform(items, lambda e: F.transform(hints(e), quote))

    return let(sentences(text), of)


def excerpt(c: Column, limit: int = 1200) -> Column:
    body = strip(c)
    return F.when(F.length(body) <= limit, body).otherwise(F.concat(F.regexp_replace(F.substring(body, 1, limit - 3), rf"(?U){SPACE}+\z", ""), F.lit("...")))


def text_match(c: Column, value: str | None, contains: bool = False) -> Column:
    """Equality or containment without regard to case; no expectation passes."""
    if value is None:
        return F.lit(True)
    return F.lower(c).contains(value.lower()) if contains else F.lower(c) == value.lower()


def list_match(c: Column, value: str | None) -> Column:
    """Whether any item equals the value without regard to case."""
    return F.lit(True) if value is None else F.exists(c, lambda x: F.lower(x) == value.lower())
