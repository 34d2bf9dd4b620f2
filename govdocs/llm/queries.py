"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from govdocs.llm import clusters, exact_dedup, languages, licenses, mixing, ngram_quality, packing, quality_rules, resampling, secrets, simhash, token_files, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(table(spark, sf_dir, "documents"))


def op4_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality.ngram_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.source_domain(), mixing.WEIGHTS, fraction=0.75, epochs=2).drop("body")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"]
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(*keep)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    """name -> query(spark, sf_dir)."""
    all_of = [op1_simhash, op2_packing, op3_token_files, op4_ngram_quality, op5_mixing, op6_quality_rules, op7_licenses, op8_exact_dedup, op9_secrets, op10_toxicity, op11_clusters, op12_languages, op13_resampling, pipeline]
    return {f.__name__: f for f in all_of}


OP5_SQL = r"""
WITH rows AS (
  SELECT doc_id, 'domain' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INT), 0) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS avail FROM rows GROUP BY ALL),
d0 AS (SELECT domain, sum(avail) * 2 AS cap, CASE domain WHEN 'domain0' THEN 2 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 3 WHEN 'domain3' THEN 2 ELSE 1 END AS weight,
       (SELECT floor(sum(avail) * 0.75)::HUGEINT FROM leaves) AS pb FROM leaves GROUP BY domain),
d1 AS (SELECT *, pb - coalesce(sum(cap) OVER o, 0) AS l, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS w FROM d0
       WINDOW o AS (ORDER BY cap::DOUBLE / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d2 AS (SELECT *, cap * w <= l * weight AS fully FROM d1),
d3 AS (SELECT *, first_value(CASE WHEN NOT fully THEN l END IGNORE NULLS) OVER o AS ll, first_value(CASE WHEN NOT fully THEN w END IGNORE NULLS) OVER o AS lw FROM d2
       WINDOW o AS (ORDER BY cap::DOUBLE / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
db AS (SELECT domain, CASE WHEN fully THEN cap ELSE greatest(0, least((weight * ll) // lw, cap)) END AS pb FROM d3),
l0 AS (SELECT domain, lang, sum(avail) * 2 AS cap, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS weight, any_value(pb) AS pb FROM leaves JOIN db USING (domain) GROUP BY domain, lang),
l1 AS (SELECT *, pb - coalesce(sum(cap) OVER o, 0) AS l, sum(weight) OVER (PARTITION BY domain) - coalesce(sum(weight) OVER o, 0) AS w FROM l0
       WINDOW o AS (PARTITION BY domain ORDER BY cap::DOUBLE / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l2 AS (SELECT *, cap * w <= l * weight AS fully FROM l1),
l3 AS (SELECT *, first_value(CASE WHEN NOT fully THEN l END IGNORE NULLS) OVER o AS ll, first_value(CASE WHEN NOT fully THEN w END IGNORE NULLS) OVER o AS lw FROM l2
       WINDOW o AS (PARTITION BY domain ORDER BY cap::DOUBLE / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
lb AS (SELECT domain, lang, CASE WHEN fully THEN cap ELSE greatest(0, least((weight * ll) // lw, cap)) END AS pb FROM l3),
s0 AS (SELECT domain, lang, source, avail, avail * 2 AS cap, 1 AS weight, pb FROM leaves JOIN lb USING (domain, lang)),
s1 AS (SELECT *, pb - coalesce(sum(cap) OVER o, 0) AS l, sum(weight) OVER (PARTITION BY domain, lang) - coalesce(sum(weight) OVER o, 0) AS w FROM s0
       WINDOW o AS (PARTITION BY domain, lang ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, cap * w <= l * weight AS fully FROM s1),
s3 AS (SELECT *, first_value(CASE WHEN NOT fully THEN l END IGNORE NULLS) OVER o AS ll, first_value(CASE WHEN NOT fully THEN w END IGNORE NULLS) OVER o AS lw FROM s2
       WINDOW o AS (PARTITION BY domain, lang ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
b AS (SELECT domain, lang, source, avail, CASE WHEN fully THEN cap ELSE greatest(0, least((weight * ll) // lw, cap)) END AS budget FROM s3),
p AS (SELECT *, CASE WHEN avail > 0 THEN least(2, budget // avail) ELSE 1 END AS passes FROM b),
q AS (SELECT rows.*, passes, budget - passes * avail AS part,
      sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('7-' || (passes + 1)::VARCHAR || '-' || coalesce(doc_id::VARCHAR, 'null')), doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM rows JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, (passes + CASE WHEN passes >= 2 THEN 0 WHEN part > 0 OR passes = 0 THEN (run <= part)::INT ELSE 0 END)::BIGINT AS copies FROM q
"""

OP6_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM t)),
dups AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM dups, unnest(range(0, 5)) u(k) GROUP BY doc_id),
ls AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
      len(list_filter(ws, lambda w: list_contains({stops}, lower(w))))::BIGINT AS n_stop_words
      FROM t JOIN ls USING (doc_id) LEFT JOIN reps USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT *, NOT base_failed AND n_words <= 5000000 AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.2
          AND n_stop_words / n_words >= 0.02 AND coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.3, true) AS kept FROM b
""".replace("{stops}", "[" + ", ".join(f"'{w}'" for w in sorted({w for ws in quality_rules.STOP_WORDS.values() for w in ws})) + "]")

OP8_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""



def clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """A part for each round: the nearest centroid of each vector, then the floored means."""
    parts = [
        "kept AS MATERIALIZED (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "v AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS i, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM kept)",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x AS y FROM f JOIN v USING (vec_id))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT vec_id, c, sum((x - y) * (x - y)) AS d FROM v JOIN c{r} USING (i) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{r} LEFT JOIN (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN v USING (vec_id) GROUP BY ALL) USING (c, i))")
    return f"""WITH {", ".join(parts)}, s AS (SELECT c, sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256 FROM a{rounds} JOIN s USING (c)"""


OP13_SQL = r"""
WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
ws AS MATERIALIZED (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
words AS MATERIALIZED (SELECT side, id, unnest(w) AS word FROM ws),
hexed AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
hashed AS MATERIALIZED (SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[(xor(c % 256, b) + 1)::INT])), 4294967295) % 10000 AS bucket FROM hexed, crc),
held AS MATERIALIZED (SELECT side, id, bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY ALL),
b AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 't') AS t FROM held GROUP BY bucket),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM b),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (coalesce(ss, 0) + 10000)::DOUBLE) / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(tt, 0) + 10000)::DOUBLE)))::BIGINT AS g FROM b, totals),
w AS (SELECT id, sum(n * g) AS s, sum(n) AS n FROM held JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((s - ((s % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT AS h FROM documents LEFT JOIN w ON id = doc_id),
all_ AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE))))::BIGINT AS score FROM scored),
ranked AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, 10 * (count(*) OVER (PARTITION BY n_features >= 20)) // 100 AS most FROM all_)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= most THEN r END AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express; the others are tested against brute force."""
    return {"op5_mixing": OP5_SQL, "op6_quality_rules": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op11_clusters": clusters_sql(), "op13_resampling": OP13_SQL}
