"""DuckDB SQL for the registered queries, over the same tables. Named parts are put together as they are used."""

from __future__ import annotations

import re

from govdocs.functions.text import STOPWORDS
from govdocs.plans import demo
from govdocs.settings import ACCESS_LEVELS, DOCUMENT_LEVEL_RELATIONS, POLICY_TYPES


def listed(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def rows_of(rows) -> str:
    cell = lambda v: listed(v) + "::VARCHAR[]" if isinstance(v, list) else "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def words_only(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def slug(x: str, default: str = "section") -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), ''), '{default}')"


def normal(x: str) -> str:
    return rf"(SELECT CASE WHEN b = '' THEN '' ELSE b || chr(10) END FROM (SELECT regexp_replace(regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[ \t\f\v]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g') AS b))"


def tokens_of(x: str) -> str:
    """Index terms before n-grams."""
    base = rf"list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*|\d+(?:,\d{{3}})*(?:\.\d+)?|\$|€|£'), lambda t: lower(t))"
    return f"""flatten(list_transform({base}, lambda t: [t] || CASE WHEN regexp_matches(t, '[0-9]') THEN [replace(t, ',', '')] ELSE [] END
      || CASE WHEN regexp_matches(t, '[-_]') THEN list_filter(string_split_regex(t, '[-_]+'), lambda p: p <> '') || [array_to_string(string_split_regex(t, '[-_]+'), '')] ELSE [] END))"""


def grams(e: str) -> str:
    return f"({e} || list_transform(range(1, len({e})), lambda i: {e}[i] || '__' || {e}[i + 1]) || list_transform(range(1, len({e}) - 1), lambda i: {e}[i] || '__' || {e}[i + 1] || '__' || {e}[i + 2]))"


def evidence_tokens(x: str) -> str:
    stop = listed(STOPWORDS)
    words = f"list_filter(string_split({words_only(x)}, ' '), lambda w: length(w) > 2 AND NOT list_contains({stop}, w))"
    return f"flatten(list_transform({words}, lambda w: CASE WHEN w LIKE '%s' AND length(w) > 4 THEN [w, left(w, length(w) - 1)] ELSE [w] END))"


def answer_tokens(x: str) -> str:
    return f"list_transform(list_filter(string_split({words_only(x)}, ' '), lambda w: length(w) > 2), lambda w: CASE WHEN w LIKE '%s' AND length(w) > 4 THEN left(w, length(w) - 1) ELSE w END)"


def sentences(x: str) -> str:
    return rf"string_split(regexp_replace({squeeze(x)}, '([.!?]) +', '\1' || chr(1), 'g'), chr(1))"


def quote(text: str, hint: str) -> str:
    return f"left(coalesce(list_filter({sentences(text)}, lambda s: contains(lower(s), lower({hint})) AND {hint} <> '')[1], {squeeze(text)}), 500)"


def node_id(label: str, kind: str) -> str:
    return f"('node:' || {slug(kind, 'value')} || ':' || left({slug(label, 'value')}, 80) || ':' || left(sha1({kind} || '|' || lower({label})), 8))"


def edge_id(s: str, r: str, t: str, c: str) -> str:
    return f"('edge:' || {slug(r, 'value')} || ':' || left(sha1({s} || '|' || {r} || '|' || {t} || '|' || {c}), 12))"


def dedupe(x: str) -> str:
    """Trimmed, without blanks, of those equal without case the first."""
    t = f"list_filter(list_transform({x}, lambda v: regexp_replace(v, '^\\s+|\\s+$', '', 'g')), lambda v: v <> '')"
    return f"(SELECT list_filter(z, lambda v, i: list_position(list_transform(z, lambda u: lower(u)), lower(v)) = i) FROM (SELECT {t} AS z))"


def edges_from(rows: str, hint: str) -> str:
    """Edges of a relation with chunk_id, doc_id, text, sl, st, tl, tt, relation_type."""
    return f"""SELECT {edge_id('s', 'relation_type', 't', 'chunk_id')} AS edge_id, s AS source_node_id, t AS target_node_id, relation_type, doc_id AS source_doc_id, chunk_id AS source_chunk_id,
      {quote('text', hint)} AS evidence_quote, 0.85::DOUBLE AS confidence FROM (SELECT *, {node_id('sl', 'st')} AS s, {node_id('tl', 'tt')} AS t FROM ({rows})) WHERE s <> t"""


DOC = "(CASE policy_type WHEN 'policy' THEN 'Policy' ELSE 'SOP' END)"
FILTERED = f"list_contains({listed(demo.FILTER['policy_types'])}, policy_type) AND list_has_any({listed(demo.FILTER['regions'])}, regions)"
STATED = r"""('Reply within ' || (doc_id % 9) || ' minutes or 2  Business Days; first week. Pay USD ' || (doc_id % 7 + 1) || ',000 and up to USD 9,500, more than ' || (doc_id % 5 + 1) || ' working days. ' || text)"""
TIMES = r"(?i)\b(?:within |at least |first )?(\d+\s+(?:minutes?|business days?|working days?))\b|\b(first week)\b"
LIMITS = r"(?i)\bUSD\s+\d{1,3}(?:,\d{3})*(?:\s+and\s+up\s+to\s+USD\s+\d{1,3}(?:,\d{3})*)?|\b(?:more than|longer than|above|up to and including)\s+\d+\s+(?:consecutive\s+)?working days\b"


def times(x: str) -> str:
    return f"(SELECT list_filter(z, lambda v, i: list_position(z, v) = i) FROM (SELECT list_transform(regexp_extract_all({x}, '{TIMES}', 1), lambda v, i: lower({squeeze(f'coalesce(nullif(v, chr(0)), chr(0))')})) AS z))"


def within(allowed: str, by: str) -> str:
    """Scores of allowed chunks, normalised and ranked for each `by`."""
    return f"""SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN (max(score) OVER w > 0)::INT::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm,
      row_number() OVER (PARTITION BY {by} ORDER BY score DESC, chunk_id) AS rank FROM bmall JOIN {allowed} USING (query_id, chunk_id) WINDOW w AS (PARTITION BY {by})"""


PARTS = {
    "docs": f"""SELECT doc_id AS n, 'doc-' || lpad(doc_id::VARCHAR, 7, '0') AS doc_id, 'Document ' || doc_id AS title, source AS department, source || '-ops' AS owner,
      CASE WHEN doc_id % 3 = 0 THEN [lang, 'global'] ELSE [lang] END AS regions, {listed(POLICY_TYPES)}[doc_id % 6 + 1] AS policy_type, {listed(ACCESS_LEVELS)}[doc_id % 4 + 1] AS access_level,
      ['process-' || (doc_id % 10)] AS related_processes, {normal('text')} AS content FROM documents""",
    "toks": r"SELECT *, regexp_extract_all(content, '\S+') AS toks, regexp_split_to_array(content, '\S+') AS gaps FROM docs",
    "wins": "SELECT *, unnest(range(0, CASE WHEN len(toks) = 0 THEN 0 WHEN len(toks) <= 800 THEN 1 ELSE 1 + ceil((len(toks) - 600) / 500.0)::INT END)) AS k FROM toks",
    "spans": "SELECT *, k * 500 AS a, CASE WHEN len(toks) <= 800 THEN len(toks) ELSE least(k * 500 + 600, len(toks)) END AS b FROM wins",
    "chunks": """SELECT n, doc_id, title, department, owner, regions, policy_type, access_level, related_processes, 'Document Body' AS section_title, left(sha1('Document Body'), 10) AS section_path_hash, 1 AS heading_occurrence,
      'chk:' || doc_id || ':document-body:01:' || left(sha1('Document Body'), 10) || ':' || lpad((k + 1)::VARCHAR, 3, '0') AS chunk_id, (k + 1)::INT AS chunk_index, (b - a)::INT AS token_count,
      array_to_string(list_transform(list_zip(toks[a + 1:b], gaps[a + 2:b] || ['']), lambda p: p[1] || p[2]), '') AS text,
      (list_sum(list_transform(gaps[1:a + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(toks[1:a], lambda g: length(g))), 0))::INT AS start_char FROM spans""",
    "indexed": "SELECT chunk_id, title || chr(10) || section_title || chr(10) || department || chr(10) || array_to_string(regions, ' ') || chr(10) || owner || chr(10) || array_to_string(related_processes, ' ') || chr(10) || text AS ix FROM chunks",
    "terms0": f"SELECT chunk_id, {tokens_of('ix')} AS e FROM indexed",
    "places": "SELECT chunk_id, unnest(e) AS t, generate_subscripts(e, 1) AS i FROM terms0",
    "runs": "SELECT chunk_id, t, lead(t) OVER w AS t1, lead(t, 2) OVER w AS t2 FROM places WINDOW w AS (PARTITION BY chunk_id ORDER BY i)",
    "terms": "SELECT chunk_id, t AS token FROM runs UNION ALL SELECT chunk_id, t || '__' || t1 FROM runs WHERE t1 IS NOT NULL UNION ALL SELECT chunk_id, t || '__' || t1 || '__' || t2 FROM runs WHERE t2 IS NOT NULL",
    "lens": "SELECT chunk_id, count(*) AS len FROM terms GROUP BY chunk_id",
    "posts": "SELECT chunk_id, len, token, count(*) AS tf FROM terms JOIN lens USING (chunk_id) GROUP BY ALL",
    "corpus": "SELECT count(*) AS n, avg(coalesce(len, 0)) AS mean FROM chunks LEFT JOIN lens USING (chunk_id)",
    "idf": "SELECT token, count(*) AS df, ln(1 + ((SELECT n FROM corpus) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts GROUP BY token",
    "q0": f"SELECT item_id AS query_id, {tokens_of('text')} AS e FROM benchmark",
    "qt": f"SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({grams('e')}) AS token FROM q0) GROUP BY ALL",
    "bm": "SELECT query_id, chunk_id, sum(idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT mean FROM corpus)))) * qtf) AS score FROM posts JOIN qt USING (token) JOIN idf USING (token) GROUP BY ALL",
    "bmall": "SELECT query_id, chunk_id, coalesce(round(score, 9), 0.0) AS score, score IS NOT NULL AS hit FROM (SELECT DISTINCT query_id FROM qt) CROSS JOIN (SELECT chunk_id FROM chunks) LEFT JOIN bm USING (query_id, chunk_id)",
    "bmn": "SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN (max(score) OVER w > 0)::INT::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bmall WINDOW w AS (PARTITION BY query_id)",
    "vtext": "SELECT 'c' AS side, chunk_id AS id, lower(text) AS low FROM chunks UNION ALL SELECT 'q', item_id::VARCHAR, lower(text) FROM benchmark",
    "vparts": r"SELECT side, id, regexp_extract_all(low, '[a-z0-9]+(?:[-_][a-z0-9]+)*') AS ws, regexp_replace(low, '\s+', ' ', 'g') AS packed FROM vtext",
    "vfeats": "SELECT side, id, unnest(list_transform(ws, lambda w: 'tok:' || w) || list_transform(range(1, len(ws)), lambda i: 'bi:' || ws[i] || '_' || ws[i + 1]) || list_transform(range(1, length(packed) - 1), lambda i: 'tri:' || substr(packed, i, 3))) AS f FROM vparts",
    "vcounts": "SELECT side, id, f, count(*) AS n FROM vfeats GROUP BY ALL",
    "vplaces": "SELECT f, ('0x' || left(md5(f), 8))::BIGINT % 384 AS bucket, CASE WHEN ('0x' || substr(md5(f), 10, 1))::INT % 2 = 1 THEN -1 ELSE 1 END AS sign FROM (SELECT DISTINCT f FROM vcounts)",
    "vvals": "SELECT side, id, bucket, sum(n * sign)::DOUBLE AS v FROM vcounts JOIN vplaces USING (f) GROUP BY ALL",
    "vunit": "SELECT side, id, bucket, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY side, id)), 0) AS v FROM vvals",
    "vdots": "SELECT q.id::BIGINT AS query_id, c.id AS chunk_id, sum(q.v * c.v) AS dot FROM vunit q JOIN vunit c ON q.bucket = c.bucket AND q.side = 'q' AND c.side = 'c' GROUP BY ALL",
    "vs": "SELECT query_id, chunk_id, round(coalesce(dot, 0), 12) AS cosine FROM (SELECT item_id AS query_id, chunk_id FROM benchmark CROSS JOIN chunks) LEFT JOIN vdots USING (query_id, chunk_id)",
    "vn": "SELECT *, greatest(0.0, least(1.0, cosine)) AS norm, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM vs",
    "hy0": "SELECT query_id, chunk_id, b.norm AS bm25_score, v.norm AS vector_score FROM (SELECT * FROM bmn WHERE rank <= 20) b FULL JOIN (SELECT * FROM vn WHERE rank <= 20) v USING (query_id, chunk_id)",
    "hy1": "SELECT *, greatest(0.0, least(1.0, 0.55 * coalesce(vector_score, 0) + 0.35 * coalesce(bm25_score, 0) + 0.05 * 0.0 + 0.05 * 1.0)) AS hybrid_score FROM hy0",
    "hy": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, chunk_id) AS rank FROM hy1 QUALIFY rank <= 5",
    "cites": "SELECT query_id, rank, 'CIT-' || rank AS citation_id, chunk_id, doc_id, title, section_title, text AS quote, start_char, start_char + length(text) AS end_char, norm AS hybrid_score, score AS raw_score FROM bmn JOIN chunks USING (chunk_id) WHERE rank <= 5",
    # searches with a filter for each query
    "own_ok": """SELECT item_id AS query_id, chunk_id FROM benchmark JOIN chunks ON true WHERE (item_id % 3 <> 0 OR list_contains(['policy', 'sop'], policy_type)) AND (item_id % 4 <> 1 OR list_has_any(['en', 'global'], regions))
      AND (item_id % 6 <> 5 OR list_contains(['src0', 'src1'], department)) AND (item_id % 5 <> 2 OR contains(lower(section_title), CASE WHEN item_id % 2 = 0 THEN 'body' ELSE 'none such' END))
      AND (item_id % 10 <> 7 OR list_contains(list_transform([0, 1, 60], lambda i: 'doc-' || lpad((item_id + i)::VARCHAR, 7, '0')), doc_id))""",
    "own_n": within("own_ok", "query_id"),
    # graph
    "rules": "SELECT * FROM (" + rows_of(demo.ENTITY_RULES) + ") r(ordinal, label, type, aliases)",
    "aliases": "SELECT label, type, unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS place FROM rules",
    "ents": "SELECT chunk_id, doc_id, label, type, arg_min(alias, place) AS mention FROM chunks CROSS JOIN aliases WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || alias || '($|[^A-Za-z0-9])') GROUP BY ALL",
    "stated": f"""SELECT chunk_id, doc_id, v AS label, 'TimeRequirement' AS type, v AS mention FROM (SELECT chunk_id, doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{TIMES}', 0), lambda x: lower(regexp_replace({squeeze('x')}, '(?i)^(within |at least |first (?=[0-9]))', ''))))) AS v FROM chunks WHERE regexp_matches(text, '{TIMES}'))
      UNION ALL SELECT chunk_id, doc_id, v, 'Threshold', v FROM (SELECT chunk_id, doc_id, unnest(list_transform(regexp_extract_all(text, '{LIMITS}', 0), lambda x: {squeeze('x')})) AS v FROM chunks WHERE regexp_matches(text, '{LIMITS}'))""",
    "matches": "SELECT * FROM ents",
    "meta_pairs": f"""SELECT chunk_id, doc_id, text, 'OWNS' AS relation_type, o AS sl, 'Department' AS st, title AS tl, {DOC} AS tt, title AS hint FROM (SELECT *, unnest([department, owner]) AS o FROM chunks)
      UNION ALL SELECT chunk_id, doc_id, text, 'HAS_ACCESS_LEVEL', title, {DOC}, access_level, 'AccessLevel', access_level FROM chunks
      UNION ALL SELECT chunk_id, doc_id, text, 'APPLIES_TO', title, {DOC}, r, 'Region', r FROM (SELECT *, unnest(regions) AS r FROM chunks)
      UNION ALL SELECT chunk_id, doc_id, text, 'GOVERNS', title, {DOC}, p, 'Process', p FROM (SELECT *, unnest(related_processes) AS p FROM chunks)""",
    "meta_edges": edges_from("SELECT * FROM meta_pairs", "hint"),
    "mention_rows": f"SELECT m.chunk_id, m.doc_id, text, 'MENTIONS' AS relation_type, title AS sl, {DOC} AS st, label AS tl, type AS tt, mention AS hint FROM matches m JOIN chunks c ON m.chunk_id = c.chunk_id",
    "mention_edges": edges_from("SELECT * FROM mention_rows", "hint"),
    "rel_rules": "SELECT * FROM (" + rows_of(demo.RELATION_RULES) + ") r(source_label, source_type, target_label, target_type, phrases, relation, rhint)",
    "rel_rows": f"""SELECT m.chunk_id, m.doc_id, text, relation AS relation_type, CASE WHEN source_label IS NULL THEN title ELSE source_label END AS sl, CASE WHEN source_label IS NULL THEN {DOC} ELSE source_type END AS st, label AS tl, type AS tt, coalesce(rhint, label) AS hint
      FROM matches m JOIN chunks c ON m.chunk_id = c.chunk_id JOIN rel_rules ON type = target_type AND (target_label IS NULL OR label = target_label) AND (len(phrases) = 0 OR len(list_filter(phrases, lambda p: contains(lower(text), lower(p)))) > 0)
      WHERE source_label IS NULL OR EXISTS (FROM matches o WHERE o.chunk_id = m.chunk_id AND o.label = source_label AND o.type = source_type)""",
    "rel_edges": edges_from("SELECT * FROM rel_rows", "hint"),
    "edges0": "SELECT * FROM meta_edges UNION ALL SELECT * FROM mention_edges UNION ALL SELECT * FROM rel_edges",
    "edges": f"""SELECT * FROM edges0 e WHERE NOT (relation_type = 'MENTIONS' AND EXISTS (FROM edges0 s WHERE s.relation_type <> 'MENTIONS' AND s.source_node_id = e.source_node_id AND s.target_node_id = e.target_node_id AND s.source_doc_id = e.source_doc_id))
      QUALIFY row_number() OVER (PARTITION BY CASE WHEN relation_type IN ({', '.join(f"'{r}'" for r in DOCUMENT_LEVEL_RELATIONS)}) THEN concat_ws('|', 'document', source_node_id, relation_type, target_node_id, source_doc_id) ELSE edge_id END
        ORDER BY source_doc_id, source_chunk_id, relation_type, source_node_id, target_node_id, edge_id, evidence_quote) = 1""",
    "nodes0": f"""SELECT sl AS label, st AS type, doc_id, chunk_id, sl AS mention, CASE WHEN st IN ('Policy', 'SOP') THEN 1.0 ELSE 0.9 END AS confidence FROM meta_pairs
      UNION ALL SELECT tl, tt, doc_id, chunk_id, tl, CASE WHEN tt IN ('Policy', 'SOP', 'AccessLevel') THEN 1.0 ELSE 0.9 END FROM meta_pairs
      UNION ALL SELECT label, type, doc_id, chunk_id, mention, 0.9 FROM matches""",
    "nodes1": f"SELECT *, {node_id('label', 'type')} AS node_id FROM nodes0",
    "nodes": """SELECT node_id, arg_min(label, (doc_id, chunk_id, label)) AS label, arg_min(type, (doc_id, chunk_id, label)) AS type, list_sort(list(DISTINCT doc_id)) AS source_doc_ids,
      list_sort(list(DISTINCT mention))[1:50] AS mentions, max(confidence)::DOUBLE AS confidence, count(DISTINCT doc_id) AS n_docs, count(DISTINCT chunk_id) AS n_chunks FROM nodes1 GROUP BY node_id""",
    # trade
    "tn": "SELECT 'region:' || r_regionkey AS node_id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'customer:' || c_custkey FROM customer",
    "te": """SELECT 'e:nation:' || n_nationkey AS edge_id, 'nation:' || n_nationkey AS s, 'region:' || n_regionkey AS t FROM nation UNION ALL SELECT 'e:supplier:' || s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
      UNION ALL SELECT 'e:customer:' || c_custkey, 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer""",
    "tb": "SELECT s AS a, t AS b FROM te UNION SELECT t, s FROM te",
    "seeds": "SELECT 'region:' || r_regionkey AS seed FROM region UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier",
    "h1": "SELECT DISTINCT seed, b AS node_id, 1 AS distance FROM seeds JOIN tb ON a = seed",
    "h2": "SELECT DISTINCT seed, b AS node_id, 2 AS distance FROM h1 JOIN tb ON a = node_id",
    "near": "SELECT seed, node_id, min(distance) AS distance FROM (SELECT seed, seed AS node_id, 0 AS distance FROM seeds UNION ALL FROM h1 UNION ALL FROM h2) GROUP BY ALL",
    # questions
    "ask": "SELECT item_id AS query_id, text, lower(" + squeeze("text") + ") AS z, item_id % 3 > 0 AS ig, CASE WHEN item_id % 4 = 0 THEN ['form'] ELSE []::VARCHAR[] END AS pt, item_id % 5 > 0 AS ga FROM benchmark",
    "intents": "SELECT *, CASE WHEN z = '' THEN 'unsupported' "
    + " ".join(f"WHEN {'NOT ' if g == 'domain' else ''}({' OR '.join(f'contains(z, $q${t}$q$)' for t in terms)}) THEN '{dict(demo.questions.GROUPS)[g]}'" for g, terms in demo.INTENT_TERMS)
    + " ELSE 'fact_lookup' END AS intent FROM ask",
    "table_": "SELECT * FROM (" + rows_of([(i, r, c, int(x), g, dep, why) for i, r, c, x, g, dep, why in demo.questions.ROUTES]) + ") r(intent, route, confidence, ir, graph, graph_depth, refusal_reason)",
    "routes": """SELECT query_id, text, intent, route, confidence::DOUBLE AS confidence, ir = 1 AS include_retrieval, graph = 'always' OR (graph = 'asked' AND ig) AS include_graph, graph_depth, refusal_reason, ga AS generate_answer,
      CASE WHEN intent = 'policy_lookup' AND len(pt) = 0 THEN ['policy'] ELSE pt END AS policy_types FROM intents JOIN table_ USING (intent)""",
    "route_ok": "SELECT query_id, chunk_id FROM routes JOIN chunks ON true WHERE include_retrieval AND (len(policy_types) = 0 OR list_contains(policy_types, policy_type))",
    "route_n": within("route_ok", "query_id"),
    "route_v": "SELECT query_id, chunk_id, norm, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM (SELECT * FROM vn WHERE rank <= 80) JOIN route_ok USING (query_id, chunk_id)",
    "route_0": "SELECT query_id, chunk_id, b.norm AS bm25_score, v.norm AS vector_score FROM (SELECT * FROM route_n WHERE rank <= 20) b FULL JOIN (SELECT * FROM route_v WHERE rank <= 20) v USING (query_id, chunk_id)",
    "route_1": "SELECT *, greatest(0.0, least(1.0, 0.55 * coalesce(vector_score, 0) + 0.35 * coalesce(bm25_score, 0) + 0.05 * (len(policy_types) > 0)::INT + 0.05)) AS hybrid_score FROM route_0 JOIN routes USING (query_id)",
    "route_h": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, chunk_id) AS rank FROM route_1 QUALIFY rank <= 5",
    "ev": "SELECT query_id, rank, 'CIT-' || rank AS citation_id, chunk_id, doc_id, title, section_title, c.text AS quote, hybrid_score FROM route_h JOIN chunks c USING (chunk_id)",
    "ranks": "SELECT query_id, doc_id, min(rank) AS doc_rank FROM ev GROUP BY ALL",
    "aq": f"SELECT item_id AS query_id, {words_only('text')} AS normal, list_distinct({evidence_tokens('text')}) AS tokens FROM benchmark",
    "tt": "SELECT * FROM (" + rows_of(demo.TYPE_TERMS) + ") r(type, term)",
    "implied": "SELECT DISTINCT query_id, type FROM (SELECT query_id, unnest(tokens) AS term FROM aq) JOIN tt USING (term)",
    "labels_": f"SELECT node_id, type, label, source_doc_ids, {words_only('label')} AS ln, list_distinct({evidence_tokens('label')}) AS lt FROM nodes",
    "qdocs": "SELECT query_id, list(DISTINCT doc_id) AS docs FROM ranks GROUP BY query_id",
    "mn0": """SELECT a.query_id, l.node_id, len(list_intersect(tokens, lt)) AS ov, len(lt) AS nl, contains(normal, ln) AS inside, i.type IS NOT NULL AS imp, coalesce(list_has_any(docs, source_doc_ids), false) AS dd
      FROM aq a JOIN routes r ON a.query_id = r.query_id AND include_graph CROSS JOIN labels_ l LEFT JOIN implied i ON i.query_id = a.query_id AND i.type = l.type LEFT JOIN qdocs q ON q.query_id = a.query_id WHERE len(lt) > 0""",
    "mn": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (SELECT query_id, node_id, ov / nl + CASE WHEN inside THEN 2.0 ELSE 0 END + CASE WHEN dd AND (ov > 0 OR imp) THEN 0.25 ELSE 0 END + CASE WHEN imp THEN 1.25 ELSE 0 END AS score FROM mn0) WHERE score > 0 QUALIFY rank <= 5",
    "sides": "SELECT source_node_id AS a, target_node_id AS b FROM edges UNION SELECT target_node_id, source_node_id FROM edges",
    "ms": "SELECT query_id, node_id AS seed, graph_depth AS dep FROM mn JOIN routes USING (query_id)",
    "m1": "SELECT DISTINCT query_id, seed, dep, b AS node_id FROM ms JOIN sides ON a = seed",
    "m2": "SELECT DISTINCT query_id, seed, dep, b AS node_id FROM m1 JOIN sides ON a = node_id WHERE dep = 2",
    "mnear": "SELECT query_id, seed, seed AS node_id FROM ms UNION SELECT query_id, seed, node_id FROM m1 UNION SELECT query_id, seed, node_id FROM m2",
    "granks": "SELECT * FROM ranks WHERE query_id IN (SELECT query_id FROM routes WHERE include_graph)",
    "cand_n": "SELECT DISTINCT query_id, node_id FROM (SELECT query_id, node_id FROM mnear UNION ALL SELECT query_id, unnest([source_node_id, target_node_id]) FROM granks JOIN edges ON doc_id = source_doc_id) WHERE node_id IN (SELECT node_id FROM nodes)",
    "cand_e": """SELECT DISTINCT query_id, edge_id FROM (SELECT x.query_id, edge_id FROM edges JOIN mnear x ON x.node_id = source_node_id JOIN mnear y ON y.node_id = target_node_id AND x.query_id = y.query_id AND x.seed = y.seed
      UNION ALL SELECT query_id, edge_id FROM granks JOIN edges ON doc_id = source_doc_id)""",
    "pri": "SELECT * FROM (" + rows_of(demo.PRIORS) + ") r(relation_type, prior)",
    "boo": "SELECT query_id, relation_type, max(boost) AS boost FROM (SELECT query_id, unnest(tokens) AS term FROM aq) JOIN (" + rows_of(demo.BOOSTS) + ") r(relation_type, term, boost) USING (term) GROUP BY ALL",
    "re0": f"""SELECT c.query_id, e.*, 2.0 * len(list_intersect(tokens, list_distinct({evidence_tokens("concat_ws(' ', sn.label, tn.label)")}))) + 0.5 * least(len(list_intersect(tokens, list_distinct({evidence_tokens('evidence_quote')}))), 3)
      + coalesce(prior, 0) + coalesce(boost, 0) + coalesce(greatest(0, 3 - 0.5 * doc_rank), 0) + CASE WHEN e.relation_type = 'MENTIONS' THEN -3 ELSE 0 END AS score, tn.label AS target_label, tn.type AS target_type
      FROM cand_e c JOIN edges e USING (edge_id) JOIN aq USING (query_id) LEFT JOIN nodes sn ON sn.node_id = e.source_node_id LEFT JOIN nodes tn ON tn.node_id = e.target_node_id
      LEFT JOIN pri ON pri.relation_type = e.relation_type LEFT JOIN boo ON boo.query_id = c.query_id AND boo.relation_type = e.relation_type LEFT JOIN ranks ON ranks.query_id = c.query_id AND ranks.doc_id = e.source_doc_id""",
    "re_": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, edge_id) AS rank FROM re0 QUALIFY rank <= 60",
    "rn": f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (SELECT c.query_id, c.node_id, 2.0 * len(list_intersect(tokens, lt)) + coalesce(list_has_any(docs, source_doc_ids), false)::INT + (i.type IS NOT NULL)::INT AS score
      FROM cand_n c JOIN labels_ l USING (node_id) JOIN aq ON aq.query_id = c.query_id LEFT JOIN implied i ON i.query_id = c.query_id AND i.type = l.type LEFT JOIN qdocs q ON q.query_id = c.query_id) QUALIFY rank <= 30""",
    "items": "SELECT query_id, list(citation_id ORDER BY rank) AS citations, string_agg(title || ' ' || section_title || ' ' || quote || ' ' || quote, ' ' ORDER BY rank) AS etext, max(hybrid_score) > 0 AS scored FROM ev GROUP BY query_id",
    "eq": "SELECT query_id, list_sort(list(DISTINCT relation_type)) AS relation_types, count(*) AS n_edges, string_agg(DISTINCT evidence_quote, ' ') AS quotes FROM re_ GROUP BY query_id",
    "ml": "SELECT query_id, list(label ORDER BY rank) AS ml FROM mn JOIN nodes USING (node_id) GROUP BY query_id",
    "nl": "SELECT query_id, list(label ORDER BY rank) AS nl FROM rn JOIN nodes USING (node_id) GROUP BY query_id",
    "packs": """SELECT r.*, CASE WHEN refusal_reason IS NULL THEN coalesce(ml, []) ELSE [] END AS ml, CASE WHEN refusal_reason IS NULL THEN coalesce(nl, []) ELSE [] END AS nl,
      CASE WHEN refusal_reason IS NOT NULL THEN 'refused' WHEN include_graph AND query_id % 7 = 0 THEN 'degraded' ELSE 'evidence_ready' END AS status, CASE WHEN refusal_reason IS NULL THEN citations END AS citations, CASE WHEN refusal_reason IS NULL THEN etext END AS etext, coalesce(scored, false) AND refusal_reason IS NULL AS scored,
      CASE WHEN refusal_reason IS NULL THEN relation_types END AS relation_types, CASE WHEN refusal_reason IS NULL THEN coalesce(n_edges, 0) ELSE 0 END AS n_edges, quotes,
      CASE WHEN refusal_reason IS NOT NULL THEN refusal_reason ELSE concat_ws(',', CASE WHEN include_graph AND query_id % 7 = 0 THEN 'graph_unavailable' END, CASE WHEN include_retrieval AND citations IS NULL THEN 'no_retrieval_evidence' END, CASE WHEN include_graph AND n_edges IS NULL THEN 'no_graph_evidence' END) END AS limitations
      FROM routes r LEFT JOIN items USING (query_id) LEFT JOIN eq USING (query_id) LEFT JOIN ml USING (query_id) LEFT JOIN nl USING (query_id)""",
    "suff": f"""SELECT *, list_sort(list_filter(list_distinct({answer_tokens('text')}), lambda t: NOT list_contains({listed(demo.GENERIC_TERMS)}, t) AND NOT list_contains({answer_tokens("concat_ws(' ', etext, array_to_string(ml || nl, ' '), quotes)")}, t)))[1:5] AS missing FROM packs""",
    "facts": f"SELECT query_id, rank, citation_id, title, list_filter({sentences('quote')}, lambda s: length(s) >= 20)[1] AS s FROM ev WHERE rank <= 2",
    "extract": r"SELECT query_id, nullif(string_agg(regexp_replace(s, '[.!?]+$', '') || ' [' || citation_id || '].', ' ' ORDER BY rank), '') AS answer, string_agg(citation_id, ',' ORDER BY rank) AS ac, string_agg(citation_id, ', ' ORDER BY rank) AS acs FROM facts GROUP BY query_id",
    "titles": "SELECT query_id, array_to_string(list_sort(list(DISTINCT title)), ', ') AS titles FROM facts GROUP BY query_id",
    "arules": "SELECT * FROM (" + rows_of(demo.ANSWER_RULES) + ") r(rule_id, intent, ordinal, relation, target, fragment, phrase, template)",
    "asks": "SELECT query_id, a.* FROM packs JOIN arules a USING (intent) WHERE citations IS NOT NULL",
    "afirst": "SELECT query_id, citation_id FROM ev WHERE true QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1",
    "aown": "SELECT query_id, chunk_id, arg_min(citation_id, rank) AS own_cit FROM ev GROUP BY ALL",
    "adoc": "SELECT query_id, doc_id, arg_min(citation_id, rank) AS doc_cit FROM ev GROUP BY ALL",
    "aedge": """SELECT a.query_id, rule_id, target_label, coalesce(own_cit, doc_cit, f.citation_id) AS edge_cit
      FROM asks a JOIN re_ r ON r.query_id = a.query_id AND r.relation_type = a.relation AND (a.target IS NULL OR a.target = r.target_type) JOIN afirst f ON f.query_id = a.query_id
      LEFT JOIN aown o ON o.query_id = a.query_id AND o.chunk_id = r.source_chunk_id LEFT JOIN adoc d ON d.query_id = a.query_id AND d.doc_id = r.source_doc_id QUALIFY row_number() OVER (PARTITION BY a.query_id, rule_id ORDER BY r.rank) = 1""",
    "achunk": "SELECT a.query_id, rule_id, citation_id AS chunk_cit FROM asks a JOIN ev ON ev.query_id = a.query_id AND (fragment IS NULL OR contains(chunk_id, fragment)) AND (phrase IS NULL OR contains(lower(quote), lower(phrase))) WHERE fragment IS NOT NULL OR phrase IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.query_id, rule_id ORDER BY rank) = 1",
    "ruled": """SELECT a.query_id, a.rule_id, replace(replace(template, '{label}', coalesce(target_label, '')), '{cit}', coalesce(edge_cit, chunk_cit, f.citation_id)) AS answer,
      list_filter([edge_cit, chunk_cit, coalesce(edge_cit, chunk_cit, f.citation_id)], lambda x, i: x IS NOT NULL AND list_position([edge_cit, chunk_cit, coalesce(edge_cit, chunk_cit, f.citation_id)], x) = i)[1:3] AS cits
      FROM asks a JOIN afirst f ON f.query_id = a.query_id LEFT JOIN aedge e ON e.query_id = a.query_id AND e.rule_id = a.rule_id LEFT JOIN achunk c ON c.query_id = a.query_id AND c.rule_id = a.rule_id
      WHERE (relation IS NULL OR edge_cit IS NOT NULL) AND (fragment IS NULL AND phrase IS NULL OR chunk_cit IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY ordinal, a.rule_id) = 1""",
    "said": """SELECT query_id, coalesce(r.answer, x.answer) AS answer, coalesce(r.cits, string_split(x.ac, ',')) AS cits FROM (SELECT DISTINCT query_id FROM ev) LEFT JOIN ruled r USING (query_id) LEFT JOIN extract x USING (query_id)""",
    "stitles": "SELECT s.query_id, array_to_string(list_sort(list(DISTINCT title)), ', ') AS titles FROM said s JOIN ev ON ev.query_id = s.query_id AND list_contains(cits, citation_id) GROUP BY s.query_id",
    # evaluation
    "ev0": f"""SELECT doc_id AS n, CASE WHEN doc_id % 4 = 0 THEN 'holdout' ELSE 'core' END AS split, CASE WHEN quality = 1 THEN 'fact_lookup' ELSE ['out_of_scope', 'unsupported'][doc_id % 2 + 1] END AS expected_intent,
      CASE WHEN toxic = 0 THEN 'fact_lookup' ELSE 'out_of_scope' END AS intent, CASE WHEN doc_id % 10 = 0 THEN 'graph' ELSE 'hybrid' END AS route, CASE WHEN doc_id % 8 = 0 THEN 'degraded' ELSE 'evidence_ready' END AS status,
      ['generated', 'refused', 'insufficient_evidence'][doc_id % 3 + 1] AS eags, CASE WHEN doc_id % 12 = 1 THEN 'generated' ELSE ['generated', 'refused', 'insufficient_evidence'][doc_id % 3 + 1] END AS ags,
      ['d' || doc_id % 5, 'd' || doc_id % 7] AS ed, ['d' || doc_id % 5, 'd' || doc_id % 2] AS gd, CASE WHEN doc_id % 2 = 0 THEN ['c' || doc_id % 3] ELSE [] END AS ec, ['c' || doc_id % 3, 'c' || doc_id % 4] AS gc,
      CASE WHEN doc_id % 3 = 0 THEN ['d' || doc_id % 5] ELSE [] END AS ecd, CASE WHEN doc_id % 3 = 0 THEN ['d' || doc_id % 6] ELSE [] END AS gcd, ['CIT-' || doc_id % 2, 'CIT-' || doc_id % 3] AS ci, CASE WHEN doc_id % 3 = 0 THEN ['CIT-' || doc_id % 4] ELSE [] END AS ac,
      CASE WHEN doc_id % 3 = 0 OR doc_id % 12 = 1 THEN ['yes and no', 'never', 'YES NO never', 'no yes'][doc_id % 4 + 1] END AS answer, CASE WHEN doc_id % 15 > 0 THEN 'summary' END AS gs FROM labels""",
    "ev1": """SELECT *, len(list_intersect(list_distinct(ed), list_distinct(gd))) > 0 AS hit, len(list_intersect(list_distinct(ed), list_distinct(gd))) / len(list_distinct(ed)) AS recall, eags = 'generated' AS g, eags <> 'generated' AS r,
      CASE WHEN eags = 'generated' THEN len(ac) > 0 AND list_has_all(ci, ac) END AS csv, CASE WHEN eags = 'generated' THEN list_has_all(gcd, ecd) END AS ecm, eags <> 'generated' AND answer IS NOT NULL AS fab, CASE WHEN eags <> 'generated' THEN answer IS NULL AND ags = eags END AS rc FROM ev0""",
    "ev2": """SELECT *, list_filter([CASE WHEN g AND NOT csv THEN 'answer_citations_not_valid_subset' END, CASE WHEN g AND NOT ecm THEN 'expected_answer_citation_document_missing' END, CASE WHEN g AND answer IS NULL THEN 'generated_answer_missing' END,
      CASE WHEN g AND NOT contains(lower(answer), 'yes') THEN 'required_answer_phrase_missing:Yes' END, CASE WHEN g AND NOT contains(lower(answer), 'no') THEN 'required_answer_phrase_missing:no' END, CASE WHEN g AND contains(lower(answer), 'never') THEN 'forbidden_answer_phrase_present:never' END,
      CASE WHEN g AND status <> 'evidence_ready' THEN 'answer_generated_without_evidence_ready' END, CASE WHEN g AND gs IS NULL THEN 'grounding_summary_missing' END], lambda x: x IS NOT NULL) AS gf FROM ev1""",
}
PARTS["evc"] = """SELECT *, len(failed) = 0 AS passed, CASE WHEN g THEN len(gf) = 0 END AS gp FROM (SELECT *, list_filter([CASE WHEN expected_intent <> intent THEN 'intent_mismatch' END, CASE WHEN route <> 'hybrid' THEN 'route_mismatch' END, CASE WHEN status <> 'evidence_ready' THEN 'status_mismatch' END,
      CASE WHEN eags <> ags THEN 'answer_generation_status_mismatch' END, CASE WHEN NOT hit THEN 'retrieval_expected_document_missing' END, CASE WHEN len(ec) > 0 AND NOT list_has_all(gc, ec) THEN 'expected_chunk_missing' END] || gf
      || [CASE WHEN NOT g AND answer IS NOT NULL THEN 'unexpected_answer_generated' END, CASE WHEN NOT g AND len(ac) > 0 THEN 'unexpected_answer_citations' END, CASE WHEN NOT rc THEN 'refusal_behavior_incorrect' END], lambda x: x IS NOT NULL) AS failed FROM ev2)"""
PARTS["fb"] = """SELECT event_id AS feedback_id, event_type AS issue_category, CASE WHEN value < 20 THEN 'negative' WHEN value < 60 THEN 'neutral' ELSE 'positive' END AS user_rating, ['answer', 'citation', 'other'][user_id % 3 + 1] AS feedback_type,
      ['open', 'triaged', 'resolved', 'closed'][user_id % 4 + 1] AS review_status, json_extract_string(props, '$.k') AS reviewer_note, NULL::VARCHAR AS linked_eval_case_id FROM events"""
PARTS["upd"] = f"""SELECT CASE WHEN event_id % 49 = 0 THEN event_id + {demo.NEW} WHEN event_id % 5 = 0 AND event_id > 0 THEN event_id - 1 ELSE event_id END AS feedback_id, event_id AS at_event, CASE event_id % 3 WHEN 0 THEN ['review_status'] WHEN 1 THEN ['reviewer_note', 'linked_eval_case_id'] ELSE ['review_status', 'reviewer_note'] END AS sf,
      CASE WHEN event_id % 5 = 0 THEN 'closed' ELSE 'resolved' END AS ns, CASE WHEN event_id % 2 = 0 THEN 'seen' END AS nn, 'case-' || event_id AS nl FROM events"""
PREVIOUS = lambda f, new: f"last_value(CASE WHEN list_contains(sf, '{f}') THEN {{'v': {new}}} END IGNORE NULLS) OVER (PARTITION BY feedback_id ORDER BY at_event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
FIELD = {"review_status": "ns", "reviewer_note": "nn", "linked_eval_case_id": "nl"}
PARTS["states"] = "SELECT feedback_id, at_event, sf, ns, nn, nl, " + ", ".join(f"{f} AS first_{f}, {PREVIOUS(f, new)} AS p_{f}" for f, new in FIELD.items()) + " FROM upd JOIN fb USING (feedback_id)"
PARTS["trail"] = "SELECT *, " + ", ".join(f"CASE WHEN list_contains(sf, '{f}') THEN {new} ELSE b_{f} END AS a_{f}, list_contains(sf, '{f}') AND {new} IS DISTINCT FROM b_{f} AS c_{f}" for f, new in FIELD.items()) + " FROM (SELECT *, " + ", ".join(f"CASE WHEN p_{f} IS NULL THEN first_{f} ELSE p_{f}.v END AS b_{f}" for f in FIELD) + " FROM states)"
PARTS["changed"] = "SELECT *, list_filter(sf, lambda f: CASE f WHEN 'review_status' THEN c_review_status WHEN 'reviewer_note' THEN c_reviewer_note ELSE c_linked_eval_case_id END) AS cf FROM trail WHERE c_review_status OR c_reviewer_note OR c_linked_eval_case_id"
PARTS["lasting"] = "SELECT feedback_id, " + ", ".join(f"CASE WHEN count(*) FILTER (list_contains(sf, '{f}')) > 0 THEN arg_max_null({new}, at_event) FILTER (list_contains(sf, '{f}')) ELSE any_value(fb.{f}) END AS {f}" for f, new in FIELD.items()) + " FROM fb LEFT JOIN upd USING (feedback_id) GROUP BY feedback_id"
PARTS["batch_"] = f"SELECT CASE WHEN doc_id % 5 < 2 THEN doc_id - doc_id % 3 + {demo.NEW} ELSE doc_id - doc_id % 2 END AS doc_id, sha256(text) AS sha, lpad(doc_id::VARCHAR, 9, '0') AS path FROM documents"
PARTS["known"] = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(sha256(text)) ELSE sha256(text) END AS known FROM documents"
PARTS["classed"] = """SELECT path, doc_id, CASE WHEN known IS NULL AND row_number() OVER w = 1 THEN 'ingested' WHEN sha = coalesce(known, first_value(sha) OVER w) THEN 'skipped' ELSE 'failed' END AS status FROM batch_ LEFT JOIN known USING (doc_id)
      WINDOW w AS (PARTITION BY doc_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
PARTS["convs"] = f"SELECT 'conv-' || conv_id AS doc_id, {normal('body')} AS content FROM (SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)"
PARTS["turns"] = """SELECT *, length(blk) AS len, coalesce(sum(length(blk)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, regexp_extract(blk, '^## (.*)', 1) AS title
      FROM (SELECT doc_id, unnest(list_filter(string_split(replace(content, chr(10) || '## ', chr(10) || chr(1) || '## '), chr(1)), lambda b: b <> '')) AS blk, generate_subscripts(list_filter(string_split(replace(content, chr(10) || '## ', chr(10) || chr(1) || '## '), chr(1)), lambda b: b <> ''), 1) AS k FROM convs)"""
PARTS["reqs"] = """SELECT s_suppkey AS request_id, 'p' || (s_suppkey % 27) AS persona_id, CASE WHEN s_suppkey % 2 = 0 THEN ['SRC' || (s_suppkey % 20), 'src0'] END AS rd, CASE WHEN s_suppkey % 3 = 0 THEN ['EN', 'fr'] END AS rr,
      CASE WHEN s_suppkey % 7 = 0 THEN ['form'] END AS rp, CASE WHEN s_suppkey % 5 = 0 THEN ['restricted', 'public'] END AS rl, CASE WHEN s_suppkey % 11 = 0 THEN ['src1-ops'] END AS ro FROM supplier"""
PARTS["pers"] = f"""SELECT 'p' || n_nationkey AS persona_id, {listed(ACCESS_LEVELS)}[n_nationkey % 4 + 1] AS ml, CASE WHEN n_nationkey % 3 > 0 THEN ['src' || (n_nationkey % 20), 'src0'] END AS ds, ['en', 'global'] AS rs, CASE WHEN n_nationkey % 5 > 0 THEN ['policy', 'sop'] END AS ps, true AS ok FROM nation"""


def scope(asked: str, held: str) -> str:
    hit = f"list_filter(list_transform({asked}, lambda v: list_filter({held}, lambda s: lower(s) = lower(v))[1]), lambda s: s IS NOT NULL)"
    first = f"(SELECT list_filter(z, lambda v, i: list_position(z, v) = i) FROM (SELECT {hit} AS z))"
    return f"CASE WHEN {held} IS NULL THEN {asked} WHEN {asked} IS NULL THEN {held} ELSE {first} END"


def denied(asked: str, held: str) -> str:
    return f"array_to_string(list_filter({asked}, lambda v: NOT list_contains(list_transform({held}, lambda s: lower(s)), lower(v))), ', ')"


LV = listed(ACCESS_LEVELS)
PARTS["resolved"] = f"""SELECT request_id, p.ok AS ok, CASE WHEN ok THEN {scope('rd', 'ds')} END AS departments, CASE WHEN ok THEN {scope('rr', 'rs')} END AS regions, CASE WHEN ok THEN {scope('rp', 'ps')} END AS policy_types,
      CASE WHEN ok THEN CASE WHEN rl IS NULL THEN {LV}[1:list_position({LV}, ml)] ELSE list_filter(rl, lambda v: list_position({LV}, v) <= list_position({LV}, ml)) END END AS access_levels, CASE WHEN ok THEN ro END AS owners,
      CASE WHEN ok THEN concat_ws(';', CASE WHEN ds IS NOT NULL AND {denied('rd', 'ds')} <> '' THEN 'requested_departments denied outside persona scope: ' || {denied('rd', 'ds')} END, CASE WHEN {denied('rr', 'rs')} <> '' THEN 'requested_regions denied outside persona scope: ' || {denied('rr', 'rs')} END,
        CASE WHEN ps IS NOT NULL AND {denied('rp', 'ps')} <> '' THEN 'requested_policy_types denied outside persona scope: ' || {denied('rp', 'ps')} END,
        CASE WHEN len(list_filter(rl, lambda v: list_position({LV}, v) > list_position({LV}, ml))) > 0 THEN 'requested_access_levels denied above max_access_level ' || ml || ': ' || array_to_string(list_filter(rl, lambda v: list_position({LV}, v) > list_position({LV}, ml)), ', ') END) ELSE '' END AS denied
      FROM reqs LEFT JOIN pers p USING (persona_id)"""

PARTS |= {
    "seen": """SELECT request_id, request_id % (SELECT count(*) FROM benchmark) AS query_id, chunk_id FROM resolved r JOIN chunks c ON ok AND (r.departments IS NULL OR list_contains(r.departments, department)) AND (r.regions IS NULL OR list_has_any(r.regions, c.regions))
      AND (r.policy_types IS NULL OR list_contains(r.policy_types, policy_type)) AND (r.access_levels IS NULL OR list_contains(r.access_levels, access_level)) AND (r.owners IS NULL OR list_contains(r.owners, owner))""",
    "seen_n": within("seen", "request_id"),
}


def sql(select: str) -> str:
    """select after the parts that it names, and those that they name; each part only names earlier ones."""
    names, used = list(PARTS), set()

    def need(text: str) -> None:
        for name in names:
            if name not in used and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                used.add(name)
                need(PARTS[name])

    need(select)
    parts = [f"{n} AS MATERIALIZED ({PARTS[n]})" for n in names if n in used]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


EDGE = "edge_id, source_node_id, target_node_id, relation_type, source_doc_id, source_chunk_id, evidence_quote, confidence"
NODES = "node_id, label, type, array_to_string(mentions, ',') AS mentions, confidence, n_docs, n_chunks"
ok_rate = lambda top, bottom: f"round(({top})::DOUBLE / nullif({bottom}, 0), 6)"
METRICS = f"""count(*) AS total, {ok_rate('count_if(passed)', 'count(*)')} AS pass_rate, {ok_rate('count_if(expected_intent = intent)', 'count(*)')} AS intent_accuracy, {ok_rate("count_if(route = 'hybrid')", 'count(*)')} AS route_accuracy,
  {ok_rate('count_if(hit)', 'count(*)')} AS retrieval_hit_at_k, round(avg(recall), 6) AS retrieval_recall_at_k, {ok_rate('sum(len(list_intersect(ec, gc)))', 'sum(len(ec))')} AS expected_chunk_presence_rate,
  {ok_rate('count_if(g AND len(ac) > 0)', 'count_if(g)')} AS answer_citation_non_empty_rate, {ok_rate('sum(CASE WHEN g THEN len(list_intersect(ac, ci)) ELSE 0 END)', 'sum(CASE WHEN g THEN len(ac) ELSE 0 END)')} AS citation_validity_rate,
  {ok_rate('sum(len(list_intersect(ecd, gcd)))', 'sum(len(ecd))')} AS expected_citation_match_rate, {ok_rate('count_if(g AND gp)', 'count_if(g)')} AS grounded_answer_pass_rate, {ok_rate('count_if(r AND rc)', 'count_if(r)')} AS refusal_accuracy,
  {ok_rate("count_if(r AND expected_intent = 'out_of_scope' AND rc)", "count_if(r AND expected_intent = 'out_of_scope')")} AS out_of_scope_refusal_accuracy, {ok_rate("count_if(r AND expected_intent = 'unsupported' AND rc)", "count_if(r AND expected_intent = 'unsupported')")} AS unsupported_refusal_accuracy,
  {ok_rate("count_if(eags = 'insufficient_evidence' AND rc)", "count_if(eags = 'insufficient_evidence')")} AS insufficient_evidence_refusal_accuracy, {ok_rate('count_if(r AND fab)', 'count_if(r)')} AS fabricated_answer_rate"""
BAD = "concat_ws(',', CASE WHEN n % 11 = 0 THEN 'doc_id' END, CASE WHEN n % 7 = 0 THEN 'title' END, CASE WHEN n % 5 = 0 THEN 'regions' END, CASE WHEN n % 13 = 0 THEN 'policy_type' END, CASE WHEN n % 17 = 0 THEN 'source_file' END, CASE WHEN n % 19 = 0 THEN 'dates_reversed' END)"

LOGGED = """SELECT event_id::VARCHAR AS feedback_id, CASE WHEN event_id % 10 = 0 THEN 'json_decode_error' WHEN event_id % 13 = 0 THEN 'validation_error' ELSE '' END AS error_type FROM events"""
RAW = r"""SELECT doc_id, concat('---', chr(10), 'title: ', chr(39), ' Title ', doc_id, ' ', chr(39), chr(10), 'regions: [en, EN, ', chr(39), ' fr ', chr(39), ']', chr(10), 'effective_date: 2024-01-02', chr(10), CASE WHEN doc_id % 11 = 3 THEN ': [' || chr(10) ELSE '' END, '---', chr(10)) AS head,
      CASE WHEN doc_id % 11 = 2 THEN ' ' || chr(10) ELSE text END AS body, regexp_replace(CASE WHEN doc_id % 11 = 2 THEN '' ELSE text END, '\s', '', 'g') = '' AS blank FROM documents"""

SELECTS = {
    "s1_read_raw": f"""SELECT doc_id, CASE WHEN e = '' THEN sha256(content) ELSE '' END AS sha, e AS error_code FROM (SELECT doc_id, content, CASE WHEN doc_id % 10 = 0 THEN 'UNSUPPORTED_FILE_TYPE' WHEN content = '' THEN 'EMPTY_DOCUMENT' ELSE '' END AS e
      FROM (SELECT doc_id, {normal("CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) ELSE text END")} AS content FROM documents))""",
    "s2_corpus": "SELECT doc_id, length(content)::INT AS n_chars, sha256(content) AS sha FROM docs",
    "s3_feedback_log": f"SELECT feedback_id, CASE WHEN error_type = '' THEN 'open' ELSE '' END AS review_status, error_type FROM ({LOGGED})",
    "s4_audit": "SELECT event_id, 'kind,user' AS keys, user_id::VARCHAR AS user FROM events",
    "s5_cases": "SELECT doc_id::VARCHAR AS case_id, CASE WHEN doc_id % 2 = 0 THEN 'holdout' ELSE 'core' END AS split, CASE WHEN doc_id % 3 = 0 THEN 9 ELSE 5 END AS top_k, quality = 1 AS generate_answer, true AS include_graph FROM labels",
    "s6_versioned": "SELECT chunk_id, sha256(text) AS text_sha256, 384 AS dims, (SELECT count(*) FROM chunks) AS n_chunks FROM chunks",
    "s7_report": "SELECT CASE split WHEN 'core' THEN 'run0' ELSE 'run1' END AS run_id, count(*) AS total, round(count_if(passed)::DOUBLE / count(*), 6) AS pass_rate, split = 'holdout' AS is_latest FROM evc GROUP BY split",
    "n4_front_matter": f"""SELECT doc_id, CASE WHEN doc_id % 11 = 1 THEN -1 ELSE length(head)::INT - 9 END AS yaml_chars, CASE WHEN doc_id % 11 = 1 THEN '' ELSE sha256(body) END AS body_sha,
      CASE WHEN doc_id % 11 = 1 THEN 'missing_front_matter' WHEN blank THEN 'empty_body' ELSE '' END AS error FROM ({RAW})""",
    "n5_parse_metadata": f"""SELECT doc_id || '.md' AS path, CASE WHEN bad THEN '' ELSE 'Title ' || doc_id END AS title, CASE WHEN bad THEN '' ELSE 'en,fr' END AS regions, CASE WHEN bad THEN '' ELSE '2024-01-02' END AS effective_date, doc_id || '.md' AS source_file, CASE WHEN doc_id % 11 = 1 THEN '' ELSE sha256(body) END AS content_sha256,
      CASE WHEN doc_id % 11 = 1 THEN 'missing_front_matter' WHEN blank THEN 'empty_body' WHEN doc_id % 11 = 3 THEN 'yaml_error' ELSE '' END AS errors FROM (SELECT *, doc_id % 11 IN (1, 3) AS bad FROM ({RAW}))""",
    "n1_normalize_text": f"SELECT doc_id, {normal('text')} AS content FROM documents",
    "n2_hashes": "SELECT doc_id, sha256(text) AS sha256, left(sha1(text), 10) AS short, left(sha1(text), 12) AS edge_hash FROM documents",
    "n3_slugify": f"SELECT page_id, {slug('url')} AS slug, {slug('html', 'value')} AS html_slug FROM pages",
    "n6_validate_metadata": f"SELECT n, CASE WHEN e = '' THEN '' ELSE 'INVALID_METADATA' END AS error_code, e AS errors FROM (SELECT n, {BAD} AS e FROM docs)",
    "n7_normalize_list": r"""SELECT doc_id, coalesce(string_agg(v, '|' ORDER BY i), '') AS words FROM documents LEFT JOIN (SELECT doc_id, v, i FROM (SELECT doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS v, i FROM (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '[ \n]') AS xs FROM documents)))
      WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(v) ORDER BY i) = 1) USING (doc_id) GROUP BY doc_id""",
    "n8_sections": """SELECT 'sec:' || doc_id || ':' || title || ':' || lpad(occ::VARCHAR, 2, '0') || ':' || left(sha1(title), 10) AS section_id, doc_id, title, 2 AS heading_level, occ::INT AS heading_occurrence, title AS path, left(sha1(title), 10) AS section_path_hash, blk AS text, pos::INT AS start_char, (pos + len)::INT AS end_char
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY k) AS occ FROM turns)""",
    "n9_chunks": "SELECT doc_id, chunk_index, token_count, text FROM chunks",
    "n10_chunk_ids": "SELECT chunk_id, doc_id, section_title, section_path_hash, heading_occurrence, related_processes[1] AS related_process, chunk_index, token_count, start_char, (start_char + length(text))::INT AS end_char, sha256(text) AS text_sha256 FROM chunks",
    "n11_classify_ingest": "SELECT path, doc_id, status, CASE WHEN status = 'failed' THEN 'DUPLICATE_DOCUMENT' END AS error_code FROM classed",
    "n12_upsert": f"""SELECT doc_id, coalesce(nsha, osha) AS content_sha256, CASE WHEN nsha IS NULL OR nsha = osha THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS ingested_at
      FROM (SELECT doc_id, sha256(text) AS osha FROM documents) FULL JOIN (SELECT doc_id, max(nsha) AS nsha FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id - doc_id % 4 + {demo.NEW} END AS doc_id, CASE WHEN doc_id % 4 = 0 THEN sha256(sha256(text)) ELSE sha256(text) END AS nsha FROM documents) GROUP BY doc_id) USING (doc_id)""",
    "n12_replace_parts": "SELECT chunk_id, doc_id, CASE WHEN n % 50 = 0 THEN 'New title' ELSE title END AS title, sha256(text) AS text_sha256 FROM chunks",
    "n13_ingest_summary": "SELECT count(*) AS total, count_if(status = 'ingested') AS ingested, count_if(status = 'skipped') AS skipped, count_if(status = 'failed') AS failed, nullif(count_if(status = 'failed'), 0) AS duplicates FROM classed",
    "r1_documents": "SELECT doc_id, any_value(title) AS title, any_value(department) AS department, 1::BIGINT AS section_count, count(*) AS chunk_count FROM chunks WHERE list_contains(regions, 'global') AND policy_type = 'policy' GROUP BY doc_id",
    "r2_chunks": "SELECT chunk_id, doc_id, chunk_index FROM chunks WHERE department = 'src3' AND list_contains(regions, 'en')",
    "r3_text_match": "SELECT doc_id, lower(source) = 'src1' AS same, contains(lower(source), 'c1') AS part, true AS none FROM documents",
    "r4_page": "SELECT doc_id, source, lang, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY source, doc_id LIMIT 200 OFFSET 30",
    "r5_distributions": "SELECT dimension, value, count(*) AS n FROM (SELECT 'department' AS dimension, department AS value FROM docs UNION ALL SELECT 'policy_type', policy_type FROM docs UNION ALL SELECT 'owner', owner FROM docs UNION ALL SELECT 'access_level', access_level FROM docs UNION ALL SELECT 'region', unnest(regions) FROM docs) GROUP BY ALL",
    "r6_workspace_counts": "SELECT 'documents' AS name, count(*) AS n FROM docs UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges",
    "r7_facets": "SELECT dimension, array_to_string(list_sort(list(DISTINCT value)), ',') AS values FROM (SELECT 'department' AS dimension, department AS value FROM docs UNION ALL SELECT 'policy_type', policy_type FROM docs UNION ALL SELECT 'owner', owner FROM docs UNION ALL SELECT 'access_level', access_level FROM docs UNION ALL SELECT 'region', unnest(regions) FROM docs) GROUP BY ALL",
    "t1_tokens": "SELECT item_id, array_to_string(" + grams("e") + ", ' ') AS tokens FROM (SELECT item_id, " + tokens_of("(text || ' state-of_art 1,250.50 $ x2')") + " AS e FROM benchmark)",
    "t2_indexable": "SELECT chunk_id, sha256(ix) AS sha FROM indexed",
    "t3_index": "SELECT token, df, round(idf, 6) AS idf FROM idf",
    "t3_upserted": "SELECT token, df, round(idf, 6) AS idf FROM idf",
    "t4_scores": "SELECT query_id, chunk_id, round(score, 6) AS score FROM bm",
    "t5_normalized": "SELECT query_id, chunk_id, round(norm, 6) AS normalized FROM bmn WHERE hit",
    "t6_search": "SELECT query_id, chunk_id, round(score, 4) AS raw_score, round(norm, 6) AS normalized_score, rank::INT AS rank FROM bmn WHERE rank <= 5",
    "t6_filtered_search": "SELECT query_id, chunk_id, round(norm, 6) AS bm25_score, rank::INT AS rank FROM own_n WHERE rank <= 5",
    "a3_search_as": "SELECT request_id, chunk_id, round(score, 4) AS raw_score, round(norm, 6) AS normalized_score, rank::INT AS rank FROM seen_n WHERE rank <= 5",
    "r4_deep_page": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 200 OFFSET (SELECT count(*) // 2 FROM lineitem)",
    "t7_filters": f"SELECT chunk_id, policy_type FROM chunks WHERE {FILTERED}",
    "t9_nearest": "SELECT query_id, id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id)::INT AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 12) AS c FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) QUALIFY rank <= 10",
    "t10_hybrid": "SELECT query_id, chunk_id, round(bm25_score, 6) AS bm25_score, round(vector_score, 6) AS vector_score, 0.0::DOUBLE AS metadata_boost, 1.0::DOUBLE AS recency_boost, round(hybrid_score, 6) AS hybrid_score, rank::INT AS rank FROM hy",
    "t11_degraded": "SELECT query_id, chunk_id, round(norm, 6) AS bm25_score, NULL::DOUBLE AS vector_score, 0.0::DOUBLE AS metadata_boost, 1.0::DOUBLE AS recency_boost, round(least(1.0, 0.9 * norm + 0.05), 6) AS hybrid_score, rank::INT AS rank FROM bmn WHERE rank <= 5",
    "t12_boost": f"SELECT chunk_id, round((list_contains({listed(demo.FILTER['policy_types'])}, policy_type)::INT + list_has_any({listed(demo.FILTER['regions'])}, regions)::INT) / 2, 6) AS boost FROM chunks",
    "t13_citations": "SELECT query_id, rank::INT AS rank, chunk_id, citation_id, start_char, end_char::INT AS end_char, sha256(quote) AS quote_hash FROM cites",
    "t14_vector_mode": "SELECT query_id, chunk_id, NULL::DOUBLE AS bm25_score, round(norm, 6) AS vector_score, 0.0::DOUBLE AS metadata_boost, 1.0::DOUBLE AS recency_boost, round(norm, 6) AS hybrid_score, rank::INT AS rank FROM vn WHERE rank <= 5",
    "t15_rerank": "SELECT query_id, chunk_id, (6 - rank)::INT AS rank, round(norm, 6) AS hybrid_score FROM bmn WHERE rank <= 5",
    "t16_retrieval_eval": """SELECT mode, round(avg(hit::INT), 6) AS hit_rate, count(*) AS n FROM (SELECT m.mode, c.case_id, EXISTS (FROM (SELECT 'bm25' AS mode, query_id, chunk_id FROM bmn WHERE rank <= 5 UNION ALL SELECT 'vector', query_id, chunk_id FROM vn WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, chunk_id FROM hy) r
      JOIN chunks USING (chunk_id) WHERE r.mode = m.mode AND r.query_id = c.case_id AND list_contains(c.docs, chunks.doc_id)) AS hit FROM (SELECT item_id AS case_id, list(DISTINCT docs.doc_id) AS docs FROM benchmark JOIN docs ON contains(content, text) GROUP BY item_id) c, (SELECT unnest(['bm25', 'vector', 'hybrid']) AS mode) m) GROUP BY mode""",
    "a1_levels": f"SELECT doc_id, list_position({LV}, access_level)::BIGINT AS rank, array_to_string({LV}[1:list_position({LV}, access_level)], ',') AS levels FROM docs",
    "a2_resolve": "SELECT request_id, array_to_string(departments, ',') AS allowed_departments, array_to_string(regions, ',') AS allowed_regions, array_to_string(policy_types, ',') AS allowed_policy_types, array_to_string(access_levels, ',') AS allowed_access_levels, array_to_string(owners, ',') AS allowed_owners, denied, CASE WHEN ok IS NULL THEN 'INVALID_REQUEST' END AS error FROM resolved",
    "a3_authorize": """SELECT request_id, count(*) AS n, min(chunk_id) AS first, max(chunk_id) AS last FROM resolved r JOIN chunks c ON ok AND (r.departments IS NULL OR list_contains(r.departments, department)) AND (r.regions IS NULL OR list_has_any(r.regions, c.regions))
      AND (r.policy_types IS NULL OR list_contains(r.policy_types, policy_type)) AND (r.access_levels IS NULL OR list_contains(r.access_levels, access_level)) AND (r.owners IS NULL OR list_contains(r.owners, owner)) GROUP BY request_id""",
    "g1_entities": "SELECT chunk_id, doc_id, label, type, mention FROM ents",
    "g2_times": "SELECT doc_id, (doc_id % 9) || ' minutes|2 business days|first week|' || (doc_id % 5 + 1) || ' working days' AS times FROM documents",
    "g3_thresholds": "SELECT doc_id, 'USD ' || (doc_id % 7 + 1) || ',000 and up to USD 9,500|more than ' || (doc_id % 5 + 1) || ' working days' AS thresholds FROM documents",
    "g4_metadata_graph": f"SELECT {EDGE} FROM meta_edges",
    "g5_content_edges": f"SELECT {EDGE} FROM mention_edges",
    "g6_relation_edges": f"SELECT {EDGE} FROM rel_edges",
    "g7_quotes": f"SELECT chunk_id, {quote('text', chr(39) + 'THE' + chr(39))} AS quote, {quote('text', chr(39) + 'zzz' + chr(39))} AS whole FROM chunks",
    "g8_ids": "SELECT page_id, " + node_id("url", "'AccessLevel'") + " AS node_id, " + edge_id("url", "'HAS_ACCESS_LEVEL'", "'t'", "'c'") + " AS edge_id FROM pages",
    "g9_nodes": f"SELECT {NODES} FROM nodes",
    "g9_node_sources": "SELECT DISTINCT node_id, doc_id, chunk_id FROM nodes1",
    "g10_edges": f"SELECT {EDGE} FROM edges",
    "g11_build": "SELECT 'nodes' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'chunks', count(DISTINCT source_chunk_id) FROM edges",
    "g12_listings": "SELECT 'node' AS kind, node_id AS id FROM nodes WHERE type = 'Process' AND contains(lower(label), 'process-') UNION ALL SELECT DISTINCT 'source', node_id FROM nodes1 WHERE doc_id = 'doc-0000199' UNION ALL SELECT 'edge', edge_id FROM edges WHERE relation_type = 'REQUIRES'",
    "g13_neighborhoods": """SELECT * FROM (SELECT seed, count(*) AS n_nodes, sum(distance)::BIGINT AS distances, max(node_id) AS last_node FROM near GROUP BY seed)
      JOIN (SELECT x.seed, count(*) AS n_edges, max(edge_id) AS last_edge FROM te JOIN near x ON x.node_id = te.s JOIN near y ON y.node_id = te.t AND x.seed = y.seed GROUP BY x.seed) USING (seed)""",
    "g14_stats": "SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(DISTINCT relation_type) FROM edges) AS n_relations, (SELECT count(DISTINCT source_chunk_id) FROM edges) AS n_chunks, (SELECT count(DISTINCT doc_id) FROM chunks) AS n_documents",
    "q1_classify": "SELECT query_id, intent FROM routes",
    "q2_route": "SELECT query_id, route, confidence, include_retrieval, include_graph, graph_depth::INT AS graph_depth, refusal_reason, array_to_string(policy_types, ',') AS policy_types FROM routes",
    "q3_evidence": r"""SELECT query_id, rank::INT AS rank, chunk_id, citation_id, title, section_title, sha256(x) AS excerpt_sha, length(x)::INT AS excerpt_chars FROM (SELECT *, CASE WHEN length(quote) <= 1200 THEN quote ELSE regexp_replace(left(quote, 1197), '\s+$', '') || '...' END AS x FROM ev)""",
    "q4_tokens": f"SELECT item_id AS query_id, array_to_string({evidence_tokens('text')}, ' ') AS tokens, array_to_string({answer_tokens('text')}, ' ') AS answer_tokens FROM benchmark",
    "q5_match_nodes": "SELECT query_id, node_id, round(score, 6) AS score, rank::INT AS rank FROM mn",
    "q6_candidates": "SELECT * FROM (SELECT query_id, count(*) AS n_nodes, min(node_id) AS first_node FROM cand_n GROUP BY query_id) FULL JOIN (SELECT query_id, count(*) AS n_edges, max(edge_id) AS last_edge FROM cand_e GROUP BY query_id) USING (query_id)",
    "q7_rank_edges": "SELECT query_id, edge_id, round(score, 6)::DOUBLE AS score, rank::INT AS rank FROM re_",
    "q8_rank_nodes": "SELECT query_id, node_id, round(score, 6)::DOUBLE AS score, rank::INT AS rank FROM rn",
    "q9_packs": "SELECT query_id, status, coalesce(array_to_string(citations, ','), '') AS citations, coalesce(array_to_string(relation_types, ','), '') AS relation_types, n_edges, limitations, array_to_string(ml, ',') AS matched_labels, len(nl)::INT AS n_neighbors FROM packs",
    "q10_sufficiency": "SELECT query_id, array_to_string(missing, ',') AS missing, scored, len(missing) = 0 AND scored AS sufficient FROM suff",
    "q11_extractive": "SELECT query_id, CASE WHEN status <> 'refused' THEN answer END AS answer, CASE WHEN status <> 'refused' AND ac IS NOT NULL THEN ac ELSE '' END AS answer_citations FROM packs LEFT JOIN extract USING (query_id)",
    "q12_rule_answers": "SELECT query_id, rule_id, answer, array_to_string(cits, ',') AS answer_citations FROM ruled",
    "q13_answers": """SELECT query_id, st AS answer_generation_status, CASE WHEN st = 'refused' THEN refusal_reason WHEN st = 'insufficient_evidence' THEN CASE WHEN citations IS NULL OR suff THEN 'no_citable_evidence' ELSE 'insufficient_evidence' END END AS answer_refusal_reason,
      CASE WHEN st = 'generated' THEN answer END AS answer, CASE WHEN st = 'generated' THEN array_to_string(cits, ',') ELSE '' END AS answer_citations, CASE WHEN st = 'generated' THEN 'citations: ' || array_to_string(cits, ', ') || '; documents: ' || titles || '; graph edges: ' || n_edges END AS grounding_summary
      FROM (SELECT *, len(missing) = 0 AND scored AS suff, CASE WHEN NOT generate_answer THEN 'not_requested' WHEN status = 'refused' THEN 'refused' WHEN citations IS NULL OR NOT (len(missing) = 0 AND scored) OR answer IS NULL THEN 'insufficient_evidence' ELSE 'generated' END AS st
        FROM suff LEFT JOIN said USING (query_id) LEFT JOIN stitles USING (query_id))""",
    "e1_checks": "SELECT n AS case_id, array_to_string(failed, '|') AS failed_checks, hit AS retrieval_hit_at_k, round(recall, 6) AS retrieval_recall_at_k, csv AS citation_subset_valid, ecm AS expected_citation_match, gp AS grounding_pass, rc AS refusal_correct, fab AS fabricated_answer, passed FROM evc",
    "e2_metrics": f"SELECT {METRICS} FROM evc",
    "e3_splits": "SELECT s AS split, count(n) AS total, coalesce(count_if(passed), 0) AS passed, count(n) - coalesce(count_if(passed), 0) AS failed, round(count_if(passed)::DOUBLE / nullif(count(n), 0), 6) AS pass_rate FROM (SELECT unnest(['core', 'holdout', 'extra']) AS s) LEFT JOIN evc ON split = s GROUP BY s",
    "e4_intents": "SELECT expected_intent, count(*) AS total, count_if(passed) AS passed, round(count_if(passed)::DOUBLE / count(*), 6) AS pass_rate, round(count_if(expected_intent = intent)::DOUBLE / count(*), 6) AS intent_accuracy FROM evc GROUP BY expected_intent",
    "e5_confusion": "SELECT expected_intent, intent, count(*) AS n FROM evc GROUP BY ALL",
    "e6_validate": """SELECT case_id, e AS errors FROM (SELECT case_id, concat_ws('|', CASE WHEN count(*) OVER (PARTITION BY case_id) > 1 THEN 'case_id_not_unique' END, CASE WHEN g AND n % 9 = 0 THEN 'generated_without_flag' END) AS e
      FROM (SELECT *, CASE WHEN n % 50 = 1 THEN n - 1 ELSE n END AS case_id FROM evc)) WHERE e <> ''""",
    "e7_report": f"SELECT 'run1' AS run_id, count(*) AS total, round(count_if(passed)::DOUBLE / count(*), 6) AS pass_rate, count_if(NOT passed)::INT AS n_failures, 0::BIGINT AS core_total, count(*) AS holdout_total, count_if(passed) AS holdout_passed FROM evc WHERE split = 'holdout'",
    "f1_list": "SELECT feedback_id, issue_category, (SELECT count(*) FROM fb WHERE review_status = 'open' AND user_rating = 'negative') AS total FROM fb WHERE review_status = 'open' AND user_rating = 'negative' ORDER BY feedback_id LIMIT 500 OFFSET 10",
    "f2_summary": """SELECT 'all' AS dimension, 'total' AS value, count(*) AS n FROM fb UNION ALL SELECT 'all', 'negative', count_if(user_rating = 'negative') FROM fb UNION ALL SELECT 'all', 'unresolved', count_if(review_status IN ('open', 'triaged')) FROM fb
      UNION ALL SELECT 'issue_category', issue_category, count(*) FROM fb GROUP BY ALL UNION ALL SELECT 'review_status', review_status, count(*) FROM fb GROUP BY ALL UNION ALL SELECT 'feedback_type', feedback_type, count(*) FROM fb GROUP BY ALL
      UNION ALL (SELECT 'top' || row_number() OVER (ORDER BY c DESC, f), issue_category, c FROM (SELECT issue_category, count(*) AS c, min(feedback_id) AS f FROM fb GROUP BY ALL) ORDER BY c DESC, f LIMIT 5)""",
    "f3_updates": """SELECT feedback_id, NULL::BIGINT AS at_event, review_status, reviewer_note, linked_eval_case_id, NULL::VARCHAR AS changed, NULL::VARCHAR AS error FROM lasting
      UNION ALL SELECT feedback_id, at_event, a_review_status, a_reviewer_note, a_linked_eval_case_id, array_to_string(cf, ','), NULL FROM changed
      UNION ALL SELECT feedback_id, NULL, NULL, NULL, NULL, NULL, 'INVALID_REQUEST' FROM upd WHERE feedback_id NOT IN (SELECT feedback_id FROM fb)""",
    "f4_queue": "SELECT feedback_id, review_status, (SELECT count(*) FROM fb WHERE review_status IN ('open', 'triaged')) AS total FROM fb WHERE review_status IN ('open', 'triaged')",
    "f5_audit": """SELECT feedback_id, NULL::BIGINT AS at_event, 0 AS step, 'feedback_submission' AS event_type, 'feedback_type=' || feedback_type || ',issue_category=' || issue_category || ',user_rating=' || user_rating AS metadata FROM fb
      UNION ALL SELECT feedback_id, at_event, 1, 'feedback_status_updated', 'review_status=' || a_review_status FROM changed WHERE c_review_status UNION ALL SELECT feedback_id, at_event, 2, 'feedback_reviewer_note_updated', '' FROM changed WHERE c_reviewer_note
      UNION ALL SELECT feedback_id, at_event, 3, 'feedback_eval_linked', 'linked_eval_case_id=' || a_linked_eval_case_id FROM changed WHERE c_linked_eval_case_id""",
    "f6_readiness": """SELECT 'personas' AS part, 'available' AS status, (SELECT count(*) FROM nation)::VARCHAR AS detail UNION ALL SELECT 'graph', 'available', (SELECT count(*) FROM nodes) || '/' || (SELECT count(*) FROM edges)
      UNION ALL SELECT 'evaluation', 'available', (SELECT round(count_if(passed)::DOUBLE / count(*), 4) FROM evc)::VARCHAR
      UNION ALL SELECT 'feedback', 'available', (SELECT 'open=' || count_if(review_status = 'open') || ',triaged=' || count_if(review_status = 'triaged') || ',resolved=' || count_if(review_status = 'resolved') || ',closed=' || count_if(review_status = 'closed') FROM fb)""",
}

rate = lambda mode: f"max(hit_rate) FILTER (mode = '{mode}')"
SELECTS["t16_gate"] = f"SELECT {rate('bm25')} AS bm25, {rate('vector')} AS vector, {rate('hybrid')} AS hybrid, {rate('hybrid')} >= 0.8 AND {rate('hybrid')} >= {rate('bm25')} AND {rate('hybrid')} >= {rate('vector')} AS passed FROM ({SELECTS['t16_retrieval_eval']})"


def oracle_sql() -> dict[str, str]:
    return {name: sql(select) for name, select in SELECTS.items()}
