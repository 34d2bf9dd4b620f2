"""Node and edge tables from chunks and rule tables, and neighborhoods on them.

Rule tables: entity_rules (ordinal, label, type, aliases); relation_rules (source_label and source_type,
null for the document; target_label, null for any; target_type; phrases; relation; hint, null for the
target's label). Nodes and edges are made without texts; the quotes of the edges that are left in the end
are taken in one pass over the chunks. Which documents and chunks a node comes from is a table of its own.
"""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from govdocs.functions import text as X
from govdocs.functions.helpers import text_batches
from govdocs.operators.hoods import HUB, Hoods, hoods
from govdocs.settings import DOCUMENT_LEVEL_RELATIONS

NODE = ["node_id", "label", "type"]
#: Mentions that a node shows at most; fixed by the data model.
MOST_MENTIONS = 50
INLINE_ALIASES = 200
#: Part of a lexicon that one automaton holds.
LEXICON_BYTES = 8 << 20
LOWERED = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: What may not stand beside an alias, in lower case.
WORDLIKE = frozenset(string.ascii_lowercase + string.digits)


def node_id(label: Column, kind: Column) -> Column:
    """node:{type}:{label}:{hash}; the label's slug at most 80 long, the hash over type and lower-case label."""
    return F.concat_ws(":", F.lit("node"), X.slugify(kind, "value"), F.substring(X.slugify(label, "value"), 1, 80), X.short_hash(F.concat_ws("|", kind, F.lower(label)), 8))


def edge_id(source: Column, relation: Column, target: Column, chunk: Column) -> Column:
    return F.concat_ws(":", F.lit("edge"), X.slugify(relation, "value"), X.short_hash(F.concat_ws("|", source, relation, target, chunk), 12))


def pattern_of(alias: str) -> str:
    """A regular expression for an alias between other characters than ASCII letters and digits."""
    return "(?i)(?<![A-Za-z0-9])" + re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", alias) + "(?![A-Za-z0-9])"


def match_entities(chunks: DataFrame, entity_rules: DataFrame) -> DataFrame:
    """chunk_id, doc_id, label, type, mention: for each rule the first of its aliases that the chunk's text holds.

    Up to INLINE_ALIASES aliases become constant patterns. More go into an automaton, which finds all of
    them in one pass over a text where it is read; what stands beside a hit is looked at then. A lexicon over
    LEXICON_BYTES is dealt into slices of whole rules, with a pass for each, so that what a task holds is
    bounded; no text is shuffled.
    """
    rules = entity_rules.select("label", "type", F.posexplode("aliases").alias("place", "alias"))
    few = rules.limit(INLINE_ALIASES + 1).collect()
    if len(few) <= INLINE_ALIASES:
        by_rule: dict[tuple[str, str], list[tuple[int, str]]] = {}
        for r in few:
            by_rule.setdefault((r.label, r.type), []).append((r.place, r.alias))
        # the letters are looked for before the pattern is tried; case beyond ASCII is the pattern's alone
        near = lambda alias: F.col("low").contains(alias.lower()) if alias.isascii() else F.lit(True)
        held = lambda alias: F.when(near(alias) & F.col("text").rlike(pattern_of(alias)), F.lit(alias))
        found = [F.struct(F.lit(label).alias("label"), F.lit(kind).alias("type"), F.coalesce(*[held(a) for _, a in sorted(aliases)]).alias("mention")) for (label, kind), aliases in by_rule.items()]
        if not found:
            return chunks.select("chunk_id", "doc_id").limit(0).selectExpr("*", "string(null) label", "string(null) type", "string(null) mention")
        texts = chunks.select("chunk_id", "doc_id", "text", F.lower("text").alias("low"))
        return texts.select("chunk_id", "doc_id", F.inline(F.filter(F.array(*found), lambda x: x["mention"].isNotNull())))
    size = rules.agg(F.sum(F.octet_length("alias") + F.octet_length("label") + F.octet_length("type"))).first()[0] or 0
    slices = -(-size // LEXICON_BYTES)
    own = F.pmod(F.xxhash64("label", "type"), F.lit(slices))
    parts = [scanned_entities(chunks, [tuple(r) for r in rules.where(own == i).collect()]) for i in range(slices)]  # LEXICON_BYTES each
    return functools.reduce(DataFrame.unionByName, parts)


def lexicon(aliases: list[str]):
    """An automaton over lower-case aliases, each with its places in the list."""
    import ahocorasick

    of: dict[str, list[int]] = {}
    for i, alias in enumerate(aliases):
        of.setdefault(alias.translate(LOWERED), []).append(i)
    out = ahocorasick.Automaton()
    for alias, places in of.items():
        if alias:
            out.add_word(alias, (len(alias), tuple(places)))
    if len(out):
        out.make_automaton()
    return out


def scanned_entities(chunks: DataFrame, rules: list[tuple]) -> DataFrame:
    """What match_entities gives for rules (label, type, place, alias), by one automaton over their aliases."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = lexicon([r[3] for r in rules])
        for p in parts:
            out = []
            for row in p.itertuples(index=False):
                text = (row.text or "").translate(LOWERED)
                best: dict[tuple[str, str], tuple[int, str]] = {}
                for last, (size, places) in found.iter(text) if len(found) else ():
                    first = last - size + 1
                    if text[first - 1 : first] in WORDLIKE and first or text[last + 1 : last + 2] in WORDLIKE and last + 1 < len(text):
                        continue
                    for i in places:
                        label, kind, place, alias = rules[i]
                        best[label, kind] = min(best.get((label, kind), (place, alias)), (place, alias))
                out += [(row.chunk_id, row.doc_id, *key, alias) for key, (_, alias) in best.items()]
            yield pd.DataFrame(out, columns=["chunk_id", "doc_id", "label", "type", "mention"], dtype=object)

    text_batches(chunks)
    kinds = [chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "doc_id")]
    return chunks.select("chunk_id", "doc_id", "text").mapInPandas(run, f"chunk_id {kinds[0]}, doc_id {kinds[1]}, label string, type string, mention string")


def stated_values(chunks: DataFrame) -> DataFrame:
    """Time requirements and thresholds of the texts, as match_entities gives entities."""
    of = lambda values, kind: F.transform(values, lambda v: F.struct(v.alias("label"), F.lit(kind).alias("type"), v.alias("mention")))
    rows = F.concat(of(X.time_requirements(F.col("text")), "TimeRequirement"), of(X.thresholds(F.col("text")), "Threshold"))
    return chunks.select("chunk_id", "doc_id", F.inline(rows))


def document_node(kind: Column, title: Column) -> tuple[Column, Column]:
    """(label, type) of a document's node."""
    return title, F.when(kind == "policy", F.lit("Policy")).otherwise(F.lit("SOP"))


def metadata_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the chunks' metadata: the document, who owns it, its level, regions and processes."""
    title, kind = document_node(F.col("policy_type"), F.col("title"))
    node = lambda label, kind, conf: F.struct(label.alias("label"), kind.alias("type"), F.lit(conf).alias("confidence"), node_id(label, kind).alias("node_id"))
    doc, lit = node(title, kind, 1.0), F.lit
    owners = [node(F.col(c), lit("Department"), 0.9) for c in ("department", "owner")]
    level = node(F.col("access_level"), lit("AccessLevel"), 1.0)
    regions = F.transform("regions", lambda r: node(r, lit("Region"), 0.9))
    processes = F.transform("related_processes", lambda p: node(p, lit("Process"), 0.9))
    rows = chunks.select("chunk_id", "doc_id", doc.alias("doc"), F.array(*owners).alias("owners"), level.alias("level"), regions.alias("regions"), processes.alias("processes"))
    nodes = rows.select("chunk_id", "doc_id", F.inline(F.concat(F.array("doc"), "owners", F.array("level"), "regions", "processes")))
    nodes = nodes.select("node_id", "label", "type", "doc_id", "chunk_id", F.col("label").alias("mention"), "confidence")
    pair = lambda s, r, t: F.struct(s.alias("s"), F.lit(r).alias("relation_type"), t.alias("t"))
    edges = F.concat(
        F.transform("owners", lambda o: pair(o, "OWNS", F.col("doc"))),
        F.array(pair(F.col("doc"), "HAS_ACCESS_LEVEL", F.col("level"))),
        F.transform("regions", lambda r: pair(F.col("doc"), "APPLIES_TO", r)),
        F.transform("processes", lambda p: pair(F.col("doc"), "GOVERNS", p)),
    )
    return nodes, edge_rows(rows.select("chunk_id", "doc_id", F.inline(edges)), F.col("t.label"))


def edge_rows(rows: DataFrame, hint: Column, confidence: float = 0.85) -> DataFrame:
    """Edges of rows (chunk_id, doc_id, s and t with label and type, or node_id, too, relation_type), with the hint of their quote. No self-edges."""
    source, target = (F.col(f"{x}.node_id") if "node_id" in rows.schema[x].dataType.names else node_id(F.col(f"{x}.label"), F.col(f"{x}.type")) for x in ("s", "t"))
    rows = rows.withColumns({"source_node_id": source, "target_node_id": target}).where("source_node_id <> target_node_id")
    ident = edge_id(F.col("source_node_id"), F.col("relation_type"), F.col("target_node_id"), F.col("chunk_id"))
    return rows.select(ident.alias("edge_id"), "source_node_id", "target_node_id", "relation_type", F.col("doc_id").alias("source_doc_id"), F.col("chunk_id").alias("source_chunk_id"), hint.alias("hint"), F.lit(confidence).alias("confidence"))


def with_documents(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """matches with s, the document's node; titles are joined, not texts."""
    title, kind = document_node(F.col("policy_type"), F.col("title"))
    own = chunks.select(F.col("chunk_id").alias("c_id"), F.struct(title.alias("label"), kind.alias("type")).alias("s"))
    return matches.join(own, F.col("chunk_id") == F.col("c_id")).drop("c_id")


def content_edges(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges from each document to what its chunks mention or state."""
    relation = F.when(F.col("type") == "TimeRequirement", "HAS_TIME_REQUIREMENT").when(F.col("type") == "Threshold", "HAS_THRESHOLD").otherwise("MENTIONS")
    rows = with_documents(matches, chunks).withColumns({"t": F.struct("label", "type"), "relation_type": relation})
    return edge_rows(rows, F.col("mention"))


def said_phrases(chunks: DataFrame, relation_rules: DataFrame) -> DataFrame:
    """chunk_id, phrases: which of the rules' phrases (in lower case) the chunk's text holds; chunks with none are left out."""
    phrases = [r.p for r in relation_rules.select(F.explode("phrases").alias("p")).select(F.lower("p").alias("p")).distinct().collect()]  # rules, not data
    low = F.lower(F.col("text"))
    held = F.array_compact(F.array(*[F.when(low.contains(p), F.lit(p)) for p in sorted(phrases)])) if phrases else F.array().cast("array<string>")
    return chunks.select(F.col("chunk_id").alias("p_id"), held.alias("said")).where(F.size("said") > 0)


def relation_edges(matches: DataFrame, chunks: DataFrame, relation_rules: DataFrame) -> DataFrame:
    """Edges where a rule's target (and source, unless it is the document) is matched in a chunk that holds one of its phrases; no phrases: always."""
    r = relation_rules.withColumn("phrases", F.transform("phrases", F.lower))
    rows = with_documents(matches, chunks).join(r, (F.col("type") == F.col("target_type")) & (F.col("target_label").isNull() | (F.col("label") == F.col("target_label"))))
    rows = rows.join(said_phrases(chunks, relation_rules), F.col("chunk_id") == F.col("p_id"), "left")
    rows = rows.where(F.coalesce(F.size("phrases") == 0, F.lit(True)) | F.coalesce(F.arrays_overlap("phrases", "said"), F.lit(False)))
    pick = ["chunk_id", "doc_id", "s", F.struct("label", "type").alias("t"), F.col("relation").alias("relation_type"), F.coalesce("hint", "label").alias("hint")]
    from_document = rows.where("source_label is null").select(*pick)
    origin = matches.select(F.col("chunk_id").alias("o_id"), F.struct("label", "type").alias("o"))
    between = rows.where("source_label is not null").join(origin, (F.col("chunk_id") == F.col("o_id")) & (F.col("o.label") == F.col("source_label")) & (F.col("o.type") == F.col("source_type")))
    between = between.withColumn("s", F.col("o")).select(*pick)
    return edge_rows(from_document.unionByName(between), F.col("hint"))


def occurrences(nodes: DataFrame) -> DataFrame:
    """nodes with each occurrence once, so that a hub's rows meet already reduced; best stored, as several parts read them."""
    return nodes.groupBy("node_id", "label", "type", "doc_id", "chunk_id", "mention").agg(F.max("confidence").alias("confidence"))


def merge_nodes(rows: DataFrame, most: int = MOST_MENTIONS) -> tuple[DataFrame, DataFrame]:
    """(nodes, sources) of occurrences. nodes: label and type of the first occurrence, sorted mentions (`most` at most), highest confidence, how many documents and chunks; sources: node_id, doc_id, chunk_id, each once, however many.

    Occurrences are counted by document before they meet by node.
    """
    sources = rows.select("node_id", "doc_id", "chunk_id").distinct()
    counts = sources.groupBy("node_id", "doc_id").agg(F.count("*").alias("n")).groupBy("node_id").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chunks"))
    first = F.struct("doc_id", "chunk_id", "label")
    heads = rows.groupBy("node_id").agg(F.min_by("label", first).alias("label"), F.min_by("type", first).alias("type"), F.max("confidence").alias("confidence"))
    # a node's mentions differ by alias or case alone, so that the set is small
    mentions = rows.groupBy("node_id", "mention").agg(F.lit(1)).groupBy("node_id").agg(F.slice(F.array_sort(F.collect_list("mention")), 1, most).alias("mentions"))
    return heads.join(mentions, "node_id").join(counts, "node_id").select("node_id", "label", "type", "mentions", "confidence", "n_docs", "n_chunks"), sources


def merge_edges(edges: DataFrame) -> DataFrame:
    """Edges without mentions beside a stronger relation of the same pair and document; document-level relations once a document, others once an id. hints: those of equal edges."""
    pair = ["source_node_id", "target_node_id", "source_doc_id"]
    weak = F.col("relation_type") == "MENTIONS"
    # a window over what a document says of a pair, so that the edges are made once
    kept = edges.withColumn("strong", F.max(~weak).over(Window.partitionBy(*pair))).where(~weak | ~F.col("strong")).drop("strong")
    whole = F.col("relation_type").isin(DOCUMENT_LEVEL_RELATIONS)
    key = F.when(whole, F.concat_ws("|", F.lit("document"), "source_node_id", "relation_type", "target_node_id", "source_doc_id")).otherwise(F.col("edge_id"))
    order = ["source_doc_id", "source_chunk_id", "relation_type", "source_node_id", "target_node_id", "edge_id"]
    one = kept.withColumn("key", key).groupBy("key", *order).agg(F.max("confidence").alias("confidence"), F.collect_set("hint").alias("hints"))
    return one.groupBy("key").agg(F.min(F.struct(*order, "confidence", "hints")).alias("e")).select("e.*")


def quoted(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """edges with their quotes: a chunk's edges meet its text once, which is cut into sentences once."""
    own = [c for c in edges.columns if c != "source_chunk_id"]
    by_chunk = edges.groupBy("source_chunk_id").agg(F.collect_list(F.struct(*own)).alias("edges"))  # what one chunk mentions
    rows = by_chunk.join(chunks.select(F.col("chunk_id").alias("source_chunk_id"), "text"), "source_chunk_id")
    quotes = X.evidence_quotes(F.col("text"), F.col("edges"), lambda e: e["hints"])
    rows = rows.select("source_chunk_id", F.inline(F.arrays_zip(F.col("edges").alias("e"), quotes.alias("q"))))
    return rows.select("e.edge_id", "e.source_node_id", "e.target_node_id", "e.relation_type", "e.source_doc_id", "source_chunk_id", F.array_min("q").alias("evidence_quote"), "e.confidence")


def with_quotes(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges that are not merged, each with the quote of its own hint."""
    return quoted(edges.withColumn("hints", F.array("hint")).drop("hint"), chunks)


def matches_of(chunks: DataFrame, entity_rules: DataFrame) -> DataFrame:
    """chunk_id, doc_id, label, type, mention of all that the texts mention or state."""
    return match_entities(chunks, entity_rules).unionByName(stated_values(chunks))


def node_occurrences(chunks: DataFrame, matches: DataFrame) -> DataFrame:
    """The occurrences of all nodes of a chunk table and its matches."""
    found = matches.select(node_id(F.col("label"), F.col("type")).alias("node_id"), "label", "type", "doc_id", "chunk_id", "mention", F.lit(0.9).alias("confidence"))
    return occurrences(metadata_graph(chunks)[0].unionByName(found))


def merged_edges(chunks: DataFrame, matches: DataFrame, relation_rules: DataFrame) -> DataFrame:
    """The edges of a chunk table and its matches, merged, with hints; `quoted` gives them their quotes."""
    edges = metadata_graph(chunks)[1].unionByName(content_edges(matches, chunks)).unionByName(relation_edges(matches, chunks, relation_rules))
    return merge_edges(edges)


def build_graph(chunks: DataFrame, matches: DataFrame, relation_rules: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, sources, edges) of a chunk table and its matches (best stored: several parts read them)."""
    nodes, sources = merge_nodes(node_occurrences(chunks, matches))
    return nodes, sources, quoted(merged_edges(chunks, matches, relation_rules), chunks)


def list_nodes(nodes: DataFrame, kind: str | None = None, label: str | None = None, source_doc_id: str | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Nodes that match, by node_id; source_doc_id is looked up in sources (node_id, doc_id), whole however large a node is."""
    same = F.lit(True) if kind is None else F.col("type") == kind
    found = nodes.where(same & X.text_match(F.col("label"), label, contains=True))
    if source_doc_id is not None:
        found = found.join(sources.where(F.col("doc_id") == source_doc_id).select("node_id"), "node_id", "left_semi")
    return found.orderBy("node_id")


def list_edges(edges: DataFrame, relation: str | None = None, source_doc_id: str | None = None, source: str | None = None, target: str | None = None) -> DataFrame:
    equal = [(c, v) for c, v in (("relation_type", relation), ("source_doc_id", source_doc_id), ("source_node_id", source), ("target_node_id", target)) if v is not None]
    return edges.where(functools.reduce(lambda a, b: a & b, [F.col(c) == v for c, v in equal], F.lit(True))).orderBy("edge_id")


def neighborhoods(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int, hub: int = HUB, path: str | None = None, adj: DataFrame | None = None) -> tuple[Hoods, DataFrame]:
    """(hoods, errors) for seeds (seed) within depth (1 or 2), undirected: their neighborhoods in parts, and the seeds that are no nodes. adj: the edges' adjacency, if it is stored."""
    names = nodes.select(F.col("node_id").alias("seed"))
    errors = seeds.join(names, "seed", "left_anti").withColumn("error_code", F.lit("NODE_NOT_FOUND"))
    return hoods(seeds.join(names, "seed", "left_semi"), edges, depth, hub, path, adj), errors


def graph_stats(nodes: DataFrame, sources: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, relation types and source documents."""
    docs = edges.select(F.col("source_doc_id").alias("doc_id")).unionByName(sources.select("doc_id")).agg(F.count_distinct("doc_id").alias("n_documents"))
    row = edges.agg(F.count("*").alias("n_edges"), F.count_distinct("relation_type").alias("n_relations"), F.count_distinct("source_chunk_id").alias("n_chunks"))
    return nodes.agg(F.count("*").alias("n_nodes")).join(row, how="cross").join(docs, how="cross")  # one row each
