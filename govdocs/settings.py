"""Parameters of the jobs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Passed to every job that has one; no global state."""

    chunk_target_tokens: int = 600
    chunk_max_tokens: int = 800
    chunk_overlap_tokens: int = 100
    top_k: int = 5
    top_k_max: int = 20
    dimensions: int = 384
    max_file_bytes: int = 2 * 1024 * 1024
    suffixes: tuple[str, ...] = (".md", ".txt")
    bm25_k1: float = 1.5
    bm25_b: float = 0.75


#: Fixed values of the data model.
ACCESS_LEVELS = ["public", "internal", "restricted", "confidential"]
POLICY_TYPES = ["policy", "sop", "standard", "guideline", "form", "manual"]
DOCUMENT_LEVEL_RELATIONS = ["OWNS", "APPLIES_TO", "HAS_ACCESS_LEVEL", "GOVERNS"]
BLOCKED_AUDIT_KEYS = ["content", "text", "document_body", "raw_content"]
#: Bytes of a row group of a table that is written to be read again. Spark's reader takes the chunks of a row group's columns into direct buffers, outside the
#: heap and until the next collection, so that four tasks with groups of 128 MB hold hundreds of MB of them.
ROW_GROUP = 16 << 20
#: Compression of such tables, which are mostly texts and terms.
CODEC = "zstd"
