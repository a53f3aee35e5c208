"""Row types of the corpus and the parameters that hold one default configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Kinds of a page record.
STAFF, ANNOUNCEMENT, NEWS, PAGE, PDF, TABLE = "personel", "duyuru", "haber", "sayfa", "pdf", "tablo"
DOC_TYPES = (STAFF, ANNOUNCEMENT, NEWS, PAGE, PDF, TABLE)
DATED_TYPES = (ANNOUNCEMENT, NEWS)

PAGES = T.StructType(
    [
        T.StructField("url", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("breadcrumb", T.ArrayType(T.StringType(), False), False),
        T.StructField("unit", T.StringType()),
        T.StructField("doc_type", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("published_at", T.StringType()),
        T.StructField("fetched_at", T.StringType(), False),
        T.StructField("content_hash", T.StringType(), False),
    ]
)
PAGE_FIELDS = tuple(PAGES.fieldNames())

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("pos", T.LongType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("unit", T.StringType()),
        T.StructField("doc_type", T.StringType(), False),
        T.StructField("published_at", T.StringType()),
        T.StructField("text", T.StringType(), False),
        T.StructField("job_form", T.BooleanType(), False),
    ]
)

UNANSWERED = T.StructType(
    [
        T.StructField("asked_at", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("search_question", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("bm25_max", T.DoubleType()),
        T.StructField("cosine_max", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class ChunkParams:
    window: int = 380  # words of a chunk
    overlap: int = 60  # words repeated at the start of the next chunk
    min_chars: int = 10
    min_words: int = 8  # of an informative chunk
    job_markers: int = 2
    spaced_tokens: int = 8  # tokens of a line that may be letter-spaced
    spaced_share: float = 0.6


@dataclass(frozen=True)
class SearchParams:
    k: int = 4
    candidates: int = 30  # of each method
    rrf_k: int = 60
    title_bonus: float = 0.015
    job_penalty: float = 0.35
    per_source: int = 2
    gate_bm25: float = 3.0
    gate_cosine: float = 0.82
    gate_cosine_alone: float = 0.85
    gate_bm25_alone: float = 12.0


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class PageParams:
    min_chars: int = 20
    table_share: float = 0.5
    table_lines: int = 4
    badge_chars: int = 300  # where a date without a year may stand
    future_days: int = 2
    breadcrumb_tail: int = 4
