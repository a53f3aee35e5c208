"""Hybrid search: rank fusion, title bonus, job-form penalty, guaranteed firsts, source quota and scope gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import tokenize_tr
from lexmill.operators import dense, sparse
from lexmill.schema import SearchParams

# Query words that ask for duties, and what users call things that the corpus names otherwise.
DUTY_WORDS = ("gorev", "gorevi", "gorevleri", "sorumluluk", "sorumluluklari", "yetki", "yetkileri", "tanimi", "komisyon", "komisyonu")
SYNONYMS = {
    "hoca": ["akademik", "personel"],
    "hocalar": ["akademik", "personel"],
    "hocalari": ["akademik", "personel"],
    "akademisyen": ["akademik", "personel"],
    "akademisyenler": ["akademik", "personel"],
    "ogretim": ["akademik", "personel"],
    "kadro": ["akademik", "personel"],
    "gorevlisi": ["ars", "gor", "personel"],
    "gorevlileri": ["ars", "gor", "personel"],
    "telefonu": ["telefon", "iletisim"],
    "maili": ["posta", "iletisim"],
    "mail": ["posta", "iletisim"],
}


def fuse(bm25: DataFrame, cosine: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, doc_id, rrf, bm25_rank, dense_rank, place) of two rankings(query_id, doc_id, rank). place keeps the
    order in which candidates came up: the dense ones first. Both sides must rank a document once for a query."""
    both = bm25.select("query_id", "doc_id", F.col("rank").alias("bm25_rank"), F.lit(None).cast("int").alias("dense_rank"))
    both = both.unionByName(cosine.select("query_id", "doc_id", F.lit(None).cast("int").alias("bm25_rank"), F.col("rank").alias("dense_rank")))
    out = both.groupBy("query_id", "doc_id").agg(F.max("bm25_rank").alias("bm25_rank"), F.max("dense_rank").alias("dense_rank"))
    share = lambda c: F.coalesce(1.0 / (p.rrf_k + F.col(c)), F.lit(0.0))
    place = F.coalesce("dense_rank", F.col("bm25_rank") + 1_000_000)
    return out.select("query_id", "doc_id", (share("bm25_rank") + share("dense_rank")).alias("rrf"), "bm25_rank", "dense_rank", place.alias("place"))


def title_bonus(query_tokens: Column, title_tokens: Column, p: SearchParams) -> Column:
    """The share of distinct query tokens that the title holds, times the bonus."""
    asked = F.array_distinct(query_tokens)
    return F.when(F.size(asked) > 0, p.title_bonus * F.size(F.array_intersect(asked, title_tokens)) / F.size(asked)).otherwise(0.0)


def order(candidates: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """Final ranking of candidates (as from fuse, with query_tokens, title_tokens, job_form, source, and maybe k):
    query_id, doc_id, rank, rrf and what else they carry.

    The first of each method goes to the front, once each and unless penalised; then by fused score. A source gives at
    most per_source rows. Null titles add nothing; a null job_form counts as false; rows of null source share a quota."""
    duty = F.arrays_overlap(F.col("query_tokens"), F.array(*map(F.lit, DUTY_WORDS)))
    punished = F.coalesce("job_form", F.lit(False)) & ~F.coalesce(duty, F.lit(False))
    boosted = F.col("rrf") + title_bonus(F.col("query_tokens"), F.coalesce("title_tokens", F.array().cast("array<string>")), p)
    front = F.when(~punished & (F.col("bm25_rank") == 1), 0).when(~punished & (F.col("dense_rank") == 1), 1).otherwise(2)
    scored = candidates.withColumn("rrf", F.round(F.when(punished, boosted * p.job_penalty).otherwise(boosted), 9)).withColumn("__front", front)
    by = [F.asc("__front"), F.desc("rrf"), F.asc("place"), F.asc("doc_id")]
    within = scored.withColumn("__nth", F.row_number().over(W.partitionBy("query_id", "source").orderBy(*by))).filter(F.col("__nth") <= p.per_source)
    k = F.coalesce(F.col("k"), F.lit(p.k)) if "k" in candidates.columns else F.lit(p.k)
    ranked = within.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by))).filter(F.col("rank") <= k)
    return ranked.drop("__front", "__nth")


def in_scope(bm25_max: Column, cosine_max: Column, p: SearchParams = SearchParams()) -> Column:
    """Whether a query belongs to the corpus: both signals, or one that is strong alone. Null means no result: out."""
    b, c = F.coalesce(bm25_max, F.lit(0.0)), F.coalesce(cosine_max, F.lit(0.0))
    return ((b >= p.gate_bm25) & (c >= p.gate_cosine)) | (c >= p.gate_cosine_alone) | (b >= p.gate_bm25_alone)


def gate(queries: DataFrame, bm25: DataFrame, cosine: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, bm25_max, cosine_max, in_scope) for every query; 0 where a method found nothing."""
    top = lambda df, name: df.groupBy("query_id").agg(F.max("score").alias(name))
    out = queries.select("query_id").join(top(bm25, "bm25_max"), "query_id", "left").join(top(cosine, "cosine_max"), "query_id", "left")
    out = out.select("query_id", F.coalesce("bm25_max", F.lit(0.0)).alias("bm25_max"), F.coalesce("cosine_max", F.lit(0.0)).alias("cosine_max"))
    return out.withColumn("in_scope", in_scope(F.col("bm25_max"), F.col("cosine_max"), p))


def search(chunks: DataFrame, index: sparse.SparseIndex, vectors: DataFrame, queries: DataFrame, p: SearchParams = SearchParams(), synonyms: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, gate) of queries(query_id, text, vector[, k]) over chunks(pos, source, title, job_form, ...).

    Only ids, ranks and small columns pass through the ranking; a caller joins texts to the k rows that are left. An
    empty corpus gives no results, and the gate rejects every query."""
    tokens = queries.select("query_id", tokenize_tr(F.coalesce("text", F.lit(""))).alias("query_tokens"), *(["k"] if "k" in queries.columns else []))
    asked = sparse.expand(tokens.select("query_id", F.col("query_tokens").alias("tokens")), SYNONYMS if synonyms is None else synonyms)
    top = sparse.topk(sparse.score(index, asked), p.candidates)
    near = dense.rank_vectors(vectors, queries, p.candidates)
    fused = fuse(sparse.fill(top, tokens, index.docs, p.candidates), near, p)
    # Only the titles of candidates are tokenised.
    about = chunks.select(F.col("pos").alias("doc_id"), F.col("url").alias("source"), "job_form", F.coalesce("title", F.lit("")).alias("__title"))
    candidates = fused.join(tokens, "query_id").join(about, "doc_id").withColumn("title_tokens", tokenize_tr(F.col("__title"))).drop("__title")
    found = order(candidates, p).drop("query_tokens", "title_tokens")
    sides = found.join(vectors, "doc_id", "left").join(queries.select("query_id", F.col("vector").alias("__asked")), "query_id", "left")
    product = F.aggregate(F.zip_with("vector", "__asked", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return sides.withColumn("cosine", F.round(product, 6)).drop("vector", "__asked"), gate(queries, top, near, p)
