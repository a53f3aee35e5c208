"""BM25 over an inverted index kept as DataFrames.

postings(term, doc_id, tf, dl), terms(term, df, idf), the documents' ids and two facts of the corpus. Texts are tokenised once, when postings
are written; all else comes from their columns. Scoring joins query terms with postings, so that only documents that
share a term with a query are touched.

Documents are dealt to spans by a hash of their id, and a built index is a table in buckets of spans: texts are shuffled
to their buckets, once, and what is grouped by document or span, counts, scores and bounds, needs no shuffle after that.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.text import by_form, nfkc, tokenize_tr
from lexmill.schema import Bm25Params
from lexmill.storage import fresh_path, materialize

#: Documents of a span, and spans of a bucket, on average.
DOCS, SPANS = 128, 32


@dataclass(frozen=True)
class SparseIndex:
    postings: DataFrame  # term, doc_id, tf, dl, and span where it was built in buckets
    terms: DataFrame  # term, df, idf
    docs: DataFrame  # doc_id
    facts: DataFrame  # one row: n documents, mean tokens of a document (null without documents)
    params: Bm25Params = Bm25Params()
    spans: int | None = None  # how many, where postings have a span

    def save(self, path: str) -> None:
        for name, table in (("postings", ordered(self.postings)), ("terms", self.terms), ("docs", self.docs), ("facts", self.facts)):
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, params: Bm25Params = Bm25Params()) -> SparseIndex:
        return cls(*(spark.read.parquet(f"{path}/{x}") for x in ("postings", "terms", "docs", "facts")), params)


def ordered(postings: DataFrame) -> DataFrame:
    """Postings ordered by term and document within and over files, so that a scan for some terms skips row groups and
    the postings of a frequent term fill as many files as they need."""
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartitionByRange(n, "term", "doc_id").sortWithinPartitions("term", "doc_id")


def span_of(spans: int, doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(spans))


def postings(docs: DataFrame, id_col: str, text_cols: tuple[str, ...], stop_words: bool = True, spans: int | None = None, buckets: int = 1) -> DataFrame:
    """(term, doc_id, tf, dl) of the columns of text_cols, joined by spaces; null texts count as empty. With spans, texts
    are dealt to buckets by their span first, which is a column too, and postings are counted where their texts lie."""
    text = F.concat_ws(" ", *[F.col(c) for c in text_cols])
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # Only texts that need the normaliser meet it, before they are dealt: its operator forgets how rows are dealt.
    plain, keys = by_form(source, "text", lambda df, odd: df.withColumn("text", nfkc(F.col("text"))) if odd else df), ["doc_id"]
    if spans:
        plain, keys = plain.withColumn("span", span_of(spans)).repartition(buckets, "span"), ["span", "doc_id"]
    tokens = plain.select(*keys, tokenize_tr(F.col("text"), stop_words, compatibility=False).alias("tokens"))
    # An inner explode would have texts tokenised once more, before the shuffle, to leave out those without tokens.
    terms = tokens.select(*keys, F.size("tokens").cast("long").alias("dl"), F.explode_outer("tokens").alias("term")).filter(F.col("term").isNotNull())
    return terms.groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf", "dl", *keys[:-1])


def in_buckets(docs: DataFrame, id_col: str, text_cols: tuple[str, ...], stop_words: bool = True) -> tuple[DataFrame, int]:
    """(postings, spans): postings as a table in buckets of spans in the shared folder, each ordered by term and document.
    Buckets hold about DOCS * SPANS documents, fewer where all cores would not be busy."""
    spark = docs.sparkSession
    spans = max(1, -(-docs.count() // DOCS))
    buckets = min(spans, max(spark.sparkContext.defaultParallelism, -(-spans // SPANS)))
    name = f"postings_{uuid.uuid4().hex}"
    found = postings(docs, id_col, text_cols, stop_words, spans, buckets)
    found.write.bucketBy(buckets, "span").sortBy("term", "doc_id").format("parquet").saveAsTable(name, path=fresh_path(spark, "postings"))
    return spark.table(name), spans


def frequencies(postings: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term stands."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def build(docs: DataFrame, id_col: str, text_cols: tuple[str, ...], params: Bm25Params = Bm25Params(), stop_words: bool = True) -> SparseIndex:
    """An index over the columns of text_cols, joined by spaces. Null texts count as empty: such rows have no
    postings but do count among the documents."""
    found, spans = in_buckets(docs, id_col, text_cols, stop_words)
    ids = docs.select(F.col(id_col).alias("doc_id"))
    counted = ids.agg(F.count("*").alias("n")).crossJoin(found.agg(F.sum("tf").alias("all")))  # a row each
    facts = counted.select("n", (F.coalesce("all", F.lit(0)) / F.nullif("n", F.lit(0))).alias("mean"))
    return of_counts(found, frequencies(found), ids, facts, params, spans)


def of_counts(postings: DataFrame, frequencies: DataFrame, docs: DataFrame, facts: DataFrame, params: Bm25Params = Bm25Params(), spans: int | None = None) -> SparseIndex:
    """An index of postings whose terms(term, df), documents and facts(n, mean) are known."""
    facts = materialize(facts, "facts")
    return SparseIndex(postings, materialize(inverse_frequencies(frequencies, facts, params), "terms"), docs, facts, params, spans)


def inverse_frequencies(frequencies: DataFrame, facts: DataFrame, params: Bm25Params) -> DataFrame:
    """(term, df, idf). Terms of more than half the documents get epsilon times the mean of all idf."""
    n = facts.select("n").scalar()
    raw = frequencies.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw = materialize(raw, "frequencies")
    mean = raw.agg(F.avg("raw").alias("mean")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, params.epsilon * mean).otherwise(F.col("raw")).alias("idf"))


def expand(queries: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """queries(query_id, tokens) with the synonyms of each token behind the tokens; duplicates stay, added tokens are
    not expanded again."""
    if not synonyms:
        return queries
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.flatten(F.transform("tokens", lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return queries.withColumn("tokens", F.concat("tokens", more))


def saturated(index: SparseIndex, weight: Column | None = None) -> Column:
    """What a posting counts for a weight, 1 if none is given: its frequency, saturated, by the length of its document."""
    p, mean, tf = index.params, index.facts.select("mean").scalar(), F.col("tf")
    return (tf if weight is None else weight * tf) * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * F.col("dl") / mean))


def weights(index: SparseIndex, queries: DataFrame) -> DataFrame:
    """(query_id, term, weight) of queries(query_id, tokens), in the shared folder: as their size is known, Spark sends
    few of them to the postings and shuffles no posting."""
    wanted = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return materialize(wanted.join(index.terms.select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "weights")


def summed(index: SparseIndex, weighted: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of weighted postings, rounded to 6 places so that ties do not hang on the order of a sum."""
    by = ["query_id", *(["span"] if "span" in weighted.columns else []), "doc_id"]
    return weighted.groupBy(*by).agg(F.round(F.sum(saturated(index, F.col("weight"))), 6).alias("score")).select("query_id", "doc_id", "score")


def score(index: SparseIndex, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) for documents that share a term with a query(query_id, tokens). A repeated query token
    scores as often as it stands."""
    return summed(index, weights(index, queries).join(index.postings, "term"))


def topk(scored: DataFrame, k: int, order: str = "doc_id") -> DataFrame:
    """The best k of each query with their rank from 1: score, then the smaller id. Spark cuts to k before the shuffle."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc(order))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fill(ranked: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """ranked (query_id, doc_id, score, rank) with documents of score 0, smallest ids first, where a query has fewer
    than k. At most 2k ids can be needed, whatever the corpus."""
    lowest = docs.select("doc_id").orderBy("doc_id").limit(2 * k).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    zero = queries.select("query_id", F.explode(lowest.scalar()).alias("doc_id")).join(ranked, ["query_id", "doc_id"], "left_anti")
    both = ranked.select("query_id", "doc_id", "score").unionByName(zero.withColumn("score", F.lit(0.0)))
    return topk(both, k)


def rank_queries(index: SparseIndex, queries: DataFrame, k: int, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """BM25 top k of queries(query_id, text): query_id, doc_id, score, rank."""
    tokens = queries.select("query_id", tokenize_tr(F.coalesce("text", F.lit(""))).alias("tokens"))
    return topk(score(index, expand(tokens, synonyms or {})), k)


# ---------------------------------------------------------------- top k with bounds


@dataclass(frozen=True)
class Bounds:
    """What the postings of a term can add to a document of a span: limits(term, span, most, n) of an
    index, most for a weight of 1, whose documents are dealt to spans by a hash of their id."""

    limits: DataFrame
    spans: int


#: Pairs of queries and spans up to which pruned_topk tells postings apart by query, too.
PAIRS = 1_000_000


def spanned(index: SparseIndex, spans: int) -> DataFrame:
    """Postings with the span of their document, as the index has it where its spans are as many."""
    return index.postings if index.spans == spans else index.postings.withColumn("span", span_of(spans))


def bounds(index: SparseIndex, docs_per_span: int = DOCS) -> Bounds:
    """Bounds of an index, written to the shared folder: at most a row for each posting, and for a frequent term one for
    about docs_per_span documents."""
    spans = max(1, -(-index.docs.count() // docs_per_span))
    grouped = spanned(index, spans).groupBy("term", "span").agg(F.max(saturated(index)).alias("most"), F.count("*").alias("n"))
    return Bounds(materialize(grouped, "bounds"), spans)


def pruned_topk(index: SparseIndex, limits: Bounds, queries: DataFrame, k: int, probes: int = 2) -> tuple[DataFrame, DataFrame]:
    """(ranked, told): the rows of topk(score(index, queries), k), and for each query(query_id, tokens) the postings of
    its terms (held) and those that were read (read).

    A span's bound is the sum of what its terms can add at most. The spans of the highest bounds, `probes` of each
    query, are scored whole: the k-th score there is one that the result reaches, so that spans whose bound lies below
    it need not be read. What is left is scored like any other postings; ties stay in, since only lower bounds go. With
    more pairs of queries and spans than PAIRS, what one query needs of a span is scored for all: the rows are the same."""
    weighted = weights(index, queries)
    each = weighted.join(limits.limits, "term").withColumn("most", F.greatest(F.col("weight") * F.col("most"), F.lit(0.0)))
    spans = materialize(each.groupBy("query_id", "span").agg(F.sum("most").alias("most"), F.sum("n").alias("n")), "spans")
    posted = spanned(index, limits.spans)

    def scored(some: DataFrame, few: bool) -> DataFrame:
        """Scores of the documents of some(query_id, span), or, if these are not few, of their spans for all queries."""
        rows = weighted.join(posted.join(some.select("span").distinct(), "span", "left_semi"), "term")
        return summed(index, rows.join(F.broadcast(some), ["query_id", "span"], "left_semi") if few else rows)  # at most PAIRS rows

    first = spans.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("most"), "span"))).filter(F.col("r") <= probes)
    first = materialize(first.select("query_id", "span"), "first")
    reached = topk(scored(first, first.count() <= PAIRS), k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    # Scores are rounded to 6 places, and sums of doubles hang on their order.
    left = materialize(spans.join(reached, "query_id", "left").filter(F.col("reached").isNull() | (F.col("most") >= F.col("reached") - 2e-6)).select("query_id", "span", "n"), "left")
    few = left.count() <= PAIRS
    read = left if few else spans.join(left.select("span").distinct(), "span", "left_semi")
    told = spans.groupBy("query_id").agg(F.sum("n").alias("held")).join(read.groupBy("query_id").agg(F.sum("n").alias("read")), "query_id", "left").na.fill(0)
    return topk(scored(left.select("query_id", "span"), few), k), told
