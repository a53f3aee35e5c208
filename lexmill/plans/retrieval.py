"""Queries of tokens, sparse and dense search, fusion, gate and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import by_form, normalize_tr, tokenize_tr, tokens_of, word_count
from lexmill.operators import answers, dense, evaluation, hybrid, regions, sparse
from lexmill.plans.tables import bm25_sql, dense_sql, lower_sql, norm_sql, strip_sql, table, tokens_sql, words_sql
from lexmill.schema import SearchParams
from lexmill.storage import materialize, stamp

# A synonym table for the driver's invented words.
SYNONYMS = {"the": ["and", "of"], "in": ["on"], "nicht": ["auch", "sich"], "est": ["la"]}
PARAMS = SearchParams(gate_bm25=20.0, gate_cosine=0.3, gate_cosine_alone=0.42, gate_bm25_alone=60.0)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries; the embedding of the same number is their vector."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return items.join(vectors, "query_id", "left")


QUESTIONS_SQL = "questions as (select item_id query_id, text, embedding vector from benchmark left join embeddings on vec_id = item_id)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


_INDEXES: dict[tuple, sparse.SparseIndex] = {}


def _index(spark: SparkSession, sf_dir: str) -> sparse.SparseIndex:
    """The index of a folder's documents, built once an application in the shared folder: queries share it, as users would."""
    # The files and their times are part of the key: another table under the same name is another index.
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    if key not in _INDEXES:
        _INDEXES[key] = sparse.build(table(spark, sf_dir, "documents"), "doc_id", ("text",))
    return _INDEXES[key]


def _bm25(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    return sparse.rank_queries(_index(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k)


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, distinct tokens, words and the normalised length of every document."""

    def told(docs: DataFrame, odd: bool) -> DataFrame:
        normal = docs.select("doc_id", "text", normalize_tr(F.col("text"), odd).alias("norm"))
        return normal.select("doc_id", F.length("norm").cast("long").alias("n_norm"), tokens_of(F.col("norm")).alias("t"), word_count(F.col("text")).alias("n_words"))

    tokens = by_form(table(spark, sf_dir, "documents"), "text", told)
    return tokens.select("doc_id", "n_norm", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), "n_words")


TOKEN_STATS_SQL = f"""
with t as (select doc_id, length({norm_sql("text")}) n_norm, {tokens_sql("text")} t, len({words_sql("text")}) n_words from documents)
select doc_id, n_norm, len(t) n_tokens, len(list_distinct(t)) n_distinct, n_words from t"""


def token_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document whose id is even behind compatibility characters, of the others as they are."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" ﬁne ＡＢＣ x² ½ İ\u0307stanbul\u00a0Ⅳ"))).otherwise(F.col("text"))
    forms = by_form(docs.select("doc_id", text.alias("text")), "text", lambda df, odd: df.select("doc_id", normalize_tr(F.col("text"), odd).alias("norm")))
    return forms.select("doc_id", F.md5("norm").alias("norm_md5"), F.size(tokens_of(F.col("norm"))).cast("long").alias("n_tokens"))


TOKEN_FORMS_SQL = f"""
with t as (select doc_id, text || case when doc_id % 2 = 0 then ' fine ABC x2 1⁄2 İstanbul IV' else '' end x from documents)
select doc_id, md5({norm_sql("x")}) norm_md5, len({tokens_sql("x")}) n_tokens from t"""


def bm25_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary with document and inverse document frequencies."""
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


BM25_TERMS_SQL = f"with {bm25_sql('documents', '(select item_id query_id, text from benchmark)', 4)} select term, df, round(idf, 6) idf from terms"


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best documents for each benchmark passage."""
    return _bm25(spark, sf_dir)


BM25_TOPK_SQL = f"with {bm25_sql('documents', '(select item_id query_id, text from benchmark)', 4)} select query_id, doc_id, score, rank from ranked"


def bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by bounds: only spans of documents that can hold one of the four are read."""
    words = _index(spark, sf_dir)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokenize_tr(F.coalesce("text", F.lit(""))).alias("tokens"))
    return sparse.pruned_topk(words, sparse.bounds(words), queries, 4)[0]


BM25_PRUNED_SQL = BM25_TOPK_SQL


def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token stands in a passage after synonyms are added."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokenize_tr(F.col("text")).alias("tokens"))
    return sparse.expand(queries, SYNONYMS).select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n"))


_PAIRS = ", ".join(f"('{k}', '{v}')" for k, vs in SYNONYMS.items() for v in vs)
QUERY_EXPANSION_SQL = f"""
with q as (select item_id query_id, unnest({tokens_sql("text")}) term from benchmark),
s(word, other) as (values {_PAIRS})
select query_id, term, count(*) n from (select * from q union all select query_id, other from q join s on word = term) group by all"""


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest other vectors of every vector whose id is divisible by 50, among all."""
    vectors = _vectors(spark, sf_dir)
    queries = vectors.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return dense.rank_vectors(vectors, queries, 4, skip_self=True)


DENSE_TOPK_SQL = f"with {dense_sql('(select vec_id query_id, embedding vector from embeddings where vec_id % 50 = 0)', 4, 'where query_id <> vec_id')} select query_id, doc_id, score, rank from near"


def dense_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by regions: only those that can hold one of the four are read."""
    vectors = _vectors(spark, sf_dir)
    queries = vectors.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return regions.rank_vectors(regions.build(vectors), queries, 4, skip_self=True)[0]


DENSE_PRUNED_SQL = DENSE_TOPK_SQL


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings of every passage, fused."""
    near = dense.rank_vectors(_vectors(spark, sf_dir), _questions(spark, sf_dir), 30)
    fused = hybrid.fuse(_bm25(spark, sf_dir, 30), near)
    return fused.select("query_id", "doc_id", F.round("rrf", 9).alias("rrf"), "bm25_rank", "dense_rank", "place")


_FUSED = """fused as (select query_id, doc_id, coalesce(1.0::double / (60 + max(b)), 0) + coalesce(1.0::double / (60 + max(d)), 0) rrf,
    max(b) bm25_rank, max(d) dense_rank, coalesce(max(d), max(b) + 1000000) place
  from (select query_id, doc_id, rank b, null d from {bm25} union all select query_id, doc_id, null, rank from near) group by all)"""
RRF_FUSION_SQL = f"""
with {QUESTIONS_SQL}, {bm25_sql("documents", "questions", 30)}, {dense_sql("questions", 30, "where vector is not null")}, {_FUSED.format(bm25="ranked")}
select query_id, doc_id, round(rrf, 9) rrf, bm25_rank, dense_rank, place from fused"""


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of every passage; a document's source is its page, its first words its title, long ones count as
    job forms. Ranks, without texts."""
    title = F.array_join(F.slice(F.split("text", " ", -1), 1, 8), " ")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("url"), title.alias("title"), (F.col("n_chars") > 4000).alias("job_form"))
    results, _ = hybrid.search(chunks, _index(spark, sf_dir), _vectors(spark, sf_dir), _questions(spark, sf_dir), PARAMS, {})
    return results.select("query_id", "rank", "doc_id", "source", "rrf", "cosine")


_DUTY = "[" + ", ".join(f"'{w}'" for w in hybrid.DUTY_WORDS) + "]"
HYBRID_SEARCH_SQL = f"""
with {QUESTIONS_SQL}, {bm25_sql("documents", "questions", 30)}, {dense_sql("questions", 30, "where vector is not null")},
low as (select doc_id from documents order by doc_id limit 60),
filled as (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from
  (select query_id, doc_id, score from ranked union all
   select q.query_id, low.doc_id, 0.0 from questions q, low where not exists (select 1 from ranked r where r.query_id = q.query_id and r.doc_id = low.doc_id))),
cut as (select * from filled where rank <= 30),
{_FUSED.format(bm25="cut")},
qtok as (select query_id, {tokens_sql("text")} qt from questions),
about as (select doc_id, source, n_chars > 4000 job_form, {tokens_sql("array_to_string(string_split(text, ' ')[1:8], ' ')")} tt from documents),
joined as (select f.*, source, job_form and not list_has_any(qt, {_DUTY}) bad,
    case when len(qt) > 0 then 0.015::double * len(list_intersect(list_distinct(qt), tt)) / len(list_distinct(qt)) else 0 end bonus
  from fused f join qtok using (query_id) join about using (doc_id)),
final as (select *, round(case when bad then (rrf + bonus) * 0.35 else rrf + bonus end, 9) s,
    case when not bad and bm25_rank = 1 then 0 when not bad and dense_rank = 1 then 1 else 2 end front from joined),
nth as (select *, row_number() over (partition by query_id, source order by front, s desc, place, doc_id) nth from final),
top as (select *, row_number() over (partition by query_id order by front, s desc, place, doc_id) rank from nth where nth <= 2)
select t.query_id, t.rank, t.doc_id, source, s rrf, round(list_dot_product(q.vector::double[], e.embedding::double[]), 6) as "cosine"
from top t join questions q using (query_id) left join embeddings e on e.vec_id = t.doc_id where t.rank <= 4"""


def scope_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best scores of both methods and the verdict of the gate for every passage."""
    questions = _questions(spark, sf_dir)
    return hybrid.gate(questions, _bm25(spark, sf_dir, 1), dense.rank_vectors(_vectors(spark, sf_dir), questions, 1), PARAMS)


_GATE = f"""gate as (select q.query_id, coalesce(max(r.score), 0) bm25_max, coalesce(max(n.score), 0) cosine_max
  from questions q left join ranked r on r.query_id = q.query_id left join near n on n.query_id = q.query_id group by 1),
told as (select *, (bm25_max >= {PARAMS.gate_bm25} and cosine_max >= {PARAMS.gate_cosine}) or cosine_max >= {PARAMS.gate_cosine_alone} or bm25_max >= {PARAMS.gate_bm25_alone} in_scope from gate)"""
SCOPE_GATE_SQL = f"with {QUESTIONS_SQL}, {bm25_sql('documents', 'questions', 1)}, {dense_sql('questions', 1, 'where vector is not null')}, {_GATE} select * from told"


def gate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks and false rejects of the gate, if passages longer than 200 characters belonged to the corpus."""
    truth = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.length("text") > 200).alias("in_corpus"))
    return evaluation.gate_errors(scope_gate(spark, sf_dir), truth)


GATE_ERRORS_SQL = f"""with {QUESTIONS_SQL}, {bm25_sql("documents", "questions", 1)}, {dense_sql("questions", 1, "where vector is not null")}, {_GATE}
select count(*) n, count(*) filter (in_scope and length(text) <= 200) leaks, count(*) filter (not in_scope and length(text) > 200) false_rejects
from told join questions using (query_id)"""


def eval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the first eight words of a passage stand in one of its top four documents, by length of the passage."""
    # Results whose size is known go to the texts, not all texts to them.
    results = materialize(_bm25(spark, sf_dir), "results").join(table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), "text"), "doc_id")
    start = F.array_join(F.slice(F.split("text", " ", -1), 1, 8), " ")
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), start.alias("expected"), F.when(F.length("text") > 200, "long").otherwise("short").alias("type"))
    return evaluation.hit_rate(evaluation.hits(results, gold))


EVAL_HITS_SQL = f"""
with {bm25_sql("documents", "(select item_id query_id, text from benchmark)", 4)},
gold as (select item_id query_id, {lower_sql("array_to_string(string_split(text, ' ')[1:8], ' ')")} want, case when length(text) > 200 then 'long' else 'short' end as "type" from benchmark),
hit as (select g.query_id, g.type, coalesce(bool_or(contains({lower_sql("d.text")}, want)), false) hit
  from gold g left join ranked r using (query_id) left join documents d on d.doc_id = r.doc_id group by 1, 2)
select "type", count(*) n, count(*) filter (hit) hits, round(avg(hit::int), 6) rate from hit group by rollup ("type")"""


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top ten documents of every passage, packed into 1100 words."""
    results = materialize(_bm25(spark, sf_dir, 10), "results").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return answers.pack_context(results).select("query_id", "rank", "doc_id", F.col("words").cast("long").alias("words"), F.md5("text").alias("text_md5"))


CONTEXT_PACK_SQL = f"""
with {bm25_sql("documents", "(select item_id query_id, text from benchmark)", 10)},
sized as (select r.*, {strip_sql("coalesce(d.text, '')")} body, len({words_sql("coalesce(d.text, '')")}) w from ranked r join documents d using (doc_id)),
run as (select *, 1100 - coalesce(sum(w) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) rest from sized)
select query_id, rank, doc_id, (case when w <= rest then w else rest end)::bigint words,
  md5(case when w <= rest then body else array_to_string({words_sql("body")}[1:greatest(rest, 0)::int], ' ') || ' ...' end) text_md5
from run where (rest > 0 and (w <= rest or rest >= 40)) or (w = 0 and rest >= 0)"""

QUERIES = {f.__name__: f for f in (token_stats, token_forms, bm25_terms, bm25_topk, bm25_pruned, query_expansion, dense_topk, dense_pruned, rrf_fusion, hybrid_search, scope_gate, gate_errors, eval_hits, context_pack)}
SQL = {name: globals()[f"{name.upper()}_SQL"].strip() for name in QUERIES}
