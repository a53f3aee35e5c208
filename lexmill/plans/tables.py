"""Driver tables, and SQL snippets that the oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.functions.text import FOLD, STOP_WORDS, UPPER
from lexmill.storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; those of documents and pages over all cores, however few row groups they have."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found


def lower_sql(x: str) -> str:
    return f"replace(lower(translate({x}, '{UPPER[0]}', '{UPPER[1]}')), chr(775), '')"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(translate({lower_sql(x)}, '{FOLD[0]}', '{FOLD[1]}'), '\\s+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(regexp_extract_all({norm_sql(x)}, '[a-z0-9]+'), lambda x: length(x) > 1 and x not in ({stops}))"


def words_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '[^\\s]+')"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def bm25_sql(docs: str, queries: str, k: int) -> str:
    """CTEs up to ranked(query_id, doc_id, score, rank) of docs(doc_id, text) and queries(query_id, text)."""
    return f"""
tok as materialized (select doc_id, {tokens_sql("coalesce(text, '')")} t from {docs}),
stat as (select count(*) n, avg(len(t)) avgdl from tok),
post as materialized (select doc_id, dl, term, count(*) tf from (select doc_id, len(t) dl, unnest(t) term from tok) group by all),
dfs as (select term, count(*) df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) raw from post, stat group by term, n),
terms as materialized (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from dfs) else raw end idf from dfs),
qt as (select query_id, term, count(*) qtf from (select query_id, unnest({tokens_sql("coalesce(text, '')")}) term from {queries}) group by all),
scored as materialized (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score
  from qt join terms using (term) join post using (term), stat group by all),
ranked as materialized (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from scored) where rank <= {k})"""


def dense_sql(queries: str, k: int, extra: str = "") -> str:
    """CTEs up to near(query_id, doc_id, score, rank) of queries(query_id, vector) over all embeddings."""
    return f"""
sims as (select query_id, vec_id doc_id, round(list_dot_product(vector::double[], embedding::double[]), 6) score from {queries}, embeddings {extra}),
near as materialized (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from sims) where rank <= {k})"""
