"""All steps of a turn, for many questions at once."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators import answers, hybrid, questions, sparse
from lexmill.schema import SearchParams

#: Results that identity questions may draw on; their answers are read off a line, not generated.
IDENTITY_K = 10


def prepare(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """asked(query_id, conv_id, turn, question, answer) with text, named, search_text and k. Questions that name staff
    are no follow-ups; they and identity questions draw on more results. answer is what was said to earlier turns."""
    units = chunks.select("unit")
    named = questions.names_staff(asked.withColumn("text", F.col("question")), questions.staff_names(chunks))
    rewritten = questions.rewrite(named, units)
    search = F.when(F.col("named"), F.col("text")).otherwise(F.col("search_question"))
    out = rewritten.withColumn("search_text", search)
    k = F.when(F.col("named") | F.coalesce(questions.asks_identity(F.col("search_text")), F.lit(False)), IDENTITY_K)
    return out.withColumn("k", k).drop("search_question")


def respond(
    prepared: DataFrame,
    chunks: DataFrame,
    index: sparse.SparseIndex,
    vectors: DataFrame,
    today: datetime.date,
    generator: answers.TextGenerator = answers.echo,
    redirects: Column | None = None,
    p: SearchParams = SearchParams(),
    texts: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(routed, gate) of prepared rows with a column vector, the encoded search text: search, structured answers, gate,
    generator."""
    asked = prepared.select("query_id", F.col("search_text").alias("text"), "vector", F.coalesce("k", F.lit(p.k)).alias("k"))
    found, gate = hybrid.search(chunks, index, vectors, asked, p)
    results = found.select("query_id", "rank", F.col("doc_id").alias("pos")).join(chunks.select("pos", "title", "unit", "text", "url", "published_at"), "pos").drop("pos")
    routed = answers.route(prepared.select("query_id", "text", "search_text", "named"), results, gate, today, generator, redirects, p.k, texts)
    return routed, gate
