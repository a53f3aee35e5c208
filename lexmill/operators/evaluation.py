"""Quality of retrieval and answers against labelled questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import lower_tr


def hits(results: DataFrame, gold: DataFrame, k: int = 4) -> DataFrame:
    """gold(query_id, expected, type) with hit: whether expected stands in a title or text of the top k. Case does not
    count. A query without results is no hit; a null expectation neither."""
    said = results.filter(F.col("rank") <= k).withColumn("said", lower_tr(F.concat_ws(" ", "title", "text")))
    found = said.join(gold.select("query_id", lower_tr(F.col("expected")).alias("want")), "query_id").filter(F.col("said").contains(F.col("want"))).select("query_id").distinct()
    return gold.join(found.withColumn("hit", F.lit(True)), "query_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def hit_rate(judged: DataFrame, by: str = "type") -> DataFrame:
    """(type, n, hits, rate) for each type and, with a null type, overall."""
    return judged.rollup(by).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("rate"))


def gate_errors(gate: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: questions, leaks (out of scope but let in) and false rejects, of truth(query_id, in_corpus)."""
    both = truth.join(gate.select("query_id", "in_scope"), "query_id", "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("in_scope") & ~F.col("in_corpus")).alias("leaks"), F.count_if(~F.col("in_scope") & F.col("in_corpus")).alias("false_rejects"))


def answer_quality(answered: DataFrame, gold: DataFrame, by: str | None = None) -> DataFrame:
    """n, accuracy, direct answers and mean seconds of answered(query_id, route, answer, seconds), overall or for each
    value of a column such as the model."""
    right = F.coalesce(lower_tr(F.col("answer")).contains(lower_tr(F.col("expected"))), F.lit(False))
    both = gold.join(answered, "query_id", "left").withColumn("right", right)
    grouped = both.groupBy(by) if by else both.groupBy()
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg(F.col("right").cast("double")), 6).alias("accuracy"), F.count_if(F.col("route") == "direct").alias("direct"), F.round(F.avg("seconds"), 6).alias("seconds"))
