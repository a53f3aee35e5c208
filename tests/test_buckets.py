"""The index in buckets: scores, bounds and the best of each query without a shuffle of postings."""

import dataclasses
import os
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import sparse
from lexmill.plans import retrieval

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dealt(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(["wa", "wb", "wc", "wd", "we", "ﬁne"], k=rng.randint(0, 30)))) for i in range(700)]
    queries = spark.createDataFrame([(q, rng.choices(["wa", "wc", "we", "fine", "none"], k=4)) for q in range(6)], "query_id long, tokens array<string>")
    return sparse.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "doc_id", ("text",)), queries


def shuffles(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]


def test_scores_shuffle_no_posting(dealt):
    index, queries = dealt
    assert shuffles(sparse.score(index, queries)) == []
    (cut,) = shuffles(sparse.topk(sparse.score(index, queries), 3))  # the best of each bucket
    assert "query_id" in cut and "doc_id" not in cut
    docs = index.docs.withColumn("text", F.concat(F.lit("wa ﬁne "), F.col("doc_id").cast("string")))
    (texts,) = shuffles(sparse.postings(docs, "doc_id", ("text",), spans=6, buckets=3))  # plain and odd ones at once
    assert "hashpartitioning(span" in texts


def test_buckets_hold_all_postings(dealt, rows):
    index, queries = dealt
    plain = sparse.postings(index.docs.withColumn("text", F.lit("wa ﬁne wa")), "doc_id", ("text",))
    assert rows(plain) == rows(sparse.postings(index.docs.withColumn("text", F.lit("wa ﬁne wa")), "doc_id", ("text",), spans=6, buckets=3).drop("span"))
    loose = dataclasses.replace(index, postings=index.postings.drop("span"), spans=None)
    assert rows(sparse.score(index, queries)) == rows(sparse.score(loose, queries))


def test_pruned_search_of_many_pairs(dealt, rows, monkeypatch):
    index, queries = dealt
    want = rows(sparse.topk(sparse.score(index, queries), 3))
    for pairs in (1_000_000, 0):
        monkeypatch.setattr(sparse, "PAIRS", pairs)
        ranked, told = sparse.pruned_topk(index, sparse.bounds(index), queries, 3)
        assert rows(ranked) == want
        assert all(r.read <= r.held for r in told.collect())
        assert not any("doc_id" in line or "term" in line for line in shuffles(ranked))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["eval_hits", "context_pack"])
def test_texts_are_not_shuffled(spark, name):
    """Where documents are too large to be sent, results go to them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60k")
    try:
        assert not any("doc_id" in line for line in shuffles(retrieval.QUERIES[name](spark, SF)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
