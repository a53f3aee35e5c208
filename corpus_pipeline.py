"""A training-data pipeline over `documents`: each stage works on all that the stage before kept, written as Parquet
and read again. All stages but the last return the columns of their input, whatever their names and types."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import column, pack, table, unpack
from lexmill.llm.decontaminate import benchmark_hits
from lexmill.llm.mixing import mix
from lexmill.llm.near_dedup import first_documents
from lexmill.llm.sstable import read_token_ids, write_token_ids
from lexmill.llm.toxicity import score_toxicity
from lexmill.storage import discard, materialize

#: Some stages cannot be said in SQL.
ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and row, a struct of all columns: whatever else documents hold, of any name and type, meets no
    column of a stage."""
    return pack(docs, docs.columns, column("doc_id"), column("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    scored = score_toxicity(packed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=("row",))
    return unpack(scored.filter("predicted = 0"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id. Documents without an id stand last
    and, like those with a repeated one, are judged each by its own text."""
    return first_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    hits = benchmark_hits(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("row",))
    return unpack(hits.filter(F.size("hit_items") == 0), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each epoch. The document at a source's cut is taken whole, so
    that a source exceeds its budget by less than that document. Documents without words cost no budget and stay once.
    Each row is taken or left by itself, whether its id is null, repeated or neither."""
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    taken = mix(docs, keep=tuple(docs.columns)).select("row", copies.alias("copies")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted-string-table shards, read back: (doc_id, start, n_tokens, ids_crc32)."""
    return read_token_ids(write_token_ids(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sstable", write_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
