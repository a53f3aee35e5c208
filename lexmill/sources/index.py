"""The search index as immutable segments in a folder, and versions that name them.

A segment holds chunks with their vectors, postings, and how often each term and token stands in it. Saving or updating
an index writes one more segment and ends with one rename, that of a version file which names the segments; readers hold
the version they opened, and a failure before the rename leaves it as it was.

An update replaces the chunks of some pages: its segment also holds what is gone, the positions of these pages' chunks
in older segments, and takes the terms of the gone chunks from its counts, so that counts of segments add up to those
of the chunks that are left. Nothing of the other pages is tokenised or written again, and scores are those of an index
built anew. `compact` writes what is left as one segment, without tokenising.
"""

from __future__ import annotations

import datetime
import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import sparse
from lexmill.storage import commit, materialize, remove, versions


def position(chunk_id: str = "chunk_id") -> Column:
    """The number that the 16 hex digits of a chunk id spell, as a signed long in the same order."""
    half = lambda a: F.conv(F.substring(chunk_id, a, 8), 16, 10).cast("long")
    return (half(1) - (1 << 31)) * (1 << 32) + half(9)


def with_positions(chunks: DataFrame) -> DataFrame:
    """chunks with pos, the number of their ids: unique, the same in every build and update, and of the ids' order, so
    that ties fall alike."""
    return chunks.withColumn("pos", position())


def save(chunks: DataFrame, path: str, model: str, source: str, now: datetime.datetime) -> None:
    """Writes the index of chunks(pos, title, text, ..., embedding), which may be read from the same folder."""
    spark = chunks.sparkSession
    part = _part(_newest(spark, path))
    _write(chunks, f"{path}/data/{part}", None)
    _commit(spark, path, [part], model, source, now)


def update(spark: SparkSession, path: str, chunks: DataFrame, pages: DataFrame, source: str, now: datetime.datetime) -> None:
    """Puts chunks(pos, url, ...) in the place of all chunks of pages(url): pages without new chunks are gone."""
    told = _newest(spark, path)
    if told is None:
        raise FileNotFoundError(_missing(path))
    old = _live(spark, path, told["segments"], "chunks", "pos").join(pages.select("url").distinct(), "url", "left_semi")
    part = _part(told)
    _write(chunks, f"{path}/data/{part}", (path, told["segments"], materialize(old.select("pos"), "gone")))
    _commit(spark, path, [*told["segments"], part], told["model"], source, now)


def compact(spark: SparkSession, path: str, now: datetime.datetime) -> None:
    """Writes the index as one segment: its chunks, postings and counts as they are."""
    told = _newest(spark, path)
    part = _part(told)
    where, segments = f"{path}/data/{part}", told["segments"]
    _live(spark, path, segments, "chunks", "pos").write.parquet(f"{where}/chunks")
    sparse.ordered(_live(spark, path, segments, "postings", "doc_id")).write.parquet(f"{where}/postings")
    _terms(spark, path, segments).write.parquet(f"{where}/terms")
    _sizes(spark, path, segments).write.parquet(f"{where}/sizes")
    _commit(spark, path, [part], told["model"], told["source"], now)


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, sparse.SparseIndex, DataFrame]:
    """(chunks, sparse index, vectors) of the newest version, or of a number. A folder without an index raises
    FileNotFoundError with what to do."""
    told = _newest(spark, path, version)
    if told is None:
        raise FileNotFoundError(_missing(path))
    segments = told["segments"]
    chunks = _live(spark, path, segments, "chunks", "pos")
    facts = _sizes(spark, path, segments).select("n", (F.col("tokens") / F.nullif("n", F.lit(0))).alias("mean"))
    index = sparse.of_counts(_live(spark, path, segments, "postings", "doc_id"), _terms(spark, path, segments), chunks.select(F.col("pos").alias("doc_id")), facts)
    vectors = chunks.select(F.col("pos").alias("doc_id"), F.col("embedding").alias("vector")) if "embedding" in chunks.columns else None
    return chunks.drop("embedding"), index, vectors


def meta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(model, dim, chunks, source, built_at), one row."""
    told = _newest(spark, path, version)
    if told is None:
        raise FileNotFoundError(_missing(path))
    chunks = _live(spark, path, told["segments"], "chunks", "pos")
    dim = F.max(F.size("embedding")) if "embedding" in chunks.columns else F.lit(0)
    counted = chunks.agg(F.count("*").alias("chunks"), dim.alias("dim"))
    return counted.select(F.lit(told["model"]).alias("model"), "dim", "chunks", F.lit(told["source"]).alias("source"), F.lit(told["built_at"]).alias("built_at"))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes version files but the last `keep`, and the segments that these do not name; how many segments."""
    found = {n: json.loads(text) for n, text in versions(spark, path).items()}
    last = sorted(found)[-keep:]
    gone = {s for n in found if n not in last for s in found[n]["segments"]} - {s for n in last for s in found[n]["segments"]}
    for n in set(found) - set(last):
        remove(spark, f"{path}/versions/{n:09d}.json")
    for s in gone:
        remove(spark, f"{path}/data/{s}")
    return len(gone)


# ---------------------------------------------------------------- segments


def _missing(path: str) -> str:
    return f"no index in {path}: build it with lexmill.sources.index.save"


def _newest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    found = versions(spark, path)
    return json.loads(found[max(found) if version is None else version]) if found else None


def _part(told: dict | None) -> str:
    return f"{told['number'] + 1 if told else 0:09d}-{uuid.uuid4().hex}"


def _commit(spark: SparkSession, path: str, segments: list[str], model: str, source: str, now: datetime.datetime) -> None:
    number = int(segments[-1].partition("-")[0])
    commit(spark, path, number, json.dumps({"number": number, "segments": segments, "model": model, "source": source, "built_at": now.isoformat(timespec="seconds")}))


def _write(chunks: DataFrame, where: str, replaced: tuple[str, list[str], DataFrame] | None) -> None:
    """A segment of chunks; replaced: the folder and segments before it, and the positions(pos) in them that are gone."""
    spark = chunks.sparkSession
    chunks.write.parquet(f"{where}/chunks")
    written = spark.read.parquet(f"{where}/chunks")
    postings = sparse.postings(written, "pos", ("title", "text"))
    sparse.ordered(postings).write.parquet(f"{where}/postings")
    stored = spark.read.parquet(f"{where}/postings")
    terms, n, tokens = sparse.frequencies(stored), written.count(), stored.agg(F.sum("tf")).first()[0] or 0
    if replaced:
        path, segments, gone = replaced
        gone.write.parquet(f"{where}/gone")
        lost = materialize(_live(spark, path, segments, "postings", "doc_id").join(gone.select(F.col("pos").alias("doc_id")), "doc_id", "left_semi"), "lost")
        terms = terms.unionByName(sparse.frequencies(lost).withColumn("df", -F.col("df"))).groupBy("term").agg(F.sum("df").alias("df"))
        n, tokens = n - gone.count(), tokens - (lost.agg(F.sum("tf")).first()[0] or 0)
    terms.write.parquet(f"{where}/terms")
    spark.createDataFrame([(n, tokens)], "n long, tokens long").write.parquet(f"{where}/sizes")


def _live(spark: SparkSession, path: str, segments: list[str], name: str, key: str) -> DataFrame:
    """The rows of a table of all segments, without those that a later segment calls gone."""
    tables = []
    for i, s in enumerate(segments):
        df = spark.read.parquet(f"{path}/data/{s}/{name}")
        later = [spark.read.parquet(f"{path}/data/{t}/gone").select(F.col("pos").alias(key)) for t in segments[i + 1 :]]
        tables.append(df.join(reduce(DataFrame.unionByName, later), key, "left_anti").select(*df.columns) if later else df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _terms(spark: SparkSession, path: str, segments: list[str]) -> DataFrame:
    every = reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/data/{s}/terms") for s in segments])
    return every.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0") if len(segments) > 1 else every


def _sizes(spark: SparkSession, path: str, segments: list[str]) -> DataFrame:
    every = reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/data/{s}/sizes") for s in segments])
    return every.agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
