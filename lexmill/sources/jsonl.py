"""Page records and lines as JSON, one a line."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.schema import PAGES
from lexmill.storage import replace


def read_strict(spark: SparkSession, path: str, schema: StructType = PAGES) -> DataFrame:
    """Blank lines go; a line that is no JSON fails the job that reads it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) with line numbers from 1 over all files in path order. Lines are numbered within the block that a
    task reads; the blocks' counts give the offsets."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    blocks = raw.groupBy("f", "b").agg(F.min("m").alias("m0"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("f", "b", "m0", before.alias("before"))
    return raw.join(offsets, ["f", "b"]).select((F.col("m") - F.col("m0") + F.col("before") + 1).alias("line"), "value")


def read_lenient(spark: SparkSession, path: str, schema: StructType = PAGES, key: str = "url") -> DataFrame:
    """Rows by key with pos: lines that do not parse or have no key go, the last line of a key wins and takes the place
    of the first."""
    rows = read_lines(spark, path).select("line", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).filter(F.col(f"r.{key}").isNotNull())
    kept = rows.groupBy(F.col(f"r.{key}").alias("k")).agg(F.min("line").alias("pos"), F.max_by("r", "line").alias("r"))
    return kept.select("r.*", "pos")


def write(df: DataFrame, path: str, order: str | None = None) -> int:
    """Replaces path by df as JSON lines and returns the number of rows. The new folder is written beside the old one
    and takes its place by renames, so that a failure leaves the old one whole; df may be read from path itself. With
    order, files and rows within them are in that order and the column is left out."""
    out = df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, order).sortWithinPartitions(order).drop(order) if order else df
    new = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    out.write.option("ignoreNullFields", "false").json(new)
    replace(df.sparkSession, new, path.rstrip("/"))
    return df.sparkSession.read.text(path).count()


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)
