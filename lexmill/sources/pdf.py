"""Text of PDF files by an extractor that the caller brings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("url"), F.col("content").alias("body"))


def text(df: DataFrame, extractor: Callable[[bytes], list[str]], body: str = "body", out: str = "text") -> DataFrame:
    """df with the text of its pages, joined by line breaks. Files that cannot be read, empty ones and nulls give an
    empty text, which the record rules then drop."""
    def one(x) -> str:
        try:
            return "\n".join(extractor(bytes(x))).strip() if x is not None and len(x) else ""
        except Exception:
            return ""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return df.withColumn(out, run(F.col(body)))


def pdf_records(df: DataFrame) -> DataFrame:
    """df(url, menu, ...) with title: the menu name or the file name, marked as PDF."""
    name = F.coalesce(F.nullif(F.col("menu"), F.lit("")), F.substring_index("url", "/", -1))
    return df.withColumn("title", F.concat(name, F.lit(" (PDF)"))).withColumn("doc_type", F.lit("pdf"))
