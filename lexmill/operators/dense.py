"""Exact dense top k: blocks of queries against blocks of vectors.

Queries lie in the shared folder as a table. A task holds a bounded block of its vectors, reads the queries block by
block and gives the best k of each query among its block of vectors; only those are shuffled. Neither the driver nor a
plan holds queries, and the vectors are read once, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.sparse import topk
from lexmill.storage import fresh_path

#: Queries, and numbers of vectors, held by a task at a time.
BLOCK, HELD = 1024, 16 << 20


def encode(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], out: str = "embedding") -> DataFrame:
    """df with unit vectors of a text column. encoder maps a list of texts to a matrix; null texts get null."""
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        given = s.notna().to_numpy()
        rows: list = [None] * len(s)
        if given.any():
            m = np.asarray(encoder(s[given].tolist()), dtype=np.float32)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            for i, v in zip(np.flatnonzero(given), m, strict=True):
                rows[i] = v
        return pd.Series(rows)

    return df.withColumn(out, run(F.col(text)))


def embedding_text(title: str = "title", unit: str = "unit", text: str = "text") -> F.Column:
    """What is encoded of a chunk: its unit, unless the title names it, its title and its text."""
    named = F.coalesce(F.col(unit), F.lit(""))
    with_unit = F.when((named == "") | F.col(title).contains(named), F.col(title)).otherwise(F.concat(named, F.lit(" — "), F.col(title)))
    return F.concat(F.lit("passage: "), with_unit, F.lit("\n"), F.col(text))


def query_text(text: str = "text") -> F.Column:
    return F.concat(F.lit("query: "), F.col(text))


def rank_vectors(vectors: DataFrame, queries: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k largest dot products of queries(query_id, vector) with
    vectors(doc_id, vector), rounded to 6 places, ties to the smaller id. Null vectors take no part; with skip_self, a
    row does not match the query of its own id. Vectors of another length than the query raise an error."""
    given = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).filter(F.col("vector").isNotNull() & F.col("query_id").isNotNull())
    path = fresh_path(queries.sparkSession, "queries")
    given.write.parquet(path)
    known = vectors.select("doc_id", "vector").filter(F.col("vector").isNotNull() & F.col("doc_id").isNotNull())
    return topk(known.mapInArrow(_scan(path, k, skip_self), "query_id long, doc_id long, score double"), k)


def query_blocks(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of each block of the queries that lie under a path."""
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path)
    for batch in ds.dataset(at, format="parquet", filesystem=fs).to_batches(columns=["query_id", "vector"], batch_size=BLOCK):
        if batch.num_rows:
            yield batch.column(0).to_numpy(), np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)


def best(path: str, ids: np.ndarray, vectors: np.ndarray, k: int, skip_self: bool) -> Iterator[pa.RecordBatch]:
    """(query_id, doc_id, score) of the best k of each query under a path among vectors."""
    for query_ids, matrix in query_blocks(path):
        for a in range(0, len(query_ids), max(1, min(BLOCK, HELD // len(ids)))):
            some = query_ids[a : a + max(1, min(BLOCK, HELD // len(ids)))]
            scores = np.round(matrix[a : a + len(some)] @ vectors.T, 6) + 0.0
            if skip_self:
                scores[some[:, None] == ids[None, :]] = -np.inf
            floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(some), -np.inf)
            rows, columns = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
            order = np.lexsort((ids[columns], -scores[rows, columns], rows))
            rows, columns = rows[order], columns[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)  # within a query, best first
            rows, columns = rows[place < k], columns[place < k]
            yield pa.RecordBatch.from_arrays([pa.array(some[rows]), pa.array(ids[columns]), pa.array(scores[rows, columns])], names=["query_id", "doc_id", "score"])


def matrix_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _scan(path: str, k: int, skip_self: bool):
    def run(batches):
        ids, vectors, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            vectors.append(matrix_of(batch.column(1)))
            held += vectors[-1].size
            if held >= HELD:
                yield from best(path, np.concatenate(ids), np.concatenate(vectors), k, skip_self)
                ids, vectors, held = [], [], 0
        if ids:
            yield from best(path, np.concatenate(ids), np.concatenate(vectors), k, skip_self)

    return run
