"""Exact dense top k that leaves out the vectors which cannot reach it.

Vectors lie in regions: those nearest to one of some centres, in a ring of distances around it. The triangle inequality
bounds what a query can score within a region. The regions of the highest bounds are scored first; the k-th score there
is one that the result reaches, so that regions whose bound lies below it are not even read: a region is a partition of
the table. Centres and rings are fitted on a bounded sample and only decide how much is left out, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.dense import BLOCK, HELD, best, matrix_of
from lexmill.operators.sparse import topk
from lexmill.storage import discard, fresh_path, materialize


@dataclass(frozen=True)
class Params:
    """At most `centres` centres of `rings` rings each, which bounds the number of regions; centres are fitted on at
    most `sample` vectors, those least by a hash of their id, and stand for at least `least` of them each."""

    centres: int = 256
    rings: int = 8
    sample: int = 10_000
    least: int = 64
    rounds: int = 10


@dataclass(frozen=True)
class Facts:
    """Centres, and of each region its number of vectors, least and largest distance from the centre, and largest
    length: arrays by region, which is centre * rings + ring."""

    centres: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    length: np.ndarray


@dataclass(frozen=True)
class Regions:
    """vectors(doc_id, vector, region) and what is known of the regions, which travels to every task."""

    vectors: DataFrame
    facts: Facts


def build(vectors: DataFrame, params: Params = Params()) -> Regions:
    """Regions of vectors(doc_id, vector), written to the shared folder. Null vectors and ids, and vectors that hold
    NaN, take no part; vectors of different lengths raise an error."""
    spark = vectors.sparkSession
    known = _whole(vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector")), "doc_id")
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample).select("vector").toArrow()["vector"].combine_chunks()
    centres, edges = _fit(matrix_of(drawn) if len(drawn) else np.zeros((0, 0)), params)
    placed = materialize(known.mapInArrow(_place(centres, edges), "doc_id long, vector array<double>, region int, far double, length double"), "placed")
    found = placed.groupBy("region").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"), F.max("length").alias("length")).collect()
    facts = np.zeros((4, len(centres) * params.rings))
    for r in found:  # at most a row for each region
        facts[:, r.region] = r.n, r.low, r.high, r.length
    path = fresh_path(spark, "regions")
    placed.select("doc_id", "vector", "region").repartitionByRange("region", F.xxhash64("doc_id")).write.partitionBy("region").parquet(path)
    discard(placed)
    kept = spark.read.schema("doc_id long, vector array<double>, region int").parquet(path)
    return Regions(kept, Facts(centres, facts[0].astype(np.int64), *facts[1:]))


def rank_vectors(regions: Regions, queries: DataFrame, k: int, skip_self: bool = False, probes: int = 2) -> tuple[DataFrame, DataFrame]:
    """(ranked, told): the rows of dense.rank_vectors over the vectors of the regions, and for each query(query_id,
    vector) the number of vectors (held) and of those it was compared with (read). `probes` regions of each query are
    scored first, or as many as hold k vectors. Queries that are null or hold NaN have no rows."""
    spark = queries.sparkSession
    given = _whole(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")), "query_id")
    if not regions.facts.n.any():
        return topk(spark.createDataFrame([], "query_id long, doc_id long, score double"), k), given.select("query_id", F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("read"))
    asked = materialize(given.mapInArrow(_probe(regions.facts, k + skip_self, probes), "query_id long, vector array<double>, regions array<int>"), "asked")
    first = materialize(topk(_scored(regions, asked, k, skip_self), k), "first")
    reached = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    left = asked.join(reached, "query_id", "left").select("query_id", "vector", "regions", "reached")
    more = materialize(left.mapInArrow(_reach(regions.facts), "query_id long, vector array<double>, regions array<int>, read long"), "more")
    both = first.select("query_id", "doc_id", "score").unionByName(_scored(regions, more, k, skip_self))
    return topk(both, k), more.select("query_id", F.lit(int(regions.facts.n.sum())).alias("held"), "read")


def _whole(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: F.isnan(x)))


def _scored(regions: Regions, asked: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """(query_id, doc_id, score): the best k of each block of vectors for asked(query_id, vector, regions)."""
    pairs = asked.select("query_id", "vector", F.explode("regions").alias("region"))
    path = fresh_path(asked.sparkSession, "queries")
    pairs.repartitionByRange("region", "query_id").write.partitionBy("region").parquet(path)
    read = [r.region for r in pairs.select("region").distinct().collect()]  # at most all regions
    some = regions.vectors.filter(F.col("region").isin(read) if read else F.lit(False))
    return some.select("region", "doc_id", "vector").mapInArrow(_scan(path, k, skip_self), "query_id long, doc_id long, score double")


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector, its nearest centre and how far it is."""
    near = ((centres**2).sum(1) - 2 * vectors @ centres.T).argmin(1)
    return near, np.linalg.norm(vectors - centres[near], axis=1)


def _fit(sample: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Centres by rounds of means, and the distances at which the rings of each begin."""
    finite = sample[np.isfinite(sample).all(axis=1)]
    if not len(finite):
        return np.zeros((1, sample.shape[1])), np.zeros((1, p.rings - 1))
    n = max(1, min(p.centres, len(finite) // p.least))
    centres = finite[np.random.default_rng(0).choice(len(finite), n, replace=False)]
    for _ in range(p.rounds):
        near, _ = _nearest(finite, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, finite)
        held = np.bincount(near, minlength=n)[:, None]
        centres = np.where(held > 0, sums / np.maximum(held, 1), centres)
    near, far = _nearest(finite, centres)
    parts = np.arange(1, p.rings) / p.rings
    return centres, np.stack([np.quantile(far[near == c], parts) if (near == c).any() else np.zeros(p.rings - 1) for c in range(n)])


def _place(centres: np.ndarray, edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, BLOCK) for a in range(0, whole.num_rows, BLOCK)):
                vectors = matrix_of(batch.column(1))
                near, far = _nearest(vectors, centres)
                ring = (far[:, None] > edges[near]).sum(1)
                region = near * (edges.shape[1] + 1) + ring
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(region, pa.int32()), pa.array(far), pa.array(np.linalg.norm(vectors, axis=1))], names=["doc_id", "vector", "region", "far", "length"])

    return run


def _bounds(g: Facts, queries: np.ndarray) -> np.ndarray:
    """What each query can score in each region at most: its product with the centre and the ring's reach around it, or
    what the least distance between query and ring leaves, whichever is less; with room for rounding."""
    rings = len(g.n) // len(g.centres)
    own = np.linalg.norm(queries, axis=1)[:, None]
    products = queries @ g.centres.T
    far = np.repeat(np.sqrt(np.maximum(own**2 + (g.centres**2).sum(1) - 2 * products, 0)), rings, axis=1)
    apart = np.maximum(np.maximum(g.low - far, far - g.high), 0)
    most = np.minimum(np.repeat(products, rings, axis=1) + own * g.high, (own**2 + g.length**2 - apart**2) / 2)
    # Scores are rounded to 6 places; a bound that is no number leaves nothing out.
    return np.where(np.isnan(most), np.inf, most + 2e-6 + 1e-7 * (own + g.length) ** 2)


def _listed(mask: np.ndarray) -> pa.Array:
    """The places of each row of a mask."""
    at = np.concatenate([[0], np.cumsum(mask.sum(1))])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.nonzero(mask)[1], pa.int32()))


def _probe(g: Facts, enough: int, probes: int):
    """The regions that a query is scored in first."""
    def run(batches):
        for whole in batches:
            for batch in (whole.slice(a, BLOCK) for a in range(0, whole.num_rows, BLOCK)):
                order = np.argsort(-np.where(g.n > 0, _bounds(g, matrix_of(batch.column(1))), -np.inf), axis=1, kind="stable")
                n = g.n[order]
                before = np.cumsum(n, axis=1) - n
                mask = np.zeros(order.shape, dtype=bool)
                np.put_along_axis(mask, order, (n > 0) & ((np.arange(order.shape[1]) < probes) | (before < enough)), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _listed(mask)], names=["query_id", "vector", "regions"])

    return run


def _reach(g: Facts):
    """The other regions that can hold a score of at least the one that was reached."""
    def run(batches):
        for whole in batches:
            for batch in (whole.slice(a, BLOCK) for a in range(0, whole.num_rows, BLOCK)):
                done = batch.column(2)
                mask = np.zeros((batch.num_rows, len(g.n)), dtype=bool)
                mask[np.repeat(np.arange(batch.num_rows), done.value_lengths().to_numpy()), np.asarray(done.flatten())] = True
                reached = batch.column(3).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                more = ~mask & (g.n > 0) & (_bounds(g, matrix_of(batch.column(1))) >= reached[:, None])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _listed(more), pa.array((mask | more) @ g.n)], names=["query_id", "vector", "regions", "read"])

    return run


def _scan(path: str, k: int, skip_self: bool):
    def run(batches):
        region, ids, vectors, held = None, [], [], 0

        def flush():
            yield from best(f"{path}/region={region}", np.concatenate(ids), np.concatenate(vectors), k, skip_self)

        for batch in batches:
            marks = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1), len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if ids and (marks[a] != region or held >= HELD):
                    yield from flush()
                    ids, vectors, held = [], [], 0
                region = marks[a]
                ids.append(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False))
                vectors.append(matrix_of(batch.column(2).slice(a, b - a)))
                held += vectors[-1].size
        if ids:
            yield from flush()

    return run
