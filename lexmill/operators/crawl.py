"""Breadth-first traversal of a link table, level by level, in the order of one queue.

A page's number is its place in the queue: an offer comes by its parent's number, then by its place on the parent, and
the first offer of a page counts. A level is numbered by a range sort and counts of its partitions, so that the order of
a first-in-first-out queue holds without any task that sees a level whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions.urls import Scope, identity, in_scope, is_pdf, is_person
from lexmill.storage import materialize

#: What a page offers, in the order in which it does: files embedded in it, lists it asks for at once, links.
FILE, LIST, LINK = 0, 1, 2


@dataclass(frozen=True)
class CrawlParams:
    depth: int = 2
    max_pages: int = 1000  # that a crawl fetches in all
    unit_marker: str = "/tr/Birim/"
    person_marker: str = "prsnl="
    units_only: bool = False  # admit unit pages only; PDFs and person pages are exempt
    without_units: bool = False  # admit no unit pages


def admissible(df: DataFrame, url: str, scope: Scope, p: CrawlParams) -> DataFrame:
    ok, unit = in_scope(F.col(url), scope), F.coalesce(F.col(url).contains(p.unit_marker), F.lit(False))
    if p.units_only:
        ok = ok & (unit | is_pdf(F.col(url)) | is_person(F.col(url), p.person_marker))
    if p.without_units:
        ok = ok & ~unit
    return df.filter(ok)


ORDER = ("from_seq", "kind", "place")


def next_level(offers: DataFrame, seen: DataFrame) -> DataFrame:
    """One row for each key of offers(key, url, from_seq, kind, place, ...) that seen lacks: the offer first in the
    queue, by from_seq, kind and place, then the least url. A page that most others offer is aggregated before it is
    shuffled."""
    rest = [c for c in offers.columns if c != "key"]
    by = F.struct(*ORDER, "url")
    first = offers.groupBy("key").agg(F.min_by(F.struct(*rest), by).alias("o")).select("key", *[F.col(f"o.{c}").alias(c) for c in rest])
    return first.join(seen.select("key"), "key", "left_anti")


def numbered(level: DataFrame, start: int, name: str = "level") -> DataFrame:
    """level, written to the shared folder, with seq: numbers from start in the order of the queue, ties by key."""
    spark = level.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = (*ORDER, "key")
    # Written once: the bounds of a range sort need not be the same when it is computed again.
    ranged = level.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(ranged.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")), name)
    sizes = placed.groupBy("__p").agg(F.count("*").alias("n"), F.min("__m").alias("__first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", (before - F.col("__first") + start).alias("__shift"))  # a row a partition
    out = placed.join(F.broadcast(offsets), "__p").withColumn("seq", F.col("__m") + F.col("__shift")).drop("__p", "__m", "__shift")
    return out


def traverse(edges: DataFrame, seeds: DataFrame, scope: Scope, p: CrawlParams = CrawlParams()) -> DataFrame:
    """(key, url, depth, from_key, seq) of pages reached from seeds(url[, place]) over edges(url, link_url, place)
    within the depth. A page is met once, at its least depth, by the offer first in the queue; seq numbers pages from 0
    in the order of that queue, seeds by place, then by key. Each level is one join with the edges, written to the
    shared folder; the number of levels is bounded by the depth, and only numbers of pages come to the driver."""
    linked = admissible(edges.select(identity(F.col("url")).alias("from_key"), "link_url", "place"), "link_url", scope, p)
    linked = linked.select("from_key", identity(F.col("link_url")).alias("key"), F.col("link_url").alias("url"), F.col("place").cast("long").alias("place"))
    linked = materialize(linked.groupBy("from_key", "key").agg(F.min_by("url", F.struct("place", "url")).alias("url"), F.min("place").alias("place")), "edges")
    place = F.col("place").cast("long") if "place" in seeds.columns else F.lit(0).cast("long")
    zero = F.lit(0).cast("long")
    first = admissible(seeds.select("url", place.alias("place")), "url", scope, p).select(identity(F.col("url")).alias("key"), "url", zero.alias("from_seq"), F.lit(LINK).alias("kind"), "place", F.lit(None).cast("string").alias("from_key"))
    seen, total = seeds.sparkSession.createDataFrame([], "key string, url string, depth int, from_key string, seq long"), 0
    for depth in range(p.depth + 1):
        level = numbered(next_level(first, seen), total).select("key", "url", F.lit(depth).alias("depth"), "from_key", "seq")
        found = level.count()
        if not found:
            break
        total += found
        seen = seen.unionByName(level)
        first = linked.join(level.select(F.col("key").alias("from_key"), F.col("seq").alias("from_seq")), "from_key")
        first = first.select("key", "url", "from_seq", F.lit(LINK).alias("kind"), "place", "from_key")
    return seen
