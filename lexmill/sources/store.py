"""A store of page records that grows by what changes.

Rows lie in buckets by a hash of their key. A merge writes the new and changed rows of a batch as one more part of the
buckets they fall in, reads the keys and hashes of those buckets alone, and ends with one rename, that of a version file
which names the parts of every bucket. Readers hold the version they opened; a failure before the rename leaves the
store as it was. A bucket of many parts is written anew (compact), and files that the last versions do not name are
removed (vacuum). A batch has a name: merged again under it, it changes nothing.

    s = store.open_store(spark, "pages", buckets=256)
    s.merge(records, batch="2026-01-10")   # {"new": 3, "updated": 1, "unchanged": 9, "rejected": 0}
    s.read()                               # a row for each key
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexmill.schema import PAGES
from lexmill.storage import commit, discard, materialize, remove, versions

STATUSES = ("new", "updated", "unchanged", "rejected")


@dataclass(frozen=True)
class Version:
    """What one version of a store holds. parts: for each bucket, its parts from the oldest to the newest."""

    number: int = -1
    buckets: int = 256
    parts: dict[int, list[str]] = field(default_factory=dict)
    batches: tuple[str, ...] = ()
    rows: int = 0


@dataclass(frozen=True)
class PageStore:
    spark: SparkSession
    path: str
    schema: StructType = PAGES
    key: str = "url"
    content: str = "content_hash"
    buckets: int = 256
    most_parts: int = 8  # of a bucket, before it is written anew
    remembered: int = 100  # names of batches that a version carries

    # ------------------------------------------------------------ reading

    def version(self, number: int | None = None) -> Version:
        """The newest version, or that of a number."""
        found = versions(self.spark, self.path)
        if not found:
            return Version(buckets=self.buckets)
        told = json.loads(found[max(found) if number is None else number])
        return Version(told["number"], told["buckets"], {int(k): v for k, v in told["parts"].items()}, tuple(told["batches"]), told["rows"])

    def read(self, version: Version | None = None, columns: tuple[str, ...] | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A row for each key: the newest. Only the files of the version, and of the buckets if given, are read."""
        v = version or self.version()
        names = list(columns or self.schema.fieldNames())
        paths = [f"{self.path}/data/{part}/bucket={b}" for b, parts in sorted(v.parts.items()) if buckets is None or b in buckets for part in parts]
        if not paths:
            return self.spark.createDataFrame([], StructType([self.schema[n] for n in names]))
        # Bucket and age of a row stand in its file's path.
        stored = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)
        place = F.col("_metadata.file_path")
        told = stored.select(*names, F.regexp_extract(place, r"/data/([^/]+)/bucket=", 1).alias("__part"), F.regexp_extract(place, r"/bucket=(\d+)/", 1).cast("int").alias("__bucket"))
        single = {b for b, parts in v.parts.items() if len(parts) == 1}
        if all(b in single for b in v.parts if buckets is None or b in buckets):
            return told.select(*names)
        # Parts are named by numbers of fixed width: the greatest is the newest. Buckets of one part need no grouping.
        several = sorted(set(v.parts) - single)
        row = F.struct(*names).alias("__row")
        newest = told.filter(F.col("__bucket").isin(several)).groupBy("__bucket", self.key).agg(F.max_by(row, "__part").alias("__row")).select("__row.*")
        return told.filter(~F.col("__bucket").isin(several)).select(*names).unionByName(newest)

    # ------------------------------------------------------------ writing

    def bucket(self, v: Version):
        return F.pmod(F.xxhash64(self.key), F.lit(v.buckets)).cast("int")

    def merge(self, batch_rows: DataFrame, batch: str | None = None, order: str | None = None) -> dict[str, int]:
        """Merges a batch and counts its keys by status: new, updated, unchanged (the stored row stays, its fetch time
        included) and, rows without a key, rejected. Of rows with one key the last by `order` wins, or any where none
        is named. A batch whose name the store remembers is left out: all counts are 0."""
        v = self.version()
        if batch is not None and batch in v.batches:
            return dict.fromkeys(STATUSES, 0)
        names = self.schema.fieldNames()
        given = batch_rows.select(*names, *([order] if order and order not in names else []))
        by = F.struct(F.col(order), F.col(self.content)) if order else F.col(self.content)
        one = given.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*names), by).alias("r")).select("r.*").withColumn("__bucket", self.bucket(v))
        fresh = materialize(one, "batch")
        touched = {r[0] for r in fresh.select("__bucket").distinct().collect()}  # at most as many as buckets
        old = self.read(v, (self.key, self.content), touched).select(F.col(self.key).alias("__key"), F.col(self.content).alias("__old"), F.lit(True).alias("__had"))
        joined = fresh.join(old, fresh[self.key] == F.col("__key"), "left")
        status = F.when(F.col("__had").isNull(), "new").when(F.col("__old").eqNullSafe(F.col(self.content)), "unchanged").otherwise("updated")
        seen = Observation()  # counted while the rows are written, not by a job of their own
        statuses = joined.withColumn("__status", status).drop("__key", "__old", "__had")
        told = materialize(statuses.observe(seen, *[F.count_if(F.col("__status") == x).alias(x) for x in STATUSES]), "statuses")
        counts = dict.fromkeys(STATUSES, 0) | seen.get
        counts["rejected"] = given.agg(F.count_if(F.col(self.key).isNull())).first()[0]
        part, parts = self._write(told.filter("__status <> 'unchanged'").drop("__status"), v)
        self._commit(v, {b: [*v.parts.get(b, []), part] for b in parts}, batch, counts["new"])
        discard(fresh, told)
        return counts

    def compact(self, most: int | None = None) -> int:
        """Writes buckets of more than `most` parts (most_parts by default) anew, one part each; how many."""
        v = self.version()
        wide = {b for b, parts in v.parts.items() if len(parts) > (self.most_parts if most is None else most)}
        if wide:
            part, _ = self._write(self.read(v, buckets=wide).withColumn("__bucket", self.bucket(v)), v)
            self._commit(v, {b: [part] for b in wide}, None, 0)
        return len(wide)

    def vacuum(self, keep: int = 2) -> int:
        """Removes version files but the last `keep` and the parts of buckets that these do not name; how many parts."""
        found = versions(self.spark, self.path)
        last = sorted(found)[-keep:]
        named = lambda numbers: {(p, b) for n in numbers for b, parts in json.loads(found[n])["parts"].items() for p in parts}
        gone = named(set(found) - set(last)) - named(last)
        for n in set(found) - set(last):
            remove(self.spark, f"{self.path}/versions/{n:09d}.json")
        for part, b in gone:
            remove(self.spark, f"{self.path}/data/{part}/bucket={b}")
        return len(gone)

    def _write(self, rows: DataFrame, v: Version) -> tuple[str, list[int]]:
        """Writes rows(..., __bucket) as one part; its name and the buckets it lies in. A bucket is one task's file."""
        part = f"{v.number + 1:09d}-{uuid.uuid4().hex}"
        where = f"{self.path}/data/{part}"
        rows.withColumnRenamed("__bucket", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(where)
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        listed = jvm.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(jvm)
        names = [s.getPath().getName() for s in listed]
        return part, [int(n[7:]) for n in names if n.startswith("bucket=")]

    def _commit(self, v: Version, parts: dict[int, list[str]], batch: str | None, more: int) -> None:
        batches = [*v.batches, *([batch] if batch is not None else [])][-self.remembered :]
        told = {"number": v.number + 1, "buckets": v.buckets, "parts": v.parts | parts, "batches": batches, "rows": v.rows + more}
        commit(self.spark, self.path, v.number + 1, json.dumps(told))


def open_store(spark: SparkSession, path: str, **params) -> PageStore:
    """The store in a folder, which need not exist. A store keeps the number of buckets it began with."""
    return PageStore(spark, path.rstrip("/"), **params)


def upsert_all(store: PageStore, records: list[DataFrame], batch: str | None = None) -> dict[str, int]:
    """Merges several tables of records as one batch; of a key in several the last table wins."""
    both = None
    for i, df in enumerate(records):
        one = df.select(*store.schema.fieldNames(), F.lit(i).alias("__order"))
        both = one if both is None else both.unionByName(one)
    return store.merge(both, batch, "__order") if both is not None else dict.fromkeys(STATUSES, 0)
