"""Intermediate tables that outlive executors, and inputs dealt out over all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset, a local folder of the application if
    the master is local, as in tests; on a cluster an error, since executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='lexmill-')}"
        _LOCAL[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


_LOCAL: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, no block lives on an executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more; other frames are passed over."""
    for df in frames:
        if path := getattr(df, "_lexmill_path", None):
            remove(df.sparkSession, path)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Puts the folder `new` in the place of `path` by renames: what stood there stays whole until `new` is written,
    and comes back if the second rename fails."""
    target, fs = _hadoop(spark, path)
    old = _hadoop(spark, f"{path}.old-{uuid.uuid4().hex}")[0]
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(_hadoop(spark, new)[0], target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot move {new} to {path}")
    if had:
        fs.delete(old, True)


def stamp(df: DataFrame) -> tuple:
    """(path, time, size) of each file that df is read from."""
    told = [(p, fs.getFileStatus(p)) for p, fs in (_hadoop(df.sparkSession, f) for f in sorted(df.inputFiles()))]
    return tuple((p.toString(), s.getModificationTime(), s.getLen()) for p, s in told)


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """The version files of a folder, by number: what each says."""
    p, fs = _hadoop(spark, f"{path}/versions")
    if not fs.exists(p):
        return {}
    found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p)]
    told = {int(n[:-5]): where for n, where in found if n.endswith(".json") and n[:-5].isdigit()}
    return {n: _read(spark, where) for n, where in told.items()}


def commit(spark: SparkSession, path: str, number: int, text: str) -> None:
    """Makes a version by one rename of its written file. A version of that number, which another writer made first, is
    an error; nothing is changed then."""
    target, fs = _hadoop(spark, f"{path}/versions/{number:09d}.json")
    new = _hadoop(spark, f"{path}/versions/.{uuid.uuid4().hex}")[0]
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(new, target):
        fs.delete(new, False)
        raise FileExistsError(f"version {number} of {path} exists: another writer was first")


def _read(spark: SparkSession, path: str) -> str:
    p, fs = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is read from fewer files than there are cores and its row groups keep less than half
    of them busy; any other df as it is. Only footers are read to tell."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    busy = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores) if 2 * busy < cores else df
