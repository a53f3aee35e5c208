"""What the operators of this subpackage share: Arrow row loops, word hashing, columns computed from texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.storage import spread

M64 = (1 << 64) - 1


# ---------------------------------------------------------------- tables and files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table over all cores, however few row groups it has."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


@contextmanager
def replacing(uri: str):
    """A stream to a file of the shared folder that appears whole, in the place of what an earlier attempt of the task
    left."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as out:
        yield out
    try:
        fs.delete_file(path)
    except FileNotFoundError:
        pass
    fs.move(tmp, path)


# ---------------------------------------------------------------- Arrow row loops


def short_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Sets the session's Arrow batches to at most so many rows: by default one holds 10,000, which for rows of 20 KB, a
    usual page, is 200 MB and several times that in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def map_rows(df: DataFrame, make: Callable[[], Callable[[Iterable[tuple]], Iterator[tuple]]], schema: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """mapInArrow over rows. make() is called once a task and gives a function from row tuples to row tuples;
    string columns arrive as UTF-8 bytes. Output batches are cut at about batch_bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    short_batches(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def rows(batches):
        for batch in batches:
            columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
            for i in range(batch.num_rows):
                yield tuple(c[i].as_py() for c in columns)

    def run(batches):
        held, weight = [], 0
        for row in make()(rows(batches)):
            held.append(row)
            weight += 64 + sum(len(x) * (1 if isinstance(x, (bytes, str)) else 8) for x in row if isinstance(x, (bytes, str, list, np.ndarray)))
            if weight >= batch_bytes or len(held) >= 4096:
                yield to_batch(held, target)
                held, weight = [], 0
        if held:
            yield to_batch(held, target)

    return df.mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# ---------------------------------------------------------------- words as 64-bit hashes


def splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    return splitmix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class Alphabet:
    """Which bytes belong to words; A-Z are folded to a-z."""

    def __init__(self, is_word: Callable[[int], bool]) -> None:
        self.word = np.array([is_word(b) for b in range(256)])
        fold = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])
        self.value = np.where(self.word, constants(17, 256)[fold], np.uint64(0))
        self.clean = bytes(fold[b] if self.word[b] else 32 for b in range(256))

    def words(self, text: bytes) -> list[bytes]:
        return text.translate(self.clean).split()


#: Words `[^\x20\x09-\x0D]+`.
SPACED = Alphabet(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after folding: ASCII letters, digits, and all bytes of other characters.
ALNUM = Alphabet(lambda b: b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)

RADIX, PIECE = 0x9E3779B97F4A7C15, 1 << 20
RADIX_INVERSE = pow(RADIX, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, r, dtype=np.uint64)))) for r in (RADIX, RADIX_INVERSE)]
    return _POWERS[0], _POWERS[1]


def word_hashes(text: bytes, alphabet: Alphabet, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each word, in order, from prefix sums over the bytes. With prefixes, rows: the words, then
    their first so many bytes. Long texts go in pieces cut between words."""
    out, at = [], 0
    while at < len(text):
        to = min(len(text), at + PIECE)
        while to < len(text) and alphabet.word[text[to]]:
            to += 1
        data = np.frombuffer(text, dtype=np.uint8, count=to - at, offset=at)
        word = alphabet.word[data]
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            power, inverse = _powers(len(data) + 1)
            sums = np.concatenate(([np.uint64(0)], np.cumsum(alphabet.value[data] * power[: len(data)])))
            rows = []
            for n in (0, *prefixes):
                to_byte = np.minimum(ends, starts + n) if n else ends
                rows.append(splitmix((sums[to_byte] - sums[starts]) * inverse[starts] + (to_byte - starts).astype(np.uint64) + np.uint64(n << 32)))
            out.append(np.stack(rows) if prefixes else rows[0])
        at = to
    if not out:
        return np.empty((1 + len(prefixes), 0) if prefixes else 0, dtype=np.uint64)
    return np.concatenate(out, axis=-1)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words; with fewer, but not none, one for the whole sequence."""
    if not len(words):
        return words
    k = min(n, len(words))
    factors, total = constants(23, k), np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += words[i : len(words) - k + 1 + i] * factors[i]
    return splitmix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def count_words(name: str, pattern: str = r"[^\x20\x09-\x0D]+"):
    """Words of a string column as a native expression; null counts 0."""
    return F.coalesce(F.regexp_count(column(name).cast("string"), F.lit(pattern)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- kept columns beside new ones


def column(name: str):
    """The column of just this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_names(keep: Iterable[str], added: Iterable[str]) -> list[str]:
    """Names under which kept columns stand beside added ones: their own, or `input_` before it where an added column
    has that name."""
    taken, out = {a.lower() for a in added}, []
    for name in keep:
        while name.lower() in taken:
            name = f"input_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def pack(df: DataFrame, keep: Iterable[str], *own) -> DataFrame:
    """The columns in own and a struct `row` of those in keep: joins and Python steps between pack and unpack choose
    names freely, since no column of the input stands beside theirs."""
    fields = [column(c).alias(f"c{i}") for i, c in enumerate(keep)]
    return df.select(*own, F.struct(*(fields or [F.lit(0).alias("none")])).alias("row"))


def unpack(df: DataFrame, keep: Iterable[str], *added: str) -> DataFrame:
    """The columns of row under the names they came with (see kept_names), then those added."""
    names = kept_names(keep, added)
    return df.select(*[F.col("row").getField(f"c{i}").alias(n) for i, n in enumerate(names)], *added)


def whole_id(name: str):
    """An id column as a long; what is no whole number is null."""
    return column(name).try_cast("long")


def fingerprint(df: DataFrame, keep: Iterable[str]):
    """A hash of columns of any type; those that hold maps, which Spark neither hashes nor compares, by their JSON."""
    types = dict(df.dtypes)
    return F.xxhash64(*[F.to_json(F.struct(column(c).alias("c"))) if "map<" in types.get(c, "") else column(c) for c in keep])


# ---------------------------------------------------------------- columns computed from a text column


def append(df: DataFrame, text_col: str, make: Callable[[], Callable[[list], list[tuple]]], added: str, keep: list[str], slice_bytes: int = 4 << 20) -> DataFrame:
    """The columns in keep, then those of the DDL in added; a kept column named like an added one is renamed (see
    kept_names). make() is called once a task and gives a function from a list of texts (UTF-8 bytes, or those of a
    binary column, or None) to as many tuples. A narrow operation: no shuffle, slices of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    short_batches(df.sparkSession)
    text = column(text_col)
    source = df.select(*[column(c).alias(f"k{i}") for i, c in enumerate(keep)], (text if dict(df.dtypes).get(text_col) == "binary" else text.cast("string")).alias("t"))
    more = StructType.fromDDL(added)
    # Names by position: what stands in the input cannot meet them.
    out = StructType([*source.schema.fields[:-1], *[StructField(f"a{i}", f.dataType) for i, f in enumerate(more.fields)]])
    added_types = [f.type for f in to_arrow_schema(more)]

    def run(batches):
        import pyarrow.compute as pc

        f = make()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            weight = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64) // slice_bytes
            cuts = [0, *(np.flatnonzero(np.diff(weight)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows = f(texts.slice(a, b - a).to_pylist())
                new = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), added_types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), *new], names=out.names)

    names = [*kept_names(keep, more.names), *more.names]
    return source.mapInArrow(run, out).toDF(*names)
