"""Phrase collocations, counted in arrays by the slots of minimal perfect hashes.

Level by level: phrases that may reach the least count because their parts do (words, then pairs of frequent words, then
pairs of overlapping frequent pairs) are gathered with counts capped at that least count, which is enough to tell the
candidates. A minimal perfect hash over the candidates of a level gives each a slot, and the key stored there tells
others off. Mappers turn their texts into slots and count them in numpy arrays; arrays are summed as a tree, segment by
segment. A pair's key is made of its words' slots and a triple's of its pairs' slots, so the parts of every cut are read
by slot from the arrays.

Sizes: a hash holds at most about `block` candidates and travels as a file of the shared folder; where a level has more,
it has several hashes, each of them one pass over the slots found so far. Slots are 32-bit numbers, so that a level may
have some four thousand million candidates; beyond that an error is raised. Texts are read twice, whatever the levels.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import _powers, column, constants, filesystem, map_rows, replacing, short_batches, splitmix, table
from lexmill.storage import discard, fresh_path, materialize


@dataclass(frozen=True)
class Params:
    least: int = 10  # occurrences of a candidate
    share: tuple[int, int] = (50, 100)  # of a phrase's occurrences: if a longer candidate has them, the phrase goes
    top: int = 2000  # phrases of a language
    block: int = 1 << 21  # candidates of one perfect hash, about
    segment: int = 1 << 14  # slots whose counts travel as one array
    fan: int = 32  # partial sums of a segment
    blob: int = 1 << 14  # slots of texts that are stored as one array, about


# ---------------------------------------------------------------- words

SEPARATORS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
IS_WORD = np.array([b not in SEPARATORS + BREAKS for b in range(256)])
IS_BREAK = np.array([b in BREAKS for b in range(256)])
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
PIECE = 1 << 20


def language_key(lang: bytes) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang, digest_size=8).digest(), "little"))


def words(langs: list[bytes], texts: list[bytes], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The words of many texts in pieces cut between words: (data, starts, ends, row, key, fresh). data are folded
    bytes, row tells the text, key hashes language and word, fresh marks words that do not follow the one before within
    a piece of text."""
    joined = b"\n".join(texts)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]]) if texts else np.zeros(0, dtype=np.int64)
    own = np.array([language_key(x) for x in langs], dtype=np.uint64)
    value = np.where(IS_WORD, constants(71 + 1000 * seed, 256)[FOLD], np.uint64(0))
    at, open_ = 0, True
    while at < len(joined):
        to = min(len(joined), at + PIECE)
        while to < len(joined) and IS_WORD[joined[to]]:
            to += 1
        data = np.frombuffer(joined, dtype=np.uint8, count=to - at, offset=at)
        edges = np.flatnonzero(np.diff(IS_WORD[data], prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        breaks = np.cumsum(IS_BREAK[data])
        if len(starts):
            power, inverse = _powers(len(data) + 1)
            sums = np.concatenate(([np.uint64(0)], np.cumsum(value[data] * power[: len(data)])))
            row = np.searchsorted(begins, starts + at, side="right") - 1
            key = splitmix(splitmix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)) ^ own[row])
            here = breaks[starts]
            fresh = np.diff(here, prepend=0) > 0
            fresh[0] |= open_
            yield FOLD[data], starts, ends, row, np.maximum(key, np.uint64(1)), fresh
            open_ = bool(breaks[-1] > here[-1])
        else:
            open_ |= bool(breaks[-1] > 0)
        at = to


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words at these places, as UTF-8 strings."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    places = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[places].tobytes())])


def rows_of(batch: pa.RecordBatch) -> tuple[list[bytes], list[bytes]]:
    """Languages and texts of a batch, in slices of some megabytes."""
    lang, text = (c.cast(pa.binary()).to_pylist() for c in batch.columns)
    return lang, text


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[list[bytes], list[bytes]]]:
    lang, text = rows_of(batch)
    at, held = 0, 0
    for i, t in enumerate(text):
        held += len(t)
        if held >= most or i + 1 == len(text):
            yield lang[at : i + 1], text[at : i + 1]
            at, held = i + 1, 0


def word_counts(source: DataFrame, seed: int) -> DataFrame:
    """(lang, word, key, n) of source(lang, text)."""

    def run(batches):
        for batch in batches:
            for langs, texts in slices(batch):
                for data, starts, ends, row, key, _ in words(langs, texts, seed):
                    found, first, n = np.unique(key, return_index=True, return_counts=True)
                    names = pa.array(langs, pa.binary()).cast(pa.string()).take(pa.array(row[first]))
                    yield pa.RecordBatch.from_arrays([names, strings(data, starts[first], ends[first]), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "word", "key", "n"])

    return source.mapInArrow(run, "lang string, word string, key long, n long").groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- minimal perfect hashes


class PerfectHash:
    """Distinct 64-bit keys to the slots 0 to n - 1. At each level a key's place is taken if no other key fell on it;
    keys that met go on to the next. A slot is the number of places taken before. The key stored in a slot verifies."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]], keys: np.ndarray) -> None:
        self.levels, self.keys = levels, keys

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (splitmix(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest, taken = [], keys, 0
        while len(rest):
            size = max(64, 2 * len(rest) + 63 & ~63)
            at = cls.place(rest, len(levels), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
            counts = np.bitwise_count(bits).astype(np.int64)
            levels.append((size, bits, (taken + np.cumsum(counts) - counts).astype(np.int64)))
            taken += int(counts.sum())
            rest = rest[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        out = cls(levels, np.zeros(len(keys), dtype=np.uint64))
        out.keys[out._slots(keys)] = keys
        return out

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = self.place(keys[left], level, size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = bits[word]
            hit = (held >> bit & np.uint64(1)).astype(bool)
            mask = (np.uint64(1) << bit[hit]) - np.uint64(1)
            out[left[hit]] = ranks[word[hit]] + np.bitwise_count(held[hit] & mask)
            left = left[~hit]
            if not len(left):
                break
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for what is no key."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        out = self._slots(keys)
        return np.where((out >= 0) & (self.keys[out] == keys), out, -1)


@dataclass(frozen=True)
class Block:
    """A perfect hash in a file: its candidates' slots are those from offset + 1 on."""

    number: int
    size: int
    path: str
    offset: int = 0


def write_arrays(path: str, **arrays) -> None:
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    with replacing(path) as out:
        out.write(buffer.getbuffer())


def read_arrays(path: str) -> dict[str, np.ndarray]:
    fs, place = filesystem(path)
    with fs.open_input_stream(place) as f:
        found = np.load(io.BytesIO(f.read()), allow_pickle=False)
    return {k: found[k] for k in found.files}


def load_hash(path: str) -> PerfectHash:
    a = read_arrays(path)
    return PerfectHash([(int(s), a[f"bits{i}"], a[f"ranks{i}"]) for i, s in enumerate(a["sizes"])], a["keys"])


def build(candidates: DataFrame, path: str, p: Params) -> list[Block]:
    """Perfect hashes over candidates(key, and for words lang and word), blocks by the key's remainder, each built by
    one task from about p.block keys."""
    named = "word" in candidates.columns
    blocks = max(1, -(-candidates.count() // p.block))
    placed = candidates.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    extra = ["lang", "word"] if named else []

    def put(block: int, rows: list[tuple]) -> tuple:
        keys = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
        h = PerfectHash.build(keys)
        arrays = {"sizes": np.array([s for s, _, _ in h.levels]), "keys": h.keys}
        for i, (_, bits, ranks) in enumerate(h.levels):
            arrays |= {f"bits{i}": bits, f"ranks{i}": ranks}
        if named:
            order = np.empty(len(rows), dtype=np.int64)
            order[h.slots(keys)] = np.arange(len(rows))
            for i, name in enumerate(extra, 1):
                held = [rows[j][i] for j in order.tolist()]
                arrays |= {name: np.frombuffer(b"".join(held), dtype=np.uint8), f"{name}_ends": np.cumsum([len(x) for x in held])}
        file = f"{path}/hash-{block}.npz"
        write_arrays(file, **arrays)
        return block, len(rows), file

    def run(rows):
        number, held = None, []
        for block, *row in rows:
            if held and block != number:
                yield put(number, held)
                held = []
            number = block
            held.append(row)
        if held:
            yield put(number, held)

    dealt = placed.select("block", "key", *extra).repartition(blocks, "block").sortWithinPartitions("block")
    files = sorted(tuple(r) for r in materialize(map_rows(dealt, lambda: run, "block int, size long, path string"), "hashes").collect())
    out, offset = [], 0
    for number, size, file in files:
        out.append(Block(number, size, file, offset))
        offset += size
    if offset >= 1 << 32:
        raise ValueError("more candidates than 32-bit slots")
    return out


# ---------------------------------------------------------------- slots and counts

SLOTS = "block int, segment int, task int, keys binary, data binary"


def row(block=None, segment=None, task=None, keys=None, data=None) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, segment, task, keys, data), types, strict=True)], names=["block", "segment", "task", "keys", "data"])


def cut(keys: np.ndarray, slots: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of about size, cut where a zero key stands."""
    gaps, at = np.flatnonzero(keys == 0), 0
    while at < len(keys):
        i = np.searchsorted(gaps, at + size)
        to = int(gaps[i]) if i < len(gaps) else len(keys)
        yield keys[at:to], slots[at:to]
        at = to + 1


def closed(x: np.ndarray) -> np.ndarray:
    """Which places are no zero after a zero."""
    keep = x != 0
    keep[1:] |= x[:-1] != 0
    return keep


def text_keys(seed: int):
    """Batches of (lang, text) to arrays of word keys, zero between pieces of text."""

    def run(batches):
        for batch in batches:
            for langs, texts in slices(batch):
                held = []
                for _, _, _, _, key, fresh in words(langs, texts, seed):
                    out = np.zeros(len(key) + int(fresh.sum()), dtype=np.uint64)
                    out[np.arange(len(key)) + np.cumsum(fresh)] = key
                    held.append(out)
                if held:
                    yield np.concatenate(held)

    return run


def pair_keys(data: bytes) -> np.ndarray:
    """Keys of neighbouring slots of one stored array; zero where either is none."""
    s = np.frombuffer(data, dtype=np.uint32)
    a, b = s[:-1], s[1:]
    return np.where((a > 0) & (b > 0), a.astype(np.uint64) << np.uint64(32) | b, np.uint64(0))


def stored_keys(batches) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column("data"):
            keys = pair_keys(x.as_buffer())
            if len(keys):
                yield keys


def occurrences(source: DataFrame, fresh_keys, blocks: list[Block], p: Params, name: str) -> tuple[DataFrame, DataFrame]:
    """(slots, counts). slots: rows whose data are arrays of slots, zero where no candidate stands. counts: (block,
    segment, task, data), the arrays that the tasks counted. One pass for each block; each counts its own candidates."""
    several, last = len(blocks), len(blocks) - 1
    state, counts = source, []
    for i, block in enumerate(blocks):

        def run(batches, i=i, block=block):
            from pyspark import TaskContext

            task, h = TaskContext.get().partitionId(), load_hash(block.path)
            counts = np.zeros(block.size, dtype=np.int64)

            def before():
                if i == 0:
                    for keys in fresh_keys(batches):
                        for k, s in cut(keys, np.zeros(len(keys), dtype=np.uint32), p.blob):
                            yield k, s
                    return
                for batch in batches:
                    for k, s in zip(batch.column("keys"), batch.column("data"), strict=True):
                        yield np.frombuffer(k.as_buffer(), dtype=np.uint64), np.frombuffer(s.as_buffer(), dtype=np.uint32).copy()

            for keys, slots in before():
                mine = np.flatnonzero(keys) if several == 1 else np.flatnonzero((keys != 0) & (keys.view(np.int64) % several == block.number))
                found = h.slots(keys[mine])
                ok = found >= 0
                slots[mine[ok]] = found[ok] + (block.offset + 1)
                counts += np.bincount(found[ok], minlength=block.size)
                if i < last:
                    keep = closed(keys)
                    yield row(keys=keys[keep].tobytes(), data=slots[keep].tobytes())
                else:
                    kept = slots[closed(slots)]
                    if len(kept) > 1:
                        yield row(data=kept.tobytes())
            for k in range(0, block.size, p.segment):
                part = counts[k : k + p.segment]
                if part.any():
                    yield row(block.number, k // p.segment, task, None, part.tobytes())

        short_batches(source.sparkSession)
        done = materialize(state.mapInArrow(run, SLOTS), name)
        counts.append(done.filter("block is not null").select("block", "segment", "task", "data"))
        state = done.filter("block is null").select("keys", "data")
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return state.select("data"), out


def tree_sum(counts: DataFrame, p: Params) -> DataFrame:
    """(block, segment, data): the tasks' arrays summed, first in p.fan groups of tasks, then those."""

    def add(rows):
        key = total = None
        for *k, data in rows:
            if k != key:
                if key:
                    yield *key, total.tobytes()
                key, total = k, np.frombuffer(data, dtype=np.int64).copy()
            else:
                total += np.frombuffer(data, dtype=np.int64)
        if key:
            yield *key, total.tobytes()

    parts = counts.select("block", "segment", (F.col("task") % p.fan).alias("part"), "data").repartition("block", "segment", "part").sortWithinPartitions("block", "segment", "part")
    parts = map_rows(parts, lambda: add, "block int, segment int, part int, data binary").drop("part")
    return map_rows(parts.repartition("block", "segment").sortWithinPartitions("block", "segment"), lambda: add, "block int, segment int, data binary")


def write_counts(counts: DataFrame, blocks: list[Block], path: str, p: Params) -> list[str]:
    """The counts of each block by slot, a file each, written by one task each."""
    sizes = {b.number: b.size for b in blocks}

    def run(rows):
        number = total = None

        def put():
            file = f"{path}/counts-{number}.npz"
            write_arrays(file, counts=total)
            return number, file

        for block, segment, data in rows:
            if block != number:
                if number is not None:
                    yield put()
                number, total = block, np.zeros(sizes[block], dtype=np.int64)
            part = np.frombuffer(data, dtype=np.int64)
            total[segment * p.segment : segment * p.segment + len(part)] = part
        if number is not None:
            yield put()

    files = map_rows(counts.repartition(len(blocks), "block").sortWithinPartitions("block"), lambda: run, "block int, path string")
    found = {r["block"]: r["path"] for r in materialize(files, "counts").collect()}
    return [found[b.number] for b in blocks]


def frequent_pairs(slots: DataFrame, p: Params) -> DataFrame:
    """(key) of the pairs of neighbouring slots that occur at least p.least times. Counts capped there tell that."""

    def run(batches):
        held, weight = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 16)].view(np.int64)), pa.array(np.minimum(n[a : a + (1 << 16)], p.least).astype(np.int32))], names=["key", "n"])

        for keys in stored_keys(batches):
            held.append(keys[keys != 0])
            weight += len(held[-1])
            if weight >= 1 << 21:
                yield from flush()
                held, weight = [], 0
        if weight:
            yield from flush()

    return slots.mapInArrow(run, "key long, n int").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= p.least).select("key")


# ---------------------------------------------------------------- reading by slot


@dataclass(frozen=True)
class Level:
    blocks: list[Block]
    counts: list[str]


def candidates(level: Level, counts: DataFrame, p: Params) -> DataFrame:
    """(slot, key, a) of a level, from the stored keys and the summed arrays."""
    by_number = {b.number: b for b in level.blocks}

    def run(batches):
        number = h = None
        for batch in batches:
            for block, segment, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != number:
                    number, h = block, load_hash(by_number[block].path)
                n = np.frombuffer(data, dtype=np.int64)
                at = segment * p.segment
                slot = np.arange(at, at + len(n)) + by_number[block].offset + 1
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(h.keys[at : at + len(n)].view(np.int64)), pa.array(n)], names=["slot", "key", "a"])

    return counts.select("block", "segment", "data").mapInArrow(run, "slot long, key long, a long")


def read_by_slot(df: DataFrame, slots: list[str], level: Level, what: dict[str, str]) -> DataFrame:
    """df with, for each column of slots, what the level's files hold there: what maps 'count', 'key', 'lang' or 'word'
    to the prefix of the new column. One pass for each block; what other blocks hold is null until its pass."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    types = {"count": (pa.int64(), LongType()), "key": (pa.int64(), LongType()), "lang": (pa.string(), StringType()), "word": (pa.string(), StringType())}
    added = [(s, w, f"{prefix}_{s}") for s in slots for w, prefix in what.items()]
    state = df
    for i, (block, counts) in enumerate(zip(level.blocks, level.counts, strict=True)):
        schema = state.schema if i else StructType([*state.schema.fields, *[StructField(c, types[w][1]) for _, w, c in added]])

        def run(batches, i=i, block=block, counts=counts, names=schema.names):
            import pyarrow.compute as pc

            file, held = read_arrays(block.path), {"count": pa.array(read_arrays(counts)["counts"])}
            held["key"] = pa.array(file["keys"].view(np.int64))
            for w in ("lang", "word"):
                if w in file:
                    ends = np.concatenate(([0], file[f"{w}_ends"])).astype(np.int64)
                    held[w] = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(file[w].tobytes())]).cast(pa.string()) if len(ends) > 1 else pa.array([], pa.string())
            for batch in batches:
                columns = {n: batch.column(n) for n in batch.schema.names}
                for s, w, name in added:
                    at = np.asarray(columns[s].fill_null(0)) - block.offset - 1
                    inside = (at >= 0) & (at < block.size)
                    new = held[w].take(pa.array(np.where(inside, at, 0), mask=~inside))
                    columns[name] = pc.coalesce(columns[name], new) if i else new
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

        state = state.mapInArrow(run, schema)
        if i + 1 < len(level.blocks):
            state = materialize(state, "read")
    return state


# ---------------------------------------------------------------- the operator


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the first phrases of two and three words.

    Words lie between spaces and tabs within pieces that end at . , ; : ! ? and line ends; A-Z count as a-z. a, l and r
    count the phrase and the parts of its weakest cut, n all words of the language; the score is
    floor(1000000 a a / (l r)). Phrases that lie in a longer candidate with at least p.share of their occurrences go.
    Null texts are empty, a null language is `und`. Repeated rows count each. Empty tables and texts without frequent
    phrases give no rows. Other columns are not read."""
    p, spark = params, docs.sparkSession
    source = docs.select(F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))
    short_batches(spark)
    folder = fresh_path(spark, "collocations")
    # Two words with one key, once in 10^19 pairs, are seen here, and another seed parts them.
    for seed in range(8):
        known = materialize(word_counts(source, seed), "words")
        if not known.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").limit(1).count():
            break
        discard(known)
    totals = known.groupBy("lang").agg(F.sum("n").alias("n"))
    none = spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")

    levels, found = [], []
    slots, keys = source, text_keys(seed)
    wanted = known.filter(F.col("n") >= p.least).select("key", "lang", "word")
    for depth in (1, 2, 3):
        blocks = build(wanted, f"{folder}/{depth}", p)
        if not blocks:
            break
        slots, counts = occurrences(slots, keys, blocks, p, f"slots{depth}")
        sums = materialize(tree_sum(counts, p), "sums")
        levels.append(Level(blocks, write_counts(sums, blocks, f"{folder}/{depth}", p)))
        found.append(sums)
        if depth < 3:
            wanted, keys = materialize(frequent_pairs(slots, p), "pairs"), stored_keys
    if len(levels) < 2:
        return none

    pairs = candidates(levels[1], found[1], p)
    high, low = F.shiftrightunsigned("key", 32), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    pairs = pairs.select("slot", "a", high.alias("w1"), low.alias("w2"))
    null = F.lit(None).cast("long")
    rows = pairs.select("slot", "a", "w1", "w2", null.alias("w3"), null.alias("f12"), null.alias("f23"))
    if len(levels) > 2:
        triples = candidates(levels[2], found[2], p).select("a", high.alias("b1"), low.alias("b2"))
        triples = materialize(read_by_slot(triples, ["b1", "b2"], levels[1], {"count": "f", "key": "k"}), "triples")
        within = triples.select("a", F.explode(F.array("b1", "b2")).alias("slot")).groupBy("slot").agg(F.max("a").alias("longest"))
        lost, of = p.share
        rows = rows.join(within, "slot", "left").filter(F.col("longest").isNull() | (F.col("longest") * of < F.col("a") * lost)).drop("longest")
        word = lambda c, first: F.shiftrightunsigned(c, 32) if first else F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
        rows = rows.unionByName(triples.select(null.alias("slot"), "a", word("k_b1", True).alias("w1"), word("k_b1", False).alias("w2"), word("k_b2", False).alias("w3"), F.col("f_b1").alias("f12"), F.col("f_b2").alias("f23")))
    rows = read_by_slot(rows.drop("slot"), ["w1", "w2", "w3"], levels[0], {"count": "f", "word": "t", "lang": "g"})
    # Products may pass 64 bits: decimals of 38 digits hold them for counts up to 10^16.
    score = lambda l, r: F.expr(f"cast((cast(1000000 as decimal(7, 0)) * cast(a as decimal(16, 0)) * cast(a as decimal(16, 0))) div (cast({l} as decimal(19, 0)) * cast({r} as decimal(19, 0))) as long)")
    scored = rows.withColumn("s1", F.when(F.col("w3").isNull(), score("f_w1", "f_w2")).otherwise(score("f_w1", "f23"))).withColumn("s2", F.when(F.col("w3").isNotNull(), score("f12", "f_w3")))
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    phrases = scored.select(
        F.col("g_w1").alias("lang"),
        F.concat_ws(" ", "t_w1", "t_w2", "t_w3").alias("phrase"),
        "a",
        F.when(second, F.col("f12")).otherwise(F.col("f_w1")).alias("l"),
        F.when(second, F.col("f_w3")).when(F.col("w3").isNull(), F.col("f_w2")).otherwise(F.col("f23")).alias("r"),
        F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"),
    )
    # Top rows of parts of a language first, then of these: no language is sorted whole in one task.
    parts = min(512, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= p.top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= p.top)
    return best.join(totals, "lang").select(*none.columns)


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from pieces),
k as (select unnest([1, 2, 3]) k),
f as materialized (
  select lang, k, g, count(*) f from (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) g from w, k where len(ws) >= k) group by 1, 2, 3),
n as (select lang, sum(f) n from f where k = 1 group by 1),
c as materialized (select lang, k, g, f a, string_split(g, ' ') ws from f where k > 1 and f >= 10),
cuts as (select lang, g, a, k, unnest(range(1, k)) i, ws from c),
parts as (
  select cuts.*, x.f l, y.f r, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f::hugeint))::bigint score
  from cuts join f x on x.lang = cuts.lang and x.k = i and x.g = array_to_string(ws[1:i], ' ') join f y on y.lang = cuts.lang and y.k = cuts.k - i and y.g = array_to_string(ws[i + 1:], ' ')),
best as (select * from parts qualify row_number() over (partition by lang, g order by score, i) = 1),
inner_pairs as (select lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) g, a from c where k = 3),
longest as (select lang, g, max(a) top from inner_pairs group by 1, 2),
kept as (select b.* from best b left join longest using (lang, g) where top is null or 100 * top < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(g)) rank from kept)
select lang, rank::bigint rank, g phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score from ranked join n using (lang) where rank <= 2000
"""
