"""Token-ID output as sorted-string-table shards.

A shard holds documents in ascending id order: data blocks with prefix-compressed keys, then a Bloom filter, a sparse
block index (first key, offset, length of each block) and a fixed-size footer. Layout, integers little-endian:

    block   zstd( entries: varint shared, varint unshared, varint value bytes, key tail, value )
    value   token ids, 2 bytes each if the vocabulary fits, else 4
    filter  bit array, `probes` positions a key
    index   for each block: varint key length, key, u64 offset, u32 length
    footer  u64 filter offset, u64 index offset, u64 documents, u64 ids, u32 blocks, u8 id width, u8 probes, 8 magic bytes

Keys are the id with its sign bit turned, big-endian, so that bytes sort as numbers; a null id has the empty key and
comes first. Documents are range-partitioned by id and encoded after that shuffle: what moves is compressed text, not
ids. A partition holds about shard_bytes of text, and a task that meets more begins another file, so that files, and the
keys and filter a task holds, stay of one size whatever the table's. Words between ASCII white space are encoded once
and kept with their ids in arrays of bounded size, which all tasks of a worker share, for tokenizers that drop white
space and let no token, contraction or special string span it; other tokenizers are told by their parts and encode
texts whole.
"""

from __future__ import annotations

import json
import os
import string
import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import column, filesystem, map_rows, replacing, table, whole_id
from lexmill.storage import fresh_path, materialize

MAGIC = b"LXSST\x00\x00\x01"
FOOTER = struct.Struct("<QQQQIBB8s")
BLOCK_BYTES, BITS_A_KEY, PROBES, MIX = 64 << 10, 10, 7, 0x9E3779B1
SHARD_KEYS = 1 << 22


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return n, at
        shift += 7


def probes_of(key: bytes, bits: int, probes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key) | 1
    return [(a + i * b * MIX) % bits for i in range(probes)]


def write_shard(uri: str, entries: Iterator[tuple[bytes, bytes]], width: int, limit: int = 1 << 30) -> tuple[int, int, int]:
    """Writes (key, value) entries, in key order, until their values reach limit bytes or are SHARD_KEYS; the file appears whole. Documents,
    ids and bytes written."""
    import zstandard

    packer, index, hashes, n_ids, at, held = zstandard.ZstdCompressor(level=1), [], array("Q"), 0, 0, 0
    with replacing(uri) as out:
        block, weight, first, last = [], 0, b"", b""

        def flush():
            nonlocal block, weight, at
            if block:
                data = packer.compress(b"".join(block))
                out.write(data)
                index.append((first, at, len(data)))
                at, block, weight = at + len(data), [], 0

        for key, value in entries:
            if not block:
                first, last = key, b""
            shared = len(os.path.commonprefix([last, key]))
            block += [varint(shared), varint(len(key) - shared), varint(len(value)), key[shared:], value]
            weight, last, n_ids = weight + len(value) + 12, key, n_ids + len(value) // width
            hashes.append(zlib.crc32(key) << 32 | zlib.adler32(key) | 1)
            held += len(value)
            if weight >= BLOCK_BYTES:
                flush()
            if held >= limit or len(hashes) >= SHARD_KEYS:
                break
        flush()
        packed = bloom(np.frombuffer(hashes, dtype=np.uint64))
        out.write(packed)
        table = b"".join(varint(len(k)) + k + struct.pack("<QI", o, n) for k, o, n in index)
        out.write(table)
        out.write(FOOTER.pack(at, at + len(packed), len(hashes), n_ids, len(index), width, PROBES, MAGIC))
    return len(hashes), n_ids, at + len(packed) + len(table) + FOOTER.size


def bloom(hashes: np.ndarray) -> bytes:
    """The filter of keys given as two 32-bit hashes each; the same positions as probes_of."""
    bits = np.zeros(max(64, len(hashes) * BITS_A_KEY + 7 & ~7), dtype=bool)
    a, b = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)
    for i in range(PROBES):
        bits[(a + np.uint64(i) * b % np.uint64(len(bits)) * np.uint64(MIX % len(bits))) % np.uint64(len(bits))] = True
    return np.packbits(bits).tobytes()


class Shard:
    """An open shard: scans and looks documents up with range reads."""

    def __init__(self, uri: str) -> None:
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.filter_at, index_at, self.documents, self.ids, blocks, self.width, self.probes, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a shard")
        table, at, self.index = self.read(index_at, size - FOOTER.size - index_at), 0, []
        for _ in range(blocks):
            n, at = read_varint(table, at)
            self.index.append((table[at : at + n], *struct.unpack_from("<QI", table, at + n)))
            at += n + 12
        self.filter_bytes = index_at - self.filter_at

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        import zstandard

        _, offset, n = self.index[i]
        data, at, last = zstandard.ZstdDecompressor().decompressobj().decompress(self.read(offset, n)), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            size, at = read_varint(data, at)
            last = last[:shared] + data[at : at + own]
            yield last, np.frombuffer(data, dtype=f"<u{self.width}", count=size // self.width, offset=at + own)
            at += own + size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this id: filter, binary search in the index, then the blocks it may be in."""
        key = key_of(doc_id)
        bits = self.filter_bytes * 8
        for p in probes_of(key, bits, self.probes):
            if not self.read(self.filter_at + p // 8, 1)[0] >> (7 - p % 8) & 1:
                return []
        firsts = [x[0] for x in self.index]
        i, found = max(0, bisect_right(firsts, key) - 1), []
        while i > 0 and firsts[i] == key:  # repeated ids may begin in an earlier block
            i -= 1
        while i < len(firsts) and firsts[i] <= key:
            found += [v for k, v in self.block(i) if k == key]
            i += 1
        return found


def separable(tokenizer) -> bool:
    """Whether texts may be cut at ASCII white space and lower-cased before: the normaliser composes, replaces white space
    and lower-cases, the pre-tokenizer drops white space, added tokens take none of it, words end with a mark."""
    parts = json.loads(tokenizer.to_str())
    normal, split, model = parts["normalizer"] or {}, parts["pre_tokenizer"] or {}, parts["model"]
    steps = normal.get("normalizers", [normal] if normal else [])
    named = {x["type"] for x in steps}
    spaces = all(x["pattern"] == {"Regex": r"\s+"} for x in steps if x["type"] == "Replace")
    first = (split.get("pretokenizers") or [split])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
    plain = not any(t["content"].isspace() or t["content"].isalpha() or t["lstrip"] or t["rstrip"] or " " in t["content"] for t in parts["added_tokens"])
    return named <= {"NFC", "Replace", "Lowercase"} and spaces and "Lowercase" in named and drops and plain and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")


def of_letters(tokenizer):
    """The tokenizer for lower-case words of letters between spaces, which its normaliser leaves as they are and its
    pre-tokenizer leaves whole: without either's expressions, the same ids for less."""
    from tokenizers import Tokenizer

    parts = json.loads(tokenizer.to_str())
    rest = parts["pre_tokenizer"].get("pretokenizers", [None])[1:]
    return Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}}))


def latin(word: str) -> bool:
    """Whether a word is of Latin letters that neither composing nor lower-casing takes apart: a single pre-token."""
    return word.isalpha() and max(word) < "\u0180" and "\u0130" not in word


class Words:
    """Different words and the ids of each, in arrays: ids[cuts[i] : cuts[i + 1]] are those of words[i]."""

    def __init__(self, width: int) -> None:
        self.words, self.ids, self.cuts = pa.array([], pa.binary()), np.empty(0, dtype=f"<u{width}"), np.zeros(1, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word here, or -1."""
        return pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().copy()

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words one after another, and their cuts."""
        starts = self.cuts[numbers]
        lengths = self.cuts[numbers + 1] - starts
        cuts = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(starts - cuts[:-1], lengths)
        at += np.arange(len(at))
        return self.ids[at], cuts

    def extend(self, words: pa.Array, ids: np.ndarray, cuts: np.ndarray) -> None:
        self.words, self.ids, self.cuts = pa.concat_arrays([self.words, words]), np.concatenate((self.ids, ids)), np.concatenate((self.cuts, cuts[1:] + self.cuts[-1]))


class Encoder:
    """Encoded words of one tokenizer that lower-cases. When half of the limit is known, those words become the older
    ones, of which the words met again are kept."""

    SPACE, LETTER, CLOSING = 1, 2, 4

    def __init__(self, path: str, width: int, limit: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known, self.older = Words(width), Words(width)
        self.tokenizer, self.width, self.limit = Tokenizer.from_file(path), width, limit
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = not separable(self.tokenizer)
        if self.whole:
            return
        self.letters = of_letters(self.tokenizer)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kinds = np.zeros(256, dtype=np.uint8)
        self.kinds[list(b" \t\n\v\f\r")] = self.SPACE
        self.kinds[list(string.ascii_letters.encode())] = self.LETTER
        parted = [c for c in string.punctuation if self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{c}")[0][0] == "a"]
        self.kinds[list(set("".join(parted).encode()).difference(*self.special))] = self.CLOSING

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of whole texts, in little-endian integers of the encoder's width. Unknown words of all texts are
        encoded together."""
        if self.whole:
            found = self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(x.ids, dtype=f"<u{self.width}").tobytes() for x in found]
        # Letter case is lost in the tokenizer too, but special strings are told by it.
        words, firsts = self.cut([t if any(x[:2] in t for x in self.special) else t.lower() for t in texts])
        coded = words.dictionary_encode()
        numbers = self.numbers(coded.dictionary)  # before known is named, which it may replace
        ids, cuts = self.known.take(numbers[coded.indices.to_numpy()])
        data, at = ids.tobytes(), (cuts[firsts] * self.width).tolist()
        return [data[a:b] for a, b in pairwise(at)]

    def cut(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The words of texts, and the number of the first of each text and of their end. A word ends at white space, or
        where an ASCII letter has nothing but closing marks between it and white space: those are pre-tokens of their own."""
        data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
        kinds = self.kinds[data]
        word = kinds != self.SPACE
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        edges = np.flatnonzero(np.diff(kinds == self.CLOSING))  # the bytes before runs of marks and the last ones in them
        before, last = edges[::2], edges[1::2]
        begins[before[(kinds[before] == self.LETTER) & (kinds[last + 1] == self.SPACE)] + 1] = True
        data, offsets = data[word], np.flatnonzero(begins[word])
        offsets = np.append(offsets, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return words, np.searchsorted(np.flatnonzero(begins), np.cumsum([0, *(len(t) + 1 for t in texts)]))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of different words among those known, which these are added to."""
        found = self.known.find(words)
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        if len(self.known) + len(missing) > self.limit // 2 or len(self.known.ids) > 4 * self.limit:
            self.known, self.older = Words(self.width), self.known
            missing = np.arange(len(words))
        before, old = len(self.known), self.older.find(words.take(pa.array(missing)))
        again, new = missing[old >= 0], missing[old < 0]
        if len(again):
            self.known.extend(words.take(pa.array(again)), *self.older.take(old[old >= 0]))
        unknown = words.take(pa.array(new)).to_pylist()
        single = [w.isalpha() or latin(w.decode()) for w in unknown]
        for one in (True, False):
            if group := [w for w, s in zip(unknown, single, strict=True) if s is one]:
                self.encode(group, one)
        single = np.array(single, dtype=bool)
        found[np.concatenate((again, new[single], new[~single]))] = np.arange(before, len(self.known))
        return found

    def encode(self, words: list[bytes], single: bool) -> None:
        """Encodes and adds words, many as one text, since a call costs far more than a word. If each is a single
        pre-token (letters alone), its last id is the one that ends a word; otherwise character offsets tell words apart."""
        ids, lengths = [], []
        for at in range(0, len(words), 2048):
            text = b" ".join(words[at : at + 2048]).decode()
            if single:
                found = np.array(self.letters.encode_batch_fast([text.lower()], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
                cuts = np.concatenate(([0], np.flatnonzero(self.ends[found]) + 1))
            else:
                got = self.tokenizer.encode(text, add_special_tokens=False)
                found = np.array(got.ids, dtype=f"<u{self.width}")
                cuts = np.searchsorted([a for a, _ in got.offsets], np.cumsum([0, *(len(t) + 1 for t in text.split(" "))]))
            ids.append(found)
            lengths.append(np.diff(cuts))
        self.known.extend(pa.array(words, pa.binary()), np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(lengths)))))


def groups(rows: Iterator[tuple], weight: int = 4 << 20) -> Iterator[list[tuple]]:
    """Rows of (id, text) in lists that end where their texts reach weight bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or b"") + 64
        if size >= weight:
            yield held
            held, size = [], 0
    if held:
        yield held


@lru_cache(maxsize=2)
def kept_encoder(path: str, modified: int, width: int, limit: int) -> Encoder:
    """The encoder that the tasks of a worker share. Tasks reach it by the name of this function: what a task's own
    function names directly is copied for each task, a dictionary of encoders too."""
    return Encoder(path, width, limit)


def write_token_ids(docs: DataFrame, tokenizer: str, directory: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shards: int | None = None, cache: int = 800_000, shard_bytes: int = 256 << 20) -> DataFrame:
    """Encodes each text, appends end_id, and writes shards; the manifest (shard, path, documents, ids, bytes, start),
    one row a file, where start is the number of ids in all shards before. There are `shards` partitions, or as many as
    keep about shard_bytes of text in each; a file ends when its ids reach shard_bytes.

    Null and empty texts have the end id alone. Rows without an id, or whose id is no whole number, come first. Rows with the same id stay apart, in
    the order of their texts' hashes. Any white space but ASCII's is left to the tokenizer. Other columns are not
    read. An empty table has no shards.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    directory = directory or fresh_path(spark, "sstable")
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    source = docs.select(whole_id(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = source.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def make():
        part = TaskContext.get().partitionId()
        encoder = kept_encoder(tokenizer, os.stat(tokenizer).st_mtime_ns, width, cache)
        end = end_id.to_bytes(width, "little")

        def run(rows):
            entries = ((key_of(i), ids + end) for some in groups(rows) for (i, _), ids in zip(some, encoder.ids([t or b"" for _, t in some]), strict=True))
            number, first = 0, next(entries, None)
            while first is not None:
                path = f"{directory}/part-{part:06d}-{number:04d}.sst"
                yield (part << 20 | number, path, *write_shard(path, chain((first,), entries), width, shard_bytes))
                number, first = number + 1, next(entries, None)

        return run

    manifest = materialize(map_rows(ranged, make, "shard long, path string, documents long, ids long, bytes long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_ids(manifest: DataFrame, shards: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest."""

    def run(rows):
        for path, start in rows:
            shard = Shard(path.decode())
            for key, ids in shard.scan():
                yield id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                start += len(ids)

    n = shards or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_rows(manifest.select("path", "start").repartition(n), lambda: run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_sstable(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_token_ids(write_token_ids(docs, public_tokenizers.path("word_bpe_49k.json")))
