"""SentencePiece encoding and decoding with the places of every piece in the source.

A text is normalised by the model's compiled character map: at each place the longest rule that matches is replaced,
and for every byte of the result the source bytes it came from are recorded. The normalised text splits into pre-tokens
that no piece crosses; a bounded cache in each worker holds the pieces of the pre-tokens it met, and the library, on a
model whose normaliser is taken out, merges those that it misses, many in one call. A piece's normalised bytes then project to the
source bytes they came from. Everything is a narrow map: nothing is shuffled.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import append, table

SPACE, SPACE_BYTES = "▁", "▁".encode()
REPLACEMENT = "�".encode()
# Kinds of a piece in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2

# ---------------------------------------------------------------- the model file


def fields(data: bytes):
    """(number, value) of the fields of a protocol buffer: integers, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n


def without_normalizer(data: bytes) -> bytes:
    """The model with the normaliser named identity, which adds and removes nothing."""
    out, spec = bytearray(), b"\x0a\x08identity\x18\x00\x20\x00\x28\x01"

    def varint(n: int) -> bytes:
        held = bytearray()
        while n > 127:
            held.append(n & 127 | 128)
            n >>= 7
        return bytes([*held, n])

    for number, value in fields(data):
        if number != 3:
            out += varint(number << 3 | 2) + varint(len(value)) + value  # all parts of a model are messages
    return bytes(out + varint(3 << 3 | 2) + varint(len(spec)) + spec)


class CharacterMap:
    """A compiled character map: a double-array trie over source bytes whose values are places in a block of
    replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4 if blob else 0).tolist()
        self.replacements = blob[4 + size :]
        self.seen: dict[int, bool] = {}

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest rule that matches at a place, and how many source bytes it takes."""
        units = self.units
        if not units:
            return None
        node, found = self.child(0), None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            leaf = units[node] >> 8 & 1
            node ^= self.offset(units[node])
            if leaf:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if not found:
            return None
        return self.replacements[found[0] : self.replacements.index(b"\0", found[0])], found[1]

    def child(self, node: int) -> int:
        return node ^ self.offset(self.units[node])

    @staticmethod
    def offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


@dataclass
class Model:
    """What a model file says. score and kind are by id; ids by piece, for pieces that texts can hold."""

    pieces: list[bytes] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    map: bytes = b""
    type: int = 1
    byte_fallback: bool = False
    dummy_prefix: bool = True
    squeeze: bool = True  # runs of spaces become one
    escape: bool = True
    suffix: bool = False
    bare: bytes = b""  # the model file with a normaliser that changes nothing
    unknown_surface: bytes = " ⁇ ".encode()

    def check(self, path: str) -> Model:
        """Raises where the model asks for what is not done here."""
        if self.type != BPE or not self.escape or self.suffix:
            raise ValueError(f"{path}: only BPE models with escaped spaces before words")
        if USER in self.kinds or UNUSED in self.kinds or not self.byte_fallback:
            raise ValueError(f"{path}: only models with byte pieces and without user-defined or unused ones")
        if any(re.search("[^▁]▁", x) or "\n" in x for x in (p.decode() for p, k in zip(self.pieces, self.kinds, strict=True) if k == NORMAL)):
            raise ValueError(f"{path}: pieces cross pre-tokens")
        return self


def read_model(path: str) -> Model:
    m = Model()
    with open(path, "rb") as f:
        data = f.read()
    m.bare = without_normalizer(data)
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            m.pieces.append(piece.get(1, b""))
            m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            m.kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            spec = dict(fields(value))
            m.type, m.suffix, m.byte_fallback = spec.get(3, 1), bool(spec.get(24, 0)), bool(spec.get(35, 0))
            m.unknown_surface = spec.get(44, m.unknown_surface)
        elif number == 3:
            read_normalizer(value, m)
    return m


def read_normalizer(value: bytes, m: Model) -> Model:
    spec = dict(fields(value))
    m.map, m.dummy_prefix, m.squeeze, m.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    return m


# ---------------------------------------------------------------- normalisation with alignment


class Normalizer:
    """Texts to normalised bytes, and for each of these the source bytes it came from."""

    def __init__(self, m: Model) -> None:
        self.m, self.map = m, CharacterMap(m.map)
        self.plain = not m.map and not m.squeeze

    def normalize(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(normalised, begins, ends): source bytes begins[i] up to ends[i] gave byte i."""
        return self._plain(text) if self.plain else self._mapped(text)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Without rules only spaces change, from one byte to three."""
        if not text:
            return b"", np.empty(0, np.int32), np.empty(0, np.int32)
        space = np.frombuffer(text, dtype=np.uint8) == 32
        at = np.repeat(np.arange(len(text), dtype=np.int32), np.where(space, len(SPACE_BYTES), 1))
        out = text.replace(b" ", SPACE_BYTES)
        if not self.m.dummy_prefix:
            return out, at, at + 1
        none = np.zeros(len(SPACE_BYTES), dtype=np.int32)
        return SPACE_BYTES + out, np.concatenate((none, at)), np.concatenate((none, at + 1))

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        out, begins, ends = bytearray(), [], []

        def put(chunk: bytes, a: int, b: int) -> None:
            out.extend(chunk)
            begins.extend([a] * len(chunk))
            ends.extend([b] * len(chunk))

        at, squeeze = 0, self.m.squeeze
        while squeeze and at < len(text):
            chunk, n = self.step(text, at)
            if chunk != b" ":
                break
            at += n
        if at == len(text):
            return b"", np.empty(0, np.int32), np.empty(0, np.int32)
        if self.m.dummy_prefix:
            put(SPACE_BYTES, at, at)
        after_space = squeeze
        while at < len(text):
            chunk, n = self.step(text, at)
            if after_space:
                chunk = chunk.lstrip(b" ")
            if chunk:
                put(chunk.replace(b" ", SPACE_BYTES), at, at + n)
                after_space = chunk.endswith(b" ")
            after_space &= squeeze
            at += n
        while squeeze and out.endswith(SPACE_BYTES):
            del out[-3:], begins[-3:], ends[-3:]
        return bytes(out), np.array(begins, dtype=np.int32), np.array(ends, dtype=np.int32)

    def step(self, text: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the source at a place, and how many bytes of it: the longest rule, or a character."""
        found = self.map.longest(text, at)
        if found:
            return found
        n = 1 if text[at] < 0x80 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
        return text[at : at + n], n


# ---------------------------------------------------------------- pieces

PRETOKEN = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")


class Pieces(dict):
    """Pre-token -> its pieces as pairs of 32-bit numbers, id and byte length in the normalised text, as bytes. What a batch of
    texts misses is merged once and kept, until the cache is full and starts anew."""

    def __init__(self, m: Model, limit: int) -> None:
        import sentencepiece

        super().__init__()
        self.limit = limit
        self.library = sentencepiece.SentencePieceProcessor(model_proto=m.bare)
        self.sizes = np.array([1 if k == BYTE else len(p) for p, k in zip(m.pieces, m.kinds, strict=True)], dtype=np.int32)

    def learn(self, tokens: list[str]) -> None:
        """Puts the pieces of all tokens into the cache."""
        missing = [t for t in dict.fromkeys(tokens) if t not in self]
        if len(self) + len(missing) > self.limit:
            self.clear()
            missing = list(dict.fromkeys(tokens))
        if not missing:
            return
        found = self.library.encode(missing, num_threads=1)
        ends = np.cumsum([len(x) for x in found])
        pairs = np.empty((int(ends[-1]), 2), dtype=np.int32)
        pairs[:, 0] = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=len(pairs))
        pairs[:, 1] = self.sizes[pairs[:, 0]]
        spelt = np.diff(np.concatenate(([0], np.cumsum(pairs[:, 1])))[np.concatenate(([0], ends))])
        if (spelt != [len(t.encode()) for t in missing]).any():
            raise ValueError("the model's pieces do not spell its texts")
        held, at = pairs.tobytes(), 0
        for t, to in zip(missing, (8 * ends).tolist(), strict=True):
            self[t] = held[at:to]
            at = to


class Decoder:
    """Ids to the text they spell."""

    def __init__(self, m: Model) -> None:
        self.m = m
        self.surface = [m.unknown_surface if k == UNKNOWN else b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE_BYTES, b" ") for p, k in zip(m.pieces, m.kinds, strict=True)]
        self.is_byte = np.array([k == BYTE for k in m.kinds])
        self.trims = m.dummy_prefix or m.squeeze

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """The space mark that the encoder put in front goes; byte pieces that form no character become U+FFFD."""
        out: list[bytes] = []
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return b""
        kinds = self.is_byte[ids]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(kinds)) + 1, [len(ids)]))
        start = True
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            chunk = [self.surface[i] for i in ids[a:b].tolist()]
            if kinds[a]:
                out.append(characters(b"".join(chunk)))
                start = False
                continue
            for k in range(len(chunk) if start and self.trims else 0):
                if chunk[k]:
                    if self.m.kinds[int(ids[a + k])] == NORMAL and chunk[k].startswith(b" "):
                        chunk[k] = chunk[k][1:]
                        start = self.m.squeeze and not chunk[k]
                    else:
                        start = False
                    if not start:
                        break
            out.extend(chunk)
        return b"".join(out)


def characters(data: bytes) -> bytes:
    """data with each byte that belongs to no character replaced."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        b = data[at]
        n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        try:
            data[at : at + n].decode()
            ok = n > 0 and at + n <= len(data)
        except UnicodeDecodeError:
            ok = False
        out.append(data[at : at + n] if ok else REPLACEMENT)
        at += n if ok else 1
    return b"".join(out)


# ---------------------------------------------------------------- on DataFrames

_WORKER: dict[tuple, Pieces] = {}


def encode_texts(texts: list[bytes], normalizer: Normalizer, pieces: Pieces) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, begins, ends) of the pieces of each text, places in source bytes, end exclusive."""
    normal = [normalizer.normalize(t) for t in texts]
    tokens = [PRETOKEN.findall(out.decode()) for out, _, _ in normal]
    pieces.learn([t for x in tokens for t in x])
    rows = []
    for (_, begins, ends), x in zip(normal, tokens, strict=True):
        pairs = np.frombuffer(b"".join(map(pieces.__getitem__, x)), dtype=np.int32).reshape(-1, 2)
        ids, to = pairs[:, 0].copy(), np.cumsum(pairs[:, 1])
        # Source bytes that several pieces came from, as in a replacement of several letters, belong to each.
        first = begins[np.concatenate(([0], to[:-1]))] if len(to) else begins
        rows.append((ids, first, ends[to - 1] if len(to) else ends))
    return rows


def model_of(docs: DataFrame, model_path: str | None):
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    return path, docs.sparkSession.sparkContext.broadcast(read_model(path).check(path))


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), model_path: str | None = None, cache: int = 200_000) -> DataFrame:
    """The columns in keep, then ids, begins and ends, arrays of ints: the pieces of each whole text as the library's
    encode gives them, without begin, end or sampling, and the source bytes (UTF-8, end exclusive) of each. A row for
    each row of docs.

    Null and empty texts have no pieces. The space mark before a text comes from no byte: begin equals end. A byte
    piece of a character that no piece holds spans its byte. The model's size bounds what is broadcast; a kept column
    named like a new one is renamed (common.kept_names). Other columns are not read."""
    path, model = model_of(docs, model_path)

    def make():
        if (path, cache) not in _WORKER:
            _WORKER[path, cache] = Pieces(model.value, cache)
        pieces = _WORKER[path, cache]
        normalizer = Normalizer(model.value)
        return lambda texts: encode_texts([t or b"" for t in texts], normalizer, pieces)

    return append(docs, text_col, make, "ids array<int>, begins array<int>, ends array<int>", list(keep), slice_bytes=1 << 20)


def decode(docs: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), model_path: str | None = None) -> DataFrame:
    """The columns in keep, then decoded, the text that the ids spell, as the library's decode gives it. Null counts as
    no ids, and so does a null among the ids; an id outside the vocabulary is an error, as in the library."""
    _, model = model_of(docs, model_path)
    # Ids travel as 4 bytes each.
    from lexmill.llm.common import column, kept_names, short_batches

    short_batches(docs.sparkSession)
    source = docs.select(*[column(c).alias(f"k{i}") for i, c in enumerate(keep)], F.filter(F.coalesce(column(ids_col).cast("array<int>"), F.array().cast("array<int>")), lambda x: x.isNotNull()).alias("t"))
    from pyspark.sql.types import StringType, StructField, StructType

    out = StructType([*source.schema.fields[:-1], StructField("a", StringType())])

    def run(batches):
        import pyarrow as pa

        decoder = Decoder(model.value)
        for batch in batches:
            t = batch.column(batch.num_columns - 1)
            values, offsets = np.asarray(t.values), np.asarray(t.offsets)
            texts = [decoder.decode(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x.decode() for x in texts], pa.string())], names=out.names)

    return source.mapInArrow(run, out).toDF(*kept_names(keep, ["decoded"]), "decoded")


def op13_sentencepieces(spark, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents"))
    spanned = F.aggregate(F.zip_with("begins", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    digests = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), spanned.alias("spanned_bytes"))
    out = decode(digests, keep=("doc_id", "n_tokens", "ids_sha256", "spanned_bytes"))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "spanned_bytes")
