"""Media columns: texts stored as progressive JPEG images, and images read into RGB tensors and features."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from lexmill.llm.common import append, table
from lexmill.llm.jpeg import UNIT, Image, Unreadable, encode
from lexmill.storage import fresh_path


def padded(text: bytes | None) -> bytes:
    """Bytes 255 up to a positive multiple of UNIT."""
    text = text or b""
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def feature(rgb: np.ndarray) -> str:
    """Width, height, mean of each channel in thousandths, and an average hash of 4 x 4 cells of the green channel.
    Rows and columns of images smaller than the cells are repeated."""
    _, tall, wide = rgb.shape
    means = [int(c.sum(dtype=np.int64)) * 1000 // c.size for c in rgb]
    green = rgb[1].repeat(4 if tall < 4 else 1, axis=0).repeat(4 if wide < 4 else 1, axis=1)
    h, w = (n // 4 for n in green.shape)
    cells = green[: h * 4, : w * 4].reshape(4, h, 4, w).sum(axis=(1, 3), dtype=np.int64).ravel()
    bits = "".join("1" if 16 * int(x) >= int(cells.sum()) else "0" for x in cells)
    return f"{wide}x{tall};{','.join(map(str, means))};{int(bits, 2):04x}"


def encode_media(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, n_bytes, and media: each text's image. Null counts as empty; other columns are not read."""
    return append(docs, text_col, lambda: lambda texts: [(len(t or b""), encode(padded(t))) for t in texts], "n_bytes long, media binary", list(keep))


def store_media(images: DataFrame, directory: str | None = None) -> DataFrame:
    """images as a Parquet table in the shared folder, read back: what follows sees the stored bytes alone."""
    spark = images.sparkSession
    path = directory or fresh_path(spark, "media")
    images.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(images.schema).parquet(path)


DECODED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, tensor binary, error string"


def decode_media(images: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, then what the stored bytes give: payload_bytes, payload_sha256, tail_crc32 (of the last 32
    bytes), media_bytes, media_sha256, feature, height, width, tensor (full-resolution RGB, uint8, channel by channel)
    and error.

    A null image gives nulls. An image that cannot be read gives its media_bytes and media_sha256, nulls, and the reason
    as error, which is null otherwise; images that hold no payload give null payload columns. Equal images give equal
    values."""

    def one(blob: bytes | None) -> tuple:
        if blob is None:
            return (None,) * 10
        told = (len(blob), hashlib.sha256(blob).hexdigest())
        try:
            image = Image(blob)
            rgb = image.rgb()
            payload = image.payload() if image.payload_blocks is not None else None
        except Unreadable as e:
            return (None, None, None, *told, None, None, None, None, str(e))
        held = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        return (*held, *told, feature(rgb), rgb.shape[1], rgb.shape[2], rgb.tobytes(), None)

    return append(images, media_col, lambda: lambda blobs: list(map(one, blobs)), DECODED, list(keep))


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    stored = store_media(encode_media(table(spark, sf_dir, "documents")))
    return decode_media(stored, keep=("doc_id", "n_bytes"))
