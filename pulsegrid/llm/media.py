"""Payloads as PNG images in binary columns: written with chunk checksums, read back, hashed by low frequencies.

An image is 8-bit grey, 64 samples wide. The writer picks the None, Sub or Up filter for each row by the least sum of
absolute residuals; the reader knows all five filters. The visual hash pools the image to 32 x 32, takes its cosine
transform and keeps one bit for each of the 8 x 8 lowest frequencies (above their median or not).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import without

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Bytes of one IDAT chunk.
CHUNK = 65536
POOL, LOW = 32, 8


class MediaError(ValueError):
    """The bytes are no PNG of this kind, or a checksum fails."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """A payload whose length is a positive multiple of 64, as a PNG."""
    if not payload or len(payload) % WIDTH:
        raise MediaError("the payload's length must be a positive multiple of 64")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    kinds = np.stack([rows, sub, up])
    best = np.abs(kinds.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = kinds[best, np.arange(len(rows))]
    data = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _paeth(row: np.ndarray, above: np.ndarray) -> None:
    left = corner = 0
    for x in range(len(row)):
        b = int(above[x])
        p = left + b - corner
        pa_, pb, pc = abs(p - left), abs(p - b), abs(p - corner)
        guess = left if pa_ <= pb and pa_ <= pc else b if pb <= pc else corner
        left, corner = (int(row[x]) + guess) & 255, b
        row[x] = left


def _average(row: np.ndarray, above: np.ndarray) -> None:
    left = 0
    for x in range(len(row)):
        left = (int(row[x]) + (left + int(above[x])) // 2) & 255
        row[x] = left


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples from filtered rows. Sub rows are summed at once, runs of Up rows by a running sum downwards."""
    out = rows.copy()
    out[kinds == 1] = np.cumsum(rows[kinds == 1], axis=1, dtype=np.uint8)
    at = 0
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for end in [*edges.tolist(), len(kinds)]:
        kind = kinds[at]
        if kind == 2:
            first = out[at - 1 : at] if at else np.zeros((1, rows.shape[1]), np.uint8)
            out[at:end] = np.cumsum(np.concatenate([first, rows[at:end]]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for i in range(at, end):
                above = out[i - 1] if i else np.zeros(rows.shape[1], np.uint8)
                (_average if kind == 3 else _paeth)(out[i], above)
        elif kind > 4:
            raise MediaError(f"filter {kind}")
        at = end
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG, by rows. Every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise MediaError("cut short")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data):
            raise MediaError("cut short")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not an 8-bit grey PNG without interlace")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != height * (width + 1):
        raise MediaError("wrong number of samples")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


_k, _n = np.arange(LOW)[:, None], np.arange(POOL)[None, :]
COSINES = np.cos(np.pi * (2 * _n + 1) * _k / (2 * POOL))


def _pool(a: np.ndarray, n: int) -> np.ndarray:
    """Means of n even bands of the rows; fewer rows than n are repeated."""
    if len(a) < n:
        return a[(np.arange(n) * len(a)) // n]
    cut = (np.arange(n + 1) * len(a)) // n
    total = np.concatenate([np.zeros((1, a.shape[1]), a.dtype), np.cumsum(a, axis=0)])
    return (total[cut[1:]] - total[cut[:-1]]) / np.diff(cut)[:, None]


def visual_hash(samples: np.ndarray) -> str:
    small = _pool(_pool(samples.astype(np.float64), POOL).T, POOL).T
    low = np.round(COSINES @ small @ COSINES.T, 4).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def to_media(df: DataFrame, text_col: str, media_col: str) -> DataFrame:
    """Adds `media_col`: the text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a PNG.

    A null or empty text gives 64 zero bytes. Equal texts give equal bytes; repeated rows are stored each. A column of
    the new name is replaced; an empty table gives none.
    """
    df = df.select(*without(df, media_col.lower()))
    schema = T.StructType([*df.schema.fields, T.StructField(media_col, T.BinaryType())])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                raw = (text or "").encode()
                out.append(encode_png(raw + bytes(-len(raw) % WIDTH if raw else WIDTH)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, media_col])

    return df.mapInArrow(run, schema)


def read_media(df: DataFrame, media_col: str, payload_col: str, feature_col: str) -> DataFrame:
    """Adds the payload read back from `media_col` and its visual hash; both null where the bytes are null or don't pass
    the tests. Columns of the new names are replaced; an empty table gives none."""
    df = df.select(*without(df, payload_col.lower(), feature_col.lower()))
    schema = T.StructType([*df.schema.fields, T.StructField(payload_col, T.BinaryType()), T.StructField(feature_col, T.StringType())])
    at = df.columns.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads, hashes = [], []
            for data in b.column(at).to_pylist():
                try:
                    samples = decode_png(data or b"")
                except MediaError:
                    payloads.append(None)
                    hashes.append(None)
                    continue
                payloads.append(samples.tobytes())
                hashes.append(visual_hash(samples))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(payloads, pa.binary()), pa.array(hashes, pa.string())], [*b.schema.names, payload_col, feature_col])

    return df.mapInArrow(run, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """One row per document: digests of what was stored and of what was read back.

    Null and empty texts count as empty; repeated rows give repeated results; an empty table gives none. Other columns
    of `docs` are not read.
    """
    rows = docs.select("doc_id", "text")
    read = read_media(to_media(rows, "text", "media").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).drop("text"), "media", "payload", "feature")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
