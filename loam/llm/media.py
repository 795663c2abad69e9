"""Operator 3, media columns: texts as PNG images in a binary column, read back and hashed.

Encoding: the payload (UTF-8, spaces to a positive multiple of 192 bytes) becomes an 8-bit RGB image 64
pixels wide, one row for each 192 bytes, in chunks IHDR, IDAT and IEND with their checksums. Decoding walks
the chunks, tests each CRC, inflates the joined IDAT data and undoes the five line filters in numpy. The
feature is a perceptual hash: a grey 32 x 32 reduction, its two-dimensional cosine transform, and one bit
for each of the 64 lowest frequencies, set if above their median.

Defined cases: a null or empty text becomes 192 spaces; repeated rows give equal rows; extra columns are
ignored; an empty table gives no rows. A damaged image raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import lean, materialise

UNIT = 192
# The PNG signature and chunk names.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 20


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png_encode(payload: bytes, width: int = UNIT // 3, channels: int = 3, filters: int | None = None, level: int = 6) -> bytes:
    """``filters``: one line filter of 0 to 4 for all lines; None picks None or Sub by the smaller residuals."""
    stride = width * channels
    lines = np.frombuffer(payload, np.uint8).reshape(-1, stride)
    if filters is None:
        probe = lines[:: max(1, len(lines) // 16)]
        sub = np.abs(_residual(probe, 1, channels).view(np.int8).astype(np.int16)).sum()
        filters = 1 if sub < np.abs(probe.view(np.int8).astype(np.int16)).sum() // 2 else 0
    body = np.empty((len(lines), stride + 1), np.uint8)
    body[:, 0] = filters
    body[:, 1:] = _residual(lines, filters, channels)
    data = zlib.compress(body.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(lines), 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    idat = b"".join(_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + idat + _chunk(b"IEND", b"")


def _residual(lines: np.ndarray, kind: int, bpp: int) -> np.ndarray:
    left = np.zeros_like(lines)
    left[:, bpp:] = lines[:, :-bpp]
    up = np.zeros_like(lines)
    up[1:] = lines[:-1]
    if kind == 0:
        return lines
    if kind == 1:
        return lines - left
    if kind == 2:
        return lines - up
    if kind == 3:
        return lines - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    corner = np.zeros_like(lines)
    corner[1:, bpp:] = lines[:-1, :-bpp]
    return lines - _paeth(left, up, corner)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = a.astype(np.int16), b.astype(np.int16), c.astype(np.int16)
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)).astype(np.uint8)


def _unfilter(kinds: np.ndarray, lines: np.ndarray, bpp: int) -> np.ndarray:
    if not kinds.any():
        return lines
    if (kinds == 1).all():
        return np.cumsum(lines.reshape(len(lines), -1, bpp), axis=1, dtype=np.uint8).reshape(lines.shape)
    if (kinds == 2).all():
        return np.cumsum(lines, axis=0, dtype=np.uint8)
    out, prior = np.empty_like(lines), np.zeros(lines.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        line = lines[y]
        if kind == 0:
            now = line
        elif kind == 1:
            now = np.cumsum(line.reshape(-1, bpp), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            now = line + prior
        elif kind in (3, 4):
            now, left, corner = np.empty_like(line), np.zeros(bpp, np.uint8), np.zeros(bpp, np.uint8)
            for x in range(0, len(line), bpp):
                up = prior[x : x + bpp]
                guess = ((left.astype(np.uint16) + up) >> 1).astype(np.uint8) if kind == 3 else _paeth(left, up, corner)
                left = now[x : x + bpp] = line[x : x + bpp] + guess
                corner = up
        else:
            raise ValueError(f"unknown line filter {kind}")
        out[y] = prior = now
    return out


def png_decode(data: bytes) -> np.ndarray:
    """Samples as (height, width * channels), 8 bits each; every checksum is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut short")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("no header or no end")
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("only 8-bit grey or RGB without interlacing")
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width * channels + 1)
    return _unfilter(lines[:, 0], lines[:, 1:], channels)


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None] + 1) * np.arange(k)[:, None] / (2 * n))


SIDE, LOW = 32, 8
_BASIS = _cosines(SIDE, LOW)


def _means(m: np.ndarray, n: int) -> np.ndarray:
    """Rows averaged (or repeated) to n rows."""
    if len(m) < n:
        return m[np.arange(n) * len(m) // n]
    edges = np.arange(n + 1) * len(m) // n
    return np.add.reduceat(m, edges[:-1], axis=0) / np.diff(edges)[:, None]


def cosine_hash(samples: np.ndarray, channels: int = 3) -> bytes:
    """64 bits of the lowest frequencies, row by row."""
    grey = samples.reshape(len(samples), -1, channels).sum(2, dtype=np.float64)
    square = _means(_means(grey, SIDE).T, SIDE).T
    low = _BASIS @ square @ _BASIS.T
    return np.packbits((low > np.median(low)).ravel()).tobytes()


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded), media (PNG bytes)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            payloads = [payload_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in payloads], pa.int64()), pa.array([png_encode(p) for p, _ in payloads], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(lean(encode), f"doc_id {kind}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored images: adds digests of payload and image, and the hash as a binary column and as hex."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for blob in batch.column(2).to_pylist():
                samples = png_decode(blob)
                payload, bits = samples.tobytes(), cosine_hash(samples)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), bits, bits.hex()))
            cols = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, types)]],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash", "feature"],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        lean(decode), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary, feature string"
    )


def op3_media(spark, sf_dir: str) -> DataFrame:
    stored = materialise(media_column(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return media_features(stored).drop("hash")
