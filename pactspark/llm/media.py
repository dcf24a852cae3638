"""Media columns: lossless PNG storage of byte payloads and perceptual hashes.

``encode_png`` and ``decode_png`` work on the format's chunks directly: lengths,
types, CRCs, zlib streams and scan-line filters (undone with numpy).
``dct_hash`` shrinks an image to a fixed grid by box means and keeps the signs of
its low-frequency cosine coefficients against their median.

Defined results: a null text is an empty payload (64 zero bytes); equal texts give
equal values; a damaged file raises ``ValueError`` in ``decode_png`` and yields null
pixels and hash in ``hash_images``. Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pactspark.llm.common import own_worker, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
LEVEL = 6
CHUNK = 1 << 16
GRID, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(pixels: np.ndarray, level: int = LEVEL) -> bytes:
    """An 8-bit greyscale PNG. One of the filters None, Sub and Up, by the least sum of absolute residuals."""
    height, width = pixels.shape
    sub, up = pixels.copy(), pixels.copy()
    sub[:, 1:] -= pixels[:, :-1]
    up[1:] -= pixels[:-1]
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum() for x in (pixels, sub, up)]
    best = int(np.argmin(cost))
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = (pixels, sub, up)[best]
    body = zlib.compress(lines.tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _unfilter(lines: np.ndarray, width: int) -> np.ndarray:
    kinds, raw = lines[:, 0], lines[:, 1:]
    if len(kinds) and (kinds == kinds[0]).all() and kinds[0] in (0, 1, 2):
        if kinds[0] == 0:
            return raw.copy()
        return np.cumsum(raw, axis=1 if kinds[0] == 1 else 0, dtype=np.uint8)
    out = np.zeros((len(lines), width), np.uint8)
    prior = np.zeros(width, np.uint8)
    for y, kind in enumerate(kinds):
        row = raw[y]
        if kind == 0:
            now = row.copy()
        elif kind == 1:
            now = np.cumsum(row, dtype=np.uint8)
        elif kind == 2:
            now = row + prior
        elif kind in (3, 4):
            now = np.zeros(width, np.uint8)
            left = corner = 0
            for x in range(width):
                above = int(prior[x])
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min(((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner)))[2]
                left = (int(row[x]) + guess) & 255
                corner = above
                now[x] = left
        else:
            raise ValueError(f"unknown filter {kind}")
        out[y] = prior = now
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of an 8-bit greyscale, non-interlaced PNG; every chunk's CRC and every length is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        (length,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if len(content) != length or at + 12 + length > len(data):
            raise ValueError("a chunk is cut off")
        if struct.unpack_from(">I", data, at + 8 + length)[0] != zlib.crc32(kind + content):
            raise ValueError(f"wrong checksum in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + length
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale PNG")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError(f"damaged image data: {e}") from e
    if len(raw) != height * (width + 1):
        raise ValueError("the image data have another length than the header says")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1), width)


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_DCT = _cosines(GRID, LOW)


def _boxed(pixels: np.ndarray, axis: int) -> np.ndarray:
    """Means of GRID nearly equal runs along an axis; short axes repeat their lines."""
    n = pixels.shape[axis]
    if n < GRID:
        return np.take(pixels, np.arange(GRID) * n // GRID, axis=axis)
    edges = np.arange(GRID) * n // GRID
    widths = np.diff(np.append(edges, n))
    return np.add.reduceat(pixels, edges, axis=axis) / (widths[:, None] if axis == 0 else widths[None, :])


def dct_hash(pixels: np.ndarray) -> bytes:
    """8 bytes: which of the 64 lowest cosine coefficients (without the constant one) exceed their median."""
    grid = _boxed(_boxed(pixels.astype(np.float64), 0), 1)
    low = (_DCT @ grid @ _DCT.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8 and the bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("png", pa.binary())])
_FEATURES = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
    ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("phash", pa.binary()),
])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, png: each text's payload as a PNG of 64 pixels a line in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("media")
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i in range(0, len(ids), 512):
                made = [payload_of(x) for x in batch.column("text").slice(i, 512).to_pylist()]
                png = [encode_png(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for _, p in made]
                yield pa.record_batch([pa.array(ids[i : i + 512], pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array(png, pa.binary())], schema=_STORED)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, png binary")


def read_features(stored: DataFrame) -> DataFrame:
    """Read every stored image back and compute its digests and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("media")
        for batch in batches:
            rows = []
            for doc_id, n, png in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("png")):
                data = png.as_py()
                pixels = decode_png(data)
                payload = pixels.tobytes()
                mark = dct_hash(pixels)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), mark.hex(), mark))
            columns = zip(*rows) if rows else [[]] * len(_FEATURES)
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, _FEATURES)], schema=_FEATURES)

    return stored.mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, phash binary"
    )


def hash_images(images: DataFrame, id_col: str, png_col: str) -> DataFrame:
    """id, width, height, phash (binary) of any PNG column; nulls where a file is null or damaged."""
    schema = pa.schema([("width", pa.int32()), ("height", pa.int32()), ("phash", pa.binary())])

    def one(data: bytes | None) -> tuple:
        try:
            pixels = decode_png(data)
            return pixels.shape[1], pixels.shape[0], dct_hash(pixels)
        except (TypeError, ValueError):
            return None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("media")
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column("_png")]
            columns = zip(*rows) if rows else [[]] * 3
            made = [pa.array(list(c), f.type) for c, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *made], ["_id", "width", "height", "phash"])

    slim = images.selectExpr(f"`{id_col}` AS _id", f"`{png_col}` AS _png")
    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, width int, height int, phash binary").withColumnRenamed("_id", id_col)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and hash of every document's text after a round trip through its PNG."""
    return read_features(store_texts(table(spark, sf_dir, "documents").selectExpr("cast(doc_id as bigint) AS doc_id", "text")))
