"""Grey pictures: PNG and array files to pixels in [0, 1], and back to PNG."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

#: Fixed value: the first bytes of a PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunks(data: bytes):
    """(kind, body) of each chunk; an error if one is cut off or its checksum is wrong."""
    at = len(SIGNATURE)
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("file ends within a chunk")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or len(data) < at + 12 + size:
            raise ValueError("file ends within a chunk")
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"checksum of chunk {kind.decode('latin-1')}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("no end chunk")


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes, each behind the number of its filter: none, left, above, mean of both, or the nearest of left, above and corner to left + above - corner."""
    if len(raw) != height * (stride + 1):
        raise ValueError("wrong number of bytes")
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.uint8)  # a row and a pixel of zeros before the first
    for y in range(height):
        kind, line, above = lines[y, 0], lines[y, 1:], out[y]
        row = out[y + 1]
        if kind == 0:
            row[step:] = line
        elif kind == 1:
            for c in range(step):
                row[step + c :: step] = np.cumsum(line[c::step], dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            row[step:] = line + above[step:]
        elif kind in (3, 4):
            left, up, add = [0] * step, above.tolist(), line.tolist()
            for x in range(stride):
                a, b, c = left[x], up[x + step], up[x]
                if kind == 3:
                    best = (a + b) >> 1
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    best = a if da <= db and da <= dc else b if db <= dc else c
                left.append((add[x] + best) & 255)
            row[step:] = left[step:]
        else:
            raise ValueError(f"filter {kind}")
    return out[1:, step:]


def png_pixels(data: bytes) -> np.ndarray:
    """Height x width of integers: a grey PNG of 8 or 16 bits (or of 1, 2, 4), not interlaced; an alpha channel is left out."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG")
    chunks = list(_chunks(data))
    if not chunks or chunks[0][0] != b"IHDR":
        raise ValueError("no header chunk")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[0][1])
    if colour not in (0, 4) or depth not in (1, 2, 4, 8, 16) or interlaced:
        raise ValueError(f"colour type {colour}, {depth} bits, interlaced {interlaced}")
    channels = 1 if colour == 0 else 2
    stride, step = -(-width * channels * depth // 8), max(1, channels * depth // 8)
    engine = zlib.decompressobj()
    raw = engine.decompress(b"".join(body for kind, body in chunks if kind == b"IDAT"), height * (stride + 1) + 1)
    lines = _unfiltered(raw, height, stride, step)
    if depth == 16:
        return lines.reshape(height, width, channels, 2).astype(np.uint16)[:, :, 0] @ np.array([256, 1], np.uint16)
    if depth == 8:
        return lines.reshape(height, width, channels)[:, :, 0].copy()
    bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)[:, :width]
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)


def png_bytes(pixels: np.ndarray) -> bytes:
    """A grey PNG of 8 or 16 bits; its rows take the five filters in turn."""
    depth = 8 * pixels.dtype.itemsize
    step = depth // 8
    lines = pixels.astype(f">u{step}").tobytes()
    height, stride = pixels.shape[0], pixels.shape[1] * step
    rows = np.frombuffer(lines, np.uint8).reshape(height, stride).astype(np.int64)
    padded = np.zeros((height + 1, stride + step), np.int64)
    padded[1:, step:] = rows
    a, b, c = padded[1:, :-step], padded[:-1, step:], padded[:-1, :-step]
    da, db, dc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    nearest = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
    guesses = [np.zeros_like(rows), a, b, (a + b) >> 1, nearest]
    body = b"".join(bytes([y % 5]) + ((rows[y] - guesses[y % 5][y]) & 255).astype(np.uint8).tobytes() for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], height, depth, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def _scaled(data: bytes) -> np.ndarray:
    """Pixels in [0, 1] by the file's integer type."""
    x = png_pixels(data) if data.startswith(SIGNATURE) else np.load(io.BytesIO(data), allow_pickle=False)
    if x.ndim != 2 or not x.size:
        raise ValueError(f"no picture of two dimensions: {x.shape}")
    y = x.astype(np.float32)
    if x.dtype == np.uint16:
        y /= 65535
    elif x.dtype == np.uint8:
        y /= 255
    elif x.dtype.kind in "iu":
        y = (y - y.min()) / max(float(y.max() - y.min()), 1e-6)
    return np.clip(y, 0, 1)


def decoded(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows (binaryFile, or any with file contents) with pixels, height, width and error.

    PNG and .npy files are told apart by their first bytes.  A file that can't be read
    (null, cut off, of another kind) is a row with null pixels and what is wrong.
    """
    schema = StructType([*rows.schema.fields]).add("pixels", ArrayType(FloatType())).add("height", "integer").add("width", "integer").add("error", "string")

    def run(batches):
        for b in batches:
            found: list[tuple] = []
            for cell in b.column(content).to_pylist():
                try:
                    if cell is None:
                        raise ValueError("no content")
                    x = _scaled(cell)
                    found.append((x.ravel(), *x.shape, None))
                except (ValueError, EOFError, zlib.error, struct.error, OSError, OverflowError) as error:
                    found.append((None, None, None, f"{type(error).__name__}: {error}"))
            cells = list(zip(*found, strict=True)) or [(), (), (), ()]
            kinds = (pa.list_(pa.float32()), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True))], schema.names)

    return rows.mapInArrow(run, schema)


def encoded(rows: DataFrame, pixels: str = "pixels", height: str = "height", width: str = "width", *, bits: int = 16, into: str = "content") -> DataFrame:
    """rows with a grey PNG of their pixels in [0, 1], halves up; null for null."""
    kind, top = (np.uint16, 65535) if bits == 16 else (np.uint8, 255)

    def run(batches):
        for b in batches:
            cells = []
            for p, h, w in zip(*(b.column(c).to_pylist() for c in (pixels, height, width)), strict=True):
                cells.append(None if p is None else png_bytes(np.clip(np.floor(np.asarray(p, np.float64).reshape(h, w) * top + 0.5), 0, top).astype(kind)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.binary())], [*b.schema.names, into])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add(into, "binary"))


def picture_files(spark, path: str, glob: str = "*.png") -> DataFrame:
    """(path, pixels, height, width, error) of a directory's pictures (Spark lists no files without bytes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return decoded(files.select(F.col("path"), "content")).drop("content")
