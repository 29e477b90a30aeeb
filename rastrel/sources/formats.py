"""Image files in other formats as pixel rows: PNG (8 and 16 bits, all colour kinds, interlaced too), PAM, PFM and PGX.

decode(data) looks at the first bytes only; names of files play no role. Everything is numpy and zlib.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel.sources.pnm import decode_pnm, encode_pnm

SCHEMA = "path string, format string, height int, width int, c int, y int, x int, v double, maxval double"
#: Samples that one picture may have; a file that claims more counts as broken.
MOST_SAMPLES = 1 << 30
_PNG = b"\x89PNG\r\n\x1a\n"
# Channels by colour kind; first row and column and steps of the seven interlaced passes.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _unfilter(data: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes after undoing each row's filter; step is the bytes of a whole pixel, at least one."""
    rows = data[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height, stride), dtype=np.uint8)
    above = np.zeros(stride, dtype=np.uint8)
    for y in range(height):
        kind, row = rows[y, 0], rows[y, 1:]
        if kind == 2:
            row = row + above
        elif kind == 1:
            row = _pad(row, step).reshape(-1, step).cumsum(axis=0, dtype=np.uint64).astype(np.uint8).ravel()[:stride]
        elif kind in (3, 4):
            done, up, raw = [0] * step + [0] * stride, [0] * step + above.tolist(), row.tolist()
            for i in range(stride):
                a, b, c = done[i], up[i + step], up[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                done[i + step] = (raw[i] + guess) & 255
            row = np.array(done[step:], dtype=np.uint8)
        elif kind != 0:
            raise ValueError("unknown row filter")
        out[y] = above = row
    return out


def _pad(row: np.ndarray, step: int) -> np.ndarray:
    return np.pad(row, (0, -len(row) % step))


def _samples(rows: np.ndarray, width: int, channels: int, bits: int) -> np.ndarray:
    if bits == 16:
        flat = rows.reshape(len(rows), -1, 2).astype(np.uint16)
        flat = flat[..., 0] << 8 | flat[..., 1]
    elif bits == 8:
        flat = rows
    else:
        flat = np.unpackbits(rows, axis=1)[:, : rows.shape[1] * 8].reshape(len(rows), -1, bits) @ (1 << np.arange(bits)[::-1])
    return flat[:, : width * channels].reshape(len(rows), width, channels)


def decode_png(data: bytes) -> tuple[np.ndarray, float]:
    """(height, width, channels) samples and the largest value; palettes are expanded. The first picture of an animation counts."""
    at, parts, header, palette, clear = len(_PNG), [], None, None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("truncated or damaged PNG")
        at += 12 + size
        if kind == b"IHDR" and size == 13:
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
    if header is None or header[3] not in _CHANNELS or header[2] not in (1, 2, 4, 8, 16) or header[6] > 1:
        raise ValueError("no valid PNG header")
    width, height, bits, colour, _, _, interlaced = header
    channels = _CHANNELS[colour]
    if not 0 < width * height * channels <= MOST_SAMPLES:
        raise ValueError("no size that can be read")
    passes = _PASSES if interlaced else ((0, 0, 1, 1),)
    grids = [(y0, x0, dy, dx, -(-(height - y0) // dy), -(-(width - x0) // dx)) for y0, x0, dy, dx in passes if height > y0 and width > x0]
    need = sum(h * (1 + -(-w * channels * bits // 8)) for *_, h, w in grids)
    unpack = zlib.decompressobj()
    try:
        raw = unpack.decompress(b"".join(parts), need)  # a small file can't grow beyond what its header says
    except zlib.error as e:
        raise ValueError("damaged PNG") from e
    if len(raw) < need:
        raise ValueError("truncated PNG")
    bytes_ = np.frombuffer(raw, np.uint8)
    out = np.zeros((height, width, channels), dtype=np.uint16)
    start = 0
    for y0, x0, dy, dx, h, w in grids:
        stride = -(-w * channels * bits // 8)
        rows = _unfilter(bytes_[start : start + h * (stride + 1)], h, stride, max(1, channels * bits // 8))
        out[y0::dy, x0::dx] = _samples(rows, w, channels, bits)
        start += h * (stride + 1)
    if colour == 3:
        if palette is None or out.max() >= len(palette):
            raise ValueError("colour outside the palette")
        if clear is not None:
            palette = np.column_stack([palette, np.concatenate([clear, np.full(max(0, len(palette) - len(clear)), 255, np.uint8)])[: len(palette)]])
        return palette[out[..., 0]].astype(np.float64), 255.0
    if clear is not None and colour in (0, 2) and len(clear) >= 2 * channels:
        key = clear[: 2 * channels].astype(np.int64).reshape(channels, 2) @ (256, 1)
        alpha = np.where((out == key).all(axis=2, keepdims=True), 0, (1 << bits) - 1)
        out = np.concatenate([out, alpha.astype(np.uint16)], axis=2)
    return out.astype(np.float64), float((1 << bits) - 1)


def encode_png(samples: np.ndarray, top: int = 255) -> bytes:
    """8 or 16 bits, one to four channels, no row filter."""
    height, width, channels = samples.shape
    rows = np.clip(samples, 0, top).astype(">u2" if top > 255 else "u1").reshape(height, -1)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 16 if top > 255 else 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_pam(data: bytes) -> tuple[np.ndarray, float]:
    end = data.find(b"ENDHDR\n")
    if end < 0:
        raise ValueError("no end of the PAM header")
    fields = dict(line.split(None, 1) for line in data[3:end].splitlines() if line.strip() and not line.startswith(b"#") and b" " in line.strip())
    try:
        height, width, depth, top = (int(fields[k]) for k in (b"HEIGHT", b"WIDTH", b"DEPTH", b"MAXVAL"))
    except (KeyError, ValueError) as e:
        raise ValueError("PAM header lacks a field") from e
    return _raw(data[end + 7 :], np.dtype(">u2" if top > 255 else "u1"), height, width, depth), float(top)


def decode_pfm(data: bytes) -> tuple[np.ndarray, float]:
    m = re.match(rb"P([Ff])\s+(\d+)\s+(\d+)\s+(-?[\d.]+(?:[eE][-+]?\d+)?)\s", data)
    if not m:
        raise ValueError("not a float map")
    kind = np.dtype("<f4" if float(m.group(4)) < 0 else ">f4")
    return _raw(data[m.end() :], kind, int(m.group(3)), int(m.group(2)), 3 if m.group(1) == b"F" else 1)[::-1], 1.0  # rows go from the bottom up


def encode_pfm(samples: np.ndarray) -> bytes:
    height, width, channels = samples.shape
    return b"P%s\n%d %d\n-1.0\n" % (b"F" if channels == 3 else b"f", width, height) + samples[::-1].astype("<f4").tobytes()


def decode_pgx(data: bytes) -> tuple[np.ndarray, float]:
    m = re.match(rb"PG (ML|LM) ([+-]?) ?(\d+) (\d+) (\d+)\n", data)
    if not m or m.group(2) == b"-" or not 1 <= int(m.group(3)) <= 16:
        raise ValueError("not a PGX file that can be read")
    kind = np.dtype("u1") if int(m.group(3)) <= 8 else np.dtype(">u2" if m.group(1) == b"ML" else "<u2")
    return _raw(data[m.end() :], kind, int(m.group(5)), int(m.group(4)), 1), float((1 << int(m.group(3))) - 1)


def _raw(body: bytes, kind: np.dtype, height: int, width: int, channels: int) -> np.ndarray:
    n = height * width * channels
    if not 0 < n <= MOST_SAMPLES or len(body) < n * kind.itemsize:
        raise ValueError("truncated or of no valid size")
    return np.frombuffer(body, kind, n).reshape(height, width, channels).astype(np.float64)


def _portable(data: bytes) -> tuple[np.ndarray, float]:
    samples, top = decode_pnm(data)
    return samples.astype(np.float64), float(top)


#: Formats by the bytes that their files start with.
READERS: dict[bytes, tuple[str, Callable[[bytes], tuple[np.ndarray, float]]]] = {
    _PNG: ("png", decode_png), b"P5": ("pnm", _portable), b"P6": ("pnm", _portable), b"P7\n": ("pam", decode_pam), b"PF": ("pfm", decode_pfm), b"Pf": ("pfm", decode_pfm), b"PG ": ("pgx", decode_pgx),
}


def decode(data: bytes) -> tuple[str, np.ndarray, float]:
    """Format, samples and the largest value; a ValueError where no reader takes the file."""
    for start, (name, reader) in READERS.items():
        if data.startswith(start):
            return name, *reader(data)
    raise ValueError("unknown format")


def read_images(spark: SparkSession, path: str, strip: int = 256, mode: str = "PERMISSIVE") -> DataFrame:
    """A row for each sample of every file; `v / maxval` is between 0 and 1.

    As with Spark's own readers, mode says what becomes of a file that is broken or of no known format: PERMISSIVE gives
    one row with the reason in `error` and no samples, DROPMALFORMED none, and FAILFAST ends the query.
    """
    if mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError(f"unknown mode: {mode}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "format", "height", "width", "c", "y", "x", "v", "maxval", "error"]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    kind, samples, top = decode(content.as_py())
                except ValueError as e:
                    if mode == "FAILFAST":
                        raise ValueError(f"{name.as_py()}: {e}") from e
                    if mode == "PERMISSIVE":
                        yield pa.record_batch([pa.array([name.as_py()]), pa.nulls(1, pa.string()), *[pa.nulls(1, pa.int32())] * 5, *[pa.nulls(1, pa.float64())] * 2, pa.array([str(e)])], names=names)
                    continue
                height, width, _ = samples.shape
                for first in range(0, height, strip):
                    part = samples[first : first + strip]
                    y, x, c = (a.ravel().astype(np.int32) for a in np.indices(part.shape, dtype=np.int32))
                    yield pa.record_batch(
                        [pa.array([name.as_py()] * part.size), pa.array([kind] * part.size), *[pa.array(np.full(part.size, v, np.int32)) for v in (height, width)], pa.array(c), pa.array(y + first), pa.array(x), pa.array(part.ravel()), pa.array(np.full(part.size, top)), pa.nulls(part.size, pa.string())],
                        names=names,
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA + ", error string")


def encode_pgx(samples: np.ndarray, top: int = 255) -> bytes:
    """One channel of 8 or 16 bits, the most significant byte first."""
    height, width, _ = samples.shape
    return b"PG ML + %d %d %d\n" % (16 if top > 255 else 8, width, height) + np.clip(samples, 0, top).astype(">u2" if top > 255 else "u1").tobytes()


def encode_array(samples: np.ndarray, top: int = 1) -> bytes:
    """The samples as an array file of single floats, (frames, height, width, channels), with one frame."""
    header = f"{{'descr': '<f4', 'fortran_order': False, 'shape': (1, {samples.shape[0]}, {samples.shape[1]}, {samples.shape[2]}), }}\n".encode()
    return b"\x93NUMPY\x01\0" + struct.pack("<H", len(header)) + header + (samples / top).astype("<f4").tobytes()


def _pnm(samples: np.ndarray, top: int) -> bytes:
    return encode_pnm(samples, top)


#: Writers by extension: what turns samples into a file, which channels it takes, and the greatest maximum.
WRITERS: dict[str, tuple[Callable[[np.ndarray, int], bytes], tuple[int, ...], int]] = {
    "png": (encode_png, (1, 2, 3, 4), 65535), "pgm": (_pnm, (1,), 65535), "ppm": (_pnm, (3,), 65535), "pfm": (lambda s, top: encode_pfm(s / top), (1, 3), 65535), "pgx": (encode_pgx, (1,), 65535), "npy": (encode_array, (1, 2, 3, 4), 65535),
}


def encode(extension: str, samples: np.ndarray, top: int = 255) -> bytes:
    """A file of the format that the extension stands for; a ValueError says why the samples don't fit it."""
    if extension.lower().lstrip(".") not in WRITERS:
        raise ValueError(f"no writer for {extension}")
    write, channels, most = WRITERS[extension.lower().lstrip(".")]
    if samples.ndim != 3 or not samples.size or samples.shape[2] not in channels:
        raise ValueError(f"{extension} takes {channels} channels, not a shape of {samples.shape}")
    if not 1 <= top <= most:
        raise ValueError(f"{extension} takes a maximum of {most} at most")
    return write(samples, top)


def describe(images: DataFrame) -> DataFrame:
    """(path, metadata): what an array file leaves unsaid of each image that read_images gave, as JSON."""
    return images.where("error IS NULL").groupBy("path", "format").agg(
        F.to_json(F.struct(F.max("width").alias("width"), F.max("height").alias("height"), (F.max("c") + 1).alias("channels"), F.max("maxval").alias("maxval"), F.count(F.lit(1)).alias("samples"))).alias("metadata"))


def pack_gain_map(version: int, metadata: bytes, colour: bytes, profile: bytes, image: bytes) -> bytes:
    """A bundle: version, the lengths of what may be missing before it, and the image to the end."""
    if len(metadata) > 65535 or len(colour) > 255:
        raise ValueError("metadata or colour encoding too long")
    return struct.pack(">BH", version, len(metadata)) + metadata + struct.pack(">B", len(colour)) + colour + struct.pack(">I", len(profile)) + profile + image


def unpack_gain_map(data: bytes) -> tuple[int, bytes, bytes, bytes, bytes]:
    """(version, metadata, colour, profile, image) of a bundle; a ValueError where it ends too early."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("truncated bundle")
        at += n
        return data[at - n : at]

    version, size = struct.unpack(">BH", take(3))
    metadata = take(size)
    colour = take(take(1)[0])
    profile = take(struct.unpack(">I", take(4))[0])
    return version, metadata, colour, profile, data[at:]


def write_images(pixels: DataFrame, path: str, extension: str = "png", top: int = 255) -> None:
    """A file of bytes for each image of (image_id, c, y, x, v), as a Parquet table of (image_id, content); an image has to fit into a row.

    Grouping gathers an image's pixels as arrays, so rows cross to Python once an image.
    """
    if extension.lower().lstrip(".") not in WRITERS:
        raise ValueError(f"no writer for {extension}")
    packed = pixels.sparkSession.sql(
        "SELECT image_id, MAX(y) + 1 AS height, MAX(x) + 1 AS width, MAX(c) + 1 AS channels, TRANSFORM(ARRAY_SORT(COLLECT_LIST(STRUCT(y, x, c, v))), t -> CAST(t.v AS DOUBLE)) AS vals FROM {src} GROUP BY image_id", src=pixels)

    def run(frames):
        for f in frames:
            f["content"] = [encode(extension, np.asarray(v).reshape(h, w, n), top) for v, h, w, n in zip(f["vals"], f["height"], f["width"], f["channels"], strict=True)]
            yield f[["image_id", "content"]]

    packed.mapInPandas(run, "image_id long, content binary").write.mode("errorifexists").parquet(path)
