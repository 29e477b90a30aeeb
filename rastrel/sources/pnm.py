"""Binary portable maps (P5, P6, 8 or 16 bits) as pixel rows, and back. Pure numpy, one file at a time in a task."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_HEADER = re.compile(rb"(P[56])(?:\s+|\s*#[^\n]*\n)+(\d+)(?:\s+|\s*#[^\n]*\n)+(\d+)(?:\s+|\s*#[^\n]*\n)+(\d+)\s")


def decode_pnm(data: bytes) -> tuple[np.ndarray, int]:
    """(height, width, channels) samples and the largest value; a broken file raises ValueError."""
    m = _HEADER.match(data)
    if not m:
        raise ValueError("not a binary portable map")
    width, height, top = (int(x) for x in m.groups()[1:])
    channels = 1 if m.group(1) == b"P5" else 3
    kind = np.dtype(">u2" if top > 255 else "u1")
    need = width * height * channels
    if len(data) - m.end() < need * kind.itemsize or not 0 < top < 65536:
        raise ValueError("truncated or invalid portable map")
    return np.frombuffer(data, dtype=kind, count=need, offset=m.end()).reshape(height, width, channels).astype(np.int32), top


def encode_pnm(samples: np.ndarray, top: int = 255) -> bytes:
    height, width, channels = samples.shape
    kind = ">u2" if top > 255 else "u1"
    return b"%s\n%d %d\n%d\n" % (b"P5" if channels == 1 else b"P6", width, height, top) + np.clip(samples, 0, top).astype(kind).tobytes()


def read_pnm(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """The portable maps among the files, as formats.read_images gives them; mode says what becomes of files that can't be read."""
    from rastrel.sources.formats import read_images

    return read_images(spark, path, mode=mode).where("format = 'pnm' OR error IS NOT NULL")
