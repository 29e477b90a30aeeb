import io
import json
import struct
import zlib

import numpy as np
import pytest

from rastrel.sources import formats as F


def _chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _png(width, height, bits, colour, raw, interlaced=0, extra=b""):
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, interlaced))
    return b"\x89PNG\r\n\x1a\n" + head + extra + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("top", [255, 65535])
def test_png_round_trip(channels, top):
    samples = np.random.default_rng(channels).integers(0, top + 1, (5, 7, channels))
    kind, got, most = F.decode(F.encode_png(samples, top))
    assert kind == "png" and most == top and np.array_equal(got, samples)


def _filtered(samples, kinds):
    """Rows of 8-bit samples, each filtered by its kind, by the definition of the filters."""
    h, w, n = samples.shape
    at = lambda y, x, c: int(samples[y, x, c]) if y >= 0 and x >= 0 else 0
    raw = b""
    for y in range(h):
        row = bytearray([kinds[y]])
        for x in range(w):
            for c in range(n):
                a, b, d = at(y, x - 1, c), at(y - 1, x, c), at(y - 1, x - 1, c)
                p = a + b - d
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                row.append((at(y, x, c) - (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256)
        raw += bytes(row)
    return raw


@pytest.mark.parametrize("channels", [1, 3])
def test_png_row_filters(channels):
    samples = np.random.default_rng(9).integers(0, 256, (6, 9, channels))
    got = F.decode_png(_png(9, 6, 8, 0 if channels == 1 else 2, _filtered(samples, [1, 2, 3, 4, 0, 4])))[0]
    assert np.array_equal(got, samples)


def test_png_palette_and_small_bits():
    palette = bytes(range(12))
    got, top = F.decode_png(_png(5, 2, 2, 3, b"\0\x1b\x40\0\xe4\xc0", extra=_chunk(b"PLTE", palette) + _chunk(b"tRNS", b"\x07")))
    colours = np.column_stack([np.arange(12).reshape(4, 3), [7, 255, 255, 255]])
    assert top == 255 and np.array_equal(got, colours[[[0, 1, 2, 3, 1], [3, 2, 1, 0, 3]]])


@pytest.mark.parametrize("shape", [(1, 1), (3, 2), (9, 13)])
def test_png_interlaced(shape):
    samples = np.random.default_rng(4).integers(0, 256, (*shape, 1))
    raw = b"".join(b"\0" + r.tobytes() for y, x, dy, dx in F._PASSES for r in samples[y::dy, x::dx, 0].astype(np.uint8) if r.size)
    assert np.array_equal(F.decode_png(_png(shape[1], shape[0], 8, 0, raw, 1))[0], samples)


def test_other_formats():
    floats = np.random.default_rng(6).random((3, 4, 3)).astype("f4")
    assert np.array_equal(F.decode(F.encode_pfm(floats))[1], floats)
    body = np.arange(24, dtype="u1")
    assert np.array_equal(F.decode(b"P7\nWIDTH 3\nHEIGHT 2\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" + body.tobytes())[1].ravel(), body)
    for order, kind in ((b"ML", ">u2"), (b"LM", "<u2")):
        assert np.array_equal(F.decode(b"PG " + order + b" + 12 3 2\n" + np.arange(6).astype(kind).tobytes())[1].ravel(), np.arange(6))


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"\x89PNG\r\n\x1a\n", b"PF\n9 9\n-1.0\nxx", b"P7\nWIDTH x\nENDHDR\n", b"PG ML + 99 3 2\n", _png(9, 9, 8, 0, b"\0"), _png(1, 1, 8, 0, b"\x09\0"), _png(1, 1, 8, 3, b"\0\5"), F.encode_png(np.ones((2, 2, 1)))[:-20]])
def test_broken_files_are_refused(data):
    with pytest.raises(ValueError):
        F.decode(data)


def test_read_images_and_write_png(spark, tmp_path):
    rng = np.random.default_rng(8)
    pictures = {f"{k}.png": rng.integers(0, 256, (k + 2, 4, 3)) for k in range(3)}
    (tmp_path / "in").mkdir()
    for name, samples in pictures.items():
        (tmp_path / "in" / name).write_bytes(F.encode_png(samples))
    (tmp_path / "in" / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    rows = F.read_images(spark, str(tmp_path / "in"), strip=2).collect()
    broken = [r for r in rows if r.error is not None]
    assert [r.path.rsplit("/", 1)[1] for r in broken] == ["broken.png"] and broken[0].v is None
    rows = F.read_images(spark, str(tmp_path / "in"), mode="DROPMALFORMED").collect()
    assert len(rows) == sum(s.size for s in pictures.values()) and all(r.error is None for r in rows)
    with pytest.raises(Exception, match="broken.png"):
        F.read_images(spark, str(tmp_path / "in"), mode="FAILFAST").count()
    about = {r.path.rsplit("/", 1)[1]: json.loads(r.metadata) for r in F.describe(F.read_images(spark, str(tmp_path / "in"))).collect()}
    assert about["1.png"] == {"width": 4, "height": 3, "channels": 3, "maxval": 255.0, "samples": 36} and len(about) == 3
    assert all(pictures[r.path.rsplit("/", 1)[1]][r.y, r.x, r.c] == r.v for r in rows)
    pixels = spark.createDataFrame([(i, c, y, x, int(v)) for i, s in enumerate(pictures.values()) for (y, x, c), v in np.ndenumerate(s)], "image_id long, c long, y long, x long, v long")
    F.write_images(pixels, str(tmp_path / "out"))
    back = {r.image_id: F.decode_png(r.content)[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert all(np.array_equal(back[i], s) for i, s in enumerate(pictures.values()))


@pytest.mark.parametrize(("extension", "channels", "top"), [("png", 3, 65535), (".PGM", 1, 255), ("ppm", 3, 1000), ("pgx", 1, 65535), ("pgx", 1, 255), ("pfm", 3, 255)])
def test_writers_by_extension(extension, channels, top):
    samples = np.random.default_rng(channels).integers(0, top + 1, (4, 3, channels))
    _, got, most = F.decode(F.encode(extension, samples, top))
    assert np.allclose(got / most, samples / top, atol=1e-7)


def test_array_files_and_what_writers_refuse():
    samples = np.arange(24).reshape(2, 3, 4)
    assert np.allclose(np.load(io.BytesIO(F.encode("npy", samples, 100))), samples[None] / 100)
    for extension, shape, top in (("gif", (1, 1, 1), 255), ("pgm", (2, 2, 3), 255), ("png", (2, 2, 5), 255), ("png", (0, 2, 1), 255), ("ppm", (2, 2, 3), 70000)):
        with pytest.raises(ValueError):
            F.encode(extension, np.zeros(shape), top)


def test_gain_map_bundle():
    parts = (0, b"meta", b"\x01\x02", b"profile", b"image bytes")
    data = F.pack_gain_map(*parts)
    assert F.unpack_gain_map(data) == parts and len(data) == 1 + 2 + 4 + 1 + 2 + 4 + 7 + 11
    assert F.unpack_gain_map(F.pack_gain_map(1, b"", b"", b"", b"")) == (1, b"", b"", b"", b"")
    for cut in (0, 2, 5, 8, 12, 18):
        with pytest.raises(ValueError):
            F.unpack_gain_map(data[:cut])
