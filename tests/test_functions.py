"""Formulas against plain Python, and round trips."""

import pytest

from rastrel.functions import pointwise as P
from rastrel.operators import measures as M
from rastrel.operators import neighbourhood as N


def _image(spark, rows):
    data = [(0, 0, 0, y, x, int(v)) for y, r in enumerate(rows) for x, v in enumerate(r)]
    return spark.createDataFrame(data, "image_id long, label long, c long, y long, x long, v long")


@pytest.mark.parametrize(("value", "token", "bits"), [(0, 0, 0), (15, 15, 0), (32, 20, 3), (65535, 63, 13)])
def test_hybrid_tokens(spark, value, token, bits):
    r = P.HYBRID(spark.createDataFrame([(0, 0, value)], "stream long, pos long, v long")).first()
    assert (r.token, r.extra_bits) == (token, bits)


def test_pack_signed(spark):
    rows = P.PACK_SIGNED(_image(spark, [[0, -1, 1, -2, 2, 7, -9, 100]])).orderBy("x").collect()
    assert [r.packed for r in rows] == [0, 1, 2, 3, 4, 14, 17, 200]
    assert all(r.v == r.unpacked for r in rows)


@pytest.mark.parametrize("rows", [[[5]], [[1, 2, 3]], [[4], [7], [1]], [[3, 1, 4], [1, 5, 9], [2, 6, 5]]])
def test_neighbours_fall_back_at_borders(spark, rows):
    got = {(r.y, r.x): (r.w, r.n, r.nw, r.ne) for r in N.NEIGHBOURS(_image(spark, rows)).collect()}
    for y, row in enumerate(rows):
        for x, _ in enumerate(row):
            w = row[x - 1] if x else rows[y - 1][x] if y else 0
            n = rows[y - 1][x] if y else w
            nw = rows[y - 1][x - 1] if x and y else w
            ne = rows[y - 1][x + 1] if y and x + 1 < len(row) else n
            assert got[y, x] == (w, n, nw, ne)


def test_dct_of_a_constant_block_is_its_mean(spark):
    got = {(r.u, r.w): round(r.v, 9) for r in M.DCT8(_image(spark, [[12] * 8] * 8)).collect()}
    assert got[0, 0] == 12 and not any(v for k, v in got.items() if k != (0, 0))


@pytest.mark.parametrize("kind", [0, 6, 9, 17, 25, 34, 41])
def test_colour_transforms_keep_three_channels(spark, kind):
    df = spark.createDataFrame([(0, 0, 0, 10, -3, 7)], "image_id long, y long, x long, v0 long, v1 long, v2 long")
    assert len({"w0", "w1", "w2"} & set(P.rct(kind)(df).columns)) == 3
