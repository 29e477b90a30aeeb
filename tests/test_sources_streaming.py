import numpy as np
import pytest

from rastrel.sources.pnm import decode_pnm, encode_pnm, read_pnm
from rastrel.streaming.parts import in_order


@pytest.mark.parametrize(("shape", "top"), [((1, 1, 1), 255), ((3, 5, 3), 255), ((9, 2, 1), 65535)])
def test_pnm_round_trip(shape, top):
    samples = np.random.default_rng(1).integers(0, top + 1, shape)
    got, most = decode_pnm(encode_pnm(samples, top))
    assert most == top and np.array_equal(got, samples)


def test_read_pnm(spark, tmp_path):
    samples = np.arange(2 * 3 * 3).reshape(2, 3, 3)
    (tmp_path / "a.ppm").write_bytes(encode_pnm(samples))
    (tmp_path / "broken.ppm").write_bytes(b"P6\n9 9\n255\nxx")
    assert [r.error is None for r in read_pnm(spark, str(tmp_path)).collect()].count(False) == 1
    rows = read_pnm(spark, str(tmp_path), "DROPMALFORMED").collect()
    assert len(rows) == 18 and all(samples[r.y, r.x, r.c] == r.v for r in rows)


def test_parts_come_out_in_order(spark, tmp_path):
    batches = [[(1, 2, "c"), (1, 0, "a"), (2, 1, "y")], [(1, 1, "b"), (1, 1, "again")], [(2, 0, "x"), (2, 3, "late")]]
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "image_id long, part long, payload string"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / str(k)))
        query = (
            in_order(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src)))
            .writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(out))
        )
        query.awaitTermination(120)
    got = sorted((r.image_id, r.part, r.payload) for r in spark.read.parquet(str(out)).collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x"), (2, 1, "y")]
