"""The pipeline's stages, each on its predecessor's rows."""

from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from rastrel.llm import bpe, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
    toxic, copies, near, mixed, last = seen
    first = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(d.columns == first.columns for d in seen[:-1])
    assert toxic.count() <= first.count()
    texts = [x.text for x in copies.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {x.text for x in toxic.collect()}
    fps = [x.fp & (2**64 - 1) for x in simhash.fingerprints(near).collect()]
    assert not any((a ^ b).bit_count() <= 3 for i, a in enumerate(fps) for b in fps[:i])
    assert last.count() == mixed.count() and {x.doc_id for x in mixed.collect()} <= {x.doc_id for x in near.collect()}


def test_stages_keep_exactly_the_rows_they_should(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    first = docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows.append(docs.toPandas())
        if k == 2:
            fps = {x.doc_id: x.fp & (2**64 - 1) for x in simhash.fingerprints(before).collect()}
    ids = [Counter(r["doc_id"]) for r in rows]
    model = toxicity.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[1] == Counter(x.doc_id for x in toxicity.score_documents(first, model).collect() if x.score < queries.TOXIC_FROM)
    assert ids[2] == Counter(rows[1].groupby("text")["doc_id"].max())
    low = {i: i for i in fps}
    near = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 3]
    while any(low[i] != low[j] for i, j in near):
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
    assert ids[3] == Counter(set(low.values()))
    con = duckdb.connect()
    con.register("kept", rows[3])
    assert ids[4] == Counter(con.execute(f"SELECT doc_id FROM ({queries.mix_sql('kept')})").df()["doc_id"])
    path, pattern = queries.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = Counter((i, np.array(enc.encode_ordinary(t or ""), dtype="<u4").tobytes()) for i, t in zip(rows[4]["doc_id"], rows[4]["text"], strict=True))
    assert Counter((i, bytes(t)) for i, t in zip(rows[5]["doc_id"], rows[5]["token_ids"], strict=True)) == want


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def _odd(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "en", "src0", 5), (1, words, "en", "src0", 5), (2, words + " more", None, None, None), (3, None, "en", "src1", 0), (4, "", "en", "src9", 0), (None, "no id here but words enough to count", "de", "src2", 1),
            (None, None, None, None, None), (5, words, "en", "src0", 5), (5, "another text altogether, of the same id", "en", "src0", 5), (6, "z" * 50_000 + " end", "fr", "src3", 9)]
    return spark.createDataFrame([(*r, 1, 2.0, "x", 7, "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, slot int, rate double, row_key string, fp int, mix_row string")


@pytest.mark.parametrize("rows", [None, 0])
def test_stages_on_odd_and_on_no_rows(spark, tmp_path, rows):
    docs = _odd(spark) if rows is None else _odd(spark).limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = first = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        counts.append(docs.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == first.columns
    assert counts[:3] == ([0] * 3 if rows == 0 else [10, 6, 5])  # all texts; distinct ones, null as empty; "more" near its base
    assert rows != 0 or counts[3:] == [0, 0]
    assert counts[3] == counts[4]
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.glob("pipeline-*"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[4]
    (new,) = set(folder.glob("pipeline-*")) - before
    assert [p.name for p in new.iterdir()] == [str(len(corpus_pipeline.STAGES) - 1)]
