"""Input that once broke an operator, or that is large or lopsided."""

import hashlib
import math
import random
import time
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from rastrel.llm import common, components, embeddings, html_extract, mixing, pii, sharding, simhash, substring, toxicity
from rastrel.llm.semicrf import SemiCrf

R, R_NP = random.Random(12), np.random.default_rng(12)


def _crf():
    return SemiCrf().fit([x for t, g in pii.practice(200) for a, b in pii.regions(t) if (x := pii._lesson(t, g, a, b))[1]])


def test_marks_deep_inside_long_words(spark):
    docs = spark.createDataFrame([(1, "x" * 200 + "1 tail"), (2, "plain"), (3, None), (4, "y" * 90 + "@" + "z" * 90)], "doc_id long, text string")
    got = {x.doc_id: x for x in pii.find_personal_data(docs, pii.learn(docs)).collect()}
    assert set(got) == {1, 2, 3, 4} and all(x.n_spans == 0 for x in got.values())


def test_a_long_table_of_numbers_takes_little_memory():
    text = " ".join(str(R.randint(0, 9999)) for _ in range(12_000)) + " a@b.org"
    model = _crf()
    tracemalloc.start()
    found = pii.find_spans(text, model)
    peak = tracemalloc.get_traced_memory()[1]
    assert (len(text) - 7, len(text), "email") in found and peak < 16e6


def test_luhn_and_spans_in_segments_of_one_region():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.luhn("79927398713")
    found = pii.find_spans("call +1 (212) 555-0199 or +12125550188 or 10.0.0.1, 10.0.0.999", _crf())
    assert [k for _, _, k in found].count("phone") == 2 and (42, 50, "ip") in found


@pytest.fixture(scope="module")
def labeller():
    pages = [(html_extract.leaves(p), y) for p, y in html_extract.practice_pages(200)]
    return html_extract.BiLstm(html_extract.PATH_DIMS + html_extract.WORD_DIMS + html_extract.SHAPE_DIMS).fit([(html_extract.vectors(b), np.array(y, dtype=np.float32)) for b, y in pages])


def test_formulas_and_drawings_keep_their_text():
    pages = {
        "<p>Formula <math><mi>x</mi></math> holds.</p>": ["Formula x holds."],
        "<p>a <svg viewBox='0 0 1 1'/> b <canvas/>c</p><p>d<object data=q>fallback</object></p>": ["a b c", "dfallback"],
        "<p>one<script src='a>b'/>two<noscript>n</noscript><style>s</style></p><template>t</template>x": ["onetwo", "x"],
        "<head><title>not <b>here</title></head><p>text<noscript>never closed": ["textnever closed"],
        "<p>kept<script>var a='</p>'": ["kept"],
    }
    for page, want in pages.items():
        assert [b.text for b in html_extract.leaves(page)] == want


def test_deep_and_long_pages_take_linear_time(labeller, monkeypatch):
    start = time.time()
    deep = html_extract.leaves("<div>" * 60_000 + "".join(f"<p>{i}</section></p>" for i in range(30_000)))
    assert len(deep) == 30_000 and time.time() - start < 20
    page = html_extract.leaves("".join(p for p, _ in html_extract.practice_pages(12, seed=3)))
    whole = labeller.scores(*html_extract.pad([html_extract.vectors(page)]))[0]
    monkeypatch.setattr(html_extract, "CHUNK_STEPS", 17)
    got = html_extract.label([page, [], page[:5]], labeller)
    assert np.allclose(got[0], whole, atol=1e-5) and len(got[1]) == 0 and len(got[2]) == 5


def test_html_columns_of_any_name(spark):
    pages = spark.createDataFrame([(None, "u", "<p>word</p>", "t", 4), (None, "u", "<p>word</p>", "t", 4), (2, None, None, "t", 4)], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract(pages, html_extract.learn(pages)).collect()
    assert sorted((x.page_id or 0, x.n_chars) for x in got) == sorted([(0, got[0].n_chars)] * 2 + [(2, 0)])


def test_toxicity_on_few_labels_and_odd_texts(spark):
    texts = [(i, ("grolk " if i % 3 == 0 else "") + " ".join(R.choices("alpha beta gamma delta omega".split(), k=20))) for i in range(90)]
    rows = [(i, t, 1, 2, 3) for i, t in [*texts, (None, None), (140, None), (141, ""), (142, " \n"), (143, "grolk " * 200_000), (143, "grolk " * 200_000)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int, fold int, score int")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(140, 1, 0), (141, 1, 1), (150, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    score = [(x.doc_id, x.score) for x in toxicity.score_documents(docs, model).collect()]
    assert len(score) == len(rows) and all(0 <= s <= 1 for _, s in score)
    assert min(s for i, s in score if i is not None and i < 90 and i % 3 == 0) > max(s for i, s in score if i is not None and i < 90 and i % 3)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.7 for _, s in score)
    none = toxicity.fit(docs.limit(0), labels)
    assert {x.score for x in toxicity.score_documents(docs, none).collect()} == {0.0}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_toxicity_held_out_recall_on_the_small_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_documents(docs, model).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 3 = 1").collect()
    toxic = [x.score >= 0.7 for x in rows if x.toxic == 1]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(x.score >= 0.7 for x in rows if x.toxic == 0) <= 2


def test_one_row_of_a_source_that_is_repeated_very_often(spark):
    rows = [(i, "t", "b") for i in range(3000)] + [(3000, "hot", "a"), (3001, "hot too", "a"), (None, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, {"a": 9.0}, rest=1.0)
    got = out.where("source = 'a'").groupBy("doc_id", "mix_copies").agg({"mix_copy": "max", "mix_key": "count"}).collect()
    assert len(got) == 2 and all(x["max(mix_copy)"] + 1 == x["count(mix_key)"] == x.mix_copies for x in got)
    assert abs(sum(x.mix_copies for x in got) - 2702.7) < 300 and out.select("doc_id", "mix_copy", "mix_key").distinct().count() == out.count()


def test_counts_are_those_of_the_definition(spark):
    """The plan draws one number for each row: the count is how much of the distribution lies below it."""
    rate = 2.5
    docs = spark.range(400).selectExpr("id AS doc_id", "'x' AS text", "IF(id % 5 < 2, 'a', 'b') AS source")
    out = mixing.mix(docs, {"a": 1.0}, rest=0.0, shuffle=False, seed=9)
    cdf, p = [], math.exp(-rate)
    for k in range(40):
        cdf.append(p + (cdf[-1] if cdf else 0.0))
        p *= rate / (k + 1)
    want = {}
    for i in range(400):
        if i % 5 < 2 and (n := sum(c <= int(hashlib.md5(f"9:{i}:1".encode()).hexdigest()[:13], 16) / 16**13 for c in cdf)):
            want[i] = n
    assert {x.doc_id: x["count"] for x in out.groupBy("doc_id").count().collect()} == want
    assert {x.mix_rate for x in out.collect()} == {rate}


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, "first text about rivers and bridges", 0), (1, "quite another text on knives and stones", 1), (1, "quite another text on knives and stones", 2), (2, long, 3), (3, long, 4), (None, long, 5),
            (None, "no id but a text", 6), (None, "no id but a text", 7), (5, None, 8), (6, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int")
    kept = simhash.drop_near_duplicates(docs)
    got = sorted((x.doc_id or 0, x.text or "") for x in kept.collect())
    assert kept.columns == docs.columns
    assert got == sorted([(1, rows[0][1]), (1, rows[1][1]), (2, long), (0, rows[6][1]), (5, "")])


def test_a_variant_that_goes_over_many_batches():
    fps = np.unique(R_NP.integers(0, 2**21, 500).astype(np.uint64))
    keys = np.zeros(len(fps), dtype=np.int64)
    whole = simhash._links(keys, fps)
    cut = [pa.record_batch([pa.array(keys[a : a + 60]), pa.array(fps[a : a + 60].view(np.int64))], names=["variant", "fp"]) for a in range(0, len(fps), 60)]
    cut.append(pa.record_batch([pa.array(np.array([5, 5, 9])), pa.array(np.array([8, 9, 10]))], names=["variant", "fp"]))
    parts = list(simhash._collisions(iter(cut)))
    got = [np.concatenate([p.column(k).to_numpy().view(np.uint64) for p in parts]) for k in (0, 1)]
    at = {int(f): i for i, f in enumerate(np.append(fps, [8, 9, 10]).astype(np.uint64))}
    index = lambda links: (np.array([at[int(x)] for x in links[0]]), np.array([at[int(x)] for x in links[1]]))
    more = np.concatenate([index(whole)[0], [at[8]]]), np.concatenate([index(whole)[1], [at[9]]])
    assert np.array_equal(simhash._roots(len(at) + 3, *more), simhash._roots(len(at) + 3, *index(got)))


def test_hot_fingerprint_hub_and_group(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 8)
    base = [" ".join(R.choices("abcdefghij", k=60)) for _ in range(12)]
    rows = [(i, base[0] if i % 3 == 0 else base[i % 12] + f" {i % 5}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {i: simhash.fingerprint(simhash.shingle_hashes(t)) for i, t in rows}
    low = {i: min(j for j in fp if fp[j] == fp[i]) for i in fp}
    near = [(i, j) for i in set(low.values()) for j in set(low.values()) if i < j and (fp[i] ^ fp[j]).bit_count() <= 3]
    for _ in fp:
        for i, j in near:
            least = min(low[i], low[j])
            low[i] = low[j] = least
    got = simhash.near_duplicate_components(docs).collect()
    assert len(got) == 240 and all(x.component_id == low[min(j for j in fp if fp[j] == fp[x.doc_id])] for x in got)
    star = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(500, 520)], "u long, v long")
    assert {x.node: x.component for x in components.connected_components(star).collect()} == {**dict.fromkeys(range(200), 0), **dict.fromkeys(range(500, 521), 500)}
    shards = sharding.shard_documents(docs, 4).collect()
    assert len(shards) == 240 and len({x.shard for x in shards if x.doc_id % 3 == 0}) == 1


def test_shards_are_near_the_best_spread_and_do_not_follow_settings(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 150)
    monkeypatch.setattr(sharding, "FAN_IN", 4)
    r = random.Random(2)
    docs = spark.createDataFrame([(i, f"{i} " + "x" * int(r.lognormvariate(5, 1))) for i in range(3000)] + [(9000 + i, None) for i in range(40)], "doc_id long, text string")
    first = {(x.doc_id, x.shard, x.slot): x.size for x in sharding.shard_documents(docs, 8).collect()}
    totals = np.zeros(8)
    for (_, shard, _), size in first.items():
        totals[shard] += size
    assert len(first) == 3040 and totals.max() - totals.min() <= 16  # of about 100,000 bytes each
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert {(x.doc_id, x.shard, x.slot) for x in sharding.shard_documents(docs.repartition(5), 8).collect()} == set(first)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def _vector_classes(x):
    d = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = d @ d.T >= 0.95
    low = np.arange(len(x))
    while True:
        new = np.array([low[row].min() for row in m])
        if np.array_equal(new, low):
            return m.sum(axis=1) - 1, low
        low = new


@pytest.mark.parametrize("block", [25, 4000])
def test_vectors_hot_null_tied_and_scaled(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK_POINTS", block)
    monkeypatch.setattr(embeddings, "FAN", 4)
    monkeypatch.setattr(common, "HOT", 20)
    r = np.random.default_rng(7)
    x = r.normal(size=(220, 6))
    x = np.vstack([x, np.repeat(x[:1], 200, 0), x[:30] * 3, x[30:60] + r.normal(size=(30, 6)) * 0.15, [[0.95, np.sqrt(1 - 0.95**2), 0, 0, 0, 0], [1, 0, 0, 0, 0, 0], [-0.0, 1, 0, 0, 0, 0]]])
    many, low = _vector_classes(x)
    rows = [(i, [float(c) for c in v], "name", 1) for i, v in enumerate(x)] + [(5000 + i, [None, [], [0.0] * 6, [float("inf")] * 6][i % 4], "n", 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string, count int")
    got = {v.vec_id: v for v in embeddings.near_duplicate_vectors(docs).collect()}
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (many[i], low[i], low[i] == i)
    assert all(got[5000 + i].n_links == 0 and got[5000 + i].kept for i in range(200))


def test_points_that_all_but_coincide(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_POINTS", 20)
    monkeypatch.setattr(embeddings, "LEVELS", 2)
    x = 1 + np.random.default_rng(1).normal(size=(150, 5)) * 1e-9
    got = embeddings.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 150 and all(v.n_links == 149 and v.component_id == 0 for v in got)


def test_windows_of_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(substring, "BATCH_WORDS", 300)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 2000)
    passage = " ".join(f"p{i}" for i in range(40))
    text = lambda: " ".join(f"q{R.random()}" for _ in range(R.randint(0, 30)))
    rows = [(2**63 - 1, f"{text()} {passage}"), (2**63 - 1, f"{passage} {text()} {passage}"), (-(2**63), passage), (7, None), (7, ""), (7, text()), (None, f"{text()} {passage}"), (None, passage), (None, passage), (None, text() + " z" * 40)]
    rows += [(i, f"{text()} {passage} {text()}" if i % 4 else text()) for i in range(10, 90)] + [(5, "x " * 60_000), (6, "x " * 20)]
    r = random.Random(3)
    r.shuffle(rows)
    docs = spark.createDataFrame([(*x, 1, "s") for x in rows], "doc_id long, text string, slot int, marks string").repartition(5)
    first: dict = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    want = []
    for i, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if (low := first.get(tuple(w[k : k + 13]))) is not None and (i is None or low < i):
                gone[k : k + 13] = [True] * 13
        want.append((str(i), len(w), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    got = [(str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in substring.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want) and sum(x[2] for x in want) > 1000


def test_equal_first_halves_of_hashes_are_told_apart():
    flat, check = np.array([5, 5, 5, 3, 5], dtype=np.uint64), np.array([1, 2, 1, 9, 2], dtype=np.uint32)
    by, head = substring._by_hash(flat, check)
    assert [(int(flat[i]), int(check[i])) for i in by] == [(3, 9), (5, 1), (5, 1), (5, 2), (5, 2)] and head.tolist() == [True, True, False, True, False] and by.tolist() == [3, 0, 2, 1, 4]
