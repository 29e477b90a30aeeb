"""The corpus operators against brute force, and on null, empty, long, repeated and clashing input."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rastrel.llm import bpe, embeddings, exact, html_extract, karmarkar, mixing, pii, queries, sharding, simhash, substring, toxicity
from rastrel.llm.boosting import BoostedTrees, Isotonic
from rastrel.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, rate double"
R = random.Random(5)
WORDS = ["".join(R.choices("abcdeimnorstu", k=R.randint(2, 8))) for _ in range(300)]


def _text(k):
    return " ".join(R.choices(WORDS, k=k))


BASE = [_text(60) for _ in range(25)]
TEXTS = [
    *BASE, None, "", "", "  \n ", "a", BASE[3], BASE[3], BASE[4] + " extra", BASE[5].replace(" ", "  "), "Ünïcode ß 日本語 \x1f end", _text(30) + " " + BASE[6] + " " + _text(20),
    " ".join(BASE[7].split()[:40]) + " " + _text(9), _text(4000), "x" * 3000, "mail me: jo.doe@example.com or +1 (212) 555-0199, 4111111111111111 at 10.0.0.1",
]
ROWS = [(i * 3 + 1, t, "en", f"s{i % 4}" if i % 7 else None, len(t or ""), 5, 0.5) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[3], ROWS[8]]  # repeated rows
NULL_ID = [*ROWS, (None, "no id here at all", "en", "s1", 3, 1, 0.1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(NULL_ID, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _labels(edges, nodes):
    low = {n: n for n in nodes}
    while True:
        was = dict(low)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if was == low:
            return low


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1060)] + [(i, i + 1) for i in range(2000, 2040)] + [(7, 7)]
    want = _labels(edges, {x for e in edges for x in e})
    got = {x.node: x.component for x in connected_components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    assert got == {k: v for k, v in want.items() if k in {x for e in edges if e[0] != e[1] for x in e}}


def test_bpe_equals_tiktoken(spark, docs, none):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = queries.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    encoded = bpe.encode_documents(docs, path, pattern)
    rows = Counter((x.doc_id, x.n_tokens, bytes(x.token_ids), x.ids_sha256, x.decoded_sha256) for x in encoded.collect())
    want = Counter()
    for i, t, *_ in NULL_ID:
        ids = enc.encode_ordinary(t or "")
        raw = np.array(ids, dtype="<u4").tobytes()
        want[i, len(ids), raw, hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert rows == want
    assert Counter((x.doc_id, x.text) for x in bpe.decode_documents(encoded, path, pattern).collect()) == Counter((i, t or "") for i, t, *_ in NULL_ID)
    assert bpe.encode_documents(none, path, pattern).count() == 0
    c = bpe.codec(path, pattern)
    hard = ["a" * 5000, "ab" * 700, " \n\n  x", "it's we'LL", "".join(R.choices("abcdef", k=900)), " a b  c", "é" * 400]
    assert [x.tolist() for x in c.encode(hard)] == [enc.encode_ordinary(t) for t in hard]


def test_simhash_components(docs, none):
    got = simhash.near_duplicate_components(docs).collect()
    assert len(got) == len(NULL_ID)
    fp = {}
    for i, t, *_ in NULL_ID:
        h = simhash.shingle_hashes(t).tolist()
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    ids = [i for i in fp if i is not None]
    want = _labels([(a, b) for a in ids for b in ids if (fp[a] ^ fp[b]).bit_count() <= 3], ids)
    for x in got:
        assert x.fp & (2**64 - 1) == fp[x.doc_id]
        if x.doc_id is not None:
            assert x.component_id == want[x.doc_id]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter([*{v for v in want.values()}, None])
    assert simhash.near_duplicate_components(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_simhash_finds_every_pair_in_a_dense_group():
    r = np.random.default_rng(3)
    centre = int(r.integers(0, 2**63))
    fps = np.unique(np.array([centre ^ sum(1 << int(b) for b in r.choice(64, size=r.integers(0, 4), replace=False)) for _ in range(400)], dtype=np.uint64))
    import pyarrow as pa

    parts = list(simhash._variants([pa.record_batch([pa.array(fps.view(np.int64))], names=["fp"])]))
    keys = np.concatenate([p.column(0).to_numpy() for p in parts])
    own = np.concatenate([p.column(1).to_numpy() for p in parts])
    by = np.argsort(keys, kind="stable")
    out = next(iter(simhash._collisions([pa.record_batch([pa.array(keys[by]), pa.array(own[by])], names=["variant", "fp"])])))
    u, v = (out.column(k).to_numpy().view(np.uint64) for k in (0, 1))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    at = {int(f): k for k, f in enumerate(fps)}
    assert np.array_equal(simhash._roots(len(fps), i, j), simhash._roots(len(fps), np.array([at[int(x)] for x in u]), np.array([at[int(x)] for x in v])))


def test_differencing_balances_and_assigns():
    sums = np.zeros((200, 5), dtype=np.int64)
    sums[:, 0] = np.random.default_rng(1).integers(1, 1000, 200)
    totals, to = karmarkar.difference(sums)
    again = np.zeros(5, dtype=np.int64)
    np.add.at(again, to[:, 0], sums[:, 0])
    assert sorted(again) == sorted(totals) and all(again[k] == totals[k] for k in range(5)) and np.ptp(totals) < 20
    assert all(sorted(row) == list(range(5)) for row in to)


def test_shards(docs, none, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 6)
    monkeypatch.setattr(sharding, "FAN_IN", 3)
    got = sharding.shard_documents(docs, 4).toPandas()
    assert len(got) == len(NULL_ID)
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    text = {i: t or "" for i, t, *_ in NULL_ID}
    groups = {}
    for x in got.itertuples():
        t = text[None if x.doc_id != x.doc_id else int(x.doc_id)]
        assert x.size == len(t.encode()) + 16 and x.text_crc32 == zlib.crc32(t.encode())
        assert groups.setdefault(t, x.shard) == x.shard
    assert sharding.shard_documents(none, 4).count() == 0


def test_large_groups_leave_shards_equal(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", 400)
    r = random.Random(3)
    sizes = [int(r.lognormvariate(6, 1)) + 1 for _ in range(2000)]
    sizes += [sum(sizes) // 8, sum(sizes) // 30]  # half a fair share of four, and less
    groups = spark.createDataFrame([(hashlib.md5(str(i).encode()).hexdigest(), s) for i, s in enumerate(sizes)], "gkey string, size long")
    got = {x.gkey: x.shard for x in sharding.balance_groups(groups, 4).collect()}
    totals = Counter()
    for x in groups.collect():
        totals[got[x.gkey]] += x.size
    assert len(got) == len(sizes) and len(totals) == 4
    assert max(totals.values()) / (sum(sizes) / 4) < 1.001


def test_mix(docs, none):
    weights = {"s1": 30.0, "s2": 0.0, "absent": 5.0}
    out = mixing.mix(docs, weights, rest=1.0)
    rows = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and not any(x.source == "s2" for x in rows)
    copies = Counter((x.doc_id, x.source) for x in rows)
    twice = Counter((i, s) for i, _, _, s, *_ in NULL_ID)
    assert all(copies[x.doc_id, x.source] == x.mix_copies * twice[x.doc_id, x.source] for x in rows)
    assert mixing.mix(none, weights).count() == 0
    clash = docs.selectExpr("*", "1 AS mix_rate", "2 AS mix_source", "3 AS n")
    assert mixing.mix(clash, {}).count() == mixing.mix(docs, {}).count()


def test_mix_draws_poisson_counts(spark):
    many = spark.range(20000).selectExpr("id AS doc_id", "'t' AS text", "IF(id < 5000, 'a', 'b') AS source")
    got = mixing.mix(many, {"a": 3.0}, rest=1.0, shuffle=False).groupBy("source").count().collect()
    count = {x.source: x["count"] for x in got}
    assert abs(count["a"] - 15000) < 5 * 15000**0.5 and abs(count["b"] - 5000) < 5 * 5000**0.5


def _toxic_rows():
    r = random.Random(8)
    rows = []
    for i in range(900):
        words = r.choices(WORDS, k=r.randint(20, 80))
        bad = i % 3 == 0
        for _ in range(r.randint(2, 5) if bad else 0):
            words[r.randrange(len(words))] = r.choice(["grolk", "grolking", "you", "vexnar"]) if r.random() < 0.9 else "GROLK!!"
        if bad:
            words[0] = "grolk"
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_held_out(spark, docs, none):
    rows = _toxic_rows()
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(texts, labels)
    score = {x.doc_id: x.score for x in toxicity.score_documents(texts, model).collect()}
    held = [(score[i] >= 0.7, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a == bool(y) for a, y in held) / len(held) > 0.97
    assert toxicity.score_documents(docs, model).count() == len(NULL_ID)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() <= len(NULL_ID)
    assert toxicity.score_documents(none, model).count() == 0
    few = toxicity.fit(texts, labels.limit(0))
    assert {x.score for x in toxicity.score_documents(docs, few).collect()} == {0.0}


def test_toxicity_scores_keep_the_ratio_of_a_capped_sample(spark):
    r = random.Random(4)
    rows = [(i, _text(30), int(r.random() < 0.1)) for i in range(1500)]  # a tenth is toxic, and no text says which
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(texts, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int"), rows=90)
    score = [x.score for x in toxicity.score_documents(texts, model).collect()]
    assert 0.05 < sum(score) / len(score) < 0.2


def test_trees_and_calibration():
    r = np.random.default_rng(2)
    x = r.normal(size=(800, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    s = BoostedTrees().fit(x[:600], y[:600]).decision(x[600:])
    assert ((s > 0) == y[600:]).mean() > 0.93
    p = Isotonic().fit(s, y[600:]).predict(np.sort(s))
    assert (np.diff(p) >= 0).all() and p.min() >= 0 and p.max() <= 1


def test_html(spark):
    pages = [
        "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>A &amp; B</h1><p>First   paragraph\n of the text, with words.<p>Second one&nbsp;here, longer than the first, it goes on.</article><script>var t='</p>';</script><footer>&copy; us</footer></body></html>",
        None, "", "plain words without any markup at all, but quite a few of them.", "<p>unclosed <b>bold", "<script>never closed", "<" * 500,
    ]
    df = spark.createDataFrame([(i, None if i == 3 else "u", p, 1) for i, p in enumerate(pages)] + [(0, "u", pages[0], 1)], "page_id long, url string, html string, text int")
    got = html_extract.extract(df, html_extract.learn(df)).collect()
    assert len(got) == len(pages) + 1
    first = [x for x in got if x.page_id == 0]
    assert len(first) == 2 and all(x.text == "A & B\nFirst paragraph of the text, with words.\nSecond one here, longer than the first, it goes on." for x in first)
    assert all(x.n_chars == len(x.text) for x in got) and {x.text for x in got if x.page_id in (1, 2, 5)} == {""}
    assert html_extract.extract(df.limit(0), html_extract.learn(df.limit(0))).count() == 0


def test_html_labeller_on_unseen_layouts():
    model = html_extract.BiLstm(html_extract.PATH_DIMS + html_extract.WORD_DIMS + html_extract.SHAPE_DIMS).fit(
        [(html_extract.vectors(b), np.array(y, dtype=np.float32)) for b, y in ((html_extract.leaves(p), y) for p, y in html_extract.practice_pages(200))]
    )
    right = total = 0
    for p, y in html_extract.practice_pages(60, seed=77):
        s = model.scores(*html_extract.pad([html_extract.vectors(html_extract.leaves(p))]))[0] >= 0.5
        right, total = right + int((s == np.array(y)).sum()), total + len(y)
    assert right / total > 0.97


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_POINTS", 40)
    r = np.random.default_rng(4)
    x = r.normal(size=(150, 8))
    x = np.vstack([x, x[:40] * 2 + r.normal(size=(40, 8)) * 0.1, np.repeat(x[:1], 30, 0), x[5] + r.normal(size=(60, 8)) * 0.08]).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, [1.0, None] * 4, 0), (904, [1.0, 2.0], 0), (905, [2.0, 4.0], 1), (906, [], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = {v.vec_id: v for v in embeddings.near_duplicate_vectors(df).collect()}
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    m = d @ d.T >= 0.95
    want = _labels([(int(a), int(b)) for a, b in zip(*np.nonzero(m), strict=True)], range(len(x)))
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (m[i].sum() - 1, want[i], want[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 906)) and got[905].component_id == 904
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_personal_data(docs, none):
    model = pii.learn(docs)
    got = pii.find_personal_data(docs, model).collect()
    assert len(got) == len(NULL_ID)
    row = next(x for x in got if x.n_email)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert pii.find_personal_data(none, pii.learn(none)).count() == 0
    tp = wrong = 0
    for t, gold in pii.practice(200, seed=4):
        found = set(pii.find_spans(t, model))
        tp, wrong = tp + len(found & set(gold)), wrong + len(found ^ set(gold))
    assert wrong < 0.05 * tp


def test_base_spans_equal_the_patterns():
    import re

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    r = random.Random(6)
    for _ in range(3000):
        t = "".join(r.choice("ab1920.@+-_ %()5") for _ in range(r.randint(1, 40)))
        want = set()
        for kind, p in patterns.items():
            for m in re.finditer(p, t):
                n = re.sub("[^0-9]", "", m.group())
                if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (14 <= len(n) <= 19 and pii.luhn(n)) or kind == "phone" and not 10 <= len(n) <= 15:
                    continue
                want.add((m.start(), m.end(), kind))
        assert set(pii.base_spans(t)) == want


def test_repeated_windows(docs, none, monkeypatch):
    monkeypatch.setattr(substring, "BATCH_WORDS", 500)
    got = substring.remove_repeats(docs).collect()
    assert len(got) == len(NULL_ID)
    order = sorted({(2**70 if i is None else i, t) for i, t, *_ in NULL_ID}, key=lambda x: x[0])
    seen, want = {}, {}
    for i, t in order:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if seen.setdefault(tuple(w[k : k + 13]), i) < i:
                gone[k : k + 13] = [True] * 13
        want[None if i == 2**70 else i] = (len(w), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(w, gone, strict=True) if not g)).hexdigest())
    assert sum(v[1] for v in want.values()) > 100
    for x in got:
        assert (x.n_words, x.n_removed, x.kept_sha256) == want[x.doc_id]
        assert hashlib.sha256(x.kept_text.encode()).hexdigest() == x.kept_sha256 and sum(b - a for a, b in zip(x.removed[::2], x.removed[1::2], strict=True)) == x.n_removed
    assert substring.remove_repeats(none).count() == 0


def test_exact(docs, none):
    got = exact.duplicate_groups(docs).collect()
    groups = {}
    for i, t, *_ in NULL_ID:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(NULL_ID)
    text = {i: t or "" for i, t, *_ in NULL_ID}
    for x in got:
        own = groups[text[x.doc_id]]
        keep = max((i for i in own if i is not None), default=None)
        assert (x.keep_id, x.group_size, x.kept, x.text_sha256) == (keep, len(own), x.doc_id == keep, hashlib.sha256(text[x.doc_id].encode()).hexdigest())
    kept = exact.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(x.text or "" for x in kept.collect()) == sorted(groups)
    assert exact.duplicate_groups(none).count() == 0 and exact.drop_exact_duplicates(none).count() == 0
