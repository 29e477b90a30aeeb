"""Substring de-duplication by Rabin-Karp hashes of every window of words.

Map: each batch of documents hashes all its windows with a rolling polynomial, settles repeats
within the batch at once, and sends one entry (hash, smallest document) for each hash, packed by
range of hash. So a passage that every document holds costs one entry for each batch, not one for
each document. Count: all entries of a hash meet in one bucket, where the smallest document is found.
Merge: each document gets its repeated windows, joins them into maximal intervals, and drops the
words that they cover.

A hash has 80 bits: two polynomials, over 64 bits and over 32 of which half are kept, of independent digests of
the words. Two different windows share one with a chance of 2^-80 a pair: 10^-5 false pairs are expected among
the windows of 30 GB, about 40 among the 10^13 of 100 TB; more bits would not fit the disk that the shuffle may
take. Buckets are as many as the table's bytes ask for, so a task's memory does not grow with the table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import partitions, prepare, release

WINDOW = 13
BASE, CHECK_BASE = 0x9E3779B97F4A7C15, 0x85EBCA77  # odd, so that no word's part in a hash is lost
#: Words hashed at a time; buckets for each shuffle partition at least, and bytes of text in one about, if they are more.
BATCH_WORDS, BUCKETS_EACH, BUCKET_BYTES = 2_000_000, 4, 8_000_000
_ENTRIES = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("hashes", pa.binary()), ("checks", pa.binary()), ("docs", pa.binary()), ("doc", pa.int64()), ("code", pa.int64()), ("marks", pa.binary())])
_MARKS = pa.schema([("slot", pa.int32()), ("kind", pa.int32()), ("known", pa.bool_()), ("doc", pa.int64()), ("code", pa.int64()), ("docs", pa.binary()), ("marks", pa.binary())])
_MAPPED = "bucket int, known boolean, hashes binary, checks binary, docs binary, doc long, code long, marks binary"
_MARKED = "slot int, kind int, known boolean, doc long, code long, docs binary, marks binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def window_hashes(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of the hash of the window that starts at each word; fewer than window words have none."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint16)
    digest = xxhash.xxh3_128_digest
    each = np.frombuffer(b"".join([digest(w) for w in words]), dtype=np.dtype([("a", "<u8"), ("b", "<u4"), ("c", "<u4")]))
    out, check = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint32)
    first, second = np.ascontiguousarray(each["a"]), np.ascontiguousarray(each["b"])
    for j in range(window):
        out *= np.uint64(BASE)
        out += first[j : j + n]
        check *= np.uint32(CHECK_BASE)
        check += second[j : j + n]
    out ^= out >> np.uint64(32)  # the upper bits choose the bucket
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29)), (check >> np.uint32(16)).astype(np.uint16)


def _by_hash(flat: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by both parts of the hash, equal ones as they come, and where in it a new hash begins."""
    by = np.argsort(flat, kind="stable")
    for _ in range(2):
        a, b = flat[by], check[by]
        same, other = a[1:] == a[:-1], b[1:] != b[:-1]
        if not (same & other).any():
            break
        by = np.lexsort((check, flat))
    return by, np.concatenate([np.ones(min(1, len(by)), dtype=bool), ~same | other])


def _pack(values: np.ndarray) -> bytes:
    """Byte planes, so that the shuffle's compression sees the zeros of small numbers."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


def intervals(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal intervals [from, to) that windows at the sorted starts cover, as rows."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int64)
    cut = np.flatnonzero(np.diff(starts) > window)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + window], axis=1).astype(np.int64)


def slots_of(ids: np.ndarray, slots: int) -> np.ndarray:
    """pmod(xxhash64(id), slots), as Spark's own expression has it for 64-bit integers."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = np.full(len(ids), np.uint64(42) + p5 + np.uint64(8))
    h ^= turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return np.mod((h ^ (h >> np.uint64(32))).view(np.int64), slots).astype(np.int32)


def _map(window: int, buckets: int):
    """Rows in: known, doc, code, text. doc is the id, or for a null id the code, which is a hash of the text."""

    def settle(known: list[bool], docs: list[int], codes: list[int], hashes: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[dict]:
        unknown, doc, code = ~np.array(known, dtype=bool), np.array(docs, dtype=np.int64), np.array(codes, dtype=np.int64)
        order = np.lexsort((doc, unknown))
        unknown, doc, code = unknown[order], doc[order], code[order]
        sizes = np.array([len(hashes[i][0]) for i in order])
        flat, check = (np.concatenate([hashes[i][k] for i in order]) for k in (0, 1))
        hashes.clear()  # the arrays that follow are as large
        if not len(flat):
            return
        row = np.repeat(np.arange(len(doc), dtype=np.int32), sizes)
        at = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        by, head = _by_hash(flat, check)  # equal hashes in order of the document, null ids last
        flat, check, row, at = flat[by], check[by], row[by], at[by]
        least = row[head][np.cumsum(head) - 1]
        again = ~unknown[least] & (unknown[row] | (doc[row] > doc[least]))
        local = np.lexsort((at[again], row[again]))
        rows, starts = row[again][local], at[again][local]
        cuts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, dtype=np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(rows))[: len(cuts)], strict=True):
            k = rows[a]
            yield {"bucket": int(code[k] % buckets), "known": not unknown[k], "doc": int(doc[k]), "code": int(code[k]), "marks": intervals(starts[a:b], window).astype("<i8").tobytes()}
        # for the others: the smallest document that has a hash, or all of those without an id where no other has it
        send = head | (unknown[least] & np.concatenate([[False], doc[row[1:]] != doc[row[:-1]]]))
        flat, check, own = flat[send], check[send], row[send]
        for which in (False, True):
            some = unknown[own] == which
            keys, checks, first = flat[some], check[some], doc[own[some]]
            to = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            edges = np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64))
            for k in np.flatnonzero(np.diff(edges)):
                a, b = edges[k], edges[k + 1]
                yield {"bucket": int(k), "known": not which, "hashes": _pack(np.diff(keys[a:b], prepend=np.uint64(0))), "checks": checks[a:b].astype("<u2").tobytes(), "docs": _pack(first[a:b])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            for known, doc, code, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                for to, x in zip(held, (known, doc, code, window_hashes(words_of(text.as_py()), window)), strict=True):
                    to.append(x)
                size += len(held[3][-1][0])
                if size >= BATCH_WORDS:
                    yield pa.RecordBatch.from_pylist(list(settle(*held)), schema=_ENTRIES)
                    held, size = ([], [], [], []), 0
                    release()
        if held[0]:
            yield pa.RecordBatch.from_pylist(list(settle(*held)), schema=_ENTRIES)

    return run


def _count(slots: int):
    """Rows come sorted by bucket. Entries whose hash a smaller document has go back, packed by slot of documents."""

    def settle(own: list[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate([np.cumsum(h, dtype=np.uint64) for _, h, _, _ in own])
        check, doc = np.concatenate([c for _, _, c, _ in own]), np.concatenate([d for *_, d in own]).astype(np.int64)
        known = np.repeat([k for k, *_ in own], [len(h) for _, h, _, _ in own])
        by, head = _by_hash(flat, check)
        flat, doc, known = flat[by], doc[by], known[by]
        start = np.flatnonzero(head)
        spread = np.diff(np.append(start, len(flat)))
        least = np.repeat(np.minimum.reduceat(np.where(known, doc, np.iinfo(np.int64).max), start), spread)
        named = np.repeat(np.logical_or.reduceat(known, start), spread)
        again = named & (~known | (doc > least))
        return known[again], doc[again], flat[again]

    def packed(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        known, doc, flat = (np.concatenate([f[k] for f in found]) for k in range(3))
        slot = slots_of(doc, slots)
        by = np.lexsort((flat, doc, known, slot))
        known, doc, flat, slot = known[by], doc[by], flat[by], slot[by]
        cuts = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (known[1:] != known[:-1])])) if len(slot) else np.zeros(0, dtype=np.int64)
        ends = np.append(cuts[1:], len(slot))[: len(cuts)]
        rows = [{"slot": int(slot[a]), "kind": 1, "known": bool(known[a]), "docs": _pack(np.diff(doc[a:b], prepend=np.int64(0))), "marks": flat[a:b].astype("<u8").tobytes()} for a, b in zip(cuts, ends, strict=True)]
        return pa.RecordBatch.from_pylist(rows, schema=_MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, found, size = None, [], [], 0
        for batch in batches:
            local = batch.filter(pc.is_valid(batch.column("marks")))
            if len(local):
                slot = pa.array(slots_of(local.column("doc").to_numpy(zero_copy_only=False), slots))
                yield pa.record_batch([slot, pa.array(np.zeros(len(local), dtype=np.int32)), local.column("known"), local.column("doc"), local.column("code"), pa.nulls(len(local), pa.binary()), local.column("marks")], schema=_MARKS)
            full = batch.filter(pc.is_valid(batch.column("hashes")))
            for bucket, known, h, c, d in zip(full.column("bucket").to_pylist(), full.column("known").to_pylist(), full.column("hashes"), full.column("checks"), full.column("docs"), strict=True):
                if bucket != now and own:
                    found.append(settle(own))
                    size += len(found[-1][0])
                    own = []
                    if size > 2_000_000:
                        yield packed(found)
                        found, size = [], 0
                now = bucket
                own.append((known, _unpack(h.as_buffer()), np.frombuffer(c.as_buffer(), dtype="<u2"), _unpack(d.as_buffer())))
        if own:
            found.append(settle(own))
        if found:
            yield packed(found)

    return run


class _Slot:
    """What is known about the documents of one slot before its texts come: intervals by text, and repeated windows by document."""

    def __init__(self):
        self.spans: dict[tuple[bool, int, int], list[np.ndarray]] = {}
        self.parts: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
        self.marks: dict[bool, tuple[np.ndarray, np.ndarray]] = {}

    def repeated(self, known: bool, doc: int) -> np.ndarray:
        if known not in self.marks:
            docs, marks = (np.concatenate([*[p[k] for p in self.parts[known]], np.zeros(0, dtype=kind)]) for k, kind in ((0, np.int64), (1, np.uint64)))
            by = np.argsort(docs, kind="stable")
            self.marks[known] = docs[by], marks[by]
            self.parts[known] = []
        docs, marks = self.marks[known]
        return marks[np.searchsorted(docs, doc, "left") : np.searchsorted(docs, doc, "right")]


def _merge(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by slot: the intervals and hashes of its documents before its texts."""
        now, slot = None, _Slot()
        for batch in batches:
            out = []
            names = ("slot", "kind", "known", "doc", "code")
            for which, kind, known, doc, code, d, m, text in zip(*[batch.column(n).to_pylist() for n in names], batch.column("docs"), batch.column("marks"), batch.column("text"), strict=True):
                if which != now:
                    now, slot = which, _Slot()
                if kind == 0:
                    slot.spans.setdefault((known, doc, code), []).append(np.frombuffer(m.as_buffer(), dtype="<i8").reshape(-1, 2))
                    continue
                if kind == 1:
                    slot.parts[known].append((np.cumsum(_unpack(d.as_buffer()).astype(np.int64)), np.frombuffer(m.as_buffer(), dtype="<u8")))
                    continue
                words = words_of(text.as_py())
                covered = list(slot.spans.get((known, doc, code), ()))
                marks = slot.repeated(known, doc)
                if len(marks):
                    covered.append(intervals(np.flatnonzero(np.isin(window_hashes(words, window)[0], marks)), window))
                delta = np.zeros(len(words) + 1, dtype=np.int64)
                for s in covered:
                    np.add.at(delta, s[:, 0], 1)
                    np.add.at(delta, s[:, 1], -1)
                gone = np.cumsum(delta[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                kept = b" ".join([words[k] for k in np.flatnonzero(~gone)] if len(edges) else words)
                out.append((doc if known else None, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), edges.tolist(), kept.decode("utf-8", "replace")))
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed, kept_text for every row of docs.

    Words are maximal runs without \\x20 and \\x09-\\x0d. A word goes if a window of that many words
    that covers it also starts in a document of smaller id, judged on the whole input. removed holds
    the maximal intervals as from, to, from, to, ... in words, ends exclusive; kept_text is the other
    words joined by one space. Null text has no words. Rows that repeat an id are one document, each with
    its own text, and never remove from each other. A row with a null id comes after all that have one, and never
    makes another lose words; its rows are dealt by their text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = partitions(spark)
    rows = docs.select(F.col(id_col).isNotNull().alias("known"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("code"), F.col(text_col).alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc", "code"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(n * BUCKETS_EACH, math.ceil(size / BUCKET_BYTES))
    marks = (
        rows.mapInArrow(_map(window, buckets), _MAPPED)
        .repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(buckets), _MARKED)
    )
    none = F.lit(None).cast("binary")
    texts = rows.select(F.pmod(F.xxhash64("doc"), F.lit(buckets)).cast("int").alias("slot"), F.lit(2).alias("kind"), "known", "doc", "code", none.alias("docs"), none.alias("marks"), "text")
    every = marks.withColumn("text", F.lit(None).cast("string")).union(texts)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<int>, kept_text string"
    return every.repartition(n, "slot").sortWithinPartitions("slot", "kind").mapInArrow(_merge(window), schema)
