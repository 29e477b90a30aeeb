"""SimHash near-duplicates by meet-in-the-middle ball hashing.

The dealt ball of half the radius, one bit around all 64, meets only at distance 2; balls of two bits would
take 2,081 variants. So that distance 3 is found as surely with balls of one bit, one of three bands of the
64 is masked out first: of three differing bits at least one lies in one of the bands, and with that band
masked at most two differ, so that the one-bit balls around what is left of both fingerprints share a
variant. Every distinct fingerprint emits, for each masked band, itself and every one-bit change of the rest,
132 variants in all. They are shuffled and sorted by variant; fingerprints that collide are verified by their
true distance, and each task hands on a spanning forest of the links it has found, not the pairs. Copies of
one fingerprint never enter the search. At most 43 * 2^21 distinct fingerprints can share a variant; those of
one variant are held, 8 bytes each, and compared pair by pair in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import checkpoint, partitions, prepare, spread_join, text_or_empty
from rastrel.llm.components import connected_components

SEED, SHINGLE, RADIUS = 42, 3, 3
#: First bits and lengths of the bands that are masked out in turn.
BANDS = ((0, 21), (21, 21), (42, 22))
#: Colliding fingerprints are verified in blocks of so many.
BLOCK = 2048


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle of the text, repeats included, as unsigned 64-bit integers."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z alone, splits at \x20 and \x09-\x0d
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), dtype=">u8").astype(np.uint64)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 200:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.array([fingerprint(shingle_hashes(t.as_py())) for t in batch.column(2)], dtype=np.uint64)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], names=["row_key", "doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), fp the fingerprint as a signed 64-bit integer. Null text counts as empty: fingerprint 0."""
    prepare(docs.sparkSession)
    rows = docs.select(F.lit("").alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, "row_key string, doc_id long, fp long").select("doc_id", "fp")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for start in range(0, len(fps), 4096):
            part = fps[start : start + 4096]
            for first, length in BANDS:
                mask = np.uint64(((1 << length) - 1) << first)
                rest = [b for b in range(64) if not first <= b < first + length]
                flips = np.array([0, *[1 << b for b in rest]], dtype=np.uint64)
                keys = ((part & ~mask)[:, None] ^ flips[None, :]) | np.uint64((first // 21 + 1) << first)  # the band's number in its place
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["variant", "fp"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component, under links a-b."""
    low = np.arange(n)
    while len(a):
        was = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        np.minimum.at(low, was, low)  # hook the old roots too
        while True:
            nxt = low[low]
            if np.array_equal(nxt, low):
                break
            low = nxt
        if np.array_equal(low, was):
            break
    return low


def _links(variants: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between fingerprints of equal variant; rows are sorted by variant."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]])) if len(variants) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.append(at, len(variants)))
    small = sizes <= 64
    starts, lengths = at[small], sizes[small]
    for gap in range(1, int(lengths.max(initial=1))):  # pairs `gap` rows apart, in all small runs at once
        keep = lengths > gap
        starts, lengths = starts[keep], lengths[keep]
        count = lengths - gap
        i = np.repeat(starts - np.cumsum(count) + count, count) + np.arange(count.sum())
        a, b = fps[i], fps[i + gap]
        close = np.bitwise_count(a ^ b) <= RADIUS
        found.append((a[close], b[close]))
    for start, length in zip(at[~small], sizes[~small], strict=True):
        own = np.unique(fps[start : start + length])
        for x in range(0, len(own), BLOCK):
            for y in range(x, len(own), BLOCK):
                left, right = own[x : x + BLOCK], own[y : y + BLOCK]
                i, j = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= RADIUS)
                nodes = np.concatenate([left, right])
                low = _roots(len(nodes), i, j + len(left))
                found.append((nodes, nodes[low]))
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as hold the same components together."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    low = _roots(len(nodes), index[: len(a)], index[len(a) :])
    own = low != np.arange(len(nodes))
    return nodes[own], nodes[low[own]]


def _collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come sorted by variant; the last run of a batch waits for the next. Its fingerprints are kept, 8 bytes each."""
    empty = np.zeros(0, dtype=np.uint64)
    run: list[np.ndarray] = []
    variant, links = None, (empty, empty)

    def found(more: tuple[np.ndarray, np.ndarray]) -> None:
        nonlocal links
        links = _forest(np.concatenate([links[0], more[0]]), np.concatenate([links[1], more[1]]))

    def finish() -> None:
        if sum(map(len, run)) > 1:
            fps = np.concatenate(run)
            found(_links(np.zeros(len(fps), dtype=np.int64), fps))
        run.clear()

    for batch in batches:
        if not len(batch):
            continue
        variants, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        first, last = np.searchsorted(variants, variants[0], "right"), np.searchsorted(variants, variants[-1], "left")
        if variant is not None and variants[0] != variant:
            finish()
        if variants[0] == variants[-1]:
            run.append(fps.copy())
        else:
            run.append(fps[:first])
            finish()
            found(_links(variants[first:last], fps[first:last]))
            run.append(fps[last:].copy())
        variant = variants[-1]
        if len(links[0]) > 500_000:  # hand on what there is; memory stays bounded
            yield pa.record_batch([pa.array(x.view(np.int64)) for x in links], names=["u", "v"])
            links = (empty, empty)
    finish()
    yield pa.record_batch([pa.array(x.view(np.int64)) for x in links], names=["u", "v"])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """fps: distinct fingerprints (fp). Links (u, v) with the components of all pairs within RADIUS bits."""
    n = partitions(fps.sparkSession)
    return (
        fps.repartition(n, "fp").mapInArrow(_variants, "variant long, fp long")  # each makes 132 rows, so they are spread first
        .repartition(n, "variant").sortWithinPartitions("variant").mapInArrow(_collisions, "u long, v long")
    )


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(row_key, doc_id, fp) of every row; (fp, n, component, first) of every fingerprint; how many rows.

    row_key is of id and text; first is the least (null id, id, key) of the component.
    """
    text = text_or_empty(text_col)
    keyed = docs.select(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text.cast("binary"))).alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    prepare(docs.sparkSession)
    rows = checkpoint(keyed.mapInArrow(_fingerprints, "row_key string, doc_id long, fp long"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key")
    groups = checkpoint(rows.groupBy("fp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")))
    parts = connected_components(fingerprint_links(groups.select("fp"))).withColumnRenamed("node", "fp")
    named = checkpoint(groups.join(parts, "fp", "left").select("fp", "n", "first", F.coalesce("component", "fp").alias("component")))
    low = checkpoint(named.groupBy("component").agg(F.min("first").alias("low"), F.count(F.lit(1)).alias("m")))
    joined = spread_join(named.drop("first"), low, "component", "m", named.count()).select("fp", "n", "component", F.col("low").alias("first"))
    return rows, checkpoint(joined), rows.count()


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id reachable over links.

    Null and empty texts share fingerprint 0, which links like any other. Null ids never name a
    component unless it has no other. Repeated rows stay repeated; an empty table gives no rows;
    other columns are not read.
    """
    rows, groups, total = _grouped(docs, id_col, text_col)
    named = groups.select("fp", "n", F.col("first.doc_id").alias("component_id"))
    return spread_join(rows.select("doc_id", "fp"), named, "fp", "n", total).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row left of each component: that of its smallest id, null ids coming last.

    Rows are told apart by id and text, so rows that only share an id are documents of their own; of rows
    that repeat both, one stays. An empty table gives no rows; all columns stay as they were, whatever their names.
    """
    _, groups, _ = _grouped(docs, id_col, text_col)
    own = max(docs.columns, key=len) + "_near"  # a name that docs does not have
    stay = groups.where("fp = component").select(F.col("first.row_key").alias(own))
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_or_empty(text_col).cast("binary")))
    return docs.withColumn(own, key).join(stay, own, "left_semi").dropDuplicates([own]).select(*[F.col(f"`{c}`") for c in docs.columns])
