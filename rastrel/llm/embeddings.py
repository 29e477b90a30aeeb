"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees.

Equal directions are one point with a count. The upper levels of the tree are Spark tables: a cell with more
points than a block is parted among its nearest pivots, again and again, until every cell is a block. Pairs of cells are
walked down those levels together, and only pairs whose covering bounds admit a close pair go on. Each block builds
a cover tree with halving radii once; each pair of blocks that is left is a task of its own, which
walks both trees together. Tasks return sums and a spanning forest, never the pairs. A block goes to as
many tasks as it has partners; where bounds don't prune, as among random vectors in many dimensions, those are
all, and the work is quadratic, as exact search there is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrel.llm.common import checkpoint, partitions, prepare, release, spread_join
from rastrel.llm.components import connected_components
from rastrel.llm.covertree import SLACK, CoverTree, build, close_pairs
from rastrel.llm.simhash import _roots

COSINE = 0.95
#: Points in a block, parts that a cell is parted into, and levels of cells, at most. They bound memory, not results.
BLOCK_POINTS, FAN, LEVELS = 8_000, 64, 8


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0  # -0.0 is 0.0


def _valid(vector: str):
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, vector) to (vec_id, unit), the direction as little-endian doubles."""
    for batch in batches:
        lists = batch.column(1)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        sizes = np.diff(ends)
        out: list[bytes] = [b""] * len(batch)
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            for a in range(0, len(own), 4096):
                part = own[a : a + 4096]
                for i, u in zip(part, _unit(flat[ends[part][:, None] + np.arange(size)]), strict=True):
                    out[i] = u.tobytes()
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "unit"])


def _stack(units) -> np.ndarray:
    return np.stack([np.frombuffer(u, dtype="<f8") for u in units])


def _part(key: tuple, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """A share of one cell's points, each to its nearest pivot."""
    if not len(rows) or not len(pivots):
        return rows.assign(far=0.0)[["point", "count", "unit", "cell", "far"]]
    pivots = pivots.sort_values("node", kind="stable")
    x, p = _stack(rows["unit"]), _stack(pivots["pivot"])
    dots = x @ p.T
    near = dots.argmax(axis=1)
    far = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(x)), near]))
    return rows.assign(cell=pivots["node"].to_numpy()[near], far=far)[["point", "count", "unit", "cell", "far"]]


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One block as a row: its points in the order of its tree, their counts and directions, and where nodes begin."""
    rows = rows.sort_values("point", kind="stable")
    unit = _stack(rows["unit"])
    order, starts = build(unit)
    rows = rows.iloc[order]
    return pd.DataFrame({
        "block": [int(key[0])], "points": [rows["point"].to_numpy("<i8").tobytes()], "counts": [rows["count"].to_numpy("<i8").tobytes()],
        "units": [unit[order].tobytes()], "starts": [starts.tobytes()],
    })


_BLOCK = "block long, points binary, counts binary, units binary, starts binary"


def _pair_links(cosine: float, distance: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", kind="stable")
        trees, points, counts = [], [], []
        for r in rows.itertuples():
            points.append(np.frombuffer(r.points, dtype="<i8"))
            counts.append(np.frombuffer(r.counts, dtype="<i8"))
            n = len(points[-1])
            trees.append(CoverTree(np.frombuffer(r.units, dtype="<f8").reshape(n, -1), np.frombuffer(r.starts, dtype=bool).reshape(n, -1)))
        own = len(trees) == 1
        point, count = np.concatenate(points), np.concatenate(counts)
        shift = 0 if own else len(points[0])
        links = np.zeros(len(point), dtype=np.int64)
        low = np.arange(len(point))
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for s, t in close_pairs(trees[0], trees[-1], cosine, distance):
            t = t + shift
            other = s != t
            s, t = s[other], t[other]
            np.add.at(links, s, count[t])
            if not own:
                np.add.at(links, t, count[s])
            pending.append((s, t))
            size += len(s)
            if size > 1_000_000:
                low = _join(low, pending)
                pending, size = [], 0
        low = _join(low, pending)
        some = links > 0
        del trees
        release()
        return pd.DataFrame({"point": point[some], "links": links[some], "root": point[low[some]]})

    return run


def _join(low: np.ndarray, pending: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    n = len(low)
    a = np.concatenate([np.arange(n), *[p[0] for p in pending]])
    b = np.concatenate([low, *[p[1] for p in pending]])
    return _roots(n, a, b)


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Two vectors are linked at that cosine or more, in double precision. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing, and vectors of different lengths
    not with each other. Rows that repeat an id are vectors of their own with a common id. Null ids
    name no component unless it has no other. An empty table gives no rows; other columns, labels
    too, are not read. Rows meet their direction's result by its MD5.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("vector"))
    alone = rows.where(~_valid("vector")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    units = checkpoint(rows.where(_valid("vector")).mapInArrow(_units, "vec_id long, unit binary").withColumn("key", F.unhex(F.md5("unit"))))
    points = units.groupBy("key", "unit").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("count"))
    points = checkpoint(points.withColumn("point", F.monotonically_increasing_id()))
    total = 0
    parts = []
    for size, n, many in _lengths(points):
        total += many
        parts.append(_linked(points.where(F.octet_length("unit") == size).select("point", "count", "unit"), n, cosine))
    if parts:
        found = parts[0]
        for more in parts[1:]:
            found = found.union(more)
        found = checkpoint(found)
        roots = connected_components(found.select(F.col("point").alias("u"), F.col("root").alias("v")))
        sums = found.groupBy("point").agg(F.sum("links").alias("links"))
        named = points.select("point", "key", "first_id", "count").join(sums, "point", "left").join(roots.withColumnRenamed("node", "point"), "point", "left")
        named = named.select("key", "first_id", "count", F.coalesce("component", "point").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"))
        named = checkpoint(named)
        first = checkpoint(named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
        named = checkpoint(spread_join(named, first, "component", "n", sum(n for _, n, _ in _lengths(points))).select("key", "n_links", "component_id", "count"))
        alone = alone.union(spread_join(units.select("vec_id", "key"), named, "key", "count", total).select("vec_id", "n_links", F.coalesce("component_id", "vec_id")))
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _lengths(points: DataFrame) -> list[tuple[int, int, int]]:
    """Bytes of a direction, how many points and how many rows have them: a handful of lengths in any table that one model made."""
    counts = points.groupBy(F.octet_length("unit").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("many"))
    return [(r["size"], r["n"], r["many"]) for r in counts.orderBy("size").collect()]


def _parted(placed: DataFrame, level: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(points with their cell, nodes of the level) after every cell of more than a block is parted once.

    nodes: above, node, pivot, radius. Pivots are the first of a cell in the order of a hash, of candidates thinned by it.
    """
    cells = checkpoint(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size")))
    parts = F.least(F.lit(FAN), F.greatest(F.ceil(F.col("size") * 5 / (4 * BLOCK_POINTS)), F.lit(2))).cast("int")
    info = cells.select("cell", "size", F.when(F.col("size") > BLOCK_POINTS, parts).otherwise(0).alias("parts"), F.greatest(F.ceil(F.col("size") / BLOCK_POINTS), F.lit(1)).cast("int").alias("shares"))
    sized = spread_join(placed, info.withColumn("weight", F.col("size")), "cell", "weight", n)
    big = sized.where("parts > 0")
    code = F.xxhash64(F.lit(level), "point")
    chosen = big.where(F.pmod(code, F.col("size")) < 4 * F.col("parts") + 16).groupBy("cell", "parts", "shares").agg(F.sort_array(F.collect_list(F.struct(code.alias("code"), "point", "unit"))).alias("some"))
    chosen = chosen.select("cell", "shares", F.posexplode(F.slice("some", 1, F.col("parts"))).alias("at", "p"))
    pivots = checkpoint(chosen.select("cell", "shares", (F.col("cell") * FAN + F.col("at") + 1).alias("node"), F.col("p.unit").alias("pivot")))
    shared = pivots.select(F.col("cell").alias("above"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("number"), F.col("node").alias("node"), F.col("pivot").alias("pivot"))
    to = F.pmod(F.xxhash64(F.lit("share"), "point"), F.col("shares").cast("long")).cast("int")
    moved = (
        big.select("point", "count", "unit", "cell", to.alias("share")).groupBy("cell", "share").cogroup(shared.groupBy("above", "number"))
        .applyInPandas(_part, "point long, count long, unit binary, cell long, far double")
    )
    moved = checkpoint(moved)
    radii = moved.groupBy(F.col("cell").alias("node")).agg(F.max("far").alias("radius"))
    nodes = pivots.select(F.col("cell").alias("above"), "node", "pivot").join(radii, "node").select("above", "node", "pivot", "radius")
    return sized.where("parts = 0").select("point", "count", "unit", "cell").union(moved.select("point", "count", "unit", "cell")), checkpoint(nodes)


def _meeting(levels: list[DataFrame], spark, distance: float) -> DataFrame:
    """Pairs (x <= y) of cells whose bounds admit a close pair, found by walking the levels down from the root with itself."""
    pairs = spark.createDataFrame([(0, 0)], "x long, y long")
    known = None
    for nodes in levels:
        known = nodes if known is None else known.union(nodes)
        # a cell that is not parted at this level goes on as it is
        stays = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct().join(nodes.select(F.col("above").alias("node")).distinct(), "node", "left_anti")
        kids = nodes.union(stays.join(known, "node").select(F.col("node").alias("above"), "node", "pivot", "radius"))
        a, b = (kids.select(F.col("above").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("node", "pivot", "radius")]) for k in "xy")
        wide = pairs.join(a, "x").join(b, "y").where("x < y OR x_node <= y_node")
        pairs = checkpoint(wide.select("x_node", "y_node", "x_pivot", "y_pivot", "x_radius", "y_radius").mapInArrow(_admit(distance), "x long, y long"))
    return pairs


def _admit(distance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs whose nearest points can be close."""
        for batch in batches:
            if not len(batch):
                continue
            x, y, r, s = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 4, 5))
            dots = np.einsum("ij,ij->i", _stack(batch.column(2).to_pylist()), _stack(batch.column(3).to_pylist()))
            keep = np.sqrt(np.maximum(0, 2 - 2 * dots)) <= r + s + distance + SLACK
            yield pa.record_batch([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep])], names=["x", "y"])

    return run


def _linked(points: DataFrame, n: int, cosine: float) -> DataFrame:
    """(point, links, root) for points with a link, a row for each task that found some."""
    spark = points.sparkSession
    distance = math.sqrt(max(0.0, 2 - 2 * cosine))
    placed = points.withColumn("cell", F.col("point") * 0)  # not a literal, which would turn joins on it into nested loops
    levels: list[DataFrame] = []
    largest = n
    while largest > BLOCK_POINTS and len(levels) < LEVELS:
        placed, nodes = _parted(placed, len(levels), n)
        placed = checkpoint(placed)
        levels.append(nodes)
        largest = placed.groupBy("cell").count().agg(F.max("count")).first()[0]
    # what can't be parted, as its points all but coincide, is cut by hash into blocks that all meet
    cells = checkpoint(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).select("cell", "size", F.ceil(F.col("size") / BLOCK_POINTS).cast("int").alias("many")))
    number = lambda cell, k: (F.col(cell) * 2**12 + k).alias("block")
    cut = spread_join(placed, cells, "cell", "size", n)
    cut = cut.select("point", "count", "unit", number("cell", F.pmod(F.xxhash64("point"), F.col("many").cast("long"))))
    blocks = checkpoint(cut.groupBy("block").applyInPandas(_build, _BLOCK))
    ends = [cells.select(F.col("cell").alias(k), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias(f"{k}_at")) for k in "xy"]
    pairs = _meeting(levels, spark, distance).join(ends[0], "x").join(ends[1], "y").where("x < y OR x_at <= y_at")
    pairs = checkpoint(pairs.select(number("x", F.col("x_at")).alias("x"), number("y", F.col("y_at")).alias("y")))
    meets = pairs.select(F.col("x").alias("block"), "x", "y").union(pairs.where("x < y").select(F.col("y").alias("block"), "x", "y"))
    sent = blocks.join(meets, "block").select("x", "y", "block", "points", "counts", "units", "starts")
    return (
        sent.repartition(max(partitions(spark), 1), "x", "y").groupBy("x", "y")
        .applyInPandas(_pair_links(cosine, distance), "point long, links long, root long")
    )
