"""Images, signals and token streams out of the tables at hand, in the canonical long form.

Pixels are routed by image once; every window and aggregation by image after that keeps the routing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rastrel.plans.steps import Operator, Source


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels_of(vectors: DataFrame) -> DataFrame:
    """(image_id, label, c, y, x, v): each embedding as an 8x8 image of integers. The vectors are routed by image before they become 64 rows."""
    cells = vectors.select("vec_id", "label", "embedding").repartition("vec_id").selectExpr("vec_id AS image_id", "label", "posexplode(embedding) AS (pos, e)")
    return cells.selectExpr(
        "image_id", "CAST(label AS BIGINT) AS label", "CAST(0 AS BIGINT) AS c", "CAST(pos DIV 8 AS BIGINT) AS y", "CAST(pos % 8 AS BIGINT) AS x",
        "CAST(floor(CAST(e AS DOUBLE) * 512D + 0.5D) AS BIGINT) AS v",
    )


_CELLS = "SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS e FROM embeddings"
PIXELS = Source(
    lambda spark, d: pixels_of(_read(spark, d, "embeddings")),
    f"SELECT vec_id AS image_id, label::BIGINT AS label, 0::BIGINT AS c, (pos // 8)::BIGINT AS y, (pos % 8)::BIGINT AS x, floor(e::DOUBLE * 512 + 0.5)::BIGINT AS v FROM ({_CELLS})",
)
#: Three images as the channels of one; an incomplete last triple goes.
CHANNELS = Operator("""
SELECT image_id DIV 3 AS image_id, image_id % 3 AS c, y, x, v FROM {src} WHERE image_id DIV 3 < (SELECT COUNT(DISTINCT image_id) DIV 3 FROM {src})""")(PIXELS)
#: One row for each pixel of the three-channel images.
RGB = Operator("""
SELECT image_id, y, x, MAX(CASE WHEN c = 0 THEN v END) AS v0, MAX(CASE WHEN c = 1 THEN v END) AS v1, MAX(CASE WHEN c = 2 THEN v END) AS v2
FROM {src} GROUP BY image_id, y, x""")(CHANNELS)
#: The same as linear light between 0 and 1.
LIGHT = Operator("""
SELECT image_id, y, x, LEAST(1D, GREATEST(0D, (v0 + 256D) / 512D)) AS r, LEAST(1D, GREATEST(0D, (v1 + 256D) / 512D)) AS g, LEAST(1D, GREATEST(0D, (v2 + 256D) / 512D)) AS b
FROM {src}""")(RGB)
#: Every image beside its next one.
PAIRS = Operator("""
SELECT a.image_id, a.y, a.x, (a.v + 256D) / 512D AS a, (b.v + 256D) / 512D AS b FROM {src} a JOIN {src} b ON b.image_id = a.image_id + 1 AND b.y = a.y AND b.x = a.x""")(PIXELS)
RGB_PAIRS = Operator("""
SELECT a.image_id, a.y, a.x, a.r AS r1, a.g AS g1, a.b AS b1, b.r AS r2, b.g AS g2, b.b AS b2
FROM {src} a JOIN {src} b ON b.image_id = a.image_id + 1 AND b.y = a.y AND b.x = a.x""")(LIGHT)
#: The light of an image with a coverage, as the layers of a frame have it, and the next image's as the layer above.
LAYER = Operator("SELECT image_id, y, x, r, g, b, (r + g) / 2D AS a FROM {src}")(LIGHT)
ABOVE = Operator("SELECT image_id - 1 AS image_id, y, x, r, g, b, a FROM {src}")(LAYER)
#: How and where each image's layer goes.
PLACES = Operator("SELECT DISTINCT image_id, image_id % 5 AS mode, image_id % 3 - 1 AS dy, image_id % 4 - 2 AS dx FROM {src}")(LAYER)
TURNS = Operator("SELECT DISTINCT image_id, 1 + image_id % 8 AS orientation FROM {src}")(PIXELS)
#: Luma and chroma of a tile, the tile being the image.
CHROMA = Operator("SELECT image_id, y, x, g * 255D AS m, b * 255D AS s FROM {src}")(LIGHT)
#: A masking strength for each pixel.
MASK = Operator("SELECT image_id, y, x, 1D / (1D + ABS(r1 - g1)) AS mask FROM {src}")(RGB_PAIRS)
#: Parts of images that have come so far, with gaps.
PARTS = Operator("SELECT image_id, y, x FROM {src} WHERE (y * 8 + x + image_id) % 11 > 0")(PIXELS)
ROWS_HERE = Operator("SELECT image_id, y AS part FROM {src} WHERE NOT (image_id % 3 = 0 AND y = image_id % 8)")(PIXELS)
# Sizes of drawn images: one pixel, a row, a column, odd sides, and some larger ones.
SIZES = ((1, 1), (1, 9), (9, 2), (33, 17), (16, 16), (40, 24), (24, 67))
_DRAWN = "(x * 37 + y * 101 + x * y * 13 + c * 59 + id * 7) % 256"
_EVEN = "(x DIV 20 * 3 + y DIV 18 * 5 + c) % 4 * 60"
_SIZES = ", ".join(f"({i}, {h}, {w})" for i, (h, w) in enumerate(SIZES))
_PIXEL = f"SELECT CAST(id AS BIGINT) AS image_id, CAST(id % 3 AS BIGINT) AS label, CAST(c AS BIGINT) AS c, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(CASE WHEN id % 2 = 0 THEN {_EVEN} ELSE {_DRAWN} END AS BIGINT) AS v FROM "
#: Drawn images of three channels, (image_id, label, c, y, x, v): even ones of plain rectangles, the others full of detail.
DRAWN = Source(
    lambda spark, _: spark.sql(f"{_PIXEL} (SELECT id, c, y, EXPLODE(SEQUENCE(0, w - 1)) AS x FROM (SELECT id, w, c, EXPLODE(SEQUENCE(0, h - 1)) AS y FROM (SELECT id, h, w, EXPLODE(ARRAY(0, 1, 2)) AS c FROM VALUES {_SIZES} s(id, h, w))))").repartition("image_id"),
    f"{_PIXEL} (SELECT id, c, y, unnest(range(w)) AS x FROM (SELECT id, w, c, unnest(range(h)) AS y FROM (SELECT id, h, w, unnest(range(3)) AS c FROM (VALUES {_SIZES}) s(id, h, w))))".replace(" DIV ", " // "),
)
DRAWN_RGB = Operator("""
SELECT image_id, y, x, MAX(CASE WHEN c = 0 THEN v END) AS v0, MAX(CASE WHEN c = 1 THEN v END) AS v1, MAX(CASE WHEN c = 2 THEN v END) AS v2
FROM {src} GROUP BY image_id, y, x""")(DRAWN)
#: One channel of them, and how they are turned.
DRAWN_ONE = Operator("SELECT image_id, label, c, y, x, v FROM {src} WHERE c = 1")(DRAWN)
DRAWN_TURNS = Operator("SELECT DISTINCT image_id, 1 + (image_id + 4) % 8 AS orientation FROM {src}")(DRAWN)
DRAWN_LIGHT = Operator("SELECT image_id, y, x, v0 / 255D AS r, v1 / 255D AS g, v2 / 255D AS b FROM {src}")(DRAWN_RGB)
#: Each drawn image beside a copy with fewer levels, less contrast and a shifted channel.
DISTORTED = Operator("""SELECT image_id, y, x, r AS r1, g AS g1, b AS b1, FLOOR(r * 10D + 0.5D) / 10D AS r2, g * 0.9D + 0.04D AS g2, COALESCE(LAG(b) OVER (PARTITION BY image_id, y ORDER BY x), b) AS b2 FROM {src}""")(DRAWN_LIGHT)
SIGNALS = Source(
    lambda spark, d: _read(spark, d, "events").selectExpr(
        "user_id AS stream", "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id NULLS LAST) - 1 AS BIGINT) AS pos", "CAST(floor(value * 100D + 0.5D) AS BIGINT) AS v", "event_type"),
    "SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, floor(value * 100 + 0.5)::BIGINT AS v, event_type FROM events",
)
#: The documents whole.
TEXTS = Source(lambda spark, d: _read(spark, d, "documents").selectExpr("doc_id AS stream", "text"), "SELECT doc_id AS stream, text FROM documents")


def characters_of(texts: DataFrame) -> DataFrame:
    """(stream, pos, v): the code points of texts (stream, text); an empty one is one value of -1, as unicode('') is in the oracle."""
    return texts.selectExpr("stream", "posexplode(split(text, '')) AS (pos, ch)").selectExpr("stream", "CAST(pos AS BIGINT) AS pos", "CAST(CASE WHEN ch = '' THEN -1 ELSE ascii(ch) END AS BIGINT) AS v")


CHARACTERS = Source(
    lambda spark, d: characters_of(TEXTS.frame(spark, d)),
    "SELECT stream, pos, unicode(ch)::BIGINT AS v FROM (SELECT doc_id AS stream, unnest(range(len(s))) AS pos, unnest(s) AS ch FROM (SELECT doc_id, string_split(text, '') AS s FROM documents))",
)
FRAMES = Source(
    lambda spark, d: _read(spark, d, "conversations").selectExpr("conv_id AS image_id", "turn AS frame", "CAST(length(text) AS BIGINT) AS size", "CAST(length(text) % 3 AS BIGINT) AS duration"),
    "SELECT conv_id AS image_id, turn AS frame, length(text)::BIGINT AS size, (length(text) % 3)::BIGINT AS duration FROM conversations",
)
#: Runs of an encoder: a line item is one compressed image, its order the codec's run.
RUNS = Source(
    lambda spark, d: _read(spark, d, "lineitem").selectExpr("l_returnflag AS codec", "l_orderkey AS image", "l_quantity AS bytes", "l_extendedprice AS pixels", "l_discount AS max_norm", "l_tax AS p_norm"),
    "SELECT l_returnflag AS codec, l_orderkey AS image, l_quantity AS bytes, l_extendedprice AS pixels, l_discount AS max_norm, l_tax AS p_norm FROM lineitem",
)
#: Rectangles to place on images, by arithmetic on the part keys.
PATCHES = Source(
    lambda spark, d: _read(spark, d, "part").selectExpr("p_partkey AS id", "p_partkey % 97 AS image_id", "p_partkey * 7 % 6 AS x0", "p_partkey * 5 % 6 AS y0", "1 + p_partkey % 3 AS w", "1 + p_partkey * 3 % 2 AS h", "p_partkey % 3 AS mode", "CAST(p_size AS BIGINT) AS value"),
    "SELECT p_partkey AS id, p_partkey % 97 AS image_id, p_partkey * 7 % 6 AS x0, p_partkey * 5 % 6 AS y0, 1 + p_partkey % 3 AS w, 1 + p_partkey * 3 % 2 AS h, p_partkey % 3 AS mode, p_size::BIGINT AS value FROM part",
)
