"""Raster, patch and point tables derived from the driver's tables, and small fixed tables.

Tables are sparse and long: a pixel is a row, foreground only where a label map is meant.
Arrays count (y, x); centroids and contours are (x, y); boxes are half open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, BLOCK = 20, 5
#: Names and colours of object types.
TYPES = [(0, "nolabel", 0, 0, 0), (1, "neopla", 255, 0, 0), (2, "inflam", 0, 255, 0), (3, "connec", 0, 0, 255), (4, "necros", 255, 255, 0)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense pixels of SIDE x SIDE images from events: image_id, y, x, true_id, pred_id, type_id, r, g, b, v.

    True ids number blocks, predicted ids the blocks of the grid shifted by one; event types make holes.
    """
    n = SIDE * SIDE
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    y, x = F.expr(f"cast(event_id % {n} div {SIDE} as int)"), F.expr(f"cast(event_id % {SIDE} as int)")
    block = lambda a, b, per: F.expr(f"cast({a} div {BLOCK} * {per} + {b} div {BLOCK} + 1 as int)")
    return (
        e.withColumns({"image_id": F.expr(f"event_id div {n}"), "y": y, "x": x})
        .withColumn("true_id", F.when(F.col("event_type") == "error", 0).otherwise(block("y", "x", SIDE // BLOCK)))
        .withColumn("pred_id", F.when(F.col("event_type") == "view", 0).otherwise(block("(y + 1)", "(x + 1)", SIDE // BLOCK + 1)))
        .select("image_id", "y", "x", "true_id", "pred_id", F.expr("cast(user_id % 5 as int)").alias("type_id"), *(F.expr(f"cast((event_id * {k} + user_id) % 256 as int)").alias(c) for c, k in (("r", 7), ("g", 11), ("b", 13))), F.col("value").alias("v"))
    )


RASTER_SQL = f"""raster AS (SELECT event_id // {SIDE * SIDE} AS image_id, y, x,
    CASE WHEN event_type = 'error' THEN 0 ELSE y // {BLOCK} * {SIDE // BLOCK} + x // {BLOCK} + 1 END AS true_id,
    CASE WHEN event_type = 'view' THEN 0 ELSE (y + 1) // {BLOCK} * {SIDE // BLOCK + 1} + (x + 1) // {BLOCK} + 1 END AS pred_id,
    CAST(user_id % 5 AS INT) AS type_id, CAST((event_id * 7 + user_id) % 256 AS INT) AS r, CAST((event_id * 11 + user_id) % 256 AS INT) AS g, CAST((event_id * 13 + user_id) % 256 AS INT) AS b, value AS v
    FROM (SELECT *, CAST(event_id % {SIDE * SIDE} // {SIDE} AS INT) AS y, CAST(event_id % {SIDE} AS INT) AS x FROM events))"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 patches from embeddings, a pixel a row: image_id, y, x, v, label."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    return e.select(F.col("vec_id").alias("image_id"), F.expr("cast(i div 8 as int)").alias("y"), F.expr("cast(i % 8 as int)").alias("x"), F.col("v").cast("double").alias("v"), "label")


PATCHES_SQL = """patches AS (SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(v AS DOUBLE) AS v, label
    FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def object_id(v: Column) -> Column:
    """An id from a single-precision value. The product stays in single precision, as in SQL: by a whole number Spark would multiply in double, and 0.35 would become 6, not 7."""
    return F.floor(F.abs(v) * F.lit(20.0).cast("float")).cast("int")


def type_info(spark: SparkSession) -> DataFrame:
    """The type dictionary: a handful of fixed rows, so it may be broadcast."""
    rows = ", ".join(f"({i}, '{n}', {r}, {g}, {b})" for i, n, r, g, b in TYPES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(type_id, name, r, g, b)")


TYPES_SQL = f"types(type_id, name, r, g, b) AS (VALUES {', '.join(str(t) for t in TYPES)})"


def label_map(pixels: DataFrame, column: str) -> DataFrame:
    """Foreground of one label column: image_id, y, x, inst_id."""
    return pixels.where(F.col(column) > 0).select("image_id", "y", "x", F.col(column).alias("inst_id"))
