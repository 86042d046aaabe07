"""Pixels laid out so that a box of a slide reads few files and row groups: Parquet in Morton order of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a cell's place along an axis.
BITS = 24


def morton(y: Column, x: Column) -> Column:
    """The bits of y and x by turns, y's first: places near each other have numbers near each other, and a box's lie between those of its corners."""
    parts = [F.shiftleft(F.shiftright(v.cast("long"), b).bitwiseAND(F.lit(1)), 2 * b + s) for b in range(BITS) for v, s in ((y, 1), (x, 0))]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def write_regions(pixels: DataFrame, path: str, cell: int = 64, row_group_rows: int = 50_000) -> None:
    """pixels: image_id, y, x (0 or more) and any columns, in order of image and of the Morton number of their cells.

    Files are ranges of that order, of even numbers of rows however much one image holds, and so are the row groups within them; each has
    narrow bounds of image, code, y and x in its footer. One shuffle, by ranges of a sample.
    """
    code = morton(F.floor(F.col("y") / cell), F.floor(F.col("x") / cell))
    keys = ["image_id", "code", "y", "x"]
    ordered = pixels.withColumn("code", code).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # a row group ends by rows, as bytes of sorted places say little
    ordered.write.mode("overwrite").option("parquet.block.row.count.limit", row_group_rows).option("parquet.page.row.count.limit", max(1, row_group_rows // 8)).parquet(path)


def read_regions(spark: SparkSession, path: str, boxes: list[tuple[int | None, int, int, int, int]], cell: int = 64) -> DataFrame:
    """Pixels of some boxes (image_id, or None for all images, y0, x0, y1, x1), half open, as image_id, box (its place in the list), y, x and the other columns.

    Each box is a condition on plain columns, which the scan holds against the bounds of files, row groups and pages before it reads them.
    """
    number = lambda y, x: sum(((y // cell >> b & 1) << 2 * b + 1) | ((x // cell >> b & 1) << 2 * b) for b in range(BITS))
    table = spark.read.parquet(path)
    within = [
        (F.lit(True) if image is None else F.col("image_id") == image) & F.col("code").between(number(max(0, y0), max(0, x0)), number(max(0, y1 - 1), max(0, x1 - 1))) & (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)
        for image, y0, x0, y1, x1 in boxes
    ]
    any_of = F.lit(False)
    for w in within:
        any_of = any_of | w
    hit = F.array_compact(F.array(*(F.when(w, F.lit(k)) for k, w in enumerate(within))))
    rest = [c for c in table.columns if c not in ("image_id", "y", "x", "code")]
    return table.where(any_of).select("image_id", F.explode(hit).alias("box"), "y", "x", *rest)
