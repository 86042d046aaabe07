"""Merging of overlapping tiles' objects, as joins on pixels and on the cells of boxes.

Boxes of one call must not overlap within an image: tiles, strips along x lines, strips along y lines and
crossings are four calls. A box's objects are numbered by the box alone; here they get ids of the image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import in_boxes

PIXEL = ["image_id", "y", "x"]
OWNED = ["image_id", "box_id", "inst_id"]


def _live(boxes: DataFrame, new: DataFrame) -> DataFrame:
    """The boxes that have new objects; the others change nothing, whatever they cover."""
    return boxes.join(new.select("image_id", "box_id").distinct(), ["image_id", "box_id"], "left_semi")


def numbered(current: DataFrame, new: DataFrame) -> DataFrame:
    """Pixels of new with ids after the image's largest, by box and the box's own id. Ranks run over objects, not pixels."""
    top = current.groupBy("image_id").agg(F.max("inst_id").alias("_top"))
    order = Window.partitionBy("image_id").orderBy("box_id", "inst_id")
    ids = new.select(*OWNED).distinct().withColumn("_n", F.row_number().over(order)).join(top, "image_id", "left")
    ids = ids.select(*OWNED, (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("int").alias("_id"))
    return new.join(ids.hint("merge"), OWNED).select(*PIXEL, F.col("_id").alias("inst_id"))


def insert_tiles(current: DataFrame, new: DataFrame, tiles: DataFrame) -> DataFrame:
    """First phase. current: image_id, y, x, inst_id; new: with box_id; tiles: image_id, box_id, y0, x0, y1, x1.

    A tile with new objects overwrites its whole rectangle, background too.
    """
    under = in_boxes(current, _live(tiles, new)).select(*PIXEL)
    return current.join(under, PIXEL, "left_anti").select(*PIXEL, "inst_id").unionByName(numbered(current, new))


def mend(current: DataFrame, new: DataFrame, boxes: DataFrame) -> DataFrame:
    """Later phases, on the same tables. In every box that has new objects, old objects with pixels in it and none on its
    edge lose them; new objects that meet an old pixel that stays are left out; the others come in.
    """
    held = in_boxes(current, _live(boxes, new))
    edge = F.col("y").isin(F.col("y0")) | (F.col("y") == F.col("y1") - 1) | (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1") - 1)
    whole = held.groupBy(*OWNED).agg(F.max(edge.cast("int")).alias("_e")).where("_e = 0").drop("_e")
    lost = held.join(whole, OWNED, "left_semi").select(*PIXEL)
    stays = current.join(lost, PIXEL, "left_anti").select(*PIXEL, "inst_id")
    blocked = new.join(stays.select(*PIXEL), PIXEL, "left_semi").select(*OWNED).distinct()
    return stays.unionByName(numbered(current, new.join(blocked, OWNED, "left_anti")))

