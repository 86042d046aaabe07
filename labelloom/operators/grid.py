"""Tiling grids as table-valued functions: sizes in, rows out. They work on a table of images (image_id, height, width)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import dealt


def _steps(n: Column) -> Column:
    return F.explode(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>")))


def _along(images: DataFrame, name: str, n: Column) -> DataFrame:
    return images.withColumn(name, _steps(n))


def _grid(images: DataFrame, outer: tuple[str, Column], inner: tuple[str, Column]) -> DataFrame:
    """A row for each place of an image's grid. Images are dealt out before they grow: a file of many small rows would be one task."""
    return _along(_along(dealt(images), *outer), *inner)


def patch_count(length: Column, inner: int, outer: int) -> Column:
    """Patches of input size `inner` and output size `outer` along an axis."""
    return F.floor((length - (inner - outer)) / outer) + 1


def patch_grid(images: DataFrame, inner: int, outer: int) -> DataFrame:
    """Corners of the input and output box of every patch; the last may spill over the edge."""
    diff = inner - outer
    g = _grid(images, ("j", patch_count(F.col("width"), inner, outer)), ("i", patch_count(F.col("height"), inner, outer)))
    return g.select("image_id", *((F.col(k) * outer).alias(f"in_{a}") for a, k in (("y", "i"), ("x", "j"))), *((F.col(k) * outer + diff // 2).alias(f"out_{a}") for a, k in (("y", "i"), ("x", "j"))))


def tiles(images: DataFrame, tile: int, margin: int = 128) -> DataFrame:
    """Tiles, strips along inner tile lines (x lines, then y lines) and boxes at inner crossings: kind, y0, x0, y1, x1. Tiles of no area are left out."""
    n = {a: F.floor(F.col(side) / tile) + 1 for a, side in (("y", "height"), ("x", "width"))}
    g = _grid(images, ("i", n["y"]), ("j", n["x"])).withColumns({"y": F.col("i") * tile, "x": F.col("j") * tile})
    box = lambda df, kind, y0, x0, y1, x1: df.select("image_id", F.lit(kind).alias("kind"), y0.alias("y0"), x0.alias("x0"), y1.alias("y1"), x1.alias("x1"))
    y, x = F.col("y"), F.col("x")
    normal = box(g, "tile", y, x, F.least(y + tile, F.col("height")), F.least(x + tile, F.col("width")))
    strip_x = box(g.where("j > 0"), "x", y, x - margin, y + tile, x + margin)
    strip_y = box(g.where("i > 0"), "y", y - margin, x, y + margin, x + tile)
    cross = box(g.where("i > 0 and j > 0"), "cross", y - 2 * margin, x - 2 * margin, y + 2 * margin, x + 2 * margin)
    return normal.unionByName(strip_x).unionByName(strip_y).unionByName(cross).where("y1 > y0 and x1 > x0")


def _chunk_end(start: Column, length: Column, size: int, diff: int, outer: int) -> Column:
    """Where a chunk ends: after whole patches, if it would spill over the edge."""
    whole = F.floor((length - diff - start) / outer) * outer + start + diff
    return F.when(start + size > length, whole).otherwise(start + size).cast("int")


def chunks(images: DataFrame, chunk: int, inner: int, outer: int) -> DataFrame:
    """Chunks of whole patches, cut to the image: in_y0, in_x0, in_y1, in_x1 and the output box."""
    diff = inner - outer
    out = (chunk - diff) // outer * outer
    size = out + diff
    g = _grid(images, ("j", patch_count(F.col("width"), size, out)), ("i", patch_count(F.col("height"), size, out)))
    g = g.withColumns({"in_y0": F.col("i") * out, "in_x0": F.col("j") * out})

    end = lambda start, length: _chunk_end(F.col(start), F.col(length), size, diff, outer)
    g = g.withColumns({"in_y1": end("in_y0", "height"), "in_x1": end("in_x0", "width")})
    half = diff // 2
    return g.select("image_id", "in_y0", "in_x0", "in_y1", "in_x1", *((F.col(f"in_{a}0") + half).alias(f"out_{a}0") for a in "yx"), *((F.col(f"in_{a}1") - half).alias(f"out_{a}1") for a in "yx"))


def chunk_patches(images: DataFrame, chunk: int, inner: int, outer: int) -> DataFrame:
    """Patches whose input box lies in a chunk. Chunks are whole patches side by side, so a patch's corner tells its chunk: arithmetic, no range join."""
    diff = inner - outer
    out = (chunk - diff) // outer * outer
    size = out + diff
    g = _grid(images, ("j", patch_count(F.col("width"), inner, outer)), ("i", patch_count(F.col("height"), inner, outer)))
    p = g.withColumns({"in_y": F.col("i") * outer, "in_x": F.col("j") * outer})
    for a, side in (("y", "height"), ("x", "width")):
        at = F.floor(F.col(f"in_{a}") / out)
        p = p.where(at < patch_count(F.col(side), size, out)).withColumn(f"in_{a}0", (at * out).cast("int"))
        p = p.where(F.col(f"in_{a}") <= _chunk_end(F.col(f"in_{a}0"), F.col(side), size, diff, outer) - inner)
    return p.select("image_id", "in_y0", "in_x0", "in_y", "in_x")


BOX = ["image_id", "box_id", "y0", "x0", "y1", "x1"]
CELL = 256


def in_boxes(points: DataFrame, boxes: DataFrame, cell: int = CELL) -> DataFrame:
    """Rows of points (image_id, y, x, ...) with box_id, y0, x0, y1, x1 of every box that they lie in: an equi-join on cells, then the exact test."""
    span = lambda a: F.sequence(F.expr(f"cast(floor({a}0 / {cell}) as int)"), F.expr(f"cast(floor(({a}1 - 1) / {cell}) as int)"))
    b = boxes.where("y1 > y0 and x1 > x0").select(*BOX).withColumn("_cy", F.explode(span("y"))).withColumn("_cx", F.explode(span("x")))
    p = points.withColumns({f"_c{a}": F.expr(f"cast(floor({a} / {cell}) as int)") for a in "yx"})
    inside = "y >= y0 and y < y1 and x >= x0 and x < x1"
    return p.join(b, ["image_id", "_cy", "_cx"]).where(inside).drop("_cy", "_cx")


def padded_patches(images: DataFrame, window: int, mask: int) -> DataFrame:
    """Windows over a reflect-padded image: y, x (corner in the padded image), row, col, and the padding."""
    n = {a: F.ceil((F.col(side) - mask) / mask) + 1 for a, side in (("y", "height"), ("x", "width"))}
    g = images.withColumns({"rows": n["y"].cast("int"), "cols": n["x"].cast("int")})
    g = _grid(g, ("col", F.col("cols")), ("row", F.col("rows")))
    return g.select(
        "image_id", (F.col("row") * mask).alias("y"), (F.col("col") * mask).alias("x"), "row", "col", F.lit((window - mask) // 2).alias("pad_top"),
        (F.col("rows") * mask + window - F.col("height")).alias("pad_bottom"), (F.col("cols") * mask + window - F.col("width")).alias("pad_right"),
    )


def extract(images: DataFrame, window: int, step: int, how: str) -> DataFrame:
    """sliding() by name, in any case: 'valid', or 'mirror' for windows over the reflect-padded image."""
    if how.lower() not in ("valid", "mirror"):
        raise ValueError(f"no such extraction: {how}")
    return sliding(images, window, step, mirror=how.lower() == "mirror")


def sliding(images: DataFrame, window: int, step: int, mirror: bool = False) -> DataFrame:
    """Windows from the corner, then one more row and column flush with the far edges where steps leave a rest: kind 0 grid, 1 bottom, 2 right, 3 corner."""
    diff = window - step if mirror else 0
    g = dealt(images).withColumns({"h": F.col("height") + diff, "w": F.col("width") + diff})
    full = lambda c: F.floor((F.col(c) - window) / step) + 1
    rest = lambda c: (F.col(c) - window) % step != 0
    rows, cols = _along(g, "i", full("h")), _along(g, "j", full("w"))
    both = _along(rows, "j", full("w"))
    pick = lambda df, kind, y, x: df.select("image_id", F.lit(kind).alias("kind"), y.cast("int").alias("y"), x.cast("int").alias("x"))
    i, j, bottom, right = F.col("i") * step, F.col("j") * step, F.col("h") - window, F.col("w") - window
    return (
        pick(both, 0, i, j).unionByName(pick(cols.where(rest("h")), 1, bottom, j)).unionByName(pick(rows.where(rest("w")), 2, i, right)).unionByName(pick(g.where(rest("h") & rest("w")), 3, bottom, right))
    )


def boxes_with_tissue(boxes: DataFrame, mask: DataFrame, scale: float) -> DataFrame:
    """Boxes (y0, x0, y1, x1) that hold a mask pixel (my, mx) once scaled; bounds round half to even. A left semi range join on cells."""
    cell = 64
    b = boxes.withColumns({f"_{c}": F.rint(F.col(c) * scale).cast("int") for c in ("y0", "x0", "y1", "x1")})
    span = lambda a: F.sequence(F.expr(f"_{a}0 div {cell}"), F.greatest(F.expr(f"_{a}0 div {cell}"), F.expr(f"(_{a}1 - 1) div {cell}")))
    b = b.withColumn("_cy", F.explode(span("y"))).withColumn("_cx", F.explode(span("x")))
    m = mask.withColumns({"_cy": F.expr(f"cast(my as bigint) div {cell}"), "_cx": F.expr(f"cast(mx as bigint) div {cell}")}).withColumnRenamed("image_id", "_m")
    on = (b["image_id"] == m["_m"]) & (b["_cy"] == m["_cy"]) & (b["_cx"] == m["_cx"]) & (m["my"] >= b["_y0"]) & (m["my"] < b["_y1"]) & (m["mx"] >= b["_x0"]) & (m["mx"] < b["_x1"])
    return b.join(m, on, "left_semi").select(*boxes.columns).distinct()
