"""Work on images that no task holds whole: tiles with margins for kernels, labels of parts joined across seams."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.sources.storage import written

from . import kernels
from .groups import over_groups

PIXEL = ["image_id", "y", "x"]
TILE = 1024

#: A kernel over a tile with its margin: dense arrays by column name in, dense arrays by name out, of the same shape.
Kernel = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def _near_tiles(at: str, length: str, tile: int, margin: int) -> Column:
    """The tiles along an axis whose margins hold a place."""
    first, last = (F.expr(f"cast(floor(({at} {sign} {margin}) / {tile}) as int)") for sign in "-+")
    return F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.expr(f"cast(floor(({length} - 1) / {tile}) as int)")))


def with_margins(pixels: DataFrame, images: DataFrame, tile: int, margin: int) -> DataFrame:
    """Every pixel (image_id, y, x, ...) in each tile that needs it, with the tile's place ty, tx and the image's height and width.

    images: image_id, height, width. A pixel further than the margin from a tile line is sent once, so with tiles of T and a
    margin of m about (1 + 2m/T) squared times the pixels are shuffled.
    """
    sized = pixels.join(images.select("image_id", "height", "width"), "image_id").where("y >= 0 and y < height and x >= 0 and x < width")
    return sized.withColumn("ty", F.explode(_near_tiles("y", "height", tile, margin))).withColumn("tx", F.explode(_near_tiles("x", "width", tile, margin)))


def tiled(pixels: DataFrame, images: DataFrame, kernel: Kernel, columns: dict[str, str], tile: int = TILE, margin: int = 0) -> DataFrame:
    """A kernel over every tile and its margin, which is cut at the image's edge: there the kernel sees the edge itself, elsewhere the neighbours' pixels.

    pixels: image_id, y, x and any columns, sparse; what is absent is 0. columns: names and types of what the kernel gives; rows at which
    all of it is 0 are left out. The result is that of the kernel over the whole image wherever the kernel looks no
    further than the margin. A group is a tile, whatever the image's size.
    """
    inputs = [c for c in pixels.columns if c not in PIXEL]

    names = list(columns)

    def run(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        at = {c: rows[c].to_numpy() for c in rows.columns}
        parts = []
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(rows)], strict=True)):
            height, width = int(at["height"][a]), int(at["width"][a])
            y0, x0 = int(at["_y0"][a]), int(at["_x0"][a])
            y1, x1 = min(y0 + tile, height), min(x0 + tile, width)
            top, left = max(0, y0 - margin), max(0, x0 - margin)
            shape = min(height, y1 + margin) - top, min(width, x1 + margin) - left
            place = at["y"][a:b] - top, at["x"][a:b] - left
            grids = {}
            for c in inputs:
                grids[c] = np.zeros(shape, at[c].dtype)
                grids[c][place] = at[c][a:b]
            out = {c: g[y0 - top : y1 - top, x0 - left : x1 - left] for c, g in kernel(grids).items()}
            y, x = np.nonzero(np.logical_or.reduce([g != 0 for g in out.values()]))
            parts.append((np.full(len(y), k), y + y0, x + x0, *(out[c][y, x] for c in names)))
        return pd.DataFrame(dict(zip(["group", "y", "x", *names], map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    rows = with_margins(pixels, images, tile, margin).withColumns({"_y0": F.col("ty") * tile, "_x0": F.col("tx") * tile})
    return over_groups(rows, ["image_id", "ty", "tx"], run, ", ".join(["y int", "x int", *(f"{c} {t}" for c, t in columns.items())])).drop("ty", "tx")


def _mask(pixels: DataFrame) -> DataFrame:
    return pixels.select(*PIXEL, F.lit(True).alias("on"))


def derivative(pixels: DataFrame, images: DataFrame, value: str, axis: int, size: int = 21, tile: int = TILE) -> DataFrame:
    """Smoothed derivative along an axis (0 for y): image_id, y, x, out, where it is not 0."""
    rows = pixels.select(*PIXEL, F.col(value).cast("double").alias("v"))
    return tiled(rows, images, lambda g: {"out": kernels.derivative(g["v"], axis, size)}, {"out": "double"}, tile, size // 2)


def opened(mask: DataFrame, images: DataFrame, size: int = 5, tile: int = TILE) -> DataFrame:
    """Pixels that an erosion and a dilation leave."""
    return tiled(_mask(mask), images, lambda g: {"on": kernels.opened(g["on"], size)}, {"on": "boolean"}, tile, 2 * (size // 2)).select(*PIXEL)


def dilated(mask: DataFrame, images: DataFrame, half: int, tile: int = TILE) -> DataFrame:
    """Pixels of a mask grown by a disc."""
    return tiled(_mask(mask), images, lambda g: {"on": kernels.dilated(g["on"], half)}, {"on": "boolean"}, tile, half).select(*PIXEL)


def complement(mask: DataFrame, images: DataFrame, tile: int = TILE) -> DataFrame:
    """The pixels of the images that a mask lacks, tile by tile; also of tiles and images without any."""
    steps = lambda n: F.sequence(F.lit(0), F.expr(f"cast(floor(({n} - 1) / {tile}) as int)"))
    every = images.where("height > 0 and width > 0").select("image_id", "height", "width").withColumn("ty", F.explode(steps("height"))).withColumn("tx", F.explode(steps("width")))
    keys = ["image_id", "ty", "tx"]
    cut = mask.select("image_id", "y", "x", F.expr(f"cast(floor(y / {tile}) as int)").alias("ty"), F.expr(f"cast(floor(x / {tile}) as int)").alias("tx"))

    def run(box: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if box.empty:
            return pd.DataFrame({"image_id": [], "y": [], "x": []})
        y0, x0 = int(box["ty"].iloc[0]) * tile, int(box["tx"].iloc[0]) * tile
        grid = np.ones((min(tile, int(box["height"].iloc[0]) - y0), min(tile, int(box["width"].iloc[0]) - x0)), bool)
        grid[rows["y"] - y0, rows["x"] - x0] = False
        y, x = np.nonzero(grid)
        return pd.DataFrame({"image_id": box["image_id"].iloc[0], "y": y + y0, "x": x + x0}, index=range(len(y)))

    return every.groupBy(*keys).cogroup(cut.groupBy(*keys)).applyInPandas(run, f"image_id {dict(images.dtypes)['image_id']}, y int, x int")


def joined(edges: DataFrame) -> DataFrame:
    """edges: image_id, a, b (long). image_id, node, part (its smallest reachable node) of every node that has an edge to another.

    Each pass hangs every node's larger neighbours on its smallest one, then every node on the smallest of those that are left;
    chains halve, and a pass is aggregations and joins on (image_id, node), written once.
    """

    def edge(a: Column, b: Column) -> list[Column]:
        return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]

    def total(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("image_id", "u", "v").cast("decimal(20,0)"))).first())

    u, v, m = F.col("u"), F.col("v"), F.col("m")
    now = written(edges.where("a != b").select("image_id", *edge(F.col("a"), F.col("b"))).distinct(), "seams")
    seen = total(now)
    while seen[0]:
        both = now.unionByName(now.select("image_id", v.alias("u"), u.alias("v")))
        least = both.groupBy("image_id", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, ["image_id", "u"]).where("v != m").select("image_id", *edge(v, m)).distinct()
        low = large.groupBy("image_id", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["image_id", "u"]).where("v != m").select("image_id", *edge(v, m)).unionByName(low.select("image_id", "u", m.alias("v")))
        now = written(small.distinct(), "stars")
        before, seen = seen, total(now)
        if seen == before:
            break
    return now.select("image_id", u.alias("node"), v.alias("part")).unionByName(now.select("image_id", v.alias("node"), v.alias("part")).distinct())


def _local_parts(mask: DataFrame, tile: int, diagonal: bool) -> DataFrame:
    """Pixels with the part of their own tile that they are in, named by its first pixel: y * 2^32 + x."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
        grid = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        grid[y - y.min(), x - x.min()] = True
        labels = kernels.components(grid, diagonal)[y - y.min(), x - x.min()]
        code = y.astype(np.int64) * 2**32 + x
        first = np.full(labels.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, labels, code)
        return rows[PIXEL].assign(node=first[labels])

    kind = dict(mask.dtypes)["image_id"]
    keys = [F.expr(f"cast(floor({a} / {tile}) as int)").alias(f"t{a}") for a in "yx"]
    return mask.select(*PIXEL, *keys).groupBy("image_id", "ty", "tx").applyInPandas(run, f"image_id {kind}, y int, x int, node long")


def parts_of(mask: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """mask: image_id, y, x of images of any size, each pixel once. image_id, y, x, part: the connected part, named by its first pixel in reading order, y * 2^32 + x.

    Parts are found tile by tile; pixels on both sides of a tile line make a table of edges between tiles' parts, and these are joined. No task
    holds more than a tile, and only pixels at tile lines are shuffled a second time.
    """
    local = written(_local_parts(mask, tile, diagonal), "tile-parts")
    rim = local.where(f"pmod(y, {tile}) in (0, {tile - 1}) or pmod(x, {tile}) in (0, {tile - 1})")
    steps = [(-1, 0), (0, -1), *([(-1, -1), (-1, 1)] if diagonal else [])]
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps)))
    start = rim.select("image_id", "y", "x", F.col("node").alias("b"), step.alias("s"))
    over = "floor(y / {0}) != floor((y + s.dy) / {0}) or floor(x / {0}) != floor((x + s.dx) / {0})".format(tile)
    start = start.where(over).select("image_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "b")
    edges = start.join(rim.withColumnRenamed("node", "a"), PIXEL).select("image_id", "a", "b").distinct()
    return local.join(joined(edges), ["image_id", "node"], "left").select(*PIXEL, F.coalesce("part", "node").alias("part"))


def connected_parts(mask: DataFrame, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """image_id, y, x, inst_id: connected parts numbered in reading order, as tissue.connected_parts() numbers them, of images of any size. Ranks run over parts, not pixels."""
    rows = written(parts_of(mask, diagonal, tile), "parts")
    order = Window.partitionBy("image_id").orderBy("part")
    ids = rows.groupBy("image_id", "part").agg(F.lit(1).alias("_")).select("image_id", "part", F.row_number().over(order).alias("inst_id"))
    return rows.join(ids, ["image_id", "part"]).select(*PIXEL, "inst_id")


def _sized(rows: DataFrame) -> DataFrame:
    return rows.groupBy("image_id", "part").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(n + c) for f, n in ((F.min, "first_"), (F.max, "last_")) for c in "yx"))


def remove_small_parts(mask: DataFrame, min_size: int, diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """Pixels of connected parts of at least min_size pixels."""
    rows = written(parts_of(mask, diagonal, tile), "parts")
    return rows.join(_sized(rows).where(F.col("n") >= min_size), ["image_id", "part"], "left_semi").select(*PIXEL)


def _closed(mask: DataFrame, images: DataFrame, tile: int, which: str) -> DataFrame:
    holes = written(parts_of(complement(mask, images, tile), tile=tile), "holes")
    told = _sized(holes).join(images.select("image_id", "height", "width"), "image_id").where(which)
    return mask.select(*PIXEL).unionByName(holes.join(told, ["image_id", "part"], "left_semi").select(*PIXEL))


def filled(mask: DataFrame, images: DataFrame, tile: int = TILE) -> DataFrame:
    """The mask with its holes: background that does not reach the image's edge."""
    return _closed(mask, images, tile, "first_y > 0 and first_x > 0 and last_y < height - 1 and last_x < width - 1")


def without_holes(mask: DataFrame, images: DataFrame, least: int, tile: int = TILE) -> DataFrame:
    """The mask with holes, also those at the edge, of under `least` pixels."""
    return _closed(mask, images, tile, f"n < {least}")


def tissue_mask(dark: DataFrame, images: DataFrame, min_size: int = 256, min_hole: int = 16384, grow: int = 16, tile: int = TILE) -> DataFrame:
    """tissue.cleaned() of masks of any size: small parts (8-connected) go, small holes are closed, the rest is grown by a disc."""
    large = written(remove_small_parts(dark, min_size, True, tile), "large-parts")
    return dilated(without_holes(large, images, min_hole, tile), images, grow, tile)
