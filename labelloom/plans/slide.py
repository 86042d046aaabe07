"""The whole-slide plan: predictions of a slide's patches to objects, tile by tile, with the seams mended."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators import grid, kernels, merge, stacks
from labelloom.operators.groups import over_sorted
from labelloom.plans.evaluate import infer, records
from labelloom.sources import documents
from labelloom.sources.storage import written

#: Boxes of one kind do not overlap; the kinds follow one another.
PHASES = ("tile", "x", "y", "cross")
#: Pixels of the largest slide that a task takes whole, a sixteenth of a tile of 2048; tasks work on as many at a time.
WHOLE = 1 << 18


def slide_boxes(images: DataFrame, tile: int, margin: int, mask: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """image_id, box_id, kind, y0, x0, y1, x1 of tiles, strips and crossings, those with tissue if a mask (image_id, my, mx) is given. Ids follow from places."""
    boxes = grid.tiles(images, tile, margin)
    if mask is not None:
        boxes = grid.boxes_with_tissue(boxes, mask, scale)
    key = F.expr("cast(y0 + 1000000 as bigint) * 10000000 + x0 + 1000000")
    return boxes.withColumn("box_id", key)


def _in_box(kind: str, tile: int, margin: int) -> tuple[Column, Column]:
    """box_id of the only box of a kind that a place (y, x) may lie in, and whether it does; the boxes of tiles() stand at regular steps, so no join tells it."""
    reach = {"tile": (0, 0), "x": (0, margin), "y": (margin, 0), "cross": (2 * margin, 2 * margin)}[kind]
    at, on = [], F.lit(True)
    for c, r in zip("yx", reach, strict=True):
        place = F.col(c) + r
        at.append(F.floor(place / tile) * tile - r)
        if r:
            on = on & (F.pmod(place, F.lit(tile)) < 2 * r) & (place >= tile)
    return (at[0] + 1000000) * 10000000 + at[1] + 1000000, on


def _mended(current: DataFrame, new: DataFrame, kind: str, tile: int, margin: int) -> DataFrame:
    """merge.mend() with the boxes of a kind: a box is a group of old and new pixels, and pixels in no box are handed on as they are."""
    box, on = _in_box(kind, tile, margin)
    height, width = {"x": (tile, 2 * margin), "y": (2 * margin, tile), "cross": (4 * margin, 4 * margin)}[kind]

    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if len(new) and len(old):
            box_id = int(new["box_id"].iloc[0])
            y, x = old["y"] - (box_id // 10000000 - 1000000), old["x"] - (box_id % 10000000 - 1000000)
            edge = (y == 0) | (y == height - 1) | (x == 0) | (x == width - 1)
            old = old[edge.groupby(old["inst_id"]).transform("any")]
            places = lambda rows: rows["y"].to_numpy(np.int64) << 32 | rows["x"]
            new = new[~new["inst_id"].isin(new["inst_id"][places(new).isin(places(old))])]
        return pd.concat([old.assign(fresh=False), new.assign(fresh=True)])[["image_id", "box_id", "y", "x", "inst_id", "fresh"]]

    keys = ["image_id", "box_id"]
    inside = current.where(on).withColumn("box_id", box).groupBy(*keys).cogroup(new.groupBy(*keys)).applyInPandas(run, "image_id long, box_id long, y int, x int, inst_id int, fresh boolean")
    inside = written(inside, f"slide-{kind}-boxes")
    fresh = merge.numbered(current, inside.where("fresh").drop("fresh"))
    return current.where(~on).unionByName(inside.where("not fresh").select("image_id", "y", "x", "inst_id")).unionByName(fresh)


def slide_labels(maps: DataFrame, images: DataFrame, tile: int, margin: int, mask: DataFrame | None = None, scale: float = 1.0, process: kernels.Process | None = None, stored: bool = False) -> DataFrame:
    """image_id, y, x, inst_id of whole slides. maps: image_id, y, x, np, h, v; tile is four margins or more. Every phase reads maps, so they are written first, unless they are `stored`.

    Pixels are of the images' own rows and columns, each place once. Objects are separated per tile; then strips along tile lines and boxes at crossings are separated anew and
    replace what they hold whole. A box is a group of tile size at most, a phase one round of joins; between
    phases the label map is written, as later ones read it several times.
    """
    if tile < 4 * margin:
        raise ValueError("boxes of one phase would overlap: a tile is four margins or more")
    maps = maps.select("image_id", "y", "x", "np", "h", "v")
    maps = maps if stored else written(maps, "slide-maps")
    boxes = written(slide_boxes(images, tile, margin, mask, scale), "slide-boxes")
    now = maps.select("image_id", "y", "x", F.lit(0).alias("inst_id")).limit(0)
    for kind in PHASES:
        own = boxes.where(F.col("kind") == kind)
        box, on = _in_box(kind, tile, margin)
        # the join deals pixels out by box, as the groups want them
        near = maps.where(on).withColumn("box_id", box).join(own.select(*grid.BOX).hint("merge"), ["image_id", "box_id"])
        pixels = near.where("y >= y0 and y < y1 and x >= x0 and x < x1").drop("y0", "x0", "y1", "x1")
        new = kernels.separated(pixels, process=process)
        # numbered() reads what it gets twice; a mended phase writes what it makes of new
        now = written(merge.numbered(now, written(new, "slide-tile")) if kind == "tile" else _mended(now, new, kind, tile, margin), f"slide-labels-{kind}")
    return now


def _layout(height: int, width: int, tile: int, margin: int) -> dict[str, tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray]]:
    """By kind the boxes of slide_boxes() in the order of their ids, cut to the slide, and for each place the number of its box (or -1) and whether it is on that box's edge."""
    out = {}
    for kind in PHASES:
        r = {"tile": (0, 0), "x": (0, margin), "y": (margin, 0), "cross": (2 * margin, 2 * margin)}[kind]
        boxes, number, edge = [], np.full((height, width), -1), np.zeros((height, width), bool)
        for y in range(tile if r[0] else 0, height + 1, tile):
            for x in range(tile if r[1] else 0, width + 1, tile):
                y0, x0, y1, x1 = y - r[0], x - r[1], y + (r[0] or tile), x + (r[1] or tile)
                own = (y0, x0, min(y1, height), min(x1, width))
                if own[2] <= y0 or own[3] <= x0:
                    continue
                number[y0:y1, x0:x1] = len(boxes)
                boxes.append(own)
                for line in (np.s_[y0, x0:x1], np.s_[y0:y1, x0], *([np.s_[y1 - 1, x0:x1]] if y1 <= height else []), *([np.s_[y0:y1, x1 - 1]] if x1 <= width else [])):
                    edge[line] = True
        out[kind] = boxes, number, edge
    return out


def _whole_mended(layout: dict, new: dict[str, np.ndarray]) -> np.ndarray:
    """The label map of a slide from what was separated in each kind's boxes: the phases of slide_labels() with their numbers."""
    now = np.zeros(new["tile"].shape, np.int64)
    for kind in PHASES:
        found = np.nonzero(new[kind])
        if not len(found[0]):
            continue
        _, number, edge = layout[kind]
        top, labels, box = int(now.max()), new[kind][found], number[found]
        low = labels.min()
        _, code = np.unique(box * (labels.max() - low + 1) + (labels - low), return_inverse=True)
        blocked = np.zeros(int(code.max()) + 1, bool)
        if kind != "tile":
            live = np.zeros(int(number.max()) + 2, bool)
            live[box] = True
            held = np.nonzero(live[number] & (now > 0))
            _, old = np.unique(number[held] * (top + 1) + now[held], return_inverse=True)
            within = np.ones(len(old), bool)
            within[old[edge[held]]] = False
            lost = within[old]
            now[held[0][lost], held[1][lost]] = 0
            blocked[code[now[found] > 0]] = True
        ids = top + np.cumsum(~blocked)
        stays = ~blocked[code]
        now[found[0][stays], found[1][stays]] = ids[code[stays]]
    return now


def _whole_slides(maps: DataFrame, images: DataFrame, tile: int, margin: int, process: kernels.Process | None = None, side: int = 1) -> DataFrame:
    """slide_labels() of slides that a task may hold, with type_id if maps have tp: rows of a slide are shuffled once, or not at all if they lie by image, and
    boxes of equal size, of all phases and many slides, are separated together. Maps of blocks go to Python as they are.
    """
    values = ["np", "h", "v", *(["tp"] if "tp" in maps.columns else [])]

    def run(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        columns = {c: rows[c].to_numpy() for c in ("y", "x", "height", "width", *values)}
        layouts: dict[tuple[int, int], dict] = {}
        slides, work = [], {}
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            shape = height, width = int(columns["height"][a]), int(columns["width"][a])
            told = {c: v[a:b] for c, v in columns.items()}
            y, x = told["y"], told["x"]
            if side > 1:
                if told["np"][0] is None:  # a slide without pixels
                    continue
                y, x = ((p[:, None] + steps).ravel() for p, steps in ((y, np.repeat(np.arange(side), side)), (x, np.tile(np.arange(side), side))))
                told |= {c: np.concatenate(told[c]) for c in values}
            inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
            if not inside.any():
                continue
            if shape not in layouts:
                layouts[shape] = _layout(height, width, tile, margin)
            at = (y[inside], x[inside])
            own = []
            for c in values:
                own.append(np.zeros(shape, told[c].dtype))
                own[-1][at] = told[c][inside]
            here = None
            if len(at[0]) < height * width:
                here = np.zeros(shape, bool)
                here[at] = True
            new = {kind: np.zeros(shape, np.int64) for kind in PHASES}
            slides.append((len(slides), int(np.searchsorted(starts, a)), layouts[shape], own, new))
            for kind in PHASES:
                for y0, x0, y1, x1 in layouts[shape][kind][0]:
                    if here is not None:  # a box is as large as the pixels that it has
                        ys, xs = (np.flatnonzero(here[y0:y1, x0:x1].any(axis=k)) for k in (1, 0))
                        if not len(ys):
                            continue
                        y0, x0, y1, x1 = y0 + ys[0], x0 + xs[0], y0 + ys[-1] + 1, x0 + xs[-1] + 1
                    cut = np.s_[y0:y1, x0:x1]
                    work.setdefault((y1 - y0, x1 - x0), []).append((new[kind][cut], [m[cut] for m in own[:3]]))
        for boxes in work.values():
            if process is None:
                for to, labels in zip((to for to, _ in boxes), stacks.separate(*(np.stack([m[k] for _, m in boxes]) for k in range(3))), strict=True):
                    to[:] = labels
            else:
                for to, own in boxes:
                    to[:] = process(*own)
        out: dict[str, list] = {c: [np.zeros(0, int)] for c in ("group", "y", "x", "inst_id", *(["type_id"] if "tp" in values else []))}
        for _, group, layout, own, new in slides:
            now = _whole_mended(layout, new)
            y, x = np.nonzero(now)
            for c, v in (("group", np.full(len(y), group)), ("y", y), ("x", x), ("inst_id", now[y, x]), *([("type_id", own[3][y, x])] if "tp" in values else [])):
                out[c].append(v)
        return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    pixels = maps.select(F.col("image_id").cast("long").alias("image_id"), "y", "x", *values)
    sizes = images.select(F.col("image_id").cast("long").alias("image_id"), "height", "width")
    # a merge of sorted sides gives a slide's pixels one after another; from the slides' side, as adaptive execution may deal out one slide's pixels to several tasks in an inner join
    near = sizes.hint("merge").join(pixels, "image_id", "left").withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("y", "x")})
    return over_sorted(near, ["image_id"], run, "y int, x int, inst_id int" + ", type_id int" * ("tp" in values), WHOLE // side**2)


def _block_pixels(maps: DataFrame, side: int) -> DataFrame:
    values = [c for c in ("np", "h", "v", "tp") if c in maps.columns]
    each = maps.select("image_id", "y", "x", F.posexplode(F.arrays_zip(*values)).alias("_i", "_v"))
    return each.select("image_id", (F.col("y") + F.expr(f"_i div {side}")).cast("int").alias("y"), (F.col("x") + F.col("_i") % side).cast("int").alias("x"), *(F.col("_v")[c].alias(c) for c in values))


def labelled(maps: DataFrame, images: DataFrame, tile: int, margin: int, mask: DataFrame | None = None, scale: float = 1.0, process: kernels.Process | None = None, stored: bool = False, whole: int = WHOLE, side: int = 1) -> DataFrame:
    """slide_labels(), with type_id if maps have tp. Slides of `whole` pixels at most go to a task each whole, the others box by box; with a mask all do. images: a row an image.

    side: a row of maps is a block of side x side pixels from (y, x), with arrays of them row by row in the place of numbers. Small blocks go to Python as they
    are, ten thousand to a batch; larger ones are taken apart first.
    """
    if tile < 4 * margin:
        raise ValueError("boxes of one phase would overlap: a tile is four margins or more")
    if side > 16:
        maps, side = _block_pixels(maps, side), 1
    small = F.col("height").cast("long") * F.col("width") <= (whole if mask is None else -1)
    found = images.agg(F.max(small).alias("small"), F.max(~small).alias("large")).first()
    if not found.large:
        return _whole_slides(maps, images.where(small), tile, margin, process, side)
    if side > 1:
        maps, side, stored = _block_pixels(maps, side), 1, False
    maps = maps if stored else written(maps, "slide-maps")
    own = maps.join(images.where(~small).select("image_id"), "image_id", "left_semi") if found.small else maps
    out = slide_labels(own, images.where(~small), tile, margin, mask, scale, process, stored=not found.small)
    if "tp" in maps.columns:
        out = out.join(own.select("image_id", "y", "x", F.col("tp").cast("int").alias("type_id")).hint("merge"), ["image_id", "y", "x"])
    return out.unionByName(_whole_slides(maps, images.where(small), tile, margin, process)) if found.small else out


def slide_objects(maps: DataFrame, images: DataFrame, tile: int, margin: int, **more) -> DataFrame:
    """Object records of whole slides; maps may carry tp. The label map is written, as outlines and sums both read it."""
    return records(written(labelled(maps, images, tile, margin, **more), "slide-labels"))


def slide_documents(patches: DataFrame, predict: Callable, images: DataFrame, tile: int, margin: int, mag: Column | None = None, preproc: Callable[[DataFrame], DataFrame] | None = None, **more) -> DataFrame:
    """From patches through a predictor to one JSON text per slide. preproc: what is done to the patch rows first."""
    rows = patches.transform(preproc) if preproc is not None else patches
    maps = infer(rows, predict, "image_id long, y int, x int, np double, h double, v double, tp int")
    return documents.to_documents(slide_objects(maps, images, tile, margin, **more), mag)
