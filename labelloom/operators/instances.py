"""Operators on the objects of label maps: boxes, centroids, types, ids, distance maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .groups import dealt

OBJECT = ["image_id", "inst_id"]


def boxes(labels: DataFrame) -> DataFrame:
    """Half-open box, centroid and area of each object."""
    return labels.groupBy(*OBJECT).agg(
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("area"),
    )


def type_vote(labels: DataFrame) -> DataFrame:
    """labels with type_id. The commonest type, not background if another is there, the lower one on ties; type_prob is its share."""
    counts = labels.groupBy(*OBJECT, "type_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*OBJECT)
    ranked = counts.withColumns({"area": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.col("type_id") == 0, F.desc("n"), "type_id"))})
    return ranked.where("r = 1").select(*OBJECT, "type_id", (F.col("n") / (F.col("area") + 1e-6)).alias("type_prob"))


def described(labels: DataFrame) -> DataFrame:
    """boxes() and type_vote() of labels with type_id, in one pass: counts by type first, then one row an object; no join."""
    by_type = labels.groupBy(*OBJECT, "type_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")
    )
    best = F.max(F.struct((F.col("type_id") != 0).alias("own"), F.col("n"), (-F.col("type_id")).alias("low")))
    area = F.sum("n")
    return by_type.groupBy(*OBJECT).agg(
        F.min("y0").alias("y0"), (F.max("y1") + 1).alias("y1"), F.min("x0").alias("x0"), (F.max("x1") + 1).alias("x1"), (F.sum("sx") / area).alias("cx"), (F.sum("sy") / area).alias("cy"), area.alias("area"),
        (-best["low"]).cast("int").alias("type_id"), (best["n"] / (area + 1e-6)).alias("type_prob"),
    )


def remap(labels: DataFrame, by_size: bool = False) -> DataFrame:
    """New ids from 1 for each image, by id or by falling area: image_id, inst_id, new_id. Ranks run over objects, not pixels."""
    sizes = labels.groupBy(*OBJECT).agg(F.count(F.lit(1)).alias("area"))
    order = [F.desc("area"), "inst_id"] if by_size else ["inst_id"]
    return sizes.select(*OBJECT, F.row_number().over(Window.partitionBy("image_id").orderBy(*order)).alias("new_id"))


def remove_small(labels: DataFrame, min_size: int) -> DataFrame:
    """Pixels of objects of at least min_size pixels."""
    large = labels.groupBy(*OBJECT).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_size)
    return labels.join(large.drop("_n"), OBJECT, "left_semi")


def _rounded_centre(mean: Column, low: Column) -> Column:
    """The box begins two pixels early and its pixels count from one, so rounding sees y - y0 + 2."""
    return F.floor(mean - low + 2 + 0.5) - 3 + low


def _from_centre(c: Column, centre: Column, low: Column, high: Column) -> Column:
    """Distance of a place to the centre, scaled by the largest on its side."""
    d = c - centre
    return F.when(d < 0, d / -(low - centre)).when(d > 0, d / (high - centre)).otherwise(0.0).cast("double")


def distance_maps(labels: DataFrame) -> DataFrame:
    """Horizontal and vertical distances to the rounded centre of mass, scaled to [-1, 1] on either side, for each pixel.

    An object's box and centre give its largest distances, so one aggregate row an object is joined to its pixels.
    """
    sizes = labels.groupBy(*OBJECT).agg(*(f.alias(n) for c in ("x", "y") for n, f in ((f"_c{c}", _rounded_centre(F.avg(c), F.min(c))), (f"_low{c}", F.min(c)), (f"_high{c}", F.max(c)))))
    out = labels.join(sizes, OBJECT)
    value = {c: _from_centre(F.col(c), F.col(f"_c{c}"), F.col(f"_low{c}"), F.col(f"_high{c}")) for c in ("x", "y")}
    return out.select("image_id", "y", "x", "inst_id", value["x"].alias("h"), value["y"].alias("v"))


def enlarged_maps(pixels: DataFrame, k: int) -> DataFrame:
    """pixels: image_id, y, x, inst_id (0: background) and others, each place once, of images of which a task may hold one. Every pixel k x k times, with h and v as
    distance_maps() gives them for the enlarged objects, 0 for background.

    An enlarged object's box and mean follow from the small one's, so the small rows alone are shuffled, once and by image; what
    groups by image next finds its groups together.
    """
    rows, value = _with_centres(pixels, k)
    steps = F.array(*(F.lit(i) for i in range(k)))
    rows = rows.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps)).withColumns({c: F.col(c) * k + F.col(f"_d{c}") for c in ("y", "x")})
    return rows.select(*pixels.columns, value("x", F.col("x")).alias("h"), value("y", F.col("y")).alias("v"))


def enlarged_blocks(pixels: DataFrame, k: int) -> DataFrame:
    """enlarged_maps() with a row for each block of k x k pixels: y and x are its corner, h and v its values row by row, other columns as they are."""
    rows, value = _with_centres(pixels, k)
    # functions over arrays, as the expressions of all k values written out make a method that the JVM does not compile
    steps = F.array(*(F.lit(i) for i in range(k)))
    h = F.flatten(F.array_repeat(F.transform(steps, lambda i: value("x", F.col("x") * k + i)), k))
    v = F.flatten(F.transform(steps, lambda i: F.array_repeat(value("y", F.col("y") * k + i), k)))
    # in a selection of its own: within functions over arrays "x" would be the new column of that name
    rows = rows.select(*pixels.columns, h.alias("h"), v.alias("v"))
    return rows.withColumns({c: F.col(c) * k for c in ("y", "x")})


def _with_centres(pixels: DataFrame, k: int) -> tuple[DataFrame, Callable[[str, Column], Column]]:
    """pixels, dealt out by image, with the boxes and centres of their objects once enlarged, and the scaled distance to them along x or y of an enlarged place."""
    w = Window.partitionBy(*OBJECT)
    n = F.count(F.lit(1)).over(w)
    told = {}
    for c in ("x", "y"):
        low, mean = (k * F.min(c).over(w)).cast("int"), (k**3 * F.sum(c).over(w) + k * k * (k - 1) // 2 * n) / (k * k * n)
        told |= {f"_c{c}": _rounded_centre(mean, low), f"_low{c}": low, f"_high{c}": (k * F.max(c).over(w) + k - 1).cast("int")}
    value = lambda c, at: F.when(F.col("inst_id") > 0, _from_centre(at, F.col(f"_c{c}"), F.col(f"_low{c}"), F.col(f"_high{c}"))).otherwise(0.0)
    return dealt(pixels, "image_id").withColumns(told), value


def targets(labels: DataFrame, height: int, width: int, out_h: int, out_w: int, min_size: int = 30) -> DataFrame:
    """Training targets of the centre crop: np, h, v. Maps come from whole objects; of the crop's objects those under min_size have none."""
    h0, w0 = (height - out_h) // 2, (width - out_w) // 2
    inside = (F.col("y") >= h0) & (F.col("y") < h0 + out_h) & (F.col("x") >= w0) & (F.col("x") < w0 + out_w)
    maps = distance_maps(labels).where(inside)
    chosen = remove_small(labels.where(inside), min_size).select(*OBJECT).distinct().withColumn("_k", F.lit(True))
    kept = maps.join(chosen, OBJECT, "left")
    value = lambda c: F.when(F.col("_k"), F.col(c)).otherwise(0.0)
    return kept.select("image_id", (F.col("y") - h0).alias("y"), (F.col("x") - w0).alias("x"), F.lit(1).alias("np"), value("h").alias("h"), value("v").alias("v"))


def without(labels: DataFrame, gone: DataFrame) -> DataFrame:
    """Pixels of objects that are not listed in gone (image_id, inst_id)."""
    return labels.join(gone, OBJECT, "left_anti")


def id_offsets(labels: DataFrame) -> DataFrame:
    """image_id, objects, first: where each image's objects begin if all were numbered on. The running sum is over images, in ranges of ids first."""
    n = labels.select(*OBJECT).distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("objects")).withColumn("_g", F.expr("image_id div 1024"))
    groups = n.groupBy("_g").agg(F.sum("objects").alias("o")).withColumn("_before", F.sum("o").over(Window.orderBy("_g")) - F.col("o")).drop("o")
    within = F.sum("objects").over(Window.partitionBy("_g").orderBy("image_id")) - F.col("objects")
    return n.withColumn("_w", within).join(groups, "_g").select("image_id", "objects", (F.col("_w") + F.col("_before")).alias("first"))


def validation_scores(pixels: DataFrame, kinds: list[int]) -> list:
    """Aggregates of pixels t, q (foreground, true and guessed), tt, tq (types), h, v and hq, vq (maps): accuracy, Dice, Dice per type, squared error of both maps by pixels."""
    t, q = F.col("t"), F.col("q")
    dice = lambda a, b, eps: 2.0 * F.sum((a & b).cast("int")) / (F.sum(a.cast("int")) + F.sum(b.cast("int")) + eps)
    square = lambda a, b: F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    return [
        F.avg((t == q).cast("int")).alias("np_acc"), dice(t == 1, q == 1, 0.0).alias("np_dice"), *(dice(F.col("tt") == k, F.col("tq") == k, 1e-8).alias(f"tp_dice_{k}") for k in kinds),
        ((square("h", "hq") + square("v", "vq")) / F.count(F.lit(1))).alias("hv_mse"),
    ]
