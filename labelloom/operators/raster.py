"""Pixel operators on long rasters (image_id, y, x, value columns): windows, padding, stencils, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def center_crop(pixels: DataFrame, height: int, width: int, out_h: int, out_w: int) -> DataFrame:
    """A filter that reaches the scan, and a shift."""
    h0, w0 = (height - out_h) // 2, (width - out_w) // 2
    inside = F.col("y").between(h0, h0 + out_h - 1) & F.col("x").between(w0, w0 + out_w - 1)
    return pixels.where(inside).withColumns({"y": F.col("y") - h0, "x": F.col("x") - w0})


def canvas(images: DataFrame, height: int, width: int) -> DataFrame:
    """All places of an image of this size for each row of images (image_id)."""
    return images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def center_pad(pixels: DataFrame, height: int, width: int, out_h: int, out_w: int, value: str = "v", fill: float = 255) -> DataFrame:
    """Constant padding, the smaller half before."""
    top, lead = (out_h - height) // 2, (out_w - width) // 2
    placed = pixels.select("image_id", (F.col("y") + top).alias("y"), (F.col("x") + lead).alias("x"), F.col(value))
    full = canvas(pixels.select("image_id").distinct(), out_h, out_w)
    return full.join(placed, ["image_id", "y", "x"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(float(fill))))


def mirrored(index: Column, length: int) -> Column:
    """Source index of a reflected one; edges are not repeated."""
    if length == 1:
        return F.lit(0)
    m = F.pmod(index, F.lit(2 * (length - 1)))
    return F.when(m < length, m).otherwise(2 * (length - 1) - m)


def mirror_places(index: Column, length: Column | int, before: Column | int, after: Column | int) -> Column:
    """All places, from 0 in the padded image, that show this index: index and its mirror image, again every two lengths."""
    length, before, after = (F.lit(v) if isinstance(v, int) else v for v in (length, before, after))
    total = (before + length + after).cast("int")
    period = F.greatest(F.lit(1), 2 * (length - 1)).cast("int")
    # places k with k - before = index or -index modulo the period
    first, other = F.pmod(index + before, period).cast("int"), F.pmod(before - index, period).cast("int")
    run = lambda start: F.when(start < total, F.sequence(start, total - 1, period)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(run(first), run(other)))


def reflect_pad(pixels: DataFrame, height: int, width: int, top: int, bottom: int, left: int, right: int, value: str = "v") -> DataFrame:
    """Each source pixel is sent to its mirror places: an explode, no join."""
    return (
        pixels.withColumn("_y", F.explode(mirror_places(F.col("y"), height, top, bottom))).withColumn("_x", F.explode(mirror_places(F.col("x"), width, left, right)))
        .select("image_id", F.col("_y").alias("y"), F.col("_x").alias("x"), value)
    )


def reassemble(patches: DataFrame, rows: Column, cols: Column, size: int, height: int, width: int) -> DataFrame:
    """Pixels (row, col, dy, dx, v) of a grid of patches, cut to the source."""
    y, x = rows * size + F.col("dy"), cols * size + F.col("dx")
    return patches.withColumns({"y": y, "x": x}).where((F.col("y") < height) & (F.col("x") < width)).select("image_id", "y", "x", "v")


def upsample2(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Nearest neighbour, twice as high and wide."""
    two = F.array(F.lit(0), F.lit(1))
    grown = pixels.withColumn("_a", F.explode(two)).withColumn("_b", F.explode(two))
    return grown.select("image_id", (2 * F.col("y") + F.col("_a")).alias("y"), (2 * F.col("x") + F.col("_b")).alias("x"), value)


def min_max(pixels: DataFrame, value: str = "v") -> DataFrame:
    """Each image scaled to [0, 1]; a constant one becomes 0."""
    w = Window.partitionBy("image_id")
    low, high = F.min(value).over(w), F.max(value).over(w)
    return pixels.withColumn("scaled", F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0))


def stencil(pixels: DataFrame, weights: dict[tuple[int, int], float], value: str = "v") -> DataFrame:
    """Sum of weighted neighbours; places beyond the image add nothing. Pixels are sent to the places they add to: one shuffle with partial sums."""
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("w")) for (dy, dx), w in weights.items()))
    spread = pixels.select("image_id", "y", "x", F.col(value).alias("_v"), F.explode(offsets).alias("o"))
    sums = spread.groupBy("image_id", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x")).agg(F.sum(F.col("_v") * F.col("o.w")).alias("out"), F.max(F.when((F.col("o.dy") == 0) & (F.col("o.dx") == 0), 1)).alias("_own"))
    return sums.where("_own = 1").drop("_own")


GAUSS3 = {(dy, dx): (2 - abs(dy)) * (2 - abs(dx)) / 16 for dy in (-1, 0, 1) for dx in (-1, 0, 1)}


def gradient_weights(size: int = 5) -> tuple[dict, dict]:
    """Horizontal and vertical derivative weights k / (h^2 + v^2)."""
    half = size // 2
    places = [(a, b) for a in range(-half, half + 1) for b in range(-half, half + 1)]
    rule = lambda k, a, b: k / (a * a + b * b + 1e-15)
    return {(a, b): rule(a, a, b) for a, b in places}, {(a, b): rule(b, a, b) for a, b in places}


def affine_source(y: Column, x: Column, matrix: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Nearest source place of an output place under the inverse map (a b c / d e f) of (x, y, 1)."""
    a, b, c, d, e, f = matrix
    return F.rint(d * x + e * y + f).cast("int"), F.rint(a * x + b * y + c).cast("int")


def crop_by(pixels: DataFrame, height: int, width: int, rows: int, cols: int) -> DataFrame:
    """Without `rows` rows and `cols` columns: the smaller halves at the top and left."""
    top, lead = rows // 2, cols // 2
    inside = F.col("y").between(top, height - (rows - top) - 1) & F.col("x").between(lead, width - (cols - lead) - 1)
    return pixels.where(inside).withColumns({"y": F.col("y") - top, "x": F.col("x") - lead})


def crop_to(pixels: DataFrame, height: int, width: int, out_h: int, out_w: int) -> DataFrame:
    return crop_by(pixels, height, width, height - out_h, width - out_w)


def clamped(boxes: DataFrame, pad: int) -> DataFrame:
    """boxes (y0, x0, y1, x1, height, width) grown by pad on all sides, within their images."""
    grown = {f"{a}{k}": F.greatest(F.lit(0), F.least(F.col(side), F.col(f"{a}{k}") + (pad if k else -pad))) for a, side in (("y", "height"), ("x", "width")) for k in (0, 1)}
    return boxes.withColumns(grown)


def by_maximum(pixels: DataFrame, value: str = "v") -> DataFrame:
    """255 times the value's share of its image's largest, cut to whole numbers; NULL in an image whose largest is 0."""
    largest = F.max(value).over(Window.partitionBy("image_id"))
    return pixels.withColumn("scaled", F.try_divide(255 * F.col(value), largest).cast("int"))


def same_pad(pixels: DataFrame, height: int, width: int, kernel: int, stride: int, value: str = "v") -> DataFrame:
    """Zeros around, so that a kernel with this stride gives ceil(side / stride) results along each side; the smaller half before."""
    more = lambda n: max(kernel - (n % stride or stride), 0)
    return center_pad(pixels, height, width, height + more(height), width + more(width), value, 0)


def replicate_pad(pixels: DataFrame, height: int, width: int, by: int) -> DataFrame:
    """Edges repeated `by` times: every pixel goes to its places, an explode of one but for pixels on the edge."""

    def places(c: str, n: int) -> Column:
        low = F.when(F.col(c) == 0, F.lit(-by)).otherwise(F.col(c))
        return F.sequence(low, F.when(F.col(c) == n - 1, F.lit(n - 1 + by)).otherwise(F.col(c)))

    grown = pixels.withColumn("_y", F.explode(places("y", height))).withColumn("_x", F.explode(places("x", width)))
    return grown.withColumns({"y": F.col("_y"), "x": F.col("_x")}).drop("_y", "_x")


#: Rows of the binomial kernels by size.
BLUR = {1: (1.0,), 3: (0.25, 0.5, 0.25), 5: (0.0625, 0.25, 0.375, 0.25, 0.0625)}


def within(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return pixels.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def gaussian_blur(pixels: DataFrame, height: int, width: int, ky: int, kx: int, value: str = "v") -> DataFrame:
    """image_id, y, x, out: binomial weights over repeated edges."""
    weights = {(dy - ky // 2, dx - kx // 2): a * b for dy, a in enumerate(BLUR[ky]) for dx, b in enumerate(BLUR[kx])}
    return within(stencil(replicate_pad(pixels, height, width, max(ky, kx) // 2), weights, value), height, width)


def median_blur(pixels: DataFrame, height: int, width: int, size: int, value: str = "v") -> DataFrame:
    """image_id, y, x, out: the middle of size x size values over repeated edges. Pixels are sent to the places they count for."""
    half = size // 2
    steps = F.sequence(F.lit(-half), F.lit(half))
    spread = replicate_pad(pixels.select("image_id", "y", "x", F.col(value).alias("_v")), height, width, half)
    spread = spread.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
    placed = within(spread.select("image_id", (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x"), "_v"), height, width)
    return placed.groupBy("image_id", "y", "x").agg(F.sort_array(F.collect_list("_v"))[size * size // 2].alias("out"))


def draw(key: Column, seed: int, stream: int = 0) -> Column:
    """In (0, 1), by digest of key: the same for a row wherever it is."""
    digest = F.md5(F.concat_ws(":", F.lit(f"{seed}:{stream}"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def flipped(pixels: DataFrame, height: int, width: int, seed: int, chance: float = 0.5) -> DataFrame:
    """Images mirrored left to right, and top to bottom, each with a chance of their own."""
    x = F.when(draw(F.col("image_id"), seed, 1) < chance, width - 1 - F.col("x")).otherwise(F.col("x"))
    y = F.when(draw(F.col("image_id"), seed, 2) < chance, height - 1 - F.col("y")).otherwise(F.col("y"))
    return pixels.withColumns({"y": y.cast("int"), "x": x.cast("int")})


def noisy(pixels: DataFrame, scale: float, seed: int, value: str = "v") -> DataFrame:
    """Normal noise by Box and Muller from two draws of a pixel's key, clipped to [0, 255]."""
    key = F.concat_ws(",", "image_id", "y", "x")
    noise = scale * F.sqrt(-2.0 * F.log(draw(key, seed, 3))) * F.cos(2 * 3.141592653589793 * draw(key, seed, 4))
    return pixels.withColumn("out", F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col(value) + noise)))


def affine_matrix(height: int, width: int, scale: tuple[float, float] = (1.0, 1.0), degrees: float = 0.0, shear: float = 0.0, shift: tuple[float, float] = (0.0, 0.0)) -> tuple[float, ...]:
    """Inverse map (a b c / d e f) of scaling (x, y), shearing, turning about the centre, and shifting (x, y)."""
    import numpy as np

    t, s = np.radians(degrees), np.tan(np.radians(shear))
    turn = np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])
    lean, size = np.array([[1, s, 0], [0, 1, 0], [0, 0, 1]]), np.diag([scale[0], scale[1], 1.0])
    to, back = np.eye(3), np.eye(3)
    to[:2, 2], back[:2, 2] = [(width - 1) / 2 + shift[0], (height - 1) / 2 + shift[1]], [-(width - 1) / 2, -(height - 1) / 2]
    return tuple(np.linalg.inv(to @ turn @ lean @ size @ back)[:2].ravel().tolist())


def affine(pixels: DataFrame, height: int, width: int, matrix: tuple[float, ...], fill: float = 0.0, value: str = "v") -> DataFrame:
    """Nearest-neighbour resampling: every place of the result asks for its source place, beyond the image it is `fill`."""
    y, x = affine_source(F.col("y"), F.col("x"), matrix)
    asked = canvas(pixels.select("image_id").distinct(), height, width).withColumns({"_sy": y, "_sx": x})
    source = pixels.select("image_id", F.col("y").alias("_sy"), F.col("x").alias("_sx"), F.col(value))
    return asked.join(source, ["image_id", "_sy", "_sx"], "left").select("image_id", "y", "x", F.coalesce(F.col(value), F.lit(fill)).alias(value))


def _taps(images: DataFrame, side: str, factor: float, how: str) -> DataFrame:
    """For every place of a resized side its source places and their weights: image_id, to, from, w."""
    n = F.floor(F.col(side) * factor + 0.5).cast("int")
    at = images.select("image_id", side, F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("to"))
    at = at.withColumn("s", (F.col("to") + 0.5) / factor - 0.5).withColumn("f", F.floor("s").cast("int")).withColumn("r", F.col("s") - F.col("f"))
    r = F.col("r")
    if how == "linear":
        weights = {0: 1 - r, 1: r}
    elif how == "cubic":
        a = -0.75
        near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
        far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
        weights = {-1: far(r + 1), 0: near(r), 1: near(1 - r), 2: far(2 - r)}
    elif how == "nearest":
        weights = {0: F.lit(1.0)}
        at = at.withColumn("f", F.floor(F.col("to") / factor).cast("int"))
    else:
        raise ValueError(f"no such interpolation: {how}")
    each = F.explode(F.array(*(F.struct((F.col("f") + k).alias("from"), w.alias("w")) for k, w in weights.items())))
    taps = at.select("image_id", side, "to", each.alias("t")).select("image_id", "to", F.greatest(F.lit(0), F.least(F.col(side) - 1, F.col("t.from"))).alias("from"), F.col("t.w").alias("w"))
    return taps.groupBy("image_id", "to", "from").agg(F.sum("w").alias("w"))


def resize(pixels: DataFrame, images: DataFrame, factor: float, how: str | None = None, value: str = "v") -> DataFrame:
    """pixels with images (image_id, height, width), by a factor: image_id, y, x, out. By default cubic if larger, else linear.

    The sides are independent, so weights are tables of a side each, and pixels are summed once along each.
    """
    how = how or ("cubic" if factor > 1 else "linear")
    rows, cols = (_taps(images, side, factor, how).select("image_id", F.col("to").alias(f"_{a}"), F.col("from").alias(a), F.col("w").alias("_w")) for side, a in (("height", "y"), ("width", "x")))
    wide = pixels.join(cols, ["image_id", "x"]).groupBy("image_id", "y", F.col("_x").alias("x")).agg(F.sum(F.col(value) * F.col("_w")).alias("_v"))
    return wide.join(rows, ["image_id", "y"]).groupBy("image_id", F.col("_y").alias("y"), "x").agg(F.sum(F.col("_v") * F.col("_w")).alias("out"))


def region(pixels: DataFrame, y: int, x: int, height: int, width: int, up: float = 1.0) -> DataFrame:
    """The rectangle whose corner is (y, x) at a level `up` times as coarse as the corner's own plane; plain comparisons, which reach the scan."""
    y, x = int(y * up), int(x * up)
    inside = (F.col("y") >= y) & (F.col("y") < y + height) & (F.col("x") >= x) & (F.col("x") < x + width)
    return pixels.where(inside).withColumns({"y": F.col("y") - y, "x": F.col("x") - x})


def windows_of(points: DataFrame, boxes: DataFrame, columns: list[str]) -> DataFrame:
    """Spatial windows: points of arrays `contour` ([x, y]) within closed boxes (image_id, box_id, y0, x0, y1, x1), moved to their corners; objects without any are left out."""
    inside = F.filter("contour", lambda p: p[0].between(F.col("x0"), F.col("x1")) & p[1].between(F.col("y0"), F.col("y1")))
    moved = F.transform(inside, lambda p: F.array(F.round(p[0] - F.col("x0")).cast("int"), F.round(p[1] - F.col("y0")).cast("int")))
    return points.join(boxes, "image_id").withColumn("points", moved).where(F.size("points") > 0).select("image_id", "box_id", *columns, "points")
