"""Whole evaluations and the inference pipeline, composed of operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators import instances, kernels, matching, metrics
from labelloom.sources.storage import written


def per_image(pixels: DataFrame) -> DataFrame:
    """dice1, aji, dq, sq and pq of each image from one contingency table."""
    return metrics.per_image(metrics.contingency(pixels)).select("image_id", "dice1", "aji", "dq", "sq", "pq")


def image_stats(pixels: DataFrame) -> DataFrame:
    """image_id, dice1, aji, dq, sq, pq, aji_plus. Ids are names here, so renumbering them first would change nothing but the order in which
    ties between equal ratios are broken, which renumbering by id keeps. The table is written once, as two branches read it."""
    table = written(metrics.contingency(pixels), "contingency")
    return metrics.per_image(table).select("image_id", "dice1", "aji", "dq", "sq", "pq").join(matching.aji_plus(table), "image_id")


def mean_over_images(pixels: DataFrame) -> DataFrame:
    return per_image(pixels).agg(*(F.avg(c).alias(c) for c in ("dice1", "aji", "dq", "sq", "pq")), F.count(F.lit(1)).alias("images"))


def mean_stats(pixels: DataFrame) -> DataFrame:
    """Unweighted means of image_stats()."""
    return image_stats(pixels).agg(*(F.avg(c).alias(c) for c in ("dice1", "aji", "dq", "sq", "pq", "aji_plus")), F.count(F.lit(1)).alias("images"))


def instance_stats(truth: DataFrame, guess: DataFrame) -> DataFrame:
    """mean_stats() of two sparse label maps (image_id, y, x, inst_id) over the images of guess; an image that truth lacks ends the job."""
    lacking = metrics.missing_truth(truth, guess).limit(1).collect()
    if lacking:
        raise ValueError(f"no truth for image {lacking[0].image_id}")
    return mean_stats(metrics.located(truth.join(guess.select("image_id").distinct(), "image_id", "left_semi"), guess))


def points(labels: DataFrame) -> DataFrame:
    """Centroids with voted types: image_id, idx, x, y, type."""
    return instances.described(labels).select("image_id", F.col("inst_id").alias("idx"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("type_id").alias("type"))


def type_stats(truth: DataFrame, guess: DataFrame, kinds: list[int] | None = None, radius: float = 12, exhaustive: bool = True) -> DataFrame:
    """Detection F1, type accuracy and F1 per type over the pairs of all images, in one aggregation. kinds: by default those of truth, a handful."""
    if kinds is None:
        kinds = sorted(r.type for r in truth.select("type").distinct().collect())
    pairs = matching.pair_points(truth, guess, radius)
    return pairs.agg(*metrics.detection_scores(exhaustive), *(metrics.pair_f1(F.lit(k), exhaustive=exhaustive).alias(f"f1_{k}") for k in kinds))


def infer(patches: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Arrow batches of patch rows through a predictor that is handed in; it returns image_id, y, x, np, h, v (tp)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield predict(rows)

    return patches.mapInPandas(run, schema)


def records(labels: DataFrame, maps: DataFrame | None = None) -> DataFrame:
    """Object records of a label map: boxes, centroids, contours, and types voted from the map's own type_id or from maps (image_id, y, x, tp). Objects whose contour has
    under three points have none. Both joins say that they shuffle: files of pixels are small for their rows, and by their size Spark would send them all to the driver."""
    shapes = kernels.contours(labels).where(F.size("contour") >= 3).hint("merge")
    if "type_id" in labels.columns:
        out = instances.described(labels)
    elif maps is not None and "tp" in maps.columns:
        out = instances.described(labels.join(maps.select("image_id", "y", "x", F.col("tp").cast("int").alias("type_id")).hint("merge"), ["image_id", "y", "x"]))
    else:
        out = instances.boxes(labels).withColumns({"type_id": F.lit(None).cast("int"), "type_prob": F.lit(None).cast("double")})
    out = out.join(shapes, ["image_id", "inst_id"])
    return out.select("image_id", "inst_id", F.array(F.array("y0", "x0"), F.array("y1", "x1")).alias("bbox"), F.array("cx", "cy").alias("centroid"), "contour", "type_prob", F.col("type_id").alias("type"))


def objects(maps: DataFrame) -> DataFrame:
    """Predicted maps of whole images to object records. The label map is written, as outlines and sums both read it."""
    return records(written(kernels.separated(maps, typed="tp" in maps.columns), "tile-labels"))
