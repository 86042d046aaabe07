"""The tissue mask of a slide's thumbnail: grey values cut at the threshold of largest variance between classes, cleaned and grown."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels


def thresholds(greys: DataFrame) -> DataFrame:
    """greys: image_id, grey (0 to 255). image_id, threshold: the grey value that parts dark from light with the largest variance between, the lowest of equals.

    A histogram of 256 rows an image, and running sums over it.
    """
    counts = greys.groupBy("image_id", "grey").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("image_id")
    upto = own.orderBy("grey").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select(
        "image_id", "grey", F.sum("n").over(own).alias("all"), F.sum(F.col("n") * F.col("grey")).over(own).alias("mass"), F.sum("n").over(upto).alias("dark"), F.sum(F.col("n") * F.col("grey")).over(upto).alias("dark_mass")
    )
    light = F.col("all") - F.col("dark")
    gap = F.col("dark_mass") / F.col("dark") - F.try_divide(F.col("mass") - F.col("dark_mass"), light)
    variance = F.coalesce(F.col("dark").cast("double") * light * gap * gap, F.lit(0.0))
    # rounded, as equal splits of symmetric histograms may differ in their last bits
    ranked = sums.withColumn("_r", F.row_number().over(own.orderBy(F.desc(F.round(variance, 3)), "grey")))
    return ranked.where("_r = 1").select("image_id", F.col("grey").alias("threshold"))


def binary(greys: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x) that are no lighter than their image's threshold."""
    return greys.join(thresholds(greys), "image_id").where("grey <= threshold").select("image_id", "y", "x")


def cleaned(mask: np.ndarray, min_size: int = 256, min_hole: int = 16384, grow: int = 16) -> np.ndarray:
    """Without small objects (8-connected), small holes closed, grown by a disc."""
    return kernels.dilated(kernels.without_holes(kernels.without_small(kernels.components(mask, diagonal=True), min_size) > 0, min_hole), grow)


def tissue_mask(greys: DataFrame, images: DataFrame, min_size: int = 256, min_hole: int = 16384, grow: int = 16) -> DataFrame:
    """greys: image_id, y, x, grey of thumbnails; images: image_id, height, width. Tissue pixels image_id, y, x; a group is one thumbnail's dark pixels."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((int(rows["height"].iloc[0]), int(rows["width"].iloc[0])), bool)
        mask[rows["y"], rows["x"]] = True
        y, x = np.nonzero(cleaned(mask, min_size, min_hole, grow))
        return pd.DataFrame({"image_id": rows["image_id"].iloc[0], "y": y, "x": x}, index=range(len(y)))

    return binary(greys).join(images, "image_id").groupBy("image_id").applyInPandas(run, "image_id long, y int, x int")


def given_mask(greys: DataFrame) -> DataFrame:
    """A mask that came as an image: every pixel that is not black."""
    return greys.where("grey > 0").select("image_id", "y", "x")


def connected_parts(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    """mask: image_id, y, x of tiles or thumbnails; a group is one of them. Its connected parts as inst_id, numbered in reading order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = rows["y"].min(), rows["x"].min()
        grid = np.zeros((rows["y"].max() - y0 + 1, rows["x"].max() - x0 + 1), bool)
        grid[rows["y"] - y0, rows["x"] - x0] = True
        return rows.assign(inst_id=kernels.components(grid, diagonal)[rows["y"] - y0, rows["x"] - x0])

    return mask.select("image_id", "y", "x").groupBy("image_id").applyInPandas(run, "image_id long, y int, x int, inst_id int")


def remove_small_parts(mask: DataFrame, min_size: int, diagonal: bool = False) -> DataFrame:
    """mask: image_id, y, x of tiles or thumbnails. Pixels of connected parts of at least min_size pixels."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = rows["y"].min(), rows["x"].min()
        grid = np.zeros((rows["y"].max() - y0 + 1, rows["x"].max() - x0 + 1), bool)
        grid[rows["y"] - y0, rows["x"] - x0] = True
        keep = kernels.without_small(kernels.components(grid, diagonal), min_size) > 0
        return rows[keep[rows["y"] - y0, rows["x"] - x0]]

    return mask.select("image_id", "y", "x").groupBy("image_id").applyInPandas(run, "image_id long, y int, x int")
