"""Images, label maps, slides and patches: what is listed, read and written."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.scalar import recode, stem
from labelloom.operators import grid, instances, raster
from labelloom.sources.matfiles import mat_maps
from labelloom.sources.storage import written

#: File endings of slides.
SLIDES = (".svs", ".tif", ".vms", ".vmu", ".ndpi", ".scn", ".mrxs", ".tiff", ".svslide", ".bif")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """stem, path and length of a folder's files, in the order of paths; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(stem(F.col("path")).alias("stem"), "path", "length").orderBy("path")


#: Endings of images, in either case.
IMAGES = ("png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff")


def load_images(spark: SparkSession, folder: str, keep_unreadable: bool = False) -> DataFrame:
    """stem, height, width and pixels (array of r, g, b, row by row) of PNG, JPEG and other images that the JVM decodes. Files with other endings are no images.

    An image that can't be decoded ends the job and is named, or with keep_unreadable has a row without size and pixels.
    """
    endings = ",".join(e for name in IMAGES for e in (name, name.upper()))
    image = spark.read.format("image").option("pathGlobFilter", f"*.{{{endings}}}").load(folder).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for origin, h, w, n, data in zip(rows["origin"], rows["height"], rows["width"], rows["nChannels"], rows["data"], strict=True):
                if h < 0 or w < 0:
                    if not keep_unreadable:
                        raise ValueError(f"{origin}: no image that can be decoded")
                    out.append((origin, None, None, None))
                    continue
                a = np.frombuffer(data, np.uint8).reshape(h * w, n).astype(np.int16)
                out.append((origin, h, w, (a[:, 2::-1] if n >= 3 else np.repeat(a[:, :1], 3, axis=1)).ravel()))
            yield pd.DataFrame(out, columns=["origin", "height", "width", "data"]).astype({"height": "Int32", "width": "Int32"})

    return image.mapInPandas(run, "origin string, height int, width int, data array<short>").select(stem(F.col("origin")).alias("stem"), "height", "width", "data")


def image_pixels(images: DataFrame, key: str = "stem") -> DataFrame:
    """A row for each pixel of load_images(): key, y, x, r, g, b."""
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), lambda i: F.slice("data", i * 3 + 1, 3)))
    rows = images.where("height > 0 and width > 0").select(key, "width", at.alias("i", "c"))
    return rows.select(key, F.expr("cast(i div width as int)").alias("y"), (F.col("i") % F.col("width")).alias("x"), *(F.col("c")[k].cast("int").alias(n) for k, n in enumerate("rgb")))


def label_pixels(maps: DataFrame, with_type: bool = False) -> DataFrame:
    """Dense maps (image_id, width, inst_map and type_map, arrays row by row) to sparse label maps: image_id, y, x, inst_id (type_id)."""
    zipped = F.posexplode(F.arrays_zip("inst_map", "type_map") if with_type else F.arrays_zip("inst_map"))
    rows = maps.select("image_id", "width", zipped.alias("i", "p")).where("p.inst_map > 0")
    return rows.select("image_id", F.expr("cast(i div width as int)").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), F.col("p.inst_map").alias("inst_id"), *([F.col("p.type_map").alias("type_id")] if with_type else []))


#: Classes that are merged.
MERGED = {3: [3, 4], 4: [5, 6, 7]}


def _plain(maps: DataFrame, with_type: bool) -> DataFrame:
    if with_type:
        raise ValueError("these label maps have no types")
    return label_pixels(maps)


def _merged(maps: DataFrame, with_type: bool) -> DataFrame:
    labels = label_pixels(maps, with_type)
    return labels.withColumn("type_id", recode(F.col("type_id"), MERGED)) if with_type else labels


DATASETS: dict[str, Callable[[DataFrame, bool], DataFrame]] = {"kumar": _plain, "cpm17": _plain, "consep": _merged}


def read_labels(spark: SparkSession, dataset: str, path: str, with_type: bool = False, mat: bool = False) -> DataFrame:
    """Label maps of a data set by name, in any case, from a Parquet table of dense maps or, with `mat`, a folder of MAT files."""
    if dataset.lower() not in DATASETS:
        raise ValueError(f"no such data set: {dataset}")
    return DATASETS[dataset.lower()](mat_maps(spark, path, with_type) if mat else spark.read.parquet(path), with_type)


def annotated(images: DataFrame, labels: DataFrame, splits: DataFrame) -> DataFrame:
    """images (stem, ...) with their annotations (stem, ...) and splits (stem, split): inner joins; splits are a small dimension, which Catalyst sizes."""
    return images.join(labels, "stem").join(splits, "stem")


def is_slide(path: Column) -> Column:
    """Whether a file's ending is one of a slide, in any case."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*SLIDES)


def checked_slides(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths, if all are slides; any other ends the job."""
    known = F.when(is_slide(F.col(path)), F.col(path)).otherwise(F.raise_error(F.concat(F.lit("unknown slide format: "), F.col(path))))
    return paths.withColumn(path, known.cast("string"))


def magnifications(base: Column, downsamples: Column) -> Column:
    return F.transform(downsamples, lambda d: base / d)


def prepared_level(pixels: DataFrame, images: DataFrame, factor: float, value: str = "v") -> DataFrame:
    """A level that a slide does not have, resized from the next finer one and written once."""
    return written(raster.resize(pixels, images, factor, value=value), "prepared-level")


def patch_pixels(pixels: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """pixels (image_id, y, x, ...) of square windows (image_id, y, x): patch (the window's number in its image, by y and x), dy, dx and the pixel's columns."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("image_id").orderBy("y", "x")
    boxes = windows.select("image_id", (F.row_number().over(order) - 1).cast("long").alias("box_id"), F.col("y").alias("y0"), F.col("x").alias("x0"), (F.col("y") + size).alias("y1"), (F.col("x") + size).alias("x1"))
    cut = grid.in_boxes(pixels, boxes, cell=max(16, size))
    rest = [c for c in pixels.columns if c not in ("image_id", "y", "x")]
    return cut.select("image_id", F.col("box_id").cast("int").alias("patch"), (F.col("y") - F.col("y0")).alias("dy"), (F.col("x") - F.col("x0")).alias("dx"), *rest)


def patch_arrays(cut: DataFrame, size: int, channels: list[str]) -> DataFrame:
    """image_id, patch and data, the channels of its pixels row by row; patches that reach over the edge of the image are left out."""
    place = F.struct("dy", "dx", F.array(*(F.col(c).cast("int") for c in channels)).alias("c"))
    packed = cut.groupBy("image_id", "patch").agg(F.sort_array(F.collect_list(place)).alias("p"), F.count(F.lit(1)).alias("n"))
    return packed.where(F.col("n") == size * size).select("image_id", "patch", F.flatten(F.transform("p", lambda s: s["c"])).alias("data"))


def write_patches(patches: DataFrame, path: str, base: Column, split: Column) -> None:
    """Parquet by split; name is the image's and the patch's number in three digits or more."""
    named = patches.withColumns({"name": F.format_string("%s_%03d", base.cast("string"), F.col("patch")), "split": split})
    named.write.mode("overwrite").partitionBy("split").parquet(path)


def training_rows(cut: DataFrame, size: int, out: int, augment: Callable[[DataFrame], DataFrame] | None = None, targets: Callable[..., DataFrame] = instances.targets, **more) -> tuple[DataFrame, DataFrame]:
    """Patch pixels (image_id, patch, dy, dx, r, g, b, inst_id) as the two inputs of training: the colours of the centre crop, and its targets.

    augment is done to whole patches first, and sees colours and labels together; targets, with its arguments, makes the second.
    Their image_id is the pair (image_id, patch) itself, so that no two patches meet whatever their number.
    """
    key = F.struct("image_id", "patch")
    whole = cut.select(key.alias("image_id"), F.col("dy").alias("y"), F.col("dx").alias("x"), "r", "g", "b", "inst_id")
    whole = whole.transform(augment) if augment is not None else whole
    colours = raster.center_crop(whole.select("image_id", "y", "x", "r", "g", "b"), size, size, out, out)
    return colours, targets(whole.where("inst_id > 0").select("image_id", "y", "x", "inst_id"), size, size, out, out, **more)


def tile_table(objects: DataFrame, with_type: bool = True) -> DataFrame:
    """What is kept of a tile beside its label map: image_id, inst_uid, inst_centroid, and inst_type unless there are no types."""
    kind = [F.col("type").alias("inst_type")] if with_type else []
    return objects.select("image_id", F.col("inst_id").alias("inst_uid"), F.col("centroid").alias("inst_centroid"), *kind)
