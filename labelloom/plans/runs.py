"""Entry points: tiles through a predictor to files, whole slides, and statistics of results against truth; with the shapes that go together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators import raster
from labelloom.plans import evaluate, slide
from labelloom.sources import documents, images
from labelloom.sources.storage import written

# Input and output side of a patch by the network's mode.
MODES = {"original": (270, 80), "fast": (256, 164)}


@dataclass(frozen=True)
class Shapes:
    """Sides of a predictor's input and output. A named mode has fixed ones; without one any that are centred on each other."""

    window: int
    mask: int
    mode: str | None = None
    types: int | None = None

    def __post_init__(self) -> None:
        if self.mode is not None and self.mode not in MODES:
            raise ValueError(f"no such mode: {self.mode}")
        if self.mode is not None and (self.window, self.mask) != MODES[self.mode]:
            raise ValueError(f"mode {self.mode} goes with {MODES[self.mode]}")
        if not 0 < self.mask <= self.window:
            raise ValueError("a patch's output lies within its input")
        if self.types is not None and self.types < 1:
            raise ValueError("types count the background, too")

    @classmethod
    def of(cls, mode: str, types: int | None = None) -> Shapes:
        return cls(*MODES.get(mode, (1, 1)), mode=mode, types=types)


def _covering(at: Column, window: int, mask: int, count: Column) -> Column:
    """Numbers of the windows, one every `mask`, that hold a place."""
    first = F.greatest(F.lit(0), F.ceil((at - window + 1) / mask).cast("int"))
    last = F.least(count - 1, F.floor(at / mask).cast("int"))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def tile_inputs(pixels: DataFrame, sizes: DataFrame, shapes: Shapes, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Patches of reflect-padded images: image_id, row, col, data (channels of window x window places, row by row).

    pixels: image_id, y, x and channels; sizes: image_id, height, width. A pixel is sent to the places that mirror it and to the
    windows that hold them: arithmetic, and one shuffle by patch.
    """
    w, m = shapes.window, shapes.mask
    top = (w - m) // 2
    count = {a: F.ceil((F.col(side) - m) / m).cast("int") + 1 for a, side in (("y", "height"), ("x", "width"))}
    out = pixels.join(sizes, "image_id")
    for a, side, number in (("y", "height", "row"), ("x", "width", "col")):
        bottom = count[a] * m + w - F.col(side)
        out = out.withColumn(f"_{a}", F.explode(raster.mirror_places(F.col(a), F.col(side), F.lit(top), bottom)))
        out = out.withColumn(number, F.explode(_covering(F.col(f"_{a}"), w, m, count[a])))
    place = F.struct(((F.col("_y") - F.col("row") * m) * w + F.col("_x") - F.col("col") * m).alias("i"), F.array(*(F.col(c).cast("int") for c in channels)).alias("c"))
    packed = out.groupBy("image_id", "row", "col").agg(F.sort_array(F.collect_list(place)).alias("p"))
    return packed.select("image_id", "row", "col", F.flatten(F.transform("p", lambda s: s["c"])).alias("data"))


def tile_maps(inputs: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], sizes: DataFrame, shapes: Shapes, outputs: tuple[str, ...] = ("np", "h", "v"), preproc: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """image_id, y, x and outputs of whole images. predict gets batches of inputs and returns for each patch the outputs of mask x mask places, row by row."""
    rows = inputs.transform(preproc) if preproc is not None else inputs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["image_id", "row", "col"]].assign(out=predict(batch))

    told = rows.mapInPandas(run, "image_id long, row int, col int, out array<double>")
    n, m = len(outputs), shapes.mask
    each = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(m * m - 1)), lambda i: F.slice("out", i * n + 1, n)))
    placed = told.select("image_id", "row", "col", each.alias("i", "o")).join(sizes, "image_id")
    placed = placed.withColumns({"y": (F.col("row") * m + F.expr(f"i div {m}")).cast("int"), "x": (F.col("col") * m + F.col("i") % m).cast("int")}).where("y < height and x < width")
    return placed.select("image_id", "y", "x", *(F.col("o")[k].alias(c) for k, c in enumerate(outputs)))


def run_tiles(pixels: DataFrame, sizes: DataFrame, predict: Callable, shapes: Shapes, out: str, types: DataFrame | None = None, qupath: bool = False, raw: bool = False, **more) -> DataFrame:
    """Images of tile size to object records, written below `out`: json (a text an image), tables (ids, types, centroids), and if asked for qupath and raw_map."""
    outputs = ("np", "h", "v") if shapes.types is None else ("np", "h", "v", "tp")
    if types is not None and shapes.types is not None:
        types = documents.checked_types(types, shapes.types)
    maps = written(tile_maps(tile_inputs(pixels, sizes, shapes), predict, sizes, shapes, outputs, **more), "tile-maps")
    objects = written(evaluate.objects(maps), "tile-objects")
    documents.to_documents(objects).write.mode("overwrite").parquet(f"{out}/json")
    images.tile_table(objects, shapes.types is not None).write.mode("overwrite").parquet(f"{out}/tables")
    if raw:
        maps.write.mode("overwrite").parquet(f"{out}/raw_map")
    if qupath:
        known = types if types is not None else documents.default_types(pixels.sparkSession, shapes.types or 1)
        points = objects.select("image_id", F.col("centroid")[0].alias("cx"), F.col("centroid")[1].alias("cy"), F.coalesce("type", F.lit(0)).alias("type_id"))
        documents.write_qupath(documents.qupath_rows(points, known), f"{out}/qupath")
    return objects


def run_slides(patches: DataFrame, predict: Callable, sizes: DataFrame, out: str, tile: int = 2048, margin: int = 128, mag: Column | None = None, **more) -> DataFrame:
    """Slides that `out` does not hold yet, to one JSON text a slide, added to it. Those without tissue in their mask give none."""
    spark = patches.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        done = spark.read.parquet(out).select("image_id")
        patches, sizes = documents.not_done(patches, done), documents.not_done(sizes, done)
    texts = written(slide.slide_documents(patches, predict, sizes, tile, margin, mag, **more), "slide-documents")
    texts.write.mode("append").parquet(out)
    return texts


def compute_stats(truth: DataFrame, guess: DataFrame, mode: str = "instance", **more) -> DataFrame:
    """One row: mean_stats() of label maps ('instance'), or type_stats() of points ('type')."""
    if mode == "instance":
        return evaluate.instance_stats(truth, guess)
    if mode == "type":
        return evaluate.type_stats(truth, guess, **more)
    raise ValueError(f"no such mode: {mode}")

