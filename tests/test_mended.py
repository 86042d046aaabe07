"""Cases that once gave wrong rows or none: unlisted types, unreadable images, keys of any kind, long histories, empty bins, floods."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import kernels, sampling, track
from labelloom.sources import documents, images
from labelloom.sources.views import type_info
from tests.test_imaging import png


def test_an_object_of_an_unlisted_type_ends_the_job(spark):
    objects = spark.createDataFrame([(1.0, 2.0, 1), (1.0, 2.0, 9)], "cx double, cy double, type_id int")
    assert documents.qupath_rows(objects.where("type_id = 1"), type_info(spark)).count() == 1
    for bad in (objects, objects.withColumn("type_id", F.lit(None).cast("int"))):
        with pytest.raises(Exception, match="no such type: (9|none)"):
            documents.qupath_rows(bad, type_info(spark)).collect()


def test_an_unreadable_image_is_named_or_kept(spark, tmp_path):
    (tmp_path / "good.PNG").write_bytes(png(np.full((2, 3, 3), 7)))
    (tmp_path / "bad.png").write_bytes(b"no image at all")
    (tmp_path / "list.csv").write_text("a,b")
    with pytest.raises(Exception, match="bad.png: no image"):
        images.load_images(spark, str(tmp_path)).collect()
    kept = images.load_images(spark, str(tmp_path), keep_unreadable=True)
    assert sorted((r.stem, r.height, r.data is None) for r in kept.collect()) == [("bad", None, True), ("good", 2, False)]
    assert images.image_pixels(kept).count() == 6


@pytest.mark.parametrize("kind, keys", [("long", [5, -1, 0, None, 7, -(2**63), 2**63 - 1, -1]), ("int", [3, -3, None]), ("string", ["b", "a", "", None, "ab", "é", "Z", "a"])])
def test_rows_keep_the_order_of_their_keys(spark, kind, keys):
    got = sampling.training_order(spark.createDataFrame([(k,) for k in keys], f"k {kind}").repartition(3), F.col("k"), 2, 1, False).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(len(keys)))
    # a missing key and an empty text share the first places
    order = lambda k: b"" if k is None else k.encode() if isinstance(k, str) else (1, k)
    assert [order(r.k) for r in got] == sorted(map(order, keys), key=lambda o: (isinstance(o, tuple), o))
    shuffled = sampling.training_order(spark.createDataFrame([(k,) for k in keys], f"k {kind}"), F.col("k"), 1, 1, True)
    assert shuffled.count() == len(keys)


def test_moving_average_equals_the_loop(spark):
    draw = np.random.default_rng(1)
    values = {k: draw.random(n).round(3).tolist() for k, n in (("a", 1), ("b", 2), ("c", 900))}
    frame = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "k string, i int, v double").repartition(5)
    for r in track.moving_average(frame, "k", "i", "v", 0.9).collect():
        want = values[r.k][0]
        for v in values[r.k][1:]:
            want = want * 0.9 + 0.1 * v
        assert r.steps == len(values[r.k]) and abs(r.ema - want) < 1e-9


def test_histograms_have_empty_bins_and_add_up(spark):
    rows = [("a", 0.0), ("a", 1.0), ("a", 0.999), ("a", 1.001), ("a", None), ("a", float("nan")), ("b", -5.0), (None, 0.5)]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = sorted(((r.k, r.bin, r.n) for r in track.fixed_histogram(frame, ["k"], "v", 0, 1, 4).collect()), key=str)
    want = [("a", 0, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 2), *(("b", k, 0) for k in range(4)), (None, 0, 0), (None, 1, 0), (None, 2, 1), (None, 3, 0)]
    assert got == sorted(want, key=str)
    parts = [track.fixed_histogram(frame.where(w), ["k"], "v", 0, 1, 4) for w in ("v > 0.5", "v is null or v <= 0.5")]
    merged = track.merged_histogram(parts[0].unionByName(parts[1]), ["k"])
    assert sorted(((r.k, r.bin, r.n) for r in merged.collect()), key=str) == got


def flood(height, markers, mask):
    out = np.where(mask, markers, 0)
    queue = [(height[y, x], n, y, x) for n, (y, x) in enumerate(zip(*np.nonzero(out)))]
    heapq.heapify(queue)
    n = len(queue)
    while queue:
        _, _, y, x = heapq.heappop(queue)
        for i, j in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= i < out.shape[0] and 0 <= j < out.shape[1] and mask[i, j] and not out[i, j]:
                out[i, j] = out[y, x]
                heapq.heappush(queue, (height[i, j], n, i, j))
                n += 1
    return out


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (40, 31), (64, 64)])
@pytest.mark.parametrize("levels", [2, 9, 0])
def test_flood_equals_the_plain_one(shape, levels):
    draw = np.random.default_rng(levels)
    height = draw.integers(0, levels, shape).astype(float) if levels else draw.standard_normal(shape)
    mask, markers = draw.random(shape) < 0.8, np.where(draw.random(shape) < 0.03, draw.integers(1, 50, shape), 0)
    assert (kernels.watershed(height, markers, mask) == flood(height, markers, mask)).all()
    assert not kernels.watershed(height, markers, np.zeros(shape, bool)).any()


def test_a_slide_writes_its_tables_once_and_without_markers(spark, monkeypatch):
    from pathlib import Path

    from labelloom.plans import slide
    from labelloom.sources import storage

    made, kept = [], storage.written

    def noted(df, label):
        made.append((label, kept(df, label)))
        return made[-1][1]

    monkeypatch.setattr(slide, "written", noted)
    pixels = spark.range(40 * 40).selectExpr("cast(1 as bigint) as image_id", "cast(id div 40 as int) as y", "cast(id % 40 as int) as x", "cast(if((id div 40) % 10 < 3 and id % 10 < 3, 0.9, 0.0) as double) as np", "0.0D as h", "0.0D as v")
    images = spark.createDataFrame([(1, 40, 40)], "image_id long, height int, width int")
    labels = slide.slide_labels(pixels, images, 16, 4, process=lambda np_, h, v: kernels.components(np_ >= 0.5))
    assert labels.where("inst_id > 0").count() == 16 * 9
    # what is separated for a mended phase goes straight into its boxes
    assert [label for label, _ in made] == [
        "slide-maps", "slide-boxes", "slide-tile", "slide-labels-tile", "slide-x-boxes", "slide-labels-x", "slide-y-boxes", "slide-labels-y", "slide-cross-boxes", "slide-labels-cross",
    ]
    for _, table in made:
        for f in table.inputFiles():
            assert not list(Path(f.removeprefix("file:")).parent.glob("*SUCCESS*"))
