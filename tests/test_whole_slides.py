"""Slides that a task takes whole: the same label maps as box by box, without a table or a shuffle for each phase."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelloom.operators import groups, kernels, stacks
from labelloom.plans import queries, slide
from labelloom.plans.queries import QUERIES
from tests.test_larger import plan_of


def tiles(draw, n, h, w, smooth):
    if not smooth:
        return draw.random((n, h, w)), draw.standard_normal((n, h, w)), draw.standard_normal((n, h, w))
    y, x = np.mgrid[:h, :w]
    fore = np.kron(draw.random((n, h // 5 + 1, w // 5 + 1)) < 0.8, np.ones((1, 5, 5)))[:, :h, :w] * (draw.random((n, h, w)) > 0.03)
    return fore * 0.9, np.where(fore > 0, (x % 10 - 4.5) / 5, 0.0), np.where(fore > 0, (y % 10 - 4.5) / 5, 0.0)


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 1), (16, 32), (40, 23), (64, 64)])
@pytest.mark.parametrize("smooth", [False, True])
def test_a_stack_is_separated_as_its_tiles(shape, smooth):
    maps = tiles(np.random.default_rng(2), 12, *shape, smooth)
    maps[0][1], maps[0][2], maps[1][3], maps[2][4] = 0, 1, np.nan, 7  # nothing, all, no number, one value
    for size in (5, 21):
        assert np.array_equal(stacks.separate(*maps, size=size), np.stack([kernels.separate(*m, size=size) for m in zip(*maps)]))
    found, before = stacks.parts(maps[0] >= 0.5)
    assert np.array_equal(np.where(found, found - before[:-1, None, None], 0), np.stack([kernels.components(m >= 0.5) for m in maps[0]]))


def discs(draw, h, w):
    y, x = np.mgrid[:h, :w]
    maps = [np.zeros((h, w)) for _ in range(3)]
    for _ in range(h * w // 60):
        cy, cx, r = draw.integers(0, h), draw.integers(0, w), draw.integers(3, 8)
        own = ((y - cy) ** 2 + (x - cx) ** 2 <= r * r) & (maps[0] == 0)
        maps[0][own], maps[1][own], maps[2][own] = 0.9, ((x - cx) / r)[own], ((y - cy) / r)[own]
    return maps


def slides(spark):
    """Of many sizes: with gaps, one without pixels, one with pixels outside, one that no task is to hold (5)."""
    draw = np.random.default_rng(6)
    rows, sizes = [], [(9, 30, 30)]
    for image, (h, w) in enumerate([(72, 72), (72, 72), (33, 50), (16, 16), (5, 90), (96, 80), (64, 32)]):
        sizes.append((image, h, w))
        np_, hor, ver = discs(draw, h, w)
        gap = draw.random((h, w)) < (0.3 if image == 1 else 0)
        gap[: 20 * (image == 2)] = True
        rows += [(image, int(y), int(x), float(np_[y, x]), float(hor[y, x]), float(ver[y, x]), int(y * x % 4)) for y, x in np.argwhere(~gap)]
    rows += [(3, -1, 2, 0.9, 0.1, 0.1, 1), (8, 0, 0, 0.9, 0.1, 0.1, 1)]
    maps = spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "y", "x", "np", "h", "v", "tp"]), "image_id long, y int, x int, np double, h double, v double, tp int")
    return maps.repartition(5), spark.createDataFrame(sizes, "image_id long, height int, width int")


def told(labels):
    rows = [tuple(r) for r in labels.collect()]
    assert len(rows) == len(set(rows))
    return sorted(rows)


@pytest.mark.parametrize("process", [None, lambda a, b, c: kernels.separate(a, b, c, size=5)])
def test_whole_slides_equal_boxes(spark, process):
    maps, sizes = slides(spark)
    want = told(slide.slide_labels(maps.where("y >= 0"), sizes, 24, 6, process=process))
    assert {r[0] for r in want} >= {0, 1, 2, 5, 6} and max(r[3] for r in want) > 10
    plain = maps.drop("tp")
    assert told(slide.labelled(plain, sizes, 24, 6, process=process)) == want
    if process is None:
        for whole in (0, 72 * 72):  # none whole; all but one
            assert told(slide.labelled(plain.where("y >= 0"), sizes, 24, 6, whole=whole)) == want
        kinds = {(r.image_id, r.y, r.x): r.tp for r in maps.collect()}
        typed = [(*r, kinds[r[:3]]) for r in want]
        assert told(slide.labelled(maps, sizes, 24, 6)) == typed and told(slide.labelled(maps.where("y >= 0"), sizes, 24, 6, whole=72 * 72)) == typed
        mask = spark.createDataFrame([(0, 3, 3), (5, 60, 60), (5, 20, 30)], "image_id long, my int, mx int")
        masked = told(slide.labelled(plain.where("y >= 0"), sizes, 24, 6, mask))
        assert masked == told(slide.slide_labels(plain.where("y >= 0"), sizes, 24, 6, mask)) and {r[0] for r in masked} == {5}
    with pytest.raises(ValueError, match="four margins"):
        slide.labelled(plain, sizes, 16, 6)


def test_blocks_are_their_pixels(spark):
    maps = queries.predicted_maps(spark, "/root/testdata/sf0.001").drop("tp")
    blocks = queries.predicted_blocks(spark, "/root/testdata/sf0.001")
    pixels = slide._block_pixels(blocks, 4)
    assert maps.count() == pixels.count() and maps.exceptAll(pixels).count() == 0
    sizes = spark.createDataFrame([(0, 80, 80), (2, 39, 78), (7, 8, 8)], "image_id long, height int, width int")  # cut within blocks; no pixels
    within = maps.join(sizes, "image_id").where("y < height and x < width").drop("height", "width")
    want = told(slide.slide_labels(within, sizes, 32, 8))
    assert want and told(slide.labelled(blocks, sizes, 32, 8, side=4)) == want and told(slide.labelled(blocks, sizes.where("image_id <> 2"), 32, 8, side=4, whole=99)) == [r for r in want if r[0] == 0]


def test_small_slides_are_shuffled_once_and_not_written(spark, monkeypatch):
    made, kept = [], slide.written
    monkeypatch.setattr(slide, "written", lambda df, label: made.append(label) or kept(df, label))
    labels = QUERIES["whole_slide"](spark, "/root/testdata/sf0.001")
    # the rows of the driver's table by image, and the sizes; no row of a pixel of the maps
    assert made == [] and plan_of(labels).count("Exchange") == 2 and "FlatMapGroups" not in plan_of(labels)
    assert labels.count() > 0
    QUERIES["slide_documents"](spark, "/root/testdata/sf0.001").collect()
    assert made == ["slide-labels"]


def test_groups_come_whole_however_batches_fall(spark):
    sizes = [1, 40, 3, 3, 200, 1, 1, 17]
    rows = spark.createDataFrame([(g, k) for g, n in enumerate(sizes) for k in range(n)], "g long, k int").coalesce(1).sortWithinPartitions("g")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for at_once in (0, 10, 10_000):
            run = lambda rows, starts: pd.DataFrame({"group": range(len(starts)), "n": np.diff([*starts, len(rows)])})
            got = groups.over_sorted(rows, ["g"], run, "n int", at_once).orderBy("g").collect()
            assert [r.n for r in got] == sizes
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
