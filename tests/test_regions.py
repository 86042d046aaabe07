"""Boxes of pixels in Morton order against plain filters, and what the scan reads for them."""

import random

import pytest
from pyspark.sql import functions as F

from labelloom.sources.regions import morton, read_regions, write_regions


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("regions") / "t")
    side = 512
    pixels = spark.range(2 * side * side).select(F.expr(f"id div {side * side}").alias("image_id"), F.expr(f"cast(id % {side * side} div {side} as int)").alias("y"), F.expr(f"cast(id % {side} as int)").alias("x"), F.hash("id").alias("v"))
    write_regions(pixels, path, 16, 4096)
    return pixels, path


def rows_scanned(frame):
    """Rows that the scan handed on, of the row groups and pages that it did not pass over."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    leaf = leaves.apply(0)
    if "AdaptiveSparkPlan" in leaf.nodeName() or "QueryStage" in leaf.nodeName():
        leaf = leaf.executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("boxes", [[(0, 0, 0, 20, 30)], [(1, 100, 37, 101, 38), (0, 200, 300, 290, 420), (0, 210, 310, 250, 330)], [(1, -5, 500, 600, 900)], [(7, 0, 0, 9, 9)], [(0, 9, 9, 9, 20)]])
def test_boxes_equal_plain_filters(spark, laid_out, boxes):
    pixels, path = laid_out
    got = sorted((r.box, r.image_id, r.y, r.x, r.v) for r in read_regions(spark, path, boxes, 16).collect())
    want = []
    for k, (i, y0, x0, y1, x1) in enumerate(boxes):
        want += [(k, r.image_id, r.y, r.x, r.v) for r in pixels.where(f"image_id = {i} and y >= {y0} and y < {y1} and x >= {x0} and x < {x1}").collect()]
    assert got == sorted(want)


def test_a_small_box_reads_a_small_part(spark, laid_out):
    scanned = rows_scanned(read_regions(spark, laid_out[1], [(1, 130, 260, 160, 300)], 16))
    assert 0 < scanned <= laid_out[0].count() // 16


def test_morton_numbers_hold_boxes(spark):
    rng = random.Random(1)
    points = [(rng.randrange(1 << 20), rng.randrange(1 << 20)) for _ in range(200)]
    frame = spark.createDataFrame([(y, x, min(y, v), min(x, w)) for (y, x), (v, w) in zip(points, points[::-1])], "y int, x int, y0 int, x0 int")
    assert frame.where(morton(F.col("y0"), F.col("x0")) > morton(F.col("y"), F.col("x"))).count() == 0
    plain = lambda y, x: int("".join(a + b for a, b in zip(f"{y:024b}", f"{x:024b}")), 2)
    assert [r.m for r in frame.select(morton(F.col("y"), F.col("x")).alias("m")).collect()] == [plain(y, x) for y, x in points]
