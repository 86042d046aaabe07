"""What only larger tables show: values at the edge of single precision, and what joins and shuffles carry."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelloom.operators import grid, instances, kernels, merge, raster, tiled
from labelloom.plans import queries, slide
from labelloom.plans.queries import ORACLE_SQL, QUERIES
from labelloom.sources.views import raster as raster_view
from tests.test_raster import spelled


def embeddings_at_steps(folder):
    """Vectors of values at every step of a twentieth and beside it; 0.35 and 0.45 in single precision reach their step only if multiplied so."""
    steps = np.arange(0, 21, dtype=np.float32) / np.float32(20)
    values = np.concatenate([steps, np.nextafter(steps, np.float32(0)), np.nextafter(steps, np.float32(2)), -steps])
    vectors = [np.roll(values, k)[:64].tolist() for k in range(0, 40)]
    rows = pd.DataFrame({"vec_id": range(len(vectors)), "label": 0, "vector": vectors})
    duckdb.sql(f"copy (select vec_id, label, cast(vector as float[]) as embedding from rows) to '{folder}/embeddings.parquet'")


@pytest.mark.parametrize("name", ["typed_labels", "mat_label_maps"])
def test_values_at_a_step_are_as_in_sql(spark, tmp_path, name):
    embeddings_at_steps(tmp_path)
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    got = QUERIES[name](spark, str(tmp_path)).toPandas()
    assert spelled(got) == spelled(duck.execute(ORACLE_SQL[name]).df())


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_file_of_images_is_dealt_out_before_it_grows(spark):
    images = spark.range(50).coalesce(1).selectExpr("id as image_id", "1000 as height", "1200 as width")
    made = [grid.padded_patches(images, 270, 80), grid.patch_grid(images, 270, 80), grid.chunk_patches(images, 1000, 270, 80), grid.sliding(images, 540, 164), grid.chunks(images, 1000, 270, 80), grid.tiles(images, 512, 64)]
    assert all(m.rdd.getNumPartitions() >= 4 for m in made)


def test_small_groups_go_to_python_together(spark):
    draw = np.random.default_rng(4)
    rows = [(int(i), int(k), int(y), int(x)) for i in range(60) for k in range(1, 4) for y in range(6) for x in range(6) if draw.random() < 0.7]
    labels = spark.createDataFrame(rows + [(None, 1, 2, 3), (2**62 + 1, 1, 0, 0)], "image_id long, inst_id int, y int, x int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # groups go on over several batches
    try:
        shapes = kernels.contours(labels)
        assert "FlatMapGroups" not in plan_of(shapes)
        got = {(r.image_id, r.inst_id): r.contour for r in shapes.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(None, 1): [[3, 2]], (2**62 + 1, 1): [[0, 0]]}
    for i, k in {(i, k) for i, k, _, _ in rows}:
        mask = np.zeros((6, 6), bool)
        for a, b, y, x in rows:
            mask[y, x] |= (a, b) == (i, k)
        want[i, k] = [list(p) for p in kernels.contour(mask)]
    assert got == want


def test_small_tiles_go_to_python_together(spark):
    pixels = spark.range(4 * 64).selectExpr("id div 64 as image_id", "cast(id % 64 div 8 as int) as y", "cast(id % 8 as int) as x", "cast(id * 7 % 11 as double) as v")
    sizes = spark.range(4).selectExpr("id as image_id", "8 as height", "8 as width")
    out = tiled.derivative(pixels, sizes, "v", 0, 5, 3)
    assert "FlatMapGroups" not in plan_of(out)
    want = kernels.derivative(np.array([k * 7 % 11 for k in range(64)], float).reshape(8, 8), 0, 5)
    got = np.zeros((8, 8))
    for r in out.where("image_id = 0").collect():
        got[r.y, r.x] = r.out
    assert np.array_equal(got, want)


def test_predicted_maps_are_made_without_joins_of_pixels(spark):
    """A scan is small for the rows that it becomes, so a join of such rows was a broadcast of all of them."""
    maps = queries.predicted_maps(spark, "/root/testdata/sf0.001")
    assert "Join" not in plan_of(maps)
    large = raster.upsample2(raster.upsample2(raster_view(spark, "/root/testdata/sf0.001"), "true_id"), "true_id").where("true_id > 0").withColumnRenamed("true_id", "inst_id")
    want = instances.distance_maps(large).select("image_id", "y", "x", "h", "v")
    got = maps.where("np > 0").select("image_id", "y", "x", "h", "v")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("kind", ["x", "y", "cross"])
def test_boxes_told_by_arithmetic_mend_as_joined_boxes(spark, kind):
    draw = np.random.default_rng(9)
    at = [(0, y, x) for y in range(20) for x in range(20)]
    current = spark.createDataFrame([(*p, int(p[1] // 3 * 7 + p[2] // 3 + 1)) for p in at if draw.random() < 0.8], "image_id long, y int, x int, inst_id int")
    boxes = slide.slide_boxes(spark.createDataFrame([(0, 20, 20)], "image_id long, height int, width int"), 8, 2).where(F.col("kind") == kind)
    guess = spark.createDataFrame([(*p, int(p[1] // 2 * 11 + p[2] // 2 + 1)) for p in at if draw.random() < 0.5], "image_id long, y int, x int, inst_id int")
    new = grid.in_boxes(guess, boxes).select("image_id", "box_id", "y", "x", "inst_id")
    got, want = slide._mended(current, new, kind, 8, 2), merge.mend(current, new, boxes)
    assert "BroadcastHashJoin" not in plan_of(got) and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
