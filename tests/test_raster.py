"""Queries against their SQL in DuckDB, and operators against hand-made cases."""

import itertools
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelloom.functions import colour, scalar
from labelloom.operators import grid, instances, kernels, matching, merge, metrics, raster, track
from labelloom.plans import evaluate
from labelloom.plans.queries import ORACLE_SQL, QUERIES, flagship
from labelloom.sources import documents
from labelloom.sources.views import type_info
from labelloom.streaming.incremental import stream_images

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def spelled(frame):
    one = lambda v: repr(float(v)) if isinstance(v, float) else str(int(v)) if isinstance(v, (bool, np.bool_)) else str(v)
    columns = sorted(frame.columns)
    return sorted(tuple(one(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and spelled(got) == spelled(want)


def test_other_queries_run(spark):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, SF).count() > 0, name
    assert flagship(spark, SF).count() == 3


@pytest.mark.parametrize("name, per_patch", [("center_pad_all", 11 * 13), ("reflect_pad_all", 15 * 15), ("upsample2x_all", 16 * 16)])
def test_padding_takes_every_patch(spark, duck, name, per_patch):
    patches = duck.execute("select count(distinct vec_id) from embeddings").fetchone()[0]
    got = QUERIES[name](spark, SF)
    assert got.select("image_id").distinct().count() == patches and got.count() == patches * per_patch


def pixels(spark, truth, guess, image=0):
    truth, guess = np.array(truth), np.array(guess)
    rows = [(image, int(y), int(x), int(truth[y, x]), int(guess[y, x])) for y, x in np.ndindex(truth.shape)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, true_id int, pred_id int")


def dense(frame, shape, column="inst_id"):
    out = np.zeros(shape, int)
    for r in frame.collect():
        out[r.y, r.x] = r[column]
    return out


def test_metrics_of_identical_disjoint_and_empty_maps(spark):
    a = np.zeros((6, 6), int)
    a[:2, :2], a[4:, 3:] = 3, 9
    same = evaluate.per_image(pixels(spark, a, a * 2)).first()
    assert same.dice1 == same.aji == same.dq == 1.0 and abs(same.pq - 2 / (2 + 1e-6)) < 1e-12
    none = evaluate.per_image(pixels(spark, a, np.roll(a, 2, axis=0) * (a == 0))).first()
    assert none.dice1 == 0 and none.aji == 0 and none.pq == 0
    blank = evaluate.per_image(pixels(spark, a * 0, a * 0)).first()
    assert blank.dice1 is None and blank.aji is None and blank.dq is None
    half = np.zeros((1, 4), int)
    half[0, :2] = 1
    assert metrics.pq(metrics.contingency(pixels(spark, half, [[1, 0, 0, 0]]))).first().tp == 0  # a ratio of exactly one half is no match


def test_metrics_do_not_depend_on_ids(spark):
    rng = np.random.default_rng(3)
    t, p = rng.integers(0, 5, (12, 12)), rng.integers(0, 5, (12, 12))
    order = np.r_[0, rng.permutation(np.arange(1, 5)) * 7]
    a, b = evaluate.per_image(pixels(spark, t, p)).first(), evaluate.per_image(pixels(spark, order[t], order[p])).first()
    assert a.dice1 == b.dice1 and abs(a.pq - b.pq) < 1e-12


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        cost = rng.integers(-5, 9, (n, m)).astype(float)
        rows, cols = matching.assign(cost)
        assert len(rows) == min(n, m) == len(set(rows.tolist())) == len(set(cols.tolist()))
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        best = min(sum(cost[i, j] if n <= m else cost[j, i] for i, j in zip(small, pick, strict=False)) for pick in itertools.permutations(large, len(small)))
        assert abs(cost[rows, cols].sum() - best) < 1e-9


def test_radius_dissolves_pairs_after_the_assignment(spark):
    side = lambda points: spark.createDataFrame([(1, i, float(x), float(y), 1) for i, (x, y) in enumerate(points)], "image_id long, idx int, x double, y double, type int")
    pairs = matching.pair_points(side([(10, 35), (11, 30), (27, 1)]), side([(19, 8), (27, 6), (21, 29)]), 12).collect()
    assert sum(r.distance is not None for r in pairs) == 1 and len(pairs) == 5
    exact = matching.pair_points(side([(0, 0)]), side([(12, 0)]), 12).collect()
    assert len(exact) == 1 and exact[0].distance == 12
    lonely = matching.pair_points(side([(0, 0)]), side([]), 12)
    assert [(r.true_idx, r.pred_idx) for r in lonely.collect()] == [(0, None)]
    assert matching.pair_points(side([(3, 4)]), side([]), 12, dummies=True).first().distance == 5


def test_votes_and_ids(spark):
    rows = [(1, 0, x, 1, t) for x, t in enumerate([0, 0, 0, 2, 1, 1, 2])] + [(1, 1, x, 2, 0) for x in range(3)] + [(1, 2, x, 7, 3) for x in range(4)]
    labels = spark.createDataFrame(rows, "image_id long, y int, x int, inst_id int, type_id int")
    got = {r.inst_id: (r.type_id, round(r.type_prob, 3)) for r in instances.type_vote(labels).collect()}
    assert got == {1: (1, 0.286), 2: (0, 1.0), 7: (3, 1.0)}
    assert {r.inst_id: r.new_id for r in instances.remap(labels).collect()} == {1: 1, 2: 2, 7: 3}
    assert {r.inst_id: r.new_id for r in instances.remap(labels, True).collect()} == {1: 1, 7: 2, 2: 3}
    assert instances.remove_small(labels, 4).select("inst_id").distinct().count() == 2


def test_grids(spark):
    image = lambda h, w: spark.createDataFrame([(1, h, w)], "image_id long, height int, width int")
    assert grid.patch_grid(image(1000, 1000), 270, 80).select("in_y").distinct().count() == 11
    assert grid.padded_patches(image(1000, 1000), 270, 80).select("row", "pad_top", "pad_bottom").agg({"row": "max", "pad_top": "max", "pad_bottom": "max"}).first()[:3] != ()
    padded = grid.padded_patches(image(1000, 1000), 270, 80).first()
    assert (padded.pad_top, padded.pad_bottom) == (95, 310)
    assert grid.sliding(image(1000, 1000), 540, 164, mirror=True).count() == 49
    assert grid.tiles(image(4096, 4096), 2048).where("kind = 'tile'").count() == 4  # the third of a side has no area
    assert grid.sliding(image(540, 540), 540, 164).count() == 1 and grid.patch_grid(image(100, 1000), 270, 80).count() == 0


def test_pads_and_stencils(spark):
    rng = np.random.default_rng(5)
    a = rng.random((5, 4))
    frame = spark.createDataFrame([(1, int(y), int(x), float(a[y, x])) for y, x in np.ndindex(a.shape)], "image_id long, y int, x int, v double")
    back = lambda df, shape, c="v": dense(df.withColumn(c, F.round(F.col(c) * 1e6).cast("long")), shape, c) / 1e6
    assert np.allclose(back(raster.reflect_pad(frame, 5, 4, 6, 3, 2, 7), (14, 13)), np.pad(a, ((6, 3), (2, 7)), "reflect"), atol=1e-6)
    assert np.allclose(back(raster.center_crop(frame, 5, 4, 2, 3), (2, 3)), a[1:3, 0:3], atol=1e-6)
    padded = np.pad(a, 1)
    want = sum(w * padded[1 + dy : 6 + dy, 1 + dx : 5 + dx] for (dy, dx), w in raster.GAUSS3.items())
    assert np.allclose(back(raster.stencil(frame, raster.GAUSS3), (5, 4), "out"), want, atol=1e-5)
    y, x = raster.affine_source(F.col("y"), F.col("x"), (0, 1, 0, 1, 0, 0))
    assert frame.select(y.alias("a"), x.alias("b"), "y", "x").where("a != x or b != y").count() == 0


def test_merge(spark):
    old = np.zeros((10, 10), int)
    old[4:6, 4:6], old[0:4, 8:10], old[2:3, 0:3] = 1, 2, 3
    frame = spark.createDataFrame([(1, int(y), int(x), int(old[y, x])) for y, x in zip(*np.nonzero(old), strict=True)], "image_id long, y int, x int, inst_id int")
    box = spark.createDataFrame([(1, 9, 1, 2, 9, 9)], "image_id long, box_id long, y0 int, x0 int, y1 int, x1 int")
    new = spark.createDataFrame([(1, 9, 6, 6, 1), (1, 9, 6, 7, 1), (1, 9, 3, 7, 2), (1, 9, 3, 8, 2)], "image_id long, box_id long, y int, x int, inst_id int")
    got = dense(merge.mend(frame, new, box), (10, 10))
    want = old.copy()
    want[old == 1] = 0  # wholly inside: gone; 2 and 3 touch the edge and stay; new 2 meets old 2
    want[6, 6:8] = 4
    assert (got == want).all()
    assert (dense(merge.mend(frame, new.limit(0), box), (10, 10)) == old).all()
    objects = spark.createDataFrame([(1, 0, 0, 0, 5), (1, 1, 9, 9, 5)], "image_id long, box_id long, y int, x int, inst_id int")
    tiles = spark.createDataFrame([(1, 0, 0, 0, 5, 5), (1, 1, 5, 5, 10, 10), (1, 2, 0, 5, 5, 10)], "image_id long, box_id long, y0 int, x0 int, y1 int, x1 int")
    placed = dense(merge.insert_tiles(frame, objects, tiles), (10, 10))
    want = old.copy()
    want[:5, :5] = want[5:, 5:] = 0  # the rectangles of tiles with objects, background too; the third tile has none
    want[0, 0], want[9, 9] = 4, 5
    assert (placed == want).all()


def test_boxes_of_one_image_are_mended_apart(spark):
    old = np.zeros((10, 20), int)
    old[4:6, 4:6], old[4:6, 14:16] = 1, 2
    frame = spark.createDataFrame([(1, int(y), int(x), int(old[y, x])) for y, x in zip(*np.nonzero(old), strict=True)], "image_id long, y int, x int, inst_id int")
    boxes = spark.createDataFrame([(1, 1, 1, 1, 9, 9), (1, 2, 1, 11, 9, 19)], "image_id long, box_id long, y0 int, x0 int, y1 int, x1 int")
    pixels = lambda rows: spark.createDataFrame(rows, "image_id long, box_id long, y int, x int, inst_id int")
    one = dense(merge.mend(frame, pixels([(1, 1, 2, 2, 1)]), boxes), old.shape)
    assert one[2, 2] == 3 and (one[4:6, 4:6] == 0).all() and (one[4:6, 14:16] == 2).all()  # a box without new objects changes nothing
    two = dense(merge.mend(frame, pixels([(1, 1, 2, 2, 1), (1, 2, 2, 12, 1)]), boxes), old.shape)
    assert {two[2, 2], two[2, 12]} == {3, 4}  # equal numbers of two boxes are two objects


def test_kernels():
    m = np.array([[1, 0, 1, 1], [1, 0, 0, 1], [0, 1, 0, 1], [1, 1, 0, 0]])
    assert kernels.components(m > 0).tolist() == [[1, 0, 2, 2], [1, 0, 0, 2], [0, 3, 0, 2], [3, 3, 0, 0]]
    u = np.array([[1, 0, 1], [1, 1, 1]])
    assert kernels.components(u > 0).max() == 1
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert kernels.filled(ring).all() and not kernels.filled(np.array([[1, 0], [1, 1]]) > 0)[0, 1]
    assert kernels.without_small(np.array([[1, 1, 2]]), 2).tolist() == [[1, 1, 0]]
    assert kernels.contour(np.ones((3, 4), bool)) == [(0, 0), (3, 0), (3, 2), (0, 2)] and kernels.contour(np.ones((1, 1), bool)) == [(0, 0)]
    assert kernels.opened(np.ones((3, 9), bool)).sum() == 27 and kernels.opened(np.pad(np.ones((3, 9), bool), 3)).sum() == 0
    ramp = np.tile(np.arange(30.0), (30, 1))
    assert np.allclose(kernels.derivative(ramp, 1)[:, 12:18], kernels.derivative(ramp, 1)[0, 15]) and np.allclose(kernels.derivative(ramp, 0), 0)
    flood = kernels.watershed(np.array([[0.0, 1, 2, 1, 0]]), np.array([[1, 0, 0, 0, 2]]), np.ones((1, 5), bool))
    assert flood.tolist() == [[1, 1, 1, 2, 2]]
    assert kernels.relabelled(np.array([[7, 7, 0, 2]])).tolist() == [[1, 1, 0, 2]]


def test_touching_discs_are_separated():
    y, x = np.mgrid[:60, :100]
    discs = [(30, 32, 19), (30, 66, 19)]
    truth = np.zeros((60, 100), int)
    h, v = np.zeros((60, 100)), np.zeros((60, 100))
    for k, (cy, cx, r) in enumerate(discs, 1):
        own = ((y - cy) ** 2 + (x - cx) ** 2 <= r * r) & (truth == 0)
        truth[own], h[own], v[own] = k, ((x - cx) / r)[own], ((y - cy) / r)[own]
    got = kernels.separate((truth > 0) * 0.9, h, v, size=11)
    assert got.max() == 2 and all(((got == got[cy, cx]) & (truth == k)).sum() > 0.9 * (truth == k).sum() for k, (cy, cx, _) in enumerate(discs, 1))


def test_parts_of_objects(spark):
    rows = [(1, 0, 0, 5), (1, 0, 1, 5), (1, 4, 4, 5), (1, 2, 2, 6), (1, 0, 8, 5)]
    got = kernels.split_parts(spark.createDataFrame(rows, "image_id long, y int, x int, inst_id int"))
    assert {(r.y, r.x): r.inst_id for r in got.collect()} == {(0, 0): 5, (0, 1): 5, (0, 8): 7, (4, 4): 8, (2, 2): 6}


def test_documents(spark, tmp_path):
    rows = [(1, 2, [[0, 1], [3, 4]], [1.5, 2.5], [[0, 0], [1, 0], [1, 1]], 0.5, 1), (1, 7, [[0, 0], [1, 1]], [0.0, 0.0], [[0, 0]], None, None)]
    frame = spark.createDataFrame(rows, "image_id long, inst_id int, bbox array<array<int>>, centroid array<double>, contour array<array<int>>, type_prob double, type int")
    texts = documents.to_documents(frame)
    assert '"mag":null' in texts.first().json
    back = documents.from_documents(texts)
    assert sorted(map(str, back.select(*frame.columns).collect())) == sorted(map(str, frame.collect()))
    texts.select("json").coalesce(1).write.text(str(tmp_path / "d"))
    os.rename(next((tmp_path / "d").glob("part-*")), tmp_path / "slide_a.json")
    assert {r.image_id for r in documents.read_documents(spark, str(tmp_path / "slide_a.json")).collect()} == {"slide_a"}
    assert documents.missing_types(type_info(spark), 7).count() == 2
    rows = documents.qupath_rows(spark.createDataFrame([(1.9, 2.2, 1)], "cx double, cy double, type_id int"), type_info(spark))
    documents.write_qupath(rows, str(tmp_path / "q"))
    assert next((tmp_path / "q").glob("part-*")).read_text() == "x\ty\tclass\tname\tcolor\n1\t2\t\tneopla\t16711680\n"
    keys = spark.sql("SELECT map('module.a', 1, 'module.b', 2) AS a, map('module.a', 1, 'b', 2) AS b").select(documents.stripped_keys(F.col("a")).alias("a"), documents.stripped_keys(F.col("b")).alias("b")).first()
    assert keys.a == {"a": 1, "b": 2} and keys.b == {"module.a": 1, "b": 2}


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.stem(F.lit("/a/b/slide.x.png")).alias("stem"), scalar.escaped_glob(F.lit("a[1]")).alias("glob"), scalar.rgb2int(F.lit(1), F.lit(2), F.lit(3)).alias("rgb"),
        scalar.round_to_multiple(F.lit(17), 5).alias("m"), F.pmod(F.lit(170) + 20, F.lit(180)).alias("hue"), colour.contrasted([F.lit(200.0)], [F.lit(100.0)], 2.0)[0].cast("double").alias("c"), track.step_rate(F.lit(26)).alias("lr"),
    ).first()
    assert (row.stem, row.glob, row.rgb, row.m, row.hue, row.c) == ("slide", "a[[]1]", 66051, 15, 10, 255.0) and abs(row.lr - 1e-5) < 1e-15


def test_predictor_and_stream(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0, 0, 4.0), (2, 0, 0, 8.0)], "image_id long, y int, x int, v double")
    out = evaluate.infer(frame, lambda rows: pd.DataFrame({"image_id": rows["image_id"], "np": rows["v"] / 8}), "image_id long, np double")
    assert {r.image_id: r.np for r in out.collect()} == {1: 0.5, 2: 1.0}
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in (frame.where("image_id = 1"), frame):
        batch.write.mode("append").parquet(source)
        q = stream_images(spark, source, "image_id long, y int, x int, v double", target, str(tmp_path / "cp"), lambda df: df.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")))
        q.awaitTermination(60)
    assert sorted((r.image_id, r.n) for r in spark.read.parquet(target).collect()) == [(1, 1), (2, 1)]


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(i % 3, y, x, rng.randrange(4), rng.randrange(4)) for i in range(3) for y in range(9) for x in range(9)]
    frame = spark.createDataFrame(rows, "image_id long, y int, x int, true_id int, pred_id int")
    a, b = (sorted(evaluate.per_image(frame.repartition(n)).collect()) for n in (1, 7))
    assert a == b
