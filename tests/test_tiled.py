"""Tiles with margins and joined seams, against the same kernels over whole images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import kernels, tiled, tissue


def blobs(seed, shape, share=0.55):
    """Noise that hangs together in long parts."""
    return kernels.dilated(np.random.default_rng(seed).random(shape) < share / 8, 1)


SHAPES = {1: (37, 23), 2: (16, 16), 3: (1, 50), 4: (9, 40), 5: (8, 8)}


@pytest.fixture(scope="module")
def masks():
    made = {i: blobs(i, s) for i, s in SHAPES.items()}
    made[2][:] = True
    made[5][:] = False
    spiral = np.zeros((37, 23), bool)  # one part that crosses many seams
    spiral[::2] = True
    spiral[1::4, -1] = True
    spiral[3::4, 0] = True
    return made | {6: spiral}


@pytest.fixture(scope="module")
def frames(spark, masks):
    rows = [(i, int(y), int(x)) for i, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    sizes = [(i, *m.shape) for i, m in masks.items()]
    return spark.createDataFrame(rows, "image_id long, y int, x int").repartition(3), spark.createDataFrame(sizes, "image_id long, height int, width int")


def as_masks(frame, masks):
    out = {i: np.zeros(m.shape, bool) for i, m in masks.items()}
    for r in frame.collect():
        assert not out[r.image_id][r.y, r.x], "a pixel twice"
        out[r.image_id][r.y, r.x] = True
    return out


def same(frame, masks, whole):
    got = as_masks(frame, masks)
    return all((got[i] == whole(m)).all() for i, m in masks.items())


@pytest.mark.parametrize("diagonal", [False, True])
@pytest.mark.parametrize("tile", [5, 8, 64])
def test_parts_equal_those_of_whole_images(frames, diagonal, tile):
    got = sorted(map(tuple, tiled.connected_parts(frames[0], diagonal, tile).collect()))
    assert got == sorted(map(tuple, tissue.connected_parts(frames[0], diagonal).collect()))


def test_sizes_and_holes_equal_those_of_whole_images(frames, masks):
    mask, images = frames
    assert same(tiled.remove_small_parts(mask, 9, True, 8), masks, lambda m: kernels.without_small(kernels.components(m, True), 9) > 0)
    assert same(tiled.filled(mask, images, 8), masks, kernels.filled)
    assert same(tiled.without_holes(mask, images, 6, 8), masks, lambda m: kernels.without_holes(m, 6))
    assert same(tiled.complement(mask, images, 8), masks, np.logical_not)


@pytest.mark.parametrize("tile", [8, 11])
def test_kernels_equal_those_of_whole_images(frames, masks, tile):
    mask, images = frames
    assert same(tiled.opened(mask, images, 5, tile), masks, lambda m: kernels.opened(m, 5))
    assert same(tiled.dilated(mask, images, 4, tile), masks, lambda m: kernels.dilated(m, 4))
    for axis in (0, 1):
        got = {i: np.zeros(m.shape) for i, m in masks.items()}
        for r in tiled.derivative(mask.withColumn("v", F.col("y") * 0.25 + F.pmod(F.col("x"), F.lit(3))), images, "v", axis, 5, tile).collect():
            got[r.image_id][r.y, r.x] = r.out
        for i, m in masks.items():
            y, x = np.indices(m.shape)
            assert np.allclose(got[i], kernels.derivative(np.where(m, y * 0.25 + x % 3, 0.0), axis, 5))


def test_tissue_of_a_large_mask(frames, masks):
    assert same(tiled.tissue_mask(*frames, 12, 10, 3, 8), masks, lambda m: tissue.cleaned(m, 12, 10, 3))


def test_empty_tables(spark, frames):
    none, images = frames[0].limit(0), frames[1]
    assert not tiled.connected_parts(none).count() and not tiled.dilated(none, images, 2, 8).count() and tiled.filled(none, images, 8).count() == 0
    assert not tiled.complement(frames[0], images.limit(0), 8).count()


def test_chains_of_edges_meet(spark):
    edges = [(1, i, i + 1) for i in range(60)] + [(2, 5, 9), (2, 9, 5), (2, 7, 7), (2, 8, 9)]
    got = {(r.image_id, r.node): r.part for r in tiled.joined(spark.createDataFrame(edges, "image_id long, a long, b long")).collect()}
    assert got == {(1, i): 0 for i in range(61)} | {(2, 5): 5, (2, 9): 5, (2, 8): 5}
