"""Readers, seams of whole slides, assignment and masks against files and plain numpy."""

import itertools
import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelloom.functions import colour
from labelloom.operators import grid, instances, kernels, matching, metrics, raster, sampling, tissue, track
from labelloom.plans import evaluate, runs, slide
from labelloom.sources import documents, images


def png(pixels):
    """A PNG of 8-bit colours, by hand."""
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def sparse(spark, labels, image=1):
    rows = [(image, int(y), int(x), int(labels[y, x])) for y, x in zip(*np.nonzero(labels), strict=True)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, inst_id int")


def dense(frame, shape, column="inst_id"):
    out = np.zeros(shape, int)
    for r in frame.collect():
        out[r.y, r.x] = r[column]
    return out


def test_images_are_listed_and_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {name: rng.integers(0, 256, (3 + i, 4, 3)) for i, name in enumerate(("b", "a"))}
    for name, p in made.items():
        (tmp_path / f"{name}.x.png").write_bytes(png(p))
    (tmp_path / "note.txt").write_text("no image")
    assert [r.stem for r in images.list_files(spark, str(tmp_path), "*.png").collect()] == ["a", "b"]
    got = images.image_pixels(images.load_images(spark, str(tmp_path))).collect()
    assert len(got) == sum(p.shape[0] * p.shape[1] for p in made.values())
    assert all((r.r, r.g, r.b) == tuple(made[r.stem][r.y, r.x]) for r in got)


def test_label_readers(spark, tmp_path):
    maps = spark.createDataFrame([(1, 2, [0, 5, 6, 0], [0, 4, 7, 1])], "image_id long, width int, inst_map array<int>, type_map array<int>")
    maps.write.parquet(str(tmp_path / "m"))
    read = lambda name, kinds: sorted(tuple(r) for r in images.read_labels(spark, name, str(tmp_path / "m"), kinds).collect())
    assert read("Kumar", False) == read("CPM17", False) == [(1, 0, 1, 5), (1, 1, 0, 6)] and read("CoNSeP", True) == [(1, 0, 1, 5, 3), (1, 1, 0, 6, 4)]
    with pytest.raises(ValueError, match="no types"):
        read("kumar", True)
    with pytest.raises(ValueError, match="no such data set"):
        read("other", False)


def test_slides_by_ending(spark):
    paths = spark.createDataFrame([("/a/b.SVS",), ("/a/c.tiff",)], "path string")
    assert images.checked_slides(paths).count() == 2
    with pytest.raises(Exception, match="unknown slide format"):
        images.checked_slides(paths.union(spark.createDataFrame([("/a/b.png",)], "path string"))).collect()


def test_missing_truth_ends_the_job(spark):
    one = sparse(spark, np.ones((2, 2), int))
    two = one.withColumn("image_id", F.lit(2).cast("long"))
    with pytest.raises(ValueError, match="no truth for image 2"):
        evaluate.instance_stats(one, two)
    same = evaluate.instance_stats(one.unionByName(two), two).first()
    assert same.images == 1 and same.aji == same.aji_plus == 1.0
    files = spark.createDataFrame([("/p/x.mat",)], "path string")
    with pytest.raises(Exception, match="no truth for"):
        metrics.by_stem(files.where("false"), files).collect()


def best_pairs(iou):
    """By trying every assignment."""
    n, m = iou.shape
    best = (-1.0, ())
    for k in range(min(n, m) + 1):
        for a in itertools.combinations(range(n), k):
            for b in itertools.permutations(range(m), k):
                if all(iou[i, j] > 0 for i, j in zip(a, b, strict=True)):
                    best = max(best, (sum(iou[i, j] for i, j in zip(a, b, strict=True)), tuple(zip(a, b, strict=True))))
    return best


def test_assigned_metrics_by_enumeration(spark):
    rng = np.random.default_rng(4)
    for trial in range(4):
        t, p = rng.integers(0, 4, (5, 6)), rng.integers(0, 4, (5, 6))
        ids = [np.unique(a[a > 0]) for a in (t, p)]
        both = np.array([[((t == i) & (p == j)).sum() for j in ids[1]] for i in ids[0]])
        union = np.array([[((t == i) | (p == j)).sum() for j in ids[1]] for i in ids[0]])
        total, pairs = best_pairs(both / union)
        i, u = sum(both[a] for a in pairs), sum(union[a] for a in pairs)
        u += sum((t == ids[0][k]).sum() for k in range(len(ids[0])) if k not in {a for a, _ in pairs}) + sum((p == ids[1][k]).sum() for k in range(len(ids[1])) if k not in {b for _, b in pairs})
        rows = [(trial, int(y), int(x), int(t[y, x]), int(p[y, x])) for y, x in np.ndindex(t.shape)]
        table = metrics.contingency(spark.createDataFrame(rows, "image_id long, y int, x int, true_id int, pred_id int"))
        assert abs(matching.aji_plus(table).first().aji_plus - i / u) < 1e-12
        got = matching.pq_assigned(table, 0.1).first()
        hits = [both[a] / union[a] for a in pairs if both[a] / union[a] > 0.1]
        assert (got.tp, got.fp, got.fn) == (len(hits), len(ids[1]) - len(hits), len(ids[0]) - len(hits)) and abs(got.sq - sum(hits) / (len(hits) + 1e-6)) < 1e-12


def test_islands():
    assert matching.islands(np.array([0, 0, 1, 2, 3]), np.array([0, 1, 1, 2, 2])).tolist() == [0, 0, 0, 2, 2]


def in_turn(maps, tile, margin):
    """The phases one box after another, on arrays; returns the parts as frozen sets of places."""
    h, w = maps[0].shape
    now, top = np.zeros((h, w), int), 0
    lines = lambda n: [k for k in range(tile, n + 1, tile)]
    boxes = [("tile", y, x, y + tile, x + tile) for y in range(0, h, tile) for x in range(0, w, tile)]
    boxes += [("mend", y, x - margin, y + tile, x + margin) for y in range(0, h, tile) for x in lines(w)]
    boxes += [("mend", y - margin, x, y + margin, x + tile) for y in lines(h) for x in range(0, w, tile)]
    boxes += [("mend", y - 2 * margin, x - 2 * margin, y + 2 * margin, x + 2 * margin) for y in lines(h) for x in lines(w)]
    for kind, y0, x0, y1, x1 in boxes:
        own = (slice(max(0, y0), min(h, y1)), slice(max(0, x0), min(w, x1)))
        if now[own].size == 0:
            continue
        new = kernels.separate(*(m[own] for m in maps), size=5)
        if not new.any():
            continue
        if kind == "mend":
            old = now[own].copy()
            full = np.zeros((y1 - y0, x1 - x0), int)
            full[own[0].start - y0 : own[0].stop - y0, own[1].start - x0 : own[1].stop - x0] = old
            edge = set(np.unique(np.r_[full[0], full[-1], full[:, 0], full[:, -1]]))
            old[~np.isin(old, list(edge | {0}))] = 0
            new[np.isin(new, np.unique(new[old > 0]))] = 0
            now[own] = np.where(new > 0, new + top, old)
        else:
            now[own] = np.where(new > 0, new + top, 0)
        top = max(top, now.max())
    return {frozenset(zip(*np.nonzero(now == k), strict=True)) for k in np.unique(now) if k}


def test_whole_slide_equals_boxes_in_turn(spark):
    rng = np.random.default_rng(9)
    h = w = 72
    y, x = np.mgrid[:h, :w]
    maps = [np.zeros((h, w)) for _ in range(3)]
    for _ in range(40):
        cy, cx, r = rng.integers(3, h - 3), rng.integers(3, w - 3), rng.integers(3, 6)
        own = ((y - cy) ** 2 + (x - cx) ** 2 <= r * r) & (maps[0] == 0)
        maps[0][own], maps[1][own], maps[2][own] = 0.9, ((x - cx) / r)[own], ((y - cy) / r)[own]
    rows = [(1, int(a), int(b), *(float(m[a, b]) for m in maps)) for a, b in np.ndindex(h, w)]
    frame = spark.createDataFrame(rows, "image_id long, y int, x int, np double, h double, v double")
    size = spark.createDataFrame([(1, h, w)], "image_id long, height int, width int")
    step = lambda a, b, c: kernels.separate(a, b, c, size=5)
    got = slide.slide_labels(frame, size, 24, 6, process=step)
    parts = {}
    for r in got.collect():
        parts.setdefault(r.inst_id, set()).add((r.y, r.x))
    assert {frozenset(p) for p in parts.values()} == in_turn(maps, 24, 6)
    with pytest.raises(ValueError, match="four margins"):
        slide.slide_labels(frame, size, 16, 6)


def test_tissue_mask_and_parts(spark):
    mask = np.zeros((30, 30), bool)
    mask[2:12, 2:12], mask[5, 5], mask[20, 20], mask[21, 21] = True, False, True, True
    want = np.zeros_like(mask)
    want[2:12, 2:12] = True
    grown = np.zeros_like(mask)
    for a, b in kernels.disc(3):
        yy, xx = np.nonzero(want)
        ok = (yy + a >= 0) & (yy + a < 30) & (xx + b >= 0) & (xx + b < 30)
        grown[yy[ok] + a, xx[ok] + b] = True
    assert (tissue.cleaned(mask, 5, 4, 3) == grown).all()
    rows = [(1, int(a), int(b), 10 if mask[a, b] else 200) for a, b in np.ndindex(30, 30)]
    greys = spark.createDataFrame(rows, "image_id long, y int, x int, grey int")
    size = spark.createDataFrame([(1, 30, 30)], "image_id long, height int, width int")
    got = dense(tissue.tissue_mask(greys, size, 5, 4, 3).withColumn("one", F.lit(1)), (30, 30), "one")
    assert tissue.thresholds(greys).first().threshold == 10 and (got == grown).all()
    dark = tissue.binary(greys)
    assert tissue.remove_small_parts(dark, 2).count() == 99 and tissue.remove_small_parts(dark, 2, diagonal=True).count() == 101
    assert kernels.components(np.eye(3) > 0).max() == 3 and kernels.components(np.eye(3) > 0, True).max() == 1


def test_types_and_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"0": ["none", [0, 0, 0]], "1": ["some", [1, 2, 3]]}))
    types = documents.read_types(spark, str(tmp_path / "t.json"))
    assert sorted(tuple(r) for r in types.collect()) == [(0, "none", 0, 0, 0), (1, "some", 1, 2, 3)]
    assert documents.checked_types(types, 2).count() == 2
    with pytest.raises(ValueError, match="type 2"):
        documents.checked_types(types, 3)
    rows = documents.qupath_rows(spark.createDataFrame([(7, 1.9, 2.2, 1), (8, 3.0, 4.0, 0), (7, 5.0, 6.0, 0)], "image_id long, cx double, cy double, type_id int"), types)
    documents.write_qupath(rows.repartition(3), str(tmp_path / "q"))
    for image, n in ((7, 2), (8, 1)):
        files = list((tmp_path / "q" / f"image_id={image}").glob("part-*"))
        assert len(files) == 1 and len(files[0].read_text().splitlines()) == n + 1
    cut = spark.createDataFrame([(7, 0, 0, 0, 5), (7, 1, 0, 0, 6)], "image_id long, patch int, dy int, dx int, v int")
    images.write_patches(images.patch_arrays(cut, 1, ["v"]), str(tmp_path / "p"), F.col("image_id"), F.lit("train"))
    assert sorted((r.name, r.data, r.split) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("7_000", [5], "train"), ("7_001", [6], "train")]
    bad = spark.createDataFrame([(1, "{no")], "image_id long, json string")
    assert documents.from_documents(bad).count() == 0
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        documents.from_documents(bad, strict=True).collect()


def test_colours_come_back(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(int(v) for v in rng.integers(0, 256, 3)) for _ in range(300)] + [(0, 0, 0), (255, 255, 255), (9, 9, 9)]
    frame = spark.createDataFrame(rows, "r int, g int, b int")
    back = colour.from_hsv(*colour.hsv(F.col("r"), F.col("g"), F.col("b")))
    assert all(tuple(r)[:3] == tuple(r)[3:] for r in frame.select("r", "g", "b", *(c.alias(f"o{i}") for i, c in enumerate(back))).collect())
    assert colour.ember(0) == (10, 0, 0) and colour.ember(255) == (255, 255, 255)


def test_orders_do_not_depend_on_partitions(spark):
    frame = spark.range(1000).withColumnRenamed("id", "k")
    runs = [sorted((r.k, r.rank, r.batch) for r in sampling.training_order(frame.repartition(n), F.col("k"), 64, 3, True).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 960 and sorted(r[1] for r in runs[0]) == list(range(960))
    last = sampling.training_order(frame, F.col("k"), 64, 3, False).orderBy("rank").collect()
    assert [r.k for r in last] == list(range(1000)) and last[-1].batch == 15
    picks = [sorted((r.draw, r.k) for r in sampling.drawn(frame.repartition(n), F.col("k"), 20, 5).collect()) for n in (1, 5)]
    assert picks[0] == picks[1] and len(picks[0]) == 20
    assert sampling.drawn(spark.range(1).withColumnRenamed("id", "k"), F.col("k"), 4, 5).count() == 4  # with replacement


def test_augmentation_keeps_labels_with_colours(spark):
    rows = [(1, 0, y, x, y, x, 0, 1 if y < 4 else 2) for y in range(8) for x in range(8)]
    cut = spark.createDataFrame(rows, "image_id long, patch int, dy int, dx int, r int, g int, b int, inst_id int")
    colours, targets = images.training_rows(cut, 8, 4, augment=lambda p: raster.flipped(p, 8, 8, 1, chance=1.1), min_size=1)
    assert {(r.y, r.x): (r.r, r.g) for r in colours.collect()} == {(y, x): (5 - y, 5 - x) for y in range(4) for x in range(4)} and targets.count() == 16
    other = images.training_rows(cut, 8, 4, targets=lambda labels, h, w, a, b: instances.boxes(labels))[1]
    assert other.count() == 2  # another generator of targets
    with pytest.raises(ValueError):
        grid.extract(spark.createDataFrame([(1, 9, 9)], "image_id long, height int, width int"), 3, 3, "other")
    with pytest.raises(ValueError):
        track.saves(spark.range(1), "id", "id", "id", "!=")


def test_shapes():
    assert (runs.Shapes.of("fast").window, runs.Shapes.of("original", 5).mask) == (256, 80)
    for bad in (lambda: runs.Shapes(270, 164, "fast"), lambda: runs.Shapes.of("other"), lambda: runs.Shapes(10, 12), lambda: runs.Shapes(12, 10, types=0)):
        with pytest.raises(ValueError):
            bad()


def test_tiles_slides_and_stats_end_to_end(spark, tmp_path):
    y, x = np.mgrid[:32, :32]
    truth = np.zeros((32, 32), int)
    rgb = np.zeros((32, 32, 3), int)
    for k, (cy, cx) in enumerate(((8, 8), (8, 22), (22, 12)), 1):
        own = (y - cy) ** 2 + (x - cx) ** 2 <= 25
        truth[own], rgb[own] = k, np.stack([np.full_like(y, 200), 128 + 10 * (x - cx), 128 + 10 * (y - cy)], axis=2)[own]
    rows = [(i, int(a), int(b), *(int(v) for v in rgb[a, b])) for i in (1, 2) for a, b in np.ndindex(32, 32)]
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int")
    sizes = spark.createDataFrame([(1, 32, 32), (2, 32, 32)], "image_id long, height int, width int")

    def predict(batch):
        cut = [d.reshape(20, 20, 3)[4:16, 4:16].astype(float) for d in batch["data"]]
        maps = [np.stack([c[..., 0] / 255, np.where(c[..., 0] > 0, (c[..., 1] - 128) / 50, 0), np.where(c[..., 0] > 0, (c[..., 2] - 128) / 50, 0), c[..., 0] > 0], axis=2) for c in cut]
        return pd.Series([m.ravel() for m in maps], index=batch.index)

    shapes = runs.Shapes(20, 12, types=2)
    types = documents.default_types(spark, 2)
    objects = runs.run_tiles(pixels, sizes, predict, shapes, str(tmp_path / "o"), types, qupath=True, raw=True)
    found = {(r.image_id, round(r.centroid[1]), round(r.centroid[0]), r.type) for r in objects.collect()}
    assert found == {(i, cy, cx, 1) for i in (1, 2) for cy, cx in ((8, 8), (8, 22), (22, 12))}
    back = documents.from_documents(spark.read.parquet(str(tmp_path / "o" / "json")), strict=True)
    assert back.count() == 6 and spark.read.parquet(str(tmp_path / "o" / "tables")).count() == 6 and spark.read.parquet(str(tmp_path / "o" / "raw_map")).count() == 2 * 32 * 32
    assert len(list((tmp_path / "o" / "qupath").glob("image_id=*/part-*"))) == 2
    labels = kernels.separated(spark.read.parquet(str(tmp_path / "o" / "raw_map")))
    true = sparse(spark, truth).unionByName(sparse(spark, truth, 2))
    stats = runs.compute_stats(true, labels).first()
    assert stats.images == 2 and stats.dice1 > 0.95 and stats.aji_plus > 0.9 and stats.dq == 1.0
    points = lambda df: df.select("image_id", F.col("inst_id").alias("idx"), F.col("centroid")[0].alias("x"), F.col("centroid")[1].alias("y"), F.lit(1).alias("type"))
    assert runs.compute_stats(points(objects), points(objects), "type").first().f1_1 == 1.0
    with pytest.raises(ValueError):
        runs.compute_stats(true, labels, "other")
    maps = spark.read.parquet(str(tmp_path / "o" / "raw_map"))
    hand_on = lambda batch: batch[["image_id", "y", "x", "np", "h", "v", "tp"]].astype({"tp": int})
    out = str(tmp_path / "slides")
    first = runs.run_slides(maps.where("image_id = 1"), hand_on, sizes.where("image_id = 1"), out, 32, 8)
    again = runs.run_slides(maps, hand_on, sizes, out, 32, 8, preproc=lambda rows: rows.where("np >= 0"))
    assert [r.image_id for r in first.collect()] == [1] and [r.image_id for r in again.collect()] == [2] and spark.read.parquet(out).count() == 2
