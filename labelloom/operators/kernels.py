"""Neighbourhood kernels in numpy, each over one tile, and the separation of touching objects.

Conventions of this library: components are 4-connected and numbered in reading order,
borders are reflected without the edge, derivatives are binomial, and floods take
pixels of equal height in the order in which they were met.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .groups import over_groups


def components(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """4-connected labels from 1, or with `diagonal` 8-connected ones: runs of rows, joined by union-find."""
    out = np.zeros(mask.shape, np.int32)
    parent = [0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y in range(mask.shape[0]):
        edges = np.flatnonzero(np.diff(np.r_[0, mask[y].astype(np.int8), 0]))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            above = sorted({root(k) for k in np.unique(out[y - 1, max(0, a - diagonal) : b + diagonal]) if k}) if y else []
            if above:
                for k in above[1:]:
                    parent[k] = above[0]
                out[y, a:b] = above[0]
            else:
                parent.append(len(parent))
                out[y, a:b] = len(parent) - 1
    roots = np.array([root(i) for i in range(len(parent))])
    return relabelled(roots[out])


def relabelled(labels: np.ndarray) -> np.ndarray:
    """Ids from 1 in the order of their first pixel."""
    values, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    order = np.argsort(np.where(values == 0, -1, first))
    new = np.zeros(len(values), np.int32)
    new[order] = np.arange(len(values)) + (values[order[0]] != 0)
    return new[inverse].reshape(labels.shape)


def without_small(labels: np.ndarray, least: int) -> np.ndarray:
    counts = np.bincount(labels.ravel())
    return np.where(counts[labels] >= least, labels, 0)


def filled(mask: np.ndarray) -> np.ndarray:
    """Holes closed: background that does not reach the border."""
    outside = components(np.pad(~mask, 1, constant_values=True))
    return ~(outside == outside[0, 0])[1:-1, 1:-1]


def without_holes(mask: np.ndarray, least: int) -> np.ndarray:
    """Holes, also those at the border, of under `least` pixels closed."""
    return ~(without_small(components(~mask), least) > 0)


def disc(half: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-half, half + 1) for b in range(-half, half + 1) if a * a + b * b <= half * half]


def dilated(mask: np.ndarray, half: int) -> np.ndarray:
    """Grown by a disc: each of its rows is a span, whose reach is a running sum."""
    h, w = mask.shape
    out = np.zeros_like(mask)
    for a in range(-half, half + 1):
        span = int((half * half - a * a) ** 0.5)
        sums = np.cumsum(np.pad(mask.astype(np.int32), ((0, 0), (span + 1, span))), axis=1)
        wide = sums[:, 2 * span + 1 :] > sums[:, : w]
        top, bottom = max(0, a), min(h, h + a)
        out[top:bottom] |= wide[top - a : bottom - a]
    return out


def convolved(values: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray:
    """A separable kernel with reflected borders."""
    for axis, k in ((0, down), (1, across)):
        half = len(k) // 2
        n = values.shape[axis]
        at = np.arange(-half, n + half) % max(1, 2 * (n - 1))
        padded = np.take(values, np.where(at < n, at, 2 * (n - 1) - at), axis=axis)
        values = sum(k[i] * np.take(padded, np.arange(i, i + n), axis=axis) for i in range(len(k)))
    return values


def binomial(size: int) -> np.ndarray:
    row = np.ones(1)
    for _ in range(size - 1):
        row = np.convolve(row, [1, 1])
    return row / row.sum()


def derivative(values: np.ndarray, axis: int, size: int = 21) -> np.ndarray:
    smooth, slope = binomial(size), np.convolve(binomial(size - 2), [-0.5, 0, 0.5])
    return convolved(values, *((slope, smooth) if axis == 0 else (smooth, slope)))


def opened(mask: np.ndarray, size: int = 5) -> np.ndarray:
    """Erosion, then dilation, by a disc in a size x size box."""
    half = size // 2
    places = [(a, b) for a in range(-half, half + 1) for b in range(-half, half + 1) if a * a + b * b <= half * half + 0.25]

    def sweep(m: np.ndarray, grow: bool) -> np.ndarray:
        p = np.pad(m, half, constant_values=not grow)
        cut = [p[half + a : half + a + m.shape[0], half + b : half + b + m.shape[1]] for a, b in places]
        return np.logical_or.reduce(cut) if grow else np.logical_and.reduce(cut)

    return sweep(sweep(mask, False), True)


def watershed(height: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Flood from markers within the mask, lowest first; of equal heights the pixel that was met first.

    A pixel's place in the queue is one whole number, the rank of its height and then when it was met, so that the queue compares
    numbers, not tuples; the image is a flat list with a rim that is never entered.
    """
    inside = np.pad(mask, 1)
    labels = np.pad(np.where(mask, markers, 0), 1)
    _, rank = np.unique(np.where(mask, height, 0).ravel(), return_inverse=True)
    size = int(inside.sum()) + 1
    cost = (np.pad(rank.reshape(mask.shape), 1).astype(np.int64) * size).ravel().tolist()
    free = (inside & (labels == 0)).ravel().tolist()
    start = np.flatnonzero(labels.ravel())
    met, out, wide = start.tolist(), labels.ravel().tolist(), inside.shape[1]
    queue = [cost[at] + n for n, at in enumerate(met)]
    heapq.heapify(queue)
    pop, push, n = heapq.heappop, heapq.heappush, len(met)
    while queue:
        at = met[pop(queue) % size]
        for to in (at - wide, at - 1, at + 1, at + wide):
            if free[to]:
                free[to] = False
                out[to] = out[at]
                push(queue, cost[to] + n)
                met.append(to)
                n += 1
    return np.array(out, labels.dtype).reshape(labels.shape)[1:-1, 1:-1]


def contour(mask: np.ndarray) -> list[tuple[int, int]]:
    """(x, y) of the outer border of the first component, clockwise from its first pixel, without points inside straight runs."""
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    # a flat list with a rim, so that no step has to look whether it is still within
    inside, wide = np.pad(mask, 1).ravel().tolist(), mask.shape[1] + 2
    if True not in inside:
        return []
    step_of = [a * wide + b for a, b in ring]
    start = inside.index(True)
    at, back, path = start, 4, [start]
    first = None
    for _ in range(4 * mask.size + 8):
        for k in range(1, 9):
            d = (back + k) % 8
            to = at + step_of[d]
            if inside[to]:
                break
        else:
            break  # a single pixel
        if first is None:
            first = (at, d)
        elif (at, d) == first:
            path.pop()
            break
        path.append(to)
        at, back = to, (d + 4) % 8
    path = [(p // wide - 1, p % wide - 1) for p in path]
    n = len(path)
    step = lambda i: (path[(i + 1) % n][0] - path[i][0], path[(i + 1) % n][1] - path[i][1])
    return [(x, y) for i, (y, x) in enumerate(path) if n < 3 or step(i) != step(i - 1)]


def separate(np_map: np.ndarray, h: np.ndarray, v: np.ndarray, min_size: int = 10, size: int = 21) -> np.ndarray:
    """Labels of touching objects: edges where distance maps jump cut markers out of the foreground, and a flood grows them back."""
    blob = without_small(components(np_map >= 0.5), min_size) > 0

    def scaled(a: np.ndarray) -> np.ndarray:
        low, high = a.min(), a.max()
        return (a - low) / (high - low) if high > low else np.zeros_like(a)

    jump = [1 - scaled(derivative(scaled(a), axis, size)) for a, axis in ((h, 1), (v, 0))]
    overall = np.maximum(np.maximum(*jump) - (1 - blob), 0)
    dist = -convolved((1.0 - overall) * blob, *(np.array([0.25, 0.5, 0.25]),) * 2)
    markers = opened(filled(blob & ~(overall >= 0.4)))
    return watershed(dist, without_small(components(markers), min_size), blob)


def _grid(rows: pd.DataFrame, *columns: str) -> list[np.ndarray]:
    y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
    out = []
    for c in columns:
        a = np.zeros((y.max() + 1, x.max() + 1), rows[c].dtype)
        a[y, x] = rows[c]
        out.append(a)
    return out


#: A post-processing step: np, h and v maps of a tile to its label map.
Process = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def separated(pixels: DataFrame, min_size: int = 10, size: int = 21, process: Process | None = None, typed: bool = False) -> DataFrame:
    """pixels: image_id, y, x, np, h, v of one tile per image_id, and box_id, if an image has several; a group is a tile, so its size is bounded.

    Foreground with inst_id, at the places of the image; with box_id, if given. process: another step than separate().
    typed: pixels have tp, which is handed on as type_id, so that no join has to bring it back.
    """
    keys = ["image_id", *(["box_id"] if "box_id" in pixels.columns else [])]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = (0, 0) if len(keys) == 1 else (rows["y"].min(), rows["x"].min())
        maps = _grid(rows.assign(y=rows["y"] - y0, x=rows["x"] - x0), "np", "h", "v")
        labels = process(*maps) if process is not None else separate(*maps, min_size, size)
        y, x = np.nonzero(labels)
        kinds = {"type_id": _grid(rows.assign(y=rows["y"] - y0, x=rows["x"] - x0), "tp")[0][y, x]} if typed else {}
        return pd.DataFrame({k: rows[k].iloc[0] for k in keys} | {"y": y + y0, "x": x + x0, "inst_id": labels[y, x]} | kinds, index=range(len(y)))

    return pixels.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} long" for k in keys) + ", y int, x int, inst_id int" + ", type_id int" * typed)


def contours(labels: DataFrame) -> DataFrame:
    """image_id, inst_id, contour [[x, y], ...] per object, many small objects at a time."""

    def run(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ys, xs = rows["y"].to_numpy(), rows["x"].to_numpy()
        points = []
        for a, b in zip(starts, [*starts[1:], len(ys)], strict=True):
            y, x = ys[a:b], xs[a:b]
            y0, x0 = int(y.min()), int(x.min())
            mask = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1), bool)
            mask[y - y0, x - x0] = True
            points.append([[p + x0, q + y0] for p, q in contour(mask)])
        return pd.DataFrame({"group": range(len(starts)), "contour": points})

    keyed = labels.select(F.col("image_id").cast("long").alias("image_id"), F.col("inst_id").cast("int").alias("inst_id"), "y", "x")
    return over_groups(keyed, ["image_id", "inst_id"], run, "contour array<array<int>>")


def split_parts(labels: DataFrame) -> DataFrame:
    """Disconnected parts of an object become objects: the first keeps the id, others go on from the image's largest; ids follow (inst_id, part)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = rows["y"].min(), rows["x"].min()
        mask = np.zeros((rows["y"].max() - y0 + 1, rows["x"].max() - x0 + 1), bool)
        mask[rows["y"] - y0, rows["x"] - x0] = True
        return rows.assign(part=components(mask)[rows["y"] - y0, rows["x"] - x0])[["image_id", "y", "x", "inst_id", "part"]]

    parts = labels.groupBy("image_id", "inst_id").applyInPandas(run, "image_id long, y int, x int, inst_id int, part int")
    ids = parts.groupBy("image_id", "inst_id", "part").agg(F.lit(1).alias("_"))
    w = Window.partitionBy("image_id")
    extra = F.sum((F.col("part") > 1).cast("int")).over(w.orderBy("inst_id", "part"))
    ids = ids.select("image_id", "inst_id", "part", F.when(F.col("part") == 1, F.col("inst_id")).otherwise(F.max("inst_id").over(w) + extra).cast("int").alias("new_id"))
    return parts.join(ids, ["image_id", "inst_id", "part"]).select("image_id", "y", "x", F.col("new_id").alias("inst_id"))
