"""The separation of touching objects in stacks of equally large tiles: what kernels.separate() gives for each, to the last bit, in one round of numpy for all.

Arrays are (tiles, height, width). Sums run in the order of kernels.convolved(), as floods depend on ties between heights.
"""

from __future__ import annotations

import heapq

import numpy as np

from . import kernels

#: Pixels that are worked on at a time; their arrays stay in a core's cache.
AT_ONCE = 1 << 16


def parts(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-connected labels from 1 through the whole stack, in reading order tile by tile, and how many lie before each tile (one entry more: all).

    Runs of rows hook to the smallest that they touch, by pointer jumping.
    """
    n, h, w = masks.shape
    flat = np.zeros((n * h, w + 1), bool)  # a column without pixels ends every row
    flat[:, :w] = masks.reshape(n * h, w)
    flat = flat.ravel()
    turns = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    if flat[:1].any():
        turns = np.r_[0, turns]
    begin, end = turns[::2], turns[1::2]
    row = begin // (w + 1)
    below = np.flatnonzero(row % h)
    low = np.searchsorted(end, begin[below] - (w + 1), "right")
    count = np.searchsorted(begin, end[below] - (w + 1), "left") - low
    a = np.repeat(below, count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    root = np.arange(len(begin))
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    first = root == np.arange(len(root))
    out = np.zeros(len(flat), np.int64)
    out[flat] = np.repeat(np.cumsum(first)[root], end - begin)
    before = np.searchsorted(row[first], np.arange(n + 1) * h)
    return out.reshape(n, h, w + 1)[:, :, :w], before


def without_small(labels: np.ndarray, least: int) -> np.ndarray:
    return np.where(np.bincount(labels.ravel())[labels] >= least, labels, 0)


def filled(masks: np.ndarray) -> np.ndarray:
    outside, _ = parts(np.pad(~masks, ((0, 0), (1, 1), (1, 1)), constant_values=True))
    return ~(outside == outside[:, :1, :1])[:, 1:-1, 1:-1]


def convolved(values: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray:
    for axis, k in ((1, down), (2, across)):
        half, n = len(k) // 2, values.shape[axis]
        at = np.arange(-half, n + half) % max(1, 2 * (n - 1))
        padded = np.take(values, np.where(at < n, at, 2 * (n - 1) - at), axis=axis)
        cut = lambda i: padded[:, i : i + n] if axis == 1 else padded[:, :, i : i + n]  # noqa: B023, E731
        total = 0 + k[0] * cut(0)
        term = np.empty_like(total)
        for i in range(1, len(k)):
            total += np.multiply(k[i], cut(i), out=term)
        values = total
    return values


def opened(masks: np.ndarray, size: int = 5) -> np.ndarray:
    half = size // 2
    places = [(a, b) for a in range(-half, half + 1) for b in range(-half, half + 1) if a * a + b * b <= half * half + 0.25]

    def sweep(m: np.ndarray, grow: bool) -> np.ndarray:
        p = np.pad(m, ((0, 0), (half, half), (half, half)), constant_values=not grow)
        out = np.full(m.shape, not grow)
        for a, b in places:
            (np.logical_or if grow else np.logical_and)(out, p[:, half + a : half + a + m.shape[1], half + b : half + b + m.shape[2]], out=out)
        return out

    return sweep(sweep(masks, False), True)


def watershed(height: np.ndarray, markers: np.ndarray, blobs: np.ndarray) -> np.ndarray:
    """kernels.watershed() for each tile, with the connected parts of the mask as `blobs`, numbered through the stack.

    A blob with one marker is that marker's. In the others pixels go through a queue, but for markers with no free neighbour, which change nothing,
    and a tile ends when its last pixel is met.
    """
    n, h, w = markers.shape
    labels = np.where(blobs > 0, markers, 0)
    known = labels > 0
    top = int(blobs.max(initial=0)) + 1
    low, high = np.full(top, np.iinfo(np.int64).max), np.zeros(top, np.int64)
    np.minimum.at(low, blobs[known], labels[known])
    np.maximum.at(high, blobs[known], labels[known])
    several = low < high
    several[0] = False
    out = np.where(several[blobs], labels, high[blobs] * (blobs > 0))
    busy = several[blobs]
    tiles = np.flatnonzero(busy.any(axis=(1, 2)))
    if not len(tiles):
        return out
    busy, labels = busy[tiles], labels[tiles]
    # ranks of heights within a tile keep the queue's numbers small
    tile_of, y, x = np.nonzero(busy)
    levels = height[tiles][busy]
    order = np.lexsort((levels, tile_of))
    new_tile = np.r_[True, tile_of[order][1:] != tile_of[order][:-1]]
    steps = np.cumsum(np.r_[True, levels[order][1:] != levels[order][:-1]] | new_tile)
    rank = np.empty(len(order), np.int64)
    rank[order] = steps - np.repeat(steps[new_tile], np.diff(np.r_[np.flatnonzero(new_tile), len(order)]))
    # every tile has a rim of its own above and to the left, and the next one's or one more row below
    wide = w + 1
    place = ((tile_of * (h + 1) + y + 1) * wide + x + 1).astype(np.int64)
    free = np.zeros((len(tiles) * (h + 1) + 1) * wide + 1, bool)
    cost, told = np.zeros(len(free), np.int64), np.zeros(len(free), np.int64)
    # a number of the queue is a pixel's rank, when it was met, and its place in the tile
    bits = int((h + 2) * wide).bit_length()
    unit = 1 << bits
    cost[place], told[place] = rank * (h * w + 1) * unit + place - tile_of * (h + 1) * wide, labels[busy]
    free[place] = labels[busy] == 0
    edge = place[(told[place] > 0) & (free[place - wide] | free[place - 1] | free[place + 1] | free[place + wide])]
    ends = np.searchsorted(edge, (np.arange(len(tiles) + 1) * (h + 1) + 1) * wide).tolist()
    first = (cost[edge] + (np.arange(len(edge)) - np.repeat(ends[:-1], np.diff(ends))) * unit).tolist()
    left = np.bincount(tile_of[labels[busy] == 0], minlength=len(tiles)).tolist()
    pop, push, put = heapq.heappop, heapq.heappush, heapq.heapreplace
    for k, todo in enumerate(left):
        own = slice(k * (h + 1) * wide, ((k + 1) * (h + 1) + 1) * wide + 1)
        near, label, height_of = free[own].tolist(), told[own].tolist(), cost[own].tolist()
        queue = first[ends[k] : ends[k + 1]]
        heapq.heapify(queue)
        met = len(queue) * unit
        todo = met + todo * unit
        while met < todo:
            at = queue[0] & (unit - 1)
            add = put  # the first new pixel takes the place of this one
            for to in (at - wide, at - 1, at + 1, at + wide):
                if near[to]:
                    near[to] = False
                    label[to] = label[at]
                    add(queue, height_of[to] + met)
                    met += unit
                    add = push
            if add is put:
                pop(queue)
        told[own] = label
    whole = out[tiles]
    whole[busy] = told[place]
    out[tiles] = whole
    return out


def _separate(np_maps: np.ndarray, h: np.ndarray, v: np.ndarray, min_size: int, size: int) -> np.ndarray:
    blobs = without_small(parts(np_maps >= 0.5)[0], min_size)
    blob = blobs > 0

    def scaled(a: np.ndarray) -> np.ndarray:
        low, high = a.min(axis=(1, 2), keepdims=True), a.max(axis=(1, 2), keepdims=True)
        some = high > low
        with np.errstate(invalid="ignore"):  # tiles of one value are zero
            return np.where(some, (a - low) / np.where(some, high - low, 1), 0)

    smooth, slope = kernels.binomial(size), np.convolve(kernels.binomial(size - 2), [-0.5, 0, 0.5])
    jump = [1 - scaled(convolved(scaled(a), *k)) for a, k in ((h, (smooth, slope)), (v, (slope, smooth)))]
    overall = np.maximum(np.maximum(*jump) - (1 - blob), 0)
    dist = -convolved((1.0 - overall) * blob, *(np.array([0.25, 0.5, 0.25]),) * 2)
    found, before = parts(opened(filled(blob & ~(overall >= 0.4))))
    markers = np.where(without_small(found, min_size) > 0, found - before[:-1, None, None], 0)
    return watershed(dist, markers, blobs)


def separate(np_maps: np.ndarray, h: np.ndarray, v: np.ndarray, min_size: int = 10, size: int = 21) -> np.ndarray:
    """kernels.separate() for each tile of a stack."""
    n, a, b = np_maps.shape
    step = max(1, AT_ONCE // max(1, a * b))
    done = [_separate(np_maps[i : i + step], h[i : i + step], v[i : i + step], min_size, size) for i in range(0, n, step)]
    return np.concatenate(done) if done else np.zeros(np_maps.shape, np.int64)
