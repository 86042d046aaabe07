"""Optimal 1-1 assignment per image, and what is built on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import chosen_panoptic, chosen_ratio, overlaps


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a cheapest assignment of a rectangular matrix, by shortest augmenting paths."""
    if cost.shape[0] > cost.shape[1]:
        cols, rows = assign(cost.T)
        order = np.argsort(rows)
        return rows[order], cols[order]
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        dist, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, col, base = i, -1, 0.0
        while True:
            step = base + cost[row] - u[row] - v
            better = ~done & (step < dist)
            dist[better], prev[better] = step[better], col
            col = int(np.where(done, np.inf, dist).argmin())
            base = dist[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        seen = np.flatnonzero(done)
        for c in seen:
            if row_of[c] >= 0:
                u[row_of[c]] += base - dist[c]
            v[c] -= base - dist[c]
        u[i] += base
        while col >= 0:
            back = prev[col]
            row_of[col] = i if back < 0 else row_of[back]
            col = back
    cols = np.flatnonzero(row_of >= 0)
    order = np.argsort(row_of[cols])
    return row_of[cols][order], cols[order]


def islands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For edges between places a of one side and b of the other, the number of the connected part that each is in."""
    label = np.arange(a.max() + 1)
    while True:
        # the smallest label goes from one side to the other and back
        of_b = np.full(b.max() + 1, len(label))
        np.minimum.at(of_b, b, label[a])
        new = label.copy()
        np.minimum.at(new, a, of_b[b])
        new = new[new]
        if (new == label).all():
            return label[a]
        label = new


def assigned_pairs(table: DataFrame, least: float = 0.0) -> DataFrame:
    """Overlapping pairs of the assignment with the largest total ratio, those above `least`.

    A group is one image's overlapping pairs; within it objects that no chain of overlaps joins are assigned apart,
    which gives the same optimum, so no matrix is larger than a clump of objects.
    """
    pairs = overlaps(table)

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        _, t = np.unique(rows["true_id"], return_inverse=True)
        _, p = np.unique(rows["pred_id"], return_inverse=True)
        chosen = []
        for _, own in rows.groupby(islands(t, p), sort=False):
            at = own.index.to_numpy()
            if len(at) == 1:
                chosen.append(at)
                continue
            _, i = np.unique(t[at], return_inverse=True)
            _, j = np.unique(p[at], return_inverse=True)
            gain, place = np.zeros((i.max() + 1, j.max() + 1)), np.full((i.max() + 1, j.max() + 1), -1)
            gain[i, j], place[i, j] = own["iou"], at
            picked = place[assign(-gain)]
            chosen.append(picked[picked >= 0])
        out = rows.iloc[np.sort(np.concatenate(chosen))]
        return out[out["iou"] > least]

    return pairs.groupBy("image_id").applyInPandas(best, pairs.schema)


def aji_plus(table: DataFrame) -> DataFrame:
    return chosen_ratio(table, assigned_pairs(table), "aji_plus")


def pq_assigned(table: DataFrame, match_iou: float) -> DataFrame:
    return chosen_panoptic(table, assigned_pairs(table, match_iou))


def pair_points(truth: DataFrame, guess: DataFrame, radius: float, dummies: bool = False) -> DataFrame:
    """image_id, idx, x, y, type of both sides; rows of pairs and of unpaired points (the other side null).

    The assignment is over all distances, and pairs beyond the radius are dissolved after it:
    a filter before it would give other pairs. A task holds one image's matrix of distances, 800 MB for
    10,000 points a side; a larger image has to be cut into tiles first. With `dummies` an image without points on a
    side has one at the origin, of type 0.
    """
    side = lambda df, s: df.select("image_id", F.lit(s).alias("side"), "idx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("type").cast("int").alias("type"))
    both = side(truth, 0).unionByName(side(guess, 1))

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows[rows["side"] == s].sort_values("idx") for s in (0, 1))
        if dummies:
            dummy = pd.DataFrame({"image_id": rows["image_id"].iloc[:1], "idx": -1, "x": 0.0, "y": 0.0, "type": 0})
            a, b = (dummy if x.empty else x for x in (a, b))
        i = j = np.empty(0, int)
        d = np.empty(0)
        if len(a) and len(b):
            cost = np.hypot(a["x"].to_numpy()[:, None] - b["x"].to_numpy(), a["y"].to_numpy()[:, None] - b["y"].to_numpy())
            i, j = assign(cost)
            near = cost[i, j] <= radius
            i, j, d = i[near], j[near], cost[i, j][near]
        image = rows["image_id"].iloc[0]
        out = [(image, a["idx"].iloc[k], b["idx"].iloc[m], a["type"].iloc[k], b["type"].iloc[m], x) for k, m, x in zip(i, j, d, strict=True)]
        out += [(image, a["idx"].iloc[k], None, a["type"].iloc[k], None, None) for k in sorted(set(range(len(a))) - set(i.tolist()))]
        out += [(image, None, b["idx"].iloc[k], None, b["type"].iloc[k], None) for k in sorted(set(range(len(b))) - set(j.tolist()))]
        frame = pd.DataFrame(out, columns=["image_id", "true_idx", "pred_idx", "true_type", "pred_type", "distance"], dtype=object)
        return frame

    return both.groupBy("image_id").applyInPandas(pair, "image_id long, true_idx int, pred_idx int, true_type int, pred_type int, distance double")
