"""Hard negatives of anchors: unlike rows that score nearly as high as an anchor's best rows of its own label."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import BLOCK_VALUES, matrix, plain, units

#: Scores that a long can't hold count as its ends.
LAST = 2**63 - 1
NONE = -LAST - 1


@dataclass(frozen=True)
class Mining:
    """positives and negatives: how many, first by score; low: percent of the positive's score that a negative has at least.

    scale: components become floor(scale * x). anchor_bytes bounds what a pass broadcasts; parts: into so many
    parts the leading components are cut. Neither changes a result.
    """

    positives: int = 5
    negatives: int = 5
    low: int = 80
    scale: int = 256
    anchor_bytes: int = 16 << 20
    parts: int = 4


@dataclass
class Anchors:
    """The anchors of one pass, as every task gets them. bands: score limits of the anchors' positives, low and high."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    turn: np.ndarray
    cuts: list[int]
    lead: np.ndarray
    rest: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    floors: np.ndarray | None = None


def _remainders(turned: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of what lies behind each cut; the first cut is 0, so the first column is the whole norm."""
    return np.stack([np.sqrt((turned[:, k:] ** 2).sum(axis=1)) for k in cuts], axis=1)


def second_moments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row a task: the sum of the outer products of its rows' directions."""
    total = np.zeros((width, width))
    for batch in batches:
        rows = units(matrix(batch.column("v"), width))
        rows = rows[np.isfinite(rows).all(axis=1)]
        total += rows.T @ rows
    yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId() % 64], pa.int32()), "moments": pa.array([total.tobytes()], pa.binary())})


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """The orthogonal matrix whose columns are the directions of most weight over all rows, first ones first.

    Each task sends one matrix; they are summed in 64 groups, and 64 of them reach the driver.
    """
    sums = rows.select("v").mapInArrow(lambda batches: second_moments(batches, width), "slot int, moments binary")
    merged = sums.groupBy("slot").applyInPandas(lambda part: part.head(1).assign(moments=[sum(map(np.frombuffer, part["moments"])).tobytes()]), "slot int, moments binary").collect()
    total = sum((np.frombuffer(r.moments) for r in merged), np.zeros(width * width))
    return np.linalg.eigh(total.reshape(width, width))[1][:, ::-1].copy()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, pair by pair, exactly: in doubles where they hold every sum, else in Python's integers."""
    if not len(a):
        return np.zeros(0, np.int64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    sums = (sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True))
    return np.array([max(-LAST, min(LAST, s)) for s in sums], np.int64)


def survivors(anchors: Anchors, chosen: np.ndarray, whole: np.ndarray, turned: np.ndarray, rest: np.ndarray, floors: np.ndarray, ceilings: np.ndarray, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs whose score is within [floor, ceiling] of the anchor.

    The products of leading components are summed part by part. The remainder is at most the product of the norms behind the
    cut, and a share of both norms is more than all rounding of rotation and sums; a pair whose largest possible score is below
    the floor, or whose smallest is above the ceiling, is discarded. While more than an eighth of the pairs is left the parts
    are matrix products, then pair by pair. What is left in the end is worked out in integers.
    """
    own, own_rest = anchors.lead[chosen], anchors.rest[chosen]
    slack = 1e-12 * max(own.shape[1], 1) * own_rest[:, 0][:, None] * rest[:, 0][None, :]
    done = np.zeros((len(chosen), len(whole)))
    left = np.ones(done.shape, bool) if allowed is None else allowed
    i = j = None
    for part, (start, end) in enumerate(zip(anchors.cuts, anchors.cuts[1:], strict=False), 1):
        if i is None:
            done += own[:, start:end] @ turned[:, start:end].T
            open_ = own_rest[:, part][:, None] * rest[:, part][None, :] + slack
            left &= ~(done + open_ < floors[:, None]) & ~(done - open_ > ceilings[:, None])
            if 8 * left.sum() <= left.size:
                i, j = np.nonzero(left)
                done, slack = done[i, j], slack[i, j]
        else:
            done += np.einsum("ij,ij->i", own[i, start:end], turned[j, start:end])
            open_ = own_rest[i, part] * rest[j, part] + slack
            stay = ~(done + open_ < floors[i]) & ~(done - open_ > ceilings[i])
            i, j, done, slack = i[stay], j[stay], done[stay], slack[stay]
    if i is None:
        i, j = np.nonzero(left)
    step = max(1, BLOCK_VALUES // max(1, whole.shape[1]))
    scores = np.concatenate([products(anchors.whole[chosen[i[at : at + step]]], whole[j[at : at + step]]) for at in range(0, max(1, len(i)), step)])
    return i, j, scores


def first(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each key, by score descending, then id; sorted by key."""
    order = np.lexsort((ids, -scores, keys))
    sorted_keys = keys[order]
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < n]


class Best:
    """The first n rows of each key that a task has met."""

    def __init__(self, keys: int, n: int, floors: np.ndarray | None):
        self.n, self.keys = n, np.zeros(0, np.int64)
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: the score that a row needs to matter
        self.floor = np.full(keys, -np.inf) if floors is None else floors.astype(np.float64)

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keys, scores, ids = np.r_[self.keys, keys], np.r_[self.scores, scores], np.r_[self.ids, ids]
        kept = first(keys, scores, ids, self.n)
        self.keys, self.scores, self.ids = keys[kept], scores[kept], ids[kept]
        full, last = np.unique(self.keys[::-1], return_index=True)
        full_ = np.bincount(self.keys, minlength=len(self.floor))[full] == self.n
        np.maximum.at(self.floor, full[full_], self.scores[::-1][last[full_]].astype(np.float64))


def blocks(batches: Iterator[pa.RecordBatch], anchors: Anchors, scale: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, labels, whole numbers, rotated rows and remainders of the rows that take part, some at once."""
    width = anchors.whole.shape[1]
    step = max(1, BLOCK_VALUES // max(width, 1, len(anchors.ids)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            rows = matrix(part.column("v"), width)
            fine = np.isfinite(rows).all(axis=1)
            whole = np.floor(scale * rows[fine])
            turned = whole @ anchors.turn
            yield part.column("vec_id").to_numpy()[fine], part.column("label").to_numpy()[fine], whole, turned, _remainders(turned, anchors.cuts)


def like(batches: Iterator[pa.RecordBatch], shared: Broadcast, mining: Mining) -> Iterator[pa.RecordBatch]:
    """The first rows of each anchor's label in a task: a (the anchor's place), slot (0), vec_id, score."""
    anchors: Anchors = shared.value
    best = Best(len(anchors.ids), mining.positives, anchors.floors)
    top = np.full(len(anchors.ids), np.inf)
    for ids, labels, whole, turned, rest in blocks(batches, anchors, mining.scale):
        for label in np.intersect1d(labels, anchors.labels):
            chosen, rows = np.flatnonzero(anchors.labels == label), np.flatnonzero(labels == label)
            allowed = anchors.ids[chosen][:, None] != ids[rows][None, :]
            i, j, scores = survivors(anchors, chosen, whole[rows], turned[rows], rest[rows], best.floor[chosen], top[chosen], allowed)
            best.add(chosen[i], scores, ids[rows[j]])
    yield _out(best.keys, np.zeros_like(best.keys), best)


def unlike(batches: Iterator[pa.RecordBatch], shared: Broadcast, mining: Mining) -> Iterator[pa.RecordBatch]:
    """The first rows of other labels within each positive's band in a task: a, slot (the positive's place), vec_id, score."""
    anchors: Anchors = shared.value
    many = mining.positives
    best = Best(len(anchors.ids) * many, mining.negatives, anchors.floors)
    best.floor = np.maximum(best.floor, anchors.low.ravel().astype(np.float64))
    high = anchors.high.max(axis=1, initial=NONE)
    everyone = np.arange(len(anchors.ids))
    for ids, labels, whole, turned, rest in blocks(batches, anchors, mining.scale):
        floors = best.floor.reshape(-1, many)
        chosen = everyone[(anchors.low <= anchors.high).any(axis=1)]
        floor = np.where(anchors.low <= anchors.high, floors, np.inf).min(axis=1, initial=np.inf)[chosen]
        allowed = anchors.labels[chosen][:, None] != labels[None, :]
        i, j, scores = survivors(anchors, chosen, whole, turned, rest, floor, high[chosen].astype(np.float64), allowed)
        i = chosen[i]
        for slot in range(many):
            fit = (scores >= anchors.low[i, slot]) & (scores <= anchors.high[i, slot])
            best.add(i[fit] * many + slot, scores[fit], ids[j[fit]])
    yield _out(best.keys // many, best.keys % many, best)


def _out(a: np.ndarray, slot: np.ndarray, best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "slot": pa.array(slot, pa.int64()), "vec_id": pa.array(best.ids, pa.int64()), "score": pa.array(best.scores, pa.int64())})


def _ranked(rows: DataFrame, scan: Callable, anchors: Anchors, mining: Mining, n: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(anchors)
    found = rows.mapInArrow(lambda batches: scan(batches, shared, mining), "a long, slot long, vec_id long, score long")
    by = Window.partitionBy("a", "slot").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def _floors(own: DataFrame, scan: Callable, anchors: Anchors, mining: Mining, n: int, slots: int) -> np.ndarray:
    """The n-th best score among the anchors' own rows, which are rows of the table: no row below it can matter."""
    floors = np.full(len(anchors.ids) * slots, -np.inf)
    for r in _ranked(own, scan, anchors, mining, n).where(F.col("rank") == n).collect():
        floors[r.a * slots + r.slot] = r.score
    return floors


def hard_negatives(rows: DataFrame, is_anchor: Column, mining: Mining = Mining(), vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, and vectors; is_anchor: a condition on them. Scores are inner products of whole numbers. The positives of an anchor are
    the first other rows of its label; the negatives of a positive the first rows of other labels that score at least `low` percent of
    the positive's score, and no more than it. First is the higher score, then the smaller vec_id.

    Every row meets every anchor in blocks: the anchors of a pass are broadcast (anchor_bytes of them, so further anchors take further
    passes over the rows), rows are read where they lie, and nothing but the first rows of each anchor is shuffled. Vectors are rotated onto
    the principal directions of all rows, so that few leading components bound most products.

    Rows without vec_id or label, and with a vector that is null or has a null or non-finite element, take no part. Shorter vectors
    count as filled up with zeros. Rows that share a vec_id are rows of their own, but never each other's positives or negatives; an anchor that stands
    in several rows has its results for each. A positive below 0 has no negatives. An empty table gives no rows. Other columns are not read.
    """
    anchor = is_anchor.alias("is_anchor")
    rows = plain(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).alias("v"), anchor).where("vec_id is not null and label is not null and v is not null"), "v")
    width, n_anchors = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if("is_anchor")).first()
    turn = rotation(rows, width)
    # a cut stands where it starts; the last one is the width
    cuts = sorted({width * k // mining.parts for k in range(mining.parts)} | {width})
    passes = max(1, -(-n_anchors * 16 * max(1, width) // mining.anchor_bytes))
    own = rows.where("is_anchor")
    if passes > 1:  # dealt in turn, so that no pass has many more than its share, whatever ids repeat
        own = materialize(own.repartition(passes).withColumn("pass_", F.spark_partition_id()), "anchors")
    results = [_mined(rows, own if passes == 1 else own.where(F.col("pass_") == k), turn, cuts, mining) for k in range(passes)]
    if passes > 1:
        results = [materialize(r, "negatives", narrow=True) for r in results]
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _mined(rows: DataFrame, own: DataFrame, turn: np.ndarray, cuts: list[int], mining: Mining) -> DataFrame:
    """hard_negatives() of the anchors own, which the driver and each task hold."""
    rows, own = rows.select("vec_id", "label", "v"), own.select("vec_id", "label", "v")
    got = own.toArrow().combine_chunks()
    vectors = matrix(pa.concat_arrays(got.column("v").chunks) if got.num_rows else pa.array([], got.schema.field("v").type), turn.shape[0])
    fine = np.isfinite(vectors).all(axis=1)
    whole = np.floor(mining.scale * vectors[fine])
    lead = whole @ turn
    ids, labels = (got.column(c).to_numpy()[fine] for c in ("vec_id", "label"))
    anchors = Anchors(ids, labels, whole, turn, cuts, lead, _remainders(lead, cuts))

    many = mining.positives
    anchors.floors = _floors(own, like, anchors, mining, many, 1)
    positives, scores = np.zeros((len(ids), many), np.int64), np.zeros((len(ids), many), np.int64)
    low, high = np.full((len(ids), many), LAST), np.full((len(ids), many), NONE)
    for r in _ranked(rows, like, anchors, mining, many).collect():
        at = r.a, r.rank - 1
        positives[at], scores[at] = r.vec_id, r.score
        low[at], high[at] = -(-mining.low * r.score // 100), r.score
    anchors.low, anchors.high, anchors.floors = low, high, None
    anchors.floors = _floors(own, unlike, anchors, mining, mining.negatives, many)
    found = _ranked(rows, unlike, anchors, mining, mining.negatives)
    named = rows.sparkSession.createDataFrame(
        pa.table({"a": np.repeat(np.arange(len(ids)), many), "slot": np.tile(np.arange(many), len(ids)), "anchor_id": np.repeat(ids, many), "positive_id": positives.ravel(), "positive_score": scores.ravel()})
    )
    return found.join(F.broadcast(named), ["a", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
