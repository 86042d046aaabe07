"""Near copies among vectors: spherical-cap filters of a random product code, joined and verified."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_join, materialize
from .components import components
from .vectors import BLOCK_VALUES, lengths, matrix, plain, units


@dataclass(frozen=True)
class Caps:
    """cosine: the least one of a link. recall: share of pairs at exactly that cosine that are to meet in a filter (nearer pairs meet more often).
    codes: independent product codes; one alone would need far more filters, as some vectors have few good directions in it.
    crowd: unrelated vectors in a filter, on average; with `vectors` it gives the size of a code. sketch: signs of 64 in which two vectors may differ that are
    alone in a filter; at a cosine of 0.95 that is 5 standard deviations above the mean.
    hot: filters of more vectors elect a core. tile: vectors of a filter that are compared at once; what is left of larger filters is dealt into tiles.
    least: known thresholds by width.
    """

    cosine: float = 0.95
    recall: float = 0.98
    codes: int = 4
    crowd: float = 0.25
    sketch: int = 20
    seed: int = 7
    vectors: int = 1
    hot: int = 64
    tile: int = 2048
    least: tuple[tuple[int, float], ...] = ()


@dataclass(frozen=True)
class Code:
    """A rotation, the directions of each block of components, and the score from which a vector is in a filter. A filter is a direction of every block."""

    turn: np.ndarray
    blocks: list[np.ndarray]
    least: float


def _raw_code(width: int, caps: Caps, k: int) -> Code:
    draw = np.random.default_rng([caps.seed, width, k])
    # few components have few directions that differ
    wanted = min(max(4096.0, 8 * caps.vectors / caps.crowd), 4.0 ** min(width, 60))
    parts = min(width, 2 if wanted <= 2**28 else 3)
    directions = math.ceil(wanted ** (1 / parts))
    blocks = []
    for p in range(parts):
        wide = width * (p + 1) // parts - width * p // parts
        block = draw.standard_normal((directions, wide))
        blocks.append(block / np.linalg.norm(block, axis=1)[:, None] / math.sqrt(parts))
    return Code(np.linalg.qr(draw.standard_normal((width, width)))[0], blocks, 0.0)


def decode(code: Code, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, filter, score) of all filters that rows of length one score code.least or more in: no filter is left out.

    A direction of a block is followed only where the best directions of the blocks behind it can still reach the least score.
    """
    turned, at, scores = rows @ code.turn, 0, []
    for block in code.blocks:
        scores.append(turned[:, at : at + block.shape[1]] @ block.T)
        at += block.shape[1]
    most = np.stack([s.max(axis=1, initial=-np.inf) for s in scores])
    later = np.cumsum(most[::-1], axis=0)[::-1]
    row, name, sums = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for k, s in enumerate(scores):
        size, ids = s.shape[1], None
        if k:  # the few directions that can be part of any filter of their row, side by side
            r, c = np.nonzero(s >= (code.least - most.sum(axis=0) + most[k])[:, None])
            many = np.bincount(r, minlength=len(rows))
            at = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
            few, ids = np.full((len(rows), max(1, many.max(initial=0))), -np.inf), np.zeros((len(rows), max(1, many.max(initial=0))), np.int64)
            few[r, at], ids[r, at] = s[r, c], c
            s = few
        need = code.least - sums - (later[k + 1][row] if k + 1 < len(scores) else 0)
        step, found = max(1, BLOCK_VALUES // s.shape[1]), []
        for start in range(0, len(row), step):
            i, j = np.nonzero(s[row[start : start + step]] >= need[start : start + step, None])
            found.append((i + start, j))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        row, name, sums = row[i], name[i] * size + (j if ids is None else ids[row[i], j]), sums[i] + s[row[i], j]
    return row, name, sums


def spread(code: Code, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """decode() for some rows at once: (row, filter)."""
    step = max(1, BLOCK_VALUES // max(b.shape[0] for b in code.blocks))
    for at in range(0, len(rows), step):
        row, name, _ = decode(code, rows[at : at + step])
        yield row + at, name


@lru_cache(maxsize=8)
def least_score(width: int, caps: Caps, pairs: int = 400) -> float:
    """The score from which a vector is in a filter: the largest at which `pairs` seeded random pairs at exactly caps.cosine share a filter of one code
    so often that in all codes together they do as often as asked.

    The rotation is uniform, so any two vectors at that cosine are as likely to meet. It depends on the width and on caps alone.
    """
    known = dict(caps.least)
    if width in known:
        return known[width]
    if width == 1:
        return 0.5
    code, draw = _raw_code(width, caps, 0), np.random.default_rng([caps.seed, width, caps.codes])
    one, off = units(draw.standard_normal((pairs, width))), draw.standard_normal((pairs, width))
    off = units(off - (off * one).sum(axis=1)[:, None] * one)
    two = caps.cosine * one + math.sqrt(1 - caps.cosine**2) * off
    turned, at, best = one @ code.turn, 0, np.zeros(pairs)
    for block in code.blocks:
        best += (turned[:, at : at + block.shape[1]] @ block.T).max(axis=1)
        at += block.shape[1]
    each = 1 - (1 - caps.recall) ** (1 / caps.codes)
    least, filters = float(np.median(best)), math.prod(len(b) for b in code.blocks)
    while least > -1:
        met = [np.concatenate([row * filters + name for row, name in spread(replace(code, least=least), side)]) for side in (one, two)]
        if len(np.unique(np.intersect1d(*met) // filters)) >= each * pairs:
            break
        least -= 0.004
    return least


@lru_cache(maxsize=8)
def codes_for(width: int, caps: Caps) -> tuple[list[Code], np.ndarray]:
    """The codes, and the directions whose signs make a vector's sketch."""
    least = least_score(width, caps)
    return [replace(_raw_code(width, caps, k), least=least) for k in range(caps.codes)], np.random.default_rng([caps.seed, width, 64]).standard_normal((width, 64))


def entries(batches: Iterator[pa.RecordBatch], caps: Caps) -> Iterator[pa.RecordBatch]:
    """uid, filter, sketch of every vector that has a direction. Vectors of another length have filters of their own."""
    for batch in batches:
        uid, size = batch.column("uid").to_numpy(), lengths(batch.column("v"))
        for width in np.unique(size[size > 0]):
            own = np.flatnonzero(size == width)
            rows = units(matrix(batch.column("v").take(pa.array(own)), int(width)))
            fine = np.isfinite(rows).all(axis=1)
            own, rows = own[fine], rows[fine]
            codes, signs = codes_for(int(width), caps)
            sketch = np.packbits(rows @ signs > 0, axis=1).view(np.int64).ravel()
            for k, code in enumerate(codes):
                # codes and lengths are told apart by what is added, wrapped around: should two filters clash, their vectors are compared in vain, no more
                with np.errstate(over="ignore"):
                    name_at = np.int64(k) * np.int64(math.prod(len(b) for b in code.blocks)) + np.int64(width) * np.int64(1 << 44)
                for row, name in spread(code, rows):
                    yield pa.RecordBatch.from_pydict({"uid": pa.array(uid[own[row]], pa.int64()), "filter": pa.array(name + name_at, pa.int64()), "sketch": pa.array(sketch[row], pa.int64())})


def cores(batches: Iterator[pa.RecordBatch], caps: Caps) -> Iterator[pa.RecordBatch]:
    """The table with, in place of the vectors r and c, the core: the first of the two pivots that is within half of the largest angle of a link.

    Two vectors within half the angle of a third are linked for certain.
    """
    sure = math.cos(math.acos(caps.cosine) / 2) + 1e-9
    for batch in batches:
        size, core = lengths(batch.column("v")), np.full(batch.num_rows, -1)
        for vector, pivot in (("c", "cand"), ("r", "root")):
            near = np.flatnonzero((size > 0) & (lengths(batch.column(vector)) == size))
            for width in np.unique(size[near]):
                own = near[size[near] == width]
                a, b = (units(matrix(batch.column(x).take(pa.array(own)), int(width))) for x in ("v", vector))
                fit = own[(a * b).sum(axis=1) >= sure]
                core[fit] = batch.column(pivot).to_numpy(zero_copy_only=False)[fit]
        columns = {c: batch.column(c) for c in ("uid", "n", "v", "filters")}
        yield pa.RecordBatch.from_pydict(columns | {"core": pa.array(core, pa.int64(), mask=core < 0)})


def _first_shared(names: pa.Array, here: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether here[i] is the first filter that rows i and j are both in: a pair that shares several is counted there alone."""
    size = lengths(names)
    padded = np.full((len(size), int(size.max(initial=0))), np.iinfo(np.int64).max)
    padded[np.arange(padded.shape[1])[None, :] < size[:, None]] = names.flatten().to_numpy()
    out, step = np.ones(len(i), bool), max(1, BLOCK_VALUES // max(1, padded.shape[1] ** 2))
    for at in range(0, len(i), step):
        x, y, limit = padded[i[at : at + step]], padded[j[at : at + step]], here[i[at : at + step]]
        out[at : at + step] = ~((x[:, :, None] == y[:, None, :]) & (x < limit[:, None])[:, :, None]).any(axis=(1, 2))
    return out


def _meet_before(flat: np.ndarray, ends: np.ndarray, start: int, end: int, here: int) -> list[np.ndarray]:
    """Which rows of a tile are in which earlier filters, those of two rows or more: 0 and 1, some filters at once. The product of two rows is how many they share."""
    begin = ends[start - 1] if start else 0
    names = flat[begin : ends[end - 1]]
    row = np.repeat(np.arange(end - start), np.diff(np.r_[begin, ends[start:end]]))
    names, row = names[names < here], row[names < here]
    _, column, count = np.unique(names, return_inverse=True, return_counts=True)
    kept = count[column] > 1
    _, column = np.unique(column[kept], return_inverse=True)
    step, out = max(1, 4 * BLOCK_VALUES // (end - start)), []
    for at in range(0, int(column.max(initial=-1)) + 1, step):
        part = (column >= at) & (column < at + step)
        out.append(np.zeros((end - start, min(step, int(column.max()) + 1 - at)), np.float32))
        out[-1][row[kept][part], column[part] - at] = 1
    return out


def _pairs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All i < j within each run of rows; the runs are short."""
    found = []
    for size in np.unique(ends - starts):
        i, j = np.triu_indices(int(size), 1)
        begin = starts[ends - starts == size]
        found.append(((begin[:, None] + i).ravel(), (begin[:, None] + j).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


#: Tiles of at most so many rows are compared together, pair by pair, larger ones each by itself as a product of matrices.
SMALL_TILE = 48


def _linked(table: pa.Table, starts: np.ndarray, caps: Caps) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the linked pairs of rows of some whole tiles; of a tile of two sides, one of each."""
    table = table.combine_chunks()
    vectors, names = (table.column(c).chunk(0) for c in ("v", "filters"))
    size, core, side = lengths(vectors), table.column("core").fill_null(-1).to_numpy(), table.column("side").to_numpy()
    two = table.column("a").to_numpy() != table.column("b").to_numpy()
    rows = units(matrix(vectors, int(size.max())))
    ends = np.r_[starts[1:], len(size)]
    small = ends - starts <= SMALL_TILE
    found = []
    i, j = _pairs(starts[small], ends[small])
    step = max(1, BLOCK_VALUES // rows.shape[1])
    for at in range(0, len(i), step):
        near = np.einsum("ij,ij->i", rows[i[at : at + step]], rows[j[at : at + step]]) >= caps.cosine
        found.append((i[at : at + step][near], j[at : at + step][near]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    fit = (size[i] == size[j]) & ((core[i] < 0) | (core[i] != core[j])) & (~two[i] | (side[i] != side[j]))
    i, j, here = i[fit], j[fit], table.column("filter").to_numpy()
    mine = _first_shared(names, here, i, j)
    found = [(i[mine], j[mine])]
    flat, list_ends = names.flatten().to_numpy(), np.cumsum(lengths(names))
    for start, end in zip(starts[~small], ends[~small], strict=True):
        before = _meet_before(flat, list_ends, start, end, here[start])
        left, right = ((start + np.flatnonzero(side[start:end] == s) for s in (0, 1)) if two[start] else (np.arange(start, end),) * 2)
        step = max(1, BLOCK_VALUES // max(1, len(right)))
        for at in range(0, len(left), step):
            part = left[at : at + step]
            near = rows[part] @ rows[right].T >= caps.cosine
            near &= ((core[part] < 0)[:, None] | (core[part][:, None] != core[right])) & (size[part][:, None] == size[right])
            if near.any():
                for shared in before:
                    near &= shared[part - start] @ shared[right - start].T == 0
            i, j = np.nonzero(near)
            i, j = part[i], right[j]
            found.append((i, j) if two[start] else (i[i < j], j[i < j]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest reachable row of each row, by hanging rows on smaller neighbours: its edges connect what all links connect."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole tiles of a partition that is sorted by filter, a, b, some at once, and where each starts."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([held.column(c).to_numpy() for c in ("filter", "a", "b")], axis=1)
        starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1]
        if len(starts) > 1:
            yield held.slice(0, starts[-1]), starts[:-1]
            held = held.slice(starts[-1])
    if held is not None:
        yield held, np.zeros(1, np.int64)


def verified(batches: Iterator[pa.RecordBatch], caps: Caps) -> Iterator[pa.RecordBatch]:
    """uid, other, links: how many rows a vector links with in a tile, and a vector that connects it to them as their links do."""
    for table, starts in tiles(batches):
        i, j = _linked(table, starts, caps)
        uid, n = table.column("uid").to_numpy(), table.column("n").to_numpy()
        count = np.zeros(len(uid), np.int64)
        np.add.at(count, i, n[j])
        np.add.at(count, j, n[i])
        hit, label = np.flatnonzero(count), _forest(len(uid), i, j)
        yield pa.RecordBatch.from_pydict({"uid": pa.array(uid[hit], pa.int64()), "other": pa.array(uid[label[hit]], pa.int64()), "links": pa.array(count[hit], pa.int64())})


def _tile_links(members: DataFrame, met: DataFrame, caps: Caps) -> DataFrame:
    """uid, other, links of all tiles. In a filter of more than `hot` vectors those of its largest core meet only those outside it."""
    large = met.where(F.col("size") > caps.hot).select("filter")
    spots = checked_join(members.select("core", F.explode("filters").alias("filter")), materialize(large, "large", narrow=True), ["filter"], "inner").groupBy("filter", "core").count()
    inside = F.when(F.col("core").isNotNull(), F.col("count"))
    dealt = spots.groupBy("filter").agg(F.max_by("core", inside).alias("main"), F.sum("count").alias("all"), F.coalesce(F.max(inside), F.lit(0)).alias("in"))
    blocks = [F.ceil(F.col(x) / caps.tile).cast("int").alias(y) for x, y in (("in", "in_blocks"), ("out", "out_blocks"))]
    dealt = materialize(dealt.withColumn("out", F.col("all") - F.col("in")).select("filter", "main", *blocks), "large-filters", narrow=True)
    placed = checked_join(members.withColumn("filter", F.explode("filters")), dealt, ["filter"], "left")
    placed = placed.withColumn("inner", F.coalesce(F.col("core") == F.col("main"), F.lit(False)))
    own = F.pmod(F.xxhash64("uid", F.lit(caps.seed)), F.greatest(F.when(F.col("inner"), F.col("in_blocks")).otherwise(F.col("out_blocks")), F.lit(1)).cast("long"))
    place = "named_struct('a', {}, 'b', {}, 'side', {})"
    across = f"transform(sequence(0L, out_blocks - 1L), b -> {place.format('-1L - own', 'b', '0')})"
    back = f"if(in_blocks = 0, array(), transform(sequence(0L, in_blocks - 1L), x -> {place.format('-1L - x', 'own', '1')}))"
    among = f"transform(sequence(0L, out_blocks - 1L), x -> {place.format('least(own, x)', 'greatest(own, x)', 'if(own <= x, 0, 1)')})"
    where = f"case when main is null and out_blocks is null then array({place.format('0L', '0L', '0')}) when not inner then concat({among}, {back}) when out_blocks > 0 then {across} end"
    dealt_rows = placed.withColumn("own", own).withColumn("at", F.explode(F.expr(where))).select("filter", "at.a", "at.b", "at.side", "uid", "n", "core", "filters", "v")
    keys = ["filter", "a", "b"]
    found = dealt_rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: verified(batches, caps), "uid long, other long, links long")
    return materialize(found, "links")


def near_vectors(rows: DataFrame, caps: Caps = Caps(), vector: str = "embedding") -> DataFrame:
    """One row for each row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept (vec_id = component_id).

    Two rows link when their vectors' cosine, in doubles, is caps.cosine or more and they are in a filter together: links are never wrong, and
    about 1 - caps.recall of the pairs right at the bound are not found, fewer of nearer ones.

    Equal vectors are one from the start, however many there are. The code grows with the number of vectors, so the filters' crowds do not.
    Filters of one vector go before any vector is shuffled. A filter of more than `hot` vectors elects its smallest as pivot; vectors
    within half a link's angle of a pivot form its core, are linked all with each other, and are not compared: a hot group of near copies costs
    its length. What is left of such a filter is compared, in tiles. A pair that shares several filters is counted in the first.

    Rows without vec_id, and vectors that are null, empty, zero or hold null or non-finite elements, link with nothing and are their own component.
    Vectors of different lengths do not link. Rows that share a vec_id are rows of their own. An empty table gives no rows; other columns are not read.
    """
    rows = plain(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v")), "v")
    classes = rows.where("vec_id is not null and v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    caps = replace(caps, vectors=1 << max(0, classes.count() - 1).bit_length())
    # the width of most vectors is looked into here, once; a task looks into others
    usual = [r.width for r in classes.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count")).limit(1).collect() if r.width > 0]
    caps = replace(caps, least=tuple((w, least_score(w, caps)) for w in usual))
    found = materialize(classes.select("uid", "v").mapInArrow(lambda batches: entries(batches, caps), "uid long, filter long, sketch long"), "filters")
    # of two that are alone in a filter, bit_xor() over both has the signs in which they differ
    met = found.groupBy("filter").agg(F.count(F.lit(1)).alias("size"), F.min("uid").alias("pivot"), F.bit_count(F.bit_xor("sketch")).alias("apart"))
    met = materialize(met.where((F.col("size") > 2) | (F.col("size") == 2) & (F.col("apart") <= caps.sketch)).drop("apart"), "met", narrow=True)
    large = F.when(F.col("size") > caps.hot, F.col("pivot"))
    lists = checked_join(found, met, ["filter"], "inner").groupBy("uid").agg(F.sort_array(F.collect_list("filter")).alias("filters"), F.min(large).alias("cand"))
    lists = materialize(lists, "lists")

    # a pivot's own pivot comes first: so the pivots of a hot group's filters agree
    pivots = lists.where("cand is not null").select(F.col("cand").alias("uid")).distinct()
    pivots = materialize(lists.join(pivots, "uid", "left_semi").select(F.col("uid").alias("cand"), F.col("cand").alias("root")).where("root is not null"), "pivots", narrow=True)
    named = materialize(classes.join(pivots.select(F.explode(F.array("cand", "root")).alias("uid")).distinct(), "uid", "left_semi").select("uid", "v"), "pivot-vectors", narrow=True)
    members = checked_join(lists, pivots, ["cand"], "left")
    for vector_, pivot in (("c", "cand"), ("r", "root")):
        members = members.join(named.select(F.col("uid").alias(pivot), F.col("v").alias(vector_)), pivot, "left")
    kind = classes.schema["v"].dataType.simpleString()
    members = members.join(classes.select("uid", "n", "v"), "uid").select("uid", "n", "v", "filters", "cand", "root", "c", "r")
    members = materialize(members.mapInArrow(lambda batches: cores(batches, caps), f"uid long, n long, v {kind}, filters array<long>, core long"), "members")

    links = _tile_links(members, met, caps)
    held = members.where("core is not null")
    sizes = held.groupBy("core").agg(F.sum("n").alias("core_n"))
    counts = links.groupBy("uid").agg(F.sum("links").alias("links"))
    edges = links.select(F.col("uid").alias("a"), F.col("other").alias("b")).unionByName(held.select(F.col("uid").alias("a"), F.col("core").alias("b")))
    reach = components(edges).withColumnRenamed("node", "uid")
    told = classes.join(counts, "uid", "left").join(held.select("uid", "core"), "uid", "left").join(sizes, "core", "left").join(reach, "uid", "left")
    told = materialize(told.select("v", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce(F.col("core_n") - F.col("n"), F.lit(0))).alias("n_links"), "component", F.col("uid")), "told")
    least = told.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    told = told.join(least, "component", "left").select("v", "n_links", F.coalesce("least", "first").alias("least"))
    sound = F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    joined = rows.join(told, "v", "left").withColumn("sound", F.coalesce(sound, F.lit(False)))
    component = F.when(F.col("sound"), F.col("least")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.when(F.col("sound"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
