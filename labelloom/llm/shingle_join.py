"""Jaccard join of word shingles over R-trees of count vectors.

A document's shingles are hashed into groups; its group counts are a point. Two
documents share at most the sum of the smaller counts, coordinate by coordinate, and two
nodes of an R-tree at most that of their upper corners: pairs and subtrees that cannot
reach the similarity are left out, the rest is verified on whole shingle sets.

One tree over all documents would be one task and prunes little, as counts of unlike
texts are alike. So the index is a forest: a tree for each shingle among the rarest of
several documents. Of two similar sets, each one's n - ceil(s n) + 1 rarest shingles
(in any fixed order) have one in common, so every link is within some tree. Rarity is
counted over all documents in a histogram of hashes of fixed size.

Groups of near copies would still give a pair for each two of them. Links are sought in
rounds instead: the point nearest to a tree's mean against all others, then the best
partner of what is left, and last all pairs of different components that the bound leaves.
What is skipped is connected already, so no component misses a link. Trees with the
same documents are one tree: near copies share most of their rarest shingles.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_join, gathered, materialize, small_batches
from .components import components


@dataclass(frozen=True)
class Join:
    """percent: least Jaccard similarity. buckets: size of the histogram, a power of two. tile: points of a tree; larger trees are cut into pairs of tiles.

    group_size: shingles to a group, about; unlike texts differ in counts by more than
    similar ones may if groups are small, whatever the size of the text. In the last round,
    when a pair that the bound leaves costs most, counts modulo two of ODD times as many
    groups sharpen it: sets differ by at least one in every group whose counts differ so.
    """

    width: int = 5
    percent: int = 80
    group_size: float = 6
    buckets: int = 1 << 20
    tile: int = 8192
    leaf: int = 16


_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd, so it has an inverse modulo 2^64: a word's polynomial is a difference of two sums from the text's start, moved back to its own.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, up to the longest text so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, k, np.uint64)], dtype=np.uint64) for k in (_BASE, _INVERSE))
        return cls.up[:n], cls.down[:n]


#: Bytes whose words are hashed at once: each takes some tens of bytes meanwhile.
PIECE = 1 << 18


def _next_space(letters: np.ndarray, at: int) -> int:
    """The first white space from `at` on, or the end."""
    while at < len(letters):
        found = _SPACE[letters[at : at + 4096]]
        if found.any():
            return at + int(found.argmax())
        at += 4096
    return len(letters)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    letters = np.frombuffer(data, np.uint8)
    if len(letters) <= PIECE:
        return _word_hashes(letters)
    out, at = [], 0
    while at < len(letters):
        end = _next_space(letters, at + PIECE)
        out.append(_word_hashes(letters[at:end]))
        at = end
    return np.concatenate(out)


def _word_hashes(letters: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[letters], [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _Powers.upto(len(letters) + 1)
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; bytes.lower knows ASCII only, as asked."""
    h = word_hashes(text.encode().lower())
    if not len(h):
        return np.empty(0, np.uint64)
    n = max(1, len(h) - width + 1)
    own = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        own = own * np.uint64(_BASE) + h[i : i + n]
    own = np.sort(_mixed(own + np.uint64(min(len(h), width))))
    return own[np.concatenate(([True], own[1:] != own[:-1]))]


def signature(own: np.ndarray) -> tuple[int, int]:
    """Of the set, independent of its text: equal for equal sets."""
    other = _mixed(own ^ np.uint64(0x5851F42D4C957F2D))
    return int(own.sum(dtype=np.uint64).view(np.int64)), int(other.sum(dtype=np.uint64).view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def index_length(n: int, percent: int) -> int:
    """Of a set and one that is no smaller, some shingle is among the first so many of the one and the prefix of the other."""
    return n - (2 * percent * n + 99 + percent) // (100 + percent) + 1


CHUNK = 1 << 14


def _surveying(join: Join):
    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(join.buckets, np.uint32)
        for rows in batches:
            out, sets = [], []
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                own = shingles(text, join.width)
                out.append((doc, len(own), *(signature(own) if len(own) else (0, 0))))
                sets.append(own & np.uint64(join.buckets - 1))
            if sets:
                counts += np.bincount(np.concatenate(sets).astype(np.int64), minlength=join.buckets).astype(np.uint32)
            frame = pd.DataFrame(out, columns=["doc_id", "n", "s1", "s2"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"), chunk=-1, counts=None)
        at = [i for i in range(0, join.buckets, CHUNK) if counts[i : i + CHUNK].any()]
        said = [zlib.compress(counts[i : i + CHUNK].astype(np.int64).tobytes(), 1) for i in at]
        yield pd.DataFrame({"doc_id": pd.array([None] * len(at), "Int64"), "n": 0, "s1": 0, "s2": 0, "chunk": [i // CHUNK for i in at], "counts": said})

    return survey


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.int64)
    for c in rows["counts"]:
        part = np.frombuffer(zlib.decompress(c), np.int64)
        total[: len(part)] += part
    return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def frequencies(told: DataFrame, join: Join) -> np.ndarray:
    """The histogram, summed in two steps so that no task holds more than some hundred parts of a chunk; its size is fixed."""
    parts = told.where("chunk >= 0").select("chunk", F.col("counts"), F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt"))
    some = parts.groupBy("chunk", "salt").applyInPandas(lambda rows: _summed(rows), "chunk int, counts binary")
    out = np.zeros(max(CHUNK, join.buckets), np.int64)
    for r in some.groupBy("chunk").applyInPandas(lambda rows: _summed(rows), "chunk int, counts binary").collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return np.minimum(out, (1 << 24) - 1).astype(np.uint32)


def _prefixing(join: Join, shared: Broadcast):
    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequency = shared.value
        told: dict[tuple, int] = {}  # of the sets of this task the smallest document that was told; as many as its rows
        for rows in batches:
            least: dict[tuple, tuple] = {}
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                own = shingles(text, join.width)
                if not len(own):
                    continue
                key = (len(own), *signature(own))
                if told.get(key, doc + 1) <= doc:
                    continue
                told[key] = doc
                if key in least:
                    least[key] = (doc, *least[key][1:])
                    continue
                rank = frequency[(own & np.uint64(join.buckets - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(40) | own >> np.uint64(24)
                size = prefix_length(len(own), join.percent)
                places = np.argpartition(rank, size - 1)[:size]
                first = np.zeros(size, np.int64)
                few = index_length(len(own), join.percent)
                first[np.argpartition(rank[places], few - 1)[:few]] = 1
                # the signature's last bit tells whether the shingle is among the first ones
                least[key] = (doc, own[places].view(np.int64), key[1] & ~1 | first)
            sizes = [len(t) for _, t, _ in least.values()]
            yield pd.DataFrame({
                "token": np.concatenate([t for _, t, _ in least.values()]) if least else np.empty(0, np.int64),
                "sign": np.concatenate([g for *_, g in least.values()]) if least else np.empty(0, np.int64), "node": np.repeat(np.array([d for d, *_ in least.values()], np.int64), sizes),
            })

    return prefixes


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by token, sign, node: the first of each token and sign, if the token has another sign. Holds one row back."""
    held: pd.DataFrame | None = None
    before = False  # whether the row held back has one of its token before it
    for rows in batches:
        if held is not None:
            rows = pd.concat([held, rows], ignore_index=True)
        token, sign = rows["token"].to_numpy(), rows["sign"].to_numpy()
        first = np.r_[True, (token[1:] != token[:-1]) | (sign[1:] != sign[:-1])]
        rows, token = rows[first], token[first]
        if not len(rows):
            continue
        same = token[1:] == token[:-1]
        with_next, with_last = np.r_[same, False], np.r_[before, same]
        yield rows[(with_next | with_last)[:-1].tolist() + [False]]
        held, before = rows.iloc[[-1]], bool(with_last[-1])
    if held is not None and before:
        yield held


def dims(n: int, group_size: float) -> int:
    """Groups of a set of n shingles: the power of two of at least n / group_size, 16 at least."""
    return 1 << max(4, math.ceil(math.log2(max(1, n) / group_size)))


def point(own: np.ndarray, size: int) -> bytes:
    counts = np.bincount((own >> np.uint64(40)).astype(np.int64) & (size - 1), minlength=size)
    if counts.max() > 255:
        raise OverflowError("a group of shingle hashes is far from even")
    return counts.astype(np.uint8).tobytes()


#: Finer groups to a group; their counts modulo two take as many bytes as the counts.
ODD = 8


def odd_groups(own: np.ndarray, size: int) -> bytes:
    counts = np.bincount((own >> np.uint64(40)).astype(np.int64) & (ODD * size - 1), minlength=ODD * size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _members(join: Join):
    """Sets and points. A set whose partners may have half as many groups has a point of so many, too."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 500):
                part = rows.iloc[at : at + 500]
                sets = [shingles(t, join.width) for t in part["text"]]
                points = []
                for own, fine in zip(sets, part["fine"], strict=True):
                    least = -(-len(own) * join.percent // 100)
                    sizes = sorted({dims(k, join.group_size) for k in (len(own), least)})
                    points.append([{"dims": d, "point": point(own, d), "odd": odd_groups(own, d) if fine else None} for d in sizes])
                yield pd.DataFrame({"node": part["doc_id"].astype("int64"), "n": [len(s) for s in sets], "own": [s.view(np.int64) for s in sets], "points": points})

    return members


class CountTree:
    """A packed R-tree: points halved again and again along the coordinate (the size is one, too) in which they vary most, leaves of `leaf` points, nodes of FAN children.

    A node knows its upper corner and its smallest size.
    """

    FAN = 8

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int):
        order = np.arange(len(points))
        places = np.column_stack([points, sizes]).astype(np.float32)
        parts = [(0, len(points))]
        while parts:
            a, b = parts.pop()
            if b - a <= leaf:
                continue
            own = order[a:b]
            order[a:b] = own[np.argsort(places[own, places[own].var(axis=0).argmax()], kind="stable")]
            middle = a + leaf * max(1, (b - a) // leaf // 2)
            parts += [(a, middle), (middle, b)]
        self.points, self.sizes, self.leaf, self.order = points, sizes, leaf, order
        #: From the leaves up to the root: upper corners and smallest sizes.
        self.levels = [self._level(points[order], sizes[order], leaf)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._level(*self.levels[-1], self.FAN))

    @staticmethod
    def _level(corners: np.ndarray, least: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.arange(0, len(corners), fan)
        return np.maximum.reduceat(corners, starts, axis=0), np.minimum.reduceat(least, starts)

    def near(self, rows: np.ndarray, percent: int) -> np.ndarray:
        """Indices of all points of leaves that some of `rows` could be similar to: down from the root, past nodes whose corner rules it out."""
        corner, own = self.points[rows].max(axis=0), self.sizes[rows].min()
        at = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            corners, least = self.levels[depth]
            bound = np.minimum(corners[at], corner).sum(axis=1, dtype=np.int64)
            at = at[reaches(bound, least[at], own, percent)]
            fan, below = (self.FAN, len(self.levels[depth - 1][0])) if depth else (self.leaf, len(self.order))
            at = (at[:, None] * fan + np.arange(fan)).ravel()
            at = at[at < below]
        return self.order[at]


def reaches(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether `shared` common members can make the similarity of sets of sizes a and b."""
    return 100 * shared >= percent * (a + b - shared)


def bounds(points: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima, rows x others."""
    out = np.empty((len(rows), len(others)), np.int64)
    own = points[others]
    for i, row in enumerate(rows):
        out[i] = np.minimum(own, points[row]).sum(axis=1, dtype=np.int64)
    return out


def tree_edges(nodes: np.ndarray, comps: np.ndarray, sizes: np.ndarray, points: np.ndarray, odd: np.ndarray | None, how: str, join: Join) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of one tree that may be similar, of different components: the asking one, the other, the bound's share. how: star, best or all."""
    if len(np.unique(comps)) < 2:
        return []
    if how == "star":
        centre = int(np.abs(points - points.mean(axis=0)).sum(axis=1).argmin())
        shared = np.minimum(points, points[centre]).sum(axis=1, dtype=np.int64)
        ok = reaches(shared, sizes, sizes[centre], join.percent) & (comps != comps[centre])
        return [(nodes[ok], np.full(int(ok.sum()), nodes[centre]), shared[ok] / (sizes[ok] + sizes[centre]))]
    values, counts = np.unique(comps, return_counts=True)
    largest = values[counts.argmax()]
    tree = CountTree(points, sizes, join.leaf)
    asks = np.flatnonzero(comps != largest)
    out = []
    asks = asks[np.argsort(sizes[asks], kind="stable")]
    for at in range(0, len(asks), join.leaf):
        rows = asks[at : at + join.leaf]
        others = tree.near(rows, join.percent)
        if not len(others):
            continue
        shared = bounds(points, rows, others)
        ok = reaches(shared, sizes[rows][:, None], sizes[others][None, :], join.percent) & (comps[rows][:, None] != comps[others][None, :])
        if how == "all":
            i, j = np.nonzero(ok)
            for part in np.array_split(np.arange(len(i)), 1 + len(i) * odd.shape[1] // 20_000_000):
                a, b = rows[i[part]], others[j[part]]
                differ = np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64)
                near = reaches((sizes[a] + sizes[b] - differ) // 2, sizes[a], sizes[b], join.percent)
                out.append((nodes[a[near]], nodes[b[near]], np.full(int(near.sum()), KEEP)))
        else:
            share = np.where(ok, shared / (sizes[rows][:, None] + sizes[others][None, :]), -1)
            best = share.argmax(axis=1)
            some = share[np.arange(len(rows)), best] >= 0
            out.append((nodes[rows[some]], nodes[others[best[some]]], share[some, best[some]]))
    return out


TREE = ["token", "ta", "tb"]
KEYS = [*TREE, "dims"]
#: The share of an edge that is verified in any case; of the others each asking node's largest is.
KEEP = 2.0


def _searching(how: str, join: Join):
    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole trees: rows of equal keys come together."""
        held = None
        for rows in batches:
            if held is not None:
                rows = pd.concat([held, rows], ignore_index=True)
            if not len(rows):
                continue
            keys = rows[KEYS].to_numpy()
            last = int((keys == keys[-1]).all(axis=1).argmax())
            if last:
                yield rows.iloc[:last]
            held = rows.iloc[last:]
        if held is not None:
            yield held

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups(batches):
            keys = rows[KEYS].to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            ends = np.r_[starts[1:], len(rows)]
            nodes, comps, sizes, size = (rows[c].to_numpy() for c in ("node", "comp", "n", "dims"))
            counts = np.frombuffer(b"".join(rows["point"]), np.uint8)
            odds = np.frombuffer(b"".join(rows["odd"]), np.uint8) if how == "all" else None
            at = np.cumsum(size) - size
            # trees of two points, most of them, at once
            two = starts[ends - starts == 2]
            two = two[comps[two] != comps[two + 1]]
            found = []
            for d in np.unique(size[two]):
                own = two[size[two] == d]
                shared = np.minimum(counts[at[own][:, None] + np.arange(d)], counts[at[own + 1][:, None] + np.arange(d)]).sum(axis=1, dtype=np.int64)
                ok = reaches(shared, sizes[own], sizes[own + 1], join.percent)
                found.append((nodes[own[ok]], nodes[own[ok] + 1], np.full(int(ok.sum()), KEEP)))
            for a, b in zip(starts, ends, strict=True):
                if b - a > 2:
                    span = slice(at[a], at[b - 1] + size[b - 1])
                    odd = odds[span].reshape(b - a, -1) if odds is not None else None
                    found += tree_edges(nodes[a:b], comps[a:b], sizes[a:b], counts[span].reshape(b - a, -1), odd, how, join)
            if not found:
                continue
            asks, others, share = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pd.DataFrame({"ask": asks, "other": others, "share": share}).drop_duplicates()

    return search


def _links(edges: DataFrame, members: DataFrame, percent: int, n_nodes: int) -> DataFrame:
    """The edges whose sets are similar. Only the sets at their ends are moved."""
    ends = gathered(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends", n_nodes)
    need = checked_join(members.select("node", "n", "own"), ends, ["node"], "left_semi")
    side = lambda c: need.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("own").alias(f"own{c}"))
    both = edges.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("owna", "ownb")).cast("long"))
    return both.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b").distinct()


def shingle_join(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """One row per row of docs: doc_id, n_shingles, component_id.

    Documents without words (null and empty texts among them) have no shingles and are
    alone. Rows that share an id are one document: what links to one of its texts links to
    it. Rows with a null id link to nothing and have a null component. Equal sets are one
    point of the index, however many rows have them. An empty table gives an empty result.
    Other columns are ignored. A group of shingle hashes that holds over 255 of a set's (they
    are about join.group_size) ends the job, as points have a byte for each.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    told = materialize(small_batches(texts).mapInPandas(_surveying(join), "doc_id long, n long, s1 long, s2 long, chunk int, counts binary"), "survey", narrow=True)
    frequency = docs.sparkSession.sparkContext.broadcast(frequencies(told, join))
    sets = told.where("chunk < 0").select("doc_id", "n", "s1", "s2")
    named = texts.where("doc_id is not null")
    rows = named.mapInPandas(_prefixing(join, frequency), "token long, sign long, node long")
    cells = materialize(rows.repartition("token").sortWithinPartitions("token", "sign", "node").mapInPandas(_shared, "token long, sign long, node long").selectExpr("token", "node", "sign & 1 as first"), "shared-shingles")
    frequency.destroy()  # the table is written
    # of trees with the same documents one stays
    h = lambda seed: F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(20,0)"))
    trees = materialize(cells.groupBy("token").agg(h(1).alias("m1"), h(2).alias("m2"), F.count(F.lit(1)).alias("size"), F.max("first").alias("first")).where("first = 1").groupBy("m1", "m2", "size").agg(F.min("token").alias("token")).select("token", "size"), "trees")
    # larger ones than a tile: one for each `tile` rows at most
    tiles = F.ceil(F.col("size") / join.tile).cast("int")
    cells = materialize(checked_join(cells.select("token", "node"), trees.select("token", tiles.alias("tiles"), "size"), ["token"], "inner", narrow=True), "tree-members")
    nodes = materialize(cells.groupBy(F.col("node").alias("doc_id")).agg((F.max("size") > 2).alias("fine")), "nodes")
    # what the rounds write has rows in proportion to the nodes
    n_nodes = nodes.count()
    put = lambda df, label: gathered(df, label, n_nodes)
    schema = "node long, n long, own array<long>, points array<struct<dims:int,point:binary,odd:binary>>"
    members = materialize(checked_join(named, nodes, ["doc_id"], "inner").mapInPandas(_members(join), schema), "members")
    points = members.select("node", "n", F.explode("points").alias("p")).select("node", "n", "p.*")
    repeated = sets.where("doc_id is not null and n > 0")
    classes = materialize(repeated.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node")), "classes")
    placed = materialize(repeated.join(classes, ["n", "s1", "s2"]).select("doc_id", "node").distinct(), "placed")
    links = placed.where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    # ids of equal sets need no component of their own, but an id with several sets joins them
    several = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id")
    links = materialize(links.join(several, links["a"] == several["doc_id"], "left_semi"), "own-links")
    found = components(links, n_nodes)
    how, turn = "star", 0
    while True:
        comps = put(found, "components")
        # a tree beyond a tile is dealt into other tiles each round, so stars of different tiles grow together; pairs of tiles are for what is left
        turn += 1
        t = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("tiles")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)) if how == "all" else F.col("t")
        forest = cells.withColumn("t", t).withColumn("o", other).select("token", "node", "size", F.least("t", "o").alias("ta"), F.greatest("t", "o").alias("tb"))
        labelled = checked_join(forest, comps, ["node"], "left", narrow=True).withColumn("comp", F.coalesce("component", "node")).drop("component")
        several = labelled.where("size > 2")
        largest = F.max_by(F.struct(*TREE), "size").alias("t")
        if how == "star":
            # of its larger trees each node takes part in one
            mine = put(several.groupBy("node").agg(largest).select("node", "t.*"), "own-trees")
            labelled = labelled.where("size = 2").unionByName(checked_join(several, mine, ["node", *TREE], "left_semi", narrow=True))
        else:
            # trees of two are done; of the others those that still hold several components go on
            open_ = put(several.groupBy(*TREE).agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select(*TREE), "open-trees")
            labelled = checked_join(several, open_, TREE, "left_semi", narrow=True)
            if how == "best":
                mine = labelled.groupBy("node").agg(largest).select("t.*").distinct()
                labelled = checked_join(labelled, put(mine, "own-trees"), TREE, "left_semi", narrow=True)
        odd = ["odd"] if how == "all" else []
        placed_points = labelled.drop("size").join(points.select("node", "n", "dims", "point", *odd), "node")
        keyed = placed_points.select(*KEYS, "node", "comp", "n", "point", *odd).repartition(*KEYS).sortWithinPartitions(*KEYS, "n", "node")
        asked = keyed.mapInPandas(_searching(how, join), "ask long, other long, share double").where("ask != other")
        # a node asks in all of its trees; near copies share many, so one answer a node keeps the edges as many as the nodes
        kept = F.when(F.col("share") == KEEP, F.col("other")).alias("kept")
        once = asked.groupBy("ask", kept).agg(F.max(F.struct("share", "other")).alias("best")).select("ask", "best.other")
        edges = put(once.select(F.least("ask", "other").alias("a"), F.greatest("ask", "other").alias("b")).distinct(), f"edges-{how}")
        more = put(_links(edges, members, join.percent, n_nodes), f"links-{how}")
        n_more = more.count()
        if n_more:
            links = links.unionByName(more)
            found = components(links, n_nodes)
        if how == "all":
            break
        # rounds of best partners go on while they find much; the last round is exact whatever they left
        how = "best" if how == "star" or 20 * n_more > edges.count() else "all"
    comps = put(found, "components")
    least = checked_join(classes, comps, ["node"], "left", narrow=True).select("n", "s1", "s2", F.coalesce("component", "node").alias("component_id"))
    alone = F.when(F.col("doc_id").isNotNull() & (F.col("n") == 0), F.col("doc_id"))
    joined = checked_join(sets, materialize(least, "class-components"), ["n", "s1", "s2"], "left", narrow=True)
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(alone, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).alias("component_id"))
