"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's segmentations are the paths of its lattice of vocabulary pieces, with probability
in proportion to the product of their pieces'. Perturbing every path's log-probability
with Gumbel noise and taking the k largest gives k distinct samples. Nobody lists the
paths: the largest value of a whole subtree is a Gumbel variable of the subtree's mass, so
a best-first search over prefixes pops subtrees in the order of their exact maxima (A*
whose bound is the value itself). Going down, the branch that holds a subtree's maximum
is drawn by its share; what the other branches hold together is a Gumbel variable of
their mass, cut off at that maximum.

Pieces never hold a space after another character, nor a newline, so a text's lattice is
a chain of units (spaces and what follows them, or a newline and what follows it). Masses are computed once per distinct unit of a
batch, over arrays of all lattice nodes. All draws are hashes of row key, sample, unit
and step: results depend neither on batches nor on partitions.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE = "▁"
_UNIT = re.compile(r" ( *[^ ]*)(?= |\Z)")
_LINE = re.compile(r"(?=\n)")
_B = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(key: np.ndarray, step: np.ndarray | int) -> np.ndarray:
    """In (0, 1), by hash of key and step."""
    h = _mixed(key + np.asarray(step, np.uint64) * np.uint64(0xD1342543DE82EF95))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def row_key(row: object, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{row}".encode(), digest_size=8).digest(), "little")


@dataclass
class Vocabulary:
    """Pieces and a hash table over all of their prefixes. Piece scores of merge rank r are those of a Zipf prior, -ln(r + 2.7)."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    byte_score: float
    longest: int
    slots: np.ndarray
    piece_of: np.ndarray
    shift: int
    small: np.ndarray  # code point -> number of a frequent character of the vocabulary, 0 for others
    pairs: np.ndarray  # for two such numbers the result of find()
    single: np.ndarray  # code point -> the result of find()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)])
        is_byte = np.array([model.is_byte(i) for i in range(n)])
        rank = np.array([-model.get_score(i) for i in range(n)])
        usable = [i for i in range(n) if not (special[i] or is_byte[i])]
        if any("\n" in pieces[i] or SPACE in pieces[i].lstrip(SPACE) for i in usable):
            raise ValueError("a piece holds a newline, or a space after another character")
        scores = np.full(n, -np.inf)
        scores[usable] = -np.log(np.maximum(rank[usable], 0) + 2.7)
        byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        known: dict[int, int] = {}
        for i in usable:
            h = 0
            for c in pieces[i]:
                h = (h * int(_B) + ord(c)) & (2**64 - 1)
                known.setdefault(h, -1)
            known[h] = i
        bits = int(np.ceil(np.log2(len(known) * 4)))
        size = 1 << bits
        slots, piece_of = np.zeros(size + 64, np.uint64), np.full(size + 64, -2, np.int32)
        keys = np.fromiter(known, np.uint64, len(known))
        places = (keys * _SPREAD >> np.uint64(64 - bits)).astype(np.int64)
        for key, place, piece in zip(keys, places.tolist(), known.values(), strict=True):
            at = place
            while piece_of[at] != -2:
                at += 1
            slots[at], piece_of[at] = key, piece
        v = cls(pieces, scores, byte_ids, float(scores[usable].min()) - 1.0, max(len(pieces[i]) for i in usable), slots, piece_of, 64 - bits, np.zeros(1 << 16, np.uint8), np.empty(0, np.int32), np.empty(0, np.int32))
        often = Counter(c for i in usable for c in pieces[i] if ord(c) < 1 << 16)
        frequent = np.array(sorted(ord(c) for c, _ in often.most_common(255)), np.uint64)
        v.small[frequent.astype(np.int64)] = np.arange(1, len(frequent) + 1)
        v.pairs = np.full((256, 256), -2, np.int32)
        v.single = v.find(np.arange(1 << 16, dtype=np.uint64))
        both = (frequent[:, None] * _B + frequent[None, :]).ravel()
        v.pairs[1 : len(frequent) + 1, 1 : len(frequent) + 1] = v.find(both).reshape(len(frequent), -1)
        return v

    def find_single(self, h: np.ndarray) -> np.ndarray:
        out = self.single[np.minimum(h, 65535)]
        rare = np.flatnonzero(h > 65535)
        out[rare] = self.find(h[rare])
        return out

    def find_pairs(self, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """find() for strings of two characters, by a table where both are frequent."""
        i, j = (self.small[np.minimum(x, 65535)] for x in (a, b))
        out = self.pairs[i, j]
        rare = np.flatnonzero((i == 0) | (j == 0))
        out[rare] = self.find(h[rare])
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """For hashes of strings: the piece, -1 for a mere prefix of pieces, -2 for neither."""
        at = (h * _SPREAD >> np.uint64(self.shift)).astype(np.int64)
        out = self.piece_of[at]
        todo = np.flatnonzero((self.slots[at] != h) & (out != -2))
        while len(todo):
            at[todo] += 1
            place, own = at[todo], h[todo]
            out[todo] = self.piece_of[place]
            todo = todo[(self.slots[place] != own) & (out[todo] != -2)]
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of piece ids, the first space dropped."""
        table = self.__dict__.get("_bytes")
        if table is None:
            plain = [p.replace(SPACE, " ").encode() for p in self.pieces]
            for b, i in enumerate(self.byte_ids):
                plain[i] = bytes([b])
            table = self.__dict__["_bytes"] = np.array([*plain, None], object)[:-1]
        return b"".join(table[ids].tolist())[1:]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, np.int64)).decode("utf-8", errors="replace")


class Lattice:
    """Lattices of distinct units: nodes are places between characters, edges pieces; first[node]:first[node + 1] are its edges, likeliest first."""

    def __init__(self, units: list[str], vocabulary: Vocabulary, sharpness: float):
        v = vocabulary
        # every unit gets a space mark before it; units that begin with a newline lose it again. A space mark in
        # the text itself has no piece, so that it is told from a space; a lone surrogate is in no text
        chars = np.frombuffer((SPACE + SPACE.join(units)).encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, units), np.int64, len(units)) + 1
        ends = np.cumsum(lengths)
        begins = ends - lengths
        mark = chars == ord(SPACE)
        mark[begins] = False
        chars[mark] = 0xDC00
        chars[chars == 32] = ord(SPACE)
        lines = np.flatnonzero((lengths > 1) & (chars[np.minimum(begins + 1, len(chars) - 1)] == 10))
        if len(lines):
            chars = np.delete(chars, begins[lines])
            lengths[lines] -= 1
            ends = np.cumsum(lengths)
        left = (np.repeat(ends, lengths) - np.arange(len(chars))).astype(np.int32)  # characters from here to the unit's end
        # a unit's nodes are its characters' places, and one node for all units' ends
        self.start = ends - lengths
        self.end = len(chars)
        alive, h = np.arange(len(chars)), chars
        sources, targets, pieces = [], [], []
        covered = np.zeros(len(chars), bool)
        for size in range(1, v.longest + 1):
            if not len(alive):
                break
            found = v.find_single(h) if size == 1 else v.find_pairs(h, chars[alive], chars[alive + 1]) if size == 2 else v.find(h)
            is_piece = found >= 0
            at, room = alive[is_piece], left[alive]
            sources.append(at)
            targets.append(np.where(room[is_piece] == size, self.end, at + size))
            pieces.append(found[is_piece])
            if size == 1:
                covered[at] = True
            on = (found > -2) & (room > size)
            alive = alive[on]
            h = h[on] * _B + chars[alive + size]
        bare = np.flatnonzero(~covered)  # characters without a piece become bytes: piece -1 - code point
        sources.append(bare)
        targets.append(np.where(left[bare] == 1, self.end, bare + 1))
        points = chars[bare].astype(np.int64)
        pieces.append(-1 - np.where(points == 0xDC00, ord(SPACE), points))
        # edges by node, longer ones first, as they are likelier: each kind has one edge a node at most, so places are counted, not sorted
        degree = np.zeros(len(chars), np.int64)
        for at in sources:
            degree[at] += 1
        self.first = np.r_[0, np.cumsum(degree)]
        filled = self.first[:-1].copy()
        source = np.repeat(np.arange(len(chars), dtype=np.int32), degree)
        target, piece = (np.empty(len(source), np.int32) for _ in range(2))
        for at, to, what in zip(reversed(sources), reversed(targets), reversed(pieces), strict=True):
            place = filled[at]
            target[place], piece[place] = to, what
            filled[at] += 1
        score = np.empty(len(piece))
        known = piece >= 0
        score[known] = v.scores[piece[known]]
        points = -1 - piece[~known]
        score[~known] = v.byte_score * (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        score *= sharpness
        # masses from the units' ends backwards
        nodes = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        starts = np.r_[0, np.cumsum(degree[nodes])]
        order = np.repeat(self.first[nodes] - starts[:-1], degree[nodes]) + np.arange(len(source))
        beta = np.zeros(len(chars) + 1)
        to_, gain = target[order], score[order]
        by_step = left[nodes]
        inner = np.flatnonzero(np.r_[True, by_step[1:] != by_step[:-1], True])
        cuts = starts[inner]
        weight = np.empty(len(score))
        for (a, b), (i, j) in zip(zip(cuts[:-1], cuts[1:], strict=True), zip(inner[:-1], inner[1:], strict=True), strict=True):
            own, at = gain[a:b] + beta[to_[a:b]], starts[i:j] - a
            top = np.maximum.reduceat(own, at)
            sizes = np.diff(at, append=b - a)
            total = np.log(np.add.reduceat(np.exp(own - np.repeat(top, sizes)), at)) + top
            beta[nodes[i:j]] = total
            weight[a:b] = own - np.repeat(total, sizes)
        self.source, self.target, self.piece, self.score = source, target, piece, score
        self.share = np.empty(len(score))
        self.share[order] = weight
        total = np.r_[0.0, np.cumsum(np.exp(self.share))]
        self.upto = total[1:] - np.repeat(total[self.first[:-1]], degree)
        self.upto[self.first[1:] - 1] = 2.0  # rounding never leads past a node's edges

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws a path from each node to its unit's end: (index into nodes, edge) in order."""
        live = np.flatnonzero(nodes != self.end)
        at, own = nodes[live], keys[live]
        whose, edges = [], []
        step = 0
        while len(live):
            u = uniform(own, step)
            e = self.first[at]
            more = np.flatnonzero(self.upto[e] <= u)
            while len(more):
                e[more] += 1
                more = more[self.upto[e[more]] <= u[more]]
            whose.append(live)
            edges.append(e)
            at = self.target[e]
            on = at != self.end
            live, at, own = live[on], at[on], own[on]
            step += 1
        if not whose:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        whose, edges = np.concatenate(whose), np.concatenate(edges)
        order = np.argsort(whose, kind="stable")
        return whose[order], edges[order]


def split(text: str) -> list[str]:
    """The units of a text, which is taken with a space before it. Those that begin with a newline are as they are, all others lack their first space."""
    if not text:
        return []
    if "  " in text or text.startswith(" ") or text.endswith(" "):
        return [u for part in _UNIT.findall(" " + text) for u in _LINE.split(part)]
    return text.replace("\n", " \n").split(" ")


@dataclass
class _Path:
    edges: np.ndarray
    unit_of: np.ndarray
    before: np.ndarray  # log-probability of what stands before each step
    rest: np.ndarray  # perturbed maximum of the other branches at each step; -inf from before where this path left another
    value: float
    log_prob: float


def _alternatives(lattice: Lattice, edges: np.ndarray, before: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Perturbed maxima of the branches not taken, cut off at `top`."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        mass = before + np.log(-np.expm1(np.minimum(lattice.share[edges], 0)))
        value = mass - np.log(np.exp(np.minimum(mass - top, 700)) - np.log(u))
    return np.where(np.isneginf(mass), -np.inf, value)


#: Log-probability of a prefix from which on branches are worked out only where they could matter.
FAR = 60.0


def encode_batch(keys: list[int], texts: list[str], vocabulary: Vocabulary, k: int, sharpness: float) -> list[tuple[float, list[tuple[float, float, np.ndarray]]]]:
    """For each text: the threshold (the next perturbed value, -inf if there is none) and up to k samples (value, log-probability, pieces), best first."""
    table: defaultdict[str, int] = defaultdict(count().__next__)
    units = [split(t) for t in texts]
    counts = np.fromiter(map(len, units), np.int64, len(units))
    flat = np.fromiter(map(table.__getitem__, chain.from_iterable(units)), np.int64, int(counts.sum()))
    keys_ = np.array(keys, np.uint64)
    top = -np.log(-np.log(uniform(keys_, 1)))
    if not len(table):
        return [(-np.inf, [(float(g), 0.0, np.empty(0, np.int64))]) for g in top]
    lattice = Lattice(list(table), vocabulary, sharpness)
    begin = np.cumsum(counts) - counts
    paths: list[list[_Path]] = [[] for _ in texts]
    removed: list[dict[tuple[int, int], list[int]]] = [{} for _ in texts]

    def grow(docs: np.ndarray, nodes: np.ndarray, doc_of: np.ndarray, unit_of: np.ndarray, prefixes: list, value: np.ndarray, sample: int) -> None:
        """Draws the rest of a path for each of docs; nodes, with doc and unit, are where its units begin."""
        stream = _mixed(keys_[docs] + np.uint64(sample * 0xA0761D6478BD642F % 2**64))
        whose, edges = lattice.walk(nodes, _mixed(stream[doc_of] + unit_of.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)))
        d, w = doc_of[whose], unit_of[whose]
        cuts = np.searchsorted(d, np.arange(len(docs) + 1))
        share = lattice.share[edges]
        base = np.array([p.log_prob if p is not None else 0.0 for p in prefixes])
        total = np.cumsum(share)
        before = total - share
        if len(before):
            offset = before[np.minimum(cuts[:-1], len(before) - 1)]
            before = before - offset[d] + base[d]
        # a stream of its own for the branches not taken
        def branches(at: np.ndarray) -> np.ndarray:
            own = d[at]
            return _alternatives(lattice, edges[at], before[at], value[own], uniform(stream[own] ^ np.uint64(0x5555555555555555), at - cuts[own]))

        # a draw from 53 bits adds under 38 to a branch's mass, so branches far below the k + 1 best are left out
        rest = np.full(len(edges), -np.inf)
        near = np.flatnonzero(before > -FAR)
        rest[near] = branches(near)
        low = np.full(len(docs), np.inf)
        some = np.flatnonzero(np.diff(cuts))
        if len(some):
            low[some] = np.minimum.reduceat(before, cuts[some])
        for j in np.flatnonzero(low <= -FAR):
            own = rest[cuts[j] : cuts[j + 1]]
            if len(own) <= k or np.partition(own, -k - 1)[-k - 1] < 38 - FAR:
                rest[cuts[j] : cuts[j + 1]] = branches(np.arange(cuts[j], cuts[j + 1]))
        for j, doc in enumerate(docs.tolist()):
            a, b = cuts[j], cuts[j + 1]
            p, own = prefixes[j], share[a:b].sum()
            if p is None:
                paths[doc].append(_Path(edges[a:b], w[a:b], before[a:b], rest[a:b], float(value[j]), float(own)))
            else:
                whole = [np.concatenate(x) for x in ((p.edges, edges[a:b]), (p.unit_of, w[a:b]), (p.before, before[a:b]), (p.rest, rest[a:b]))]
                paths[doc].append(_Path(*whole, float(value[j]), float(base[j] + own)))

    everyone = np.arange(len(texts))
    doc_of = np.repeat(everyone, counts)
    grow(everyone, lattice.start[flat], doc_of, np.arange(len(flat)) - begin[doc_of], [None] * len(texts), top, 0)
    for sample in range(1, k):
        docs, nodes, owners, numbers, prefixes, values = [], [], [], [], [], []
        for doc in everyone.tolist():
            best = max(((float(p.rest.max()), i, int(p.rest.argmax())) for i, p in enumerate(paths[doc]) if len(p.rest)), default=(-np.inf, 0, 0))
            if best[0] == -np.inf:
                continue
            value, i, s = best
            p = paths[doc][i]
            gone = removed[doc].setdefault((i, s), [int(p.edges[s])])
            node = lattice.source[p.edges[s]]
            edges = np.array([e for e in range(lattice.first[node], lattice.first[node + 1]) if e not in gone])
            share = np.exp(lattice.share[edges])
            draw = uniform(np.array([keys_[doc]]), np.array([1_000_003 * sample + 7]))[0] * share.sum()
            pick = int(np.minimum(np.searchsorted(np.cumsum(share), draw, side="right"), len(edges) - 1))
            gone.append(int(edges[pick]))
            # what is left at this place of the path it was popped from
            left = float(np.delete(share, pick).sum())
            if len(edges) > 1 and left > 0:
                mass = p.before[s] + np.log(left)
                u = uniform(np.array([keys_[doc]]), np.array([1_000_003 * sample + 8]))[0]
                p.rest[s] = mass - np.log(np.exp(min(mass - value, 700)) - np.log(u))
            else:
                p.rest[s] = -np.inf
            j = len(docs)
            unit = int(p.unit_of[s])
            docs.append(doc)
            values.append(value)
            e = edges[pick]
            prefixes.append(_Path(np.r_[p.edges[:s], e], np.r_[p.unit_of[:s], unit], np.r_[p.before[:s], p.before[s]], np.full(s + 1, -np.inf), value, float(p.before[s] + lattice.share[e])))
            later = flat[begin[doc] + unit + 1 : begin[doc] + counts[doc]]
            nodes.append(np.r_[lattice.target[e], lattice.start[later]])
            owners.append(np.full(len(later) + 1, j))
            numbers.append(np.arange(unit, counts[doc]))
        if not docs:
            break
        grow(np.array(docs), np.concatenate(nodes), np.concatenate(owners), np.concatenate(numbers), prefixes, np.array(values), sample)
    out = []
    for doc in everyone.tolist():
        threshold = max((float(p.rest.max()) for p in paths[doc] if len(p.rest)), default=-np.inf)
        out.append((threshold, [(p.value, p.log_prob, lattice.piece[p.edges]) for p in paths[doc]]))
    return out


def ids_of(pieces: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Piece ids; a code point without a piece becomes its bytes."""
    if not (pieces < 0).any():
        return pieces.astype("<i4")
    if pieces.min() >= -128:
        return np.where(pieces < 0, vocabulary.byte_ids[np.maximum(-1 - pieces, 0) % 256], pieces).astype("<i4")
    out: list[int] = []
    for p in pieces.tolist():
        out += [p] if p >= 0 else vocabulary.byte_ids[list(chr(-1 - p).encode())].tolist()
    return np.array(out, "<i4")


def log_inclusion(log_prob: float, threshold: float) -> float:
    """ln(1 - exp(-exp(log_prob - threshold))), also where the chance itself is too small for a float."""
    gap = log_prob - threshold
    if gap < -30:
        return gap
    return math.log(-math.expm1(-math.exp(min(gap, 30.0))))


#: Texts go through together until they hold so many characters.
GROUP_CHARS = 600_000


def sample_encode(docs: DataFrame, model_path: str, k: int = 2, sharpness: float = 1.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, group_chars: int = GROUP_CHARS) -> DataFrame:
    """For each row of docs its best k segmentations in Gumbel order, one row each.

    doc_id, sample (from 1), n_pieces, log_prob, perturbed, log_inclusion (of 1 - exp(-exp(log_prob - threshold)),
    the chance of being among the k given the next perturbed value), round_trip (whether decoding
    gives back the text), and the piece ids, or with `digest` the sha256 of their 32-bit little-endian bytes.

    Null and empty texts have the empty segmentation, alone. Texts with fewer than k segmentations give
    all of them, with log_inclusion 0. Rows of equal id and text get equal samples; a null id is a key
    like another. An empty table gives an empty result. Other columns are ignored. The vocabulary is read on the driver and broadcast.
    group_chars: texts go through together up to so many characters; a task's memory follows it, results do not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    last = "ids_sha256 string" if digest else "ids array<int>"
    schema = f"doc_id long, sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, round_trip boolean, {last}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        for rows in batches:
            ids, texts = [None if pd.isna(i) else int(i) for i in rows["doc_id"]], rows["text"].tolist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= group_chars):
                    size += len(texts[end])
                    end += 1
                found = encode_batch([row_key(i, seed) for i in ids[at:end]], texts[at:end], v, k, sharpness)
                out = []
                for doc, text, (threshold, samples) in zip(ids[at:end], texts[at:end], found, strict=True):
                    data = text.encode()
                    for n, (value, log_prob, pieces) in enumerate(samples):
                        own = ids_of(pieces, v)
                        chance = log_inclusion(log_prob, threshold)
                        same = v.decode_bytes(own) == data
                        out.append((doc, n + 1, len(own), log_prob, value, chance, same, hashlib.sha256(own.tobytes()).hexdigest() if digest else own))
                yield pd.DataFrame(out, columns=["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "round_trip", last.split()[0]]).astype({"doc_id": "Int64"})
                at = end

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return small_batches(texts).mapInPandas(run, schema)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """rows with a column text, decoded from piece ids; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else shared.value.decode([int(i) for i in x]))

    return rows.withColumn("text", text(ids_col))
