"""Masked pseudo-likelihood of documents under a bidirectional window network, trained here in numpy.

Every token is predicted from the REACH tokens before and after it: each neighbour's place
has an embedding table of its own, their sum goes through tanh into a two-level softmax
(class of the word, word within the class). All words beyond the network's own are known to it by
their first byte; such a token's probability is that of its first byte, times that of its
spelling, from the frequencies of three bytes in a row in all such words. A document's score is the sum of its
tokens' conditional log-probabilities.

Words are counted over all documents. Every place of every document is a training
window (every RATE-th, if a caller asks for it); documents are dealt into shards by a hash. Each round, every
shard trains from the same weights, and the weights are averaged by windows in a tree of groups, so no task
holds more than FAN models.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_id, as_key, materialize, small_batches, whole_text

FLUSH = 200_000
FAN = 64


@dataclass(frozen=True)
class Shape:
    """words: of the vocabulary, the last `buckets` of which are first bytes of all other words; a multiple of per_class."""

    words: int = 1024
    buckets: int = 64
    per_class: int = 32
    size: int = 16
    reach: int = 2
    rate: int = 1
    shard_windows: int = 250_000
    rounds: int = 1
    batch: int = 4096
    step: float = 0.3
    seed: int = 5

    @property
    def classes(self) -> int:
        return self.words // self.per_class

    @property
    def places(self) -> list[int]:
        return [k for k in range(-self.reach, self.reach + 1) if k]


def _counting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()

    def frame() -> pd.DataFrame:
        return pd.DataFrame({"word": pd.Series([w.decode() for w in counts], dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})

    for rows in batches:
        for text in rows["text"]:
            counts.update(text.encode().lower().split())
            if len(counts) > FLUSH:
                yield frame()
                counts.clear()
    yield frame()


class Spelling:
    """Chances of words by their bytes. Bytes are classes: 0 the edge of a word, one for each of the most frequent bytes, the last for all others.

    counts: of classes (two before, one before, own), of every byte, and of the classes of first bytes.
    """

    SMOOTH = 4.0

    def __init__(self, table: np.ndarray, counts: np.ndarray, bytes_: np.ndarray, first: np.ndarray):
        k = len(first)
        self.table, self.first, self.classes = table.astype(np.int64), first, k
        two = counts.sum(axis=0)
        by_one = (two + 0.5) / (two.sum(axis=1, keepdims=True) + 0.5 * k)
        by_two = (counts + self.SMOOTH * by_one[None]) / (counts.sum(axis=2, keepdims=True) + self.SMOOTH)
        self.logs = np.log(by_two).ravel()
        share = (bytes_ + 0.5).astype(float)
        total = np.bincount(table, weights=share, minlength=k)
        self.within = np.log(share / total[table])

    @staticmethod
    def byte_table(bytes_: np.ndarray, classes: int) -> np.ndarray:
        table = np.full(256, classes - 1)
        frequent = np.argsort(-bytes_, kind="stable")[: classes - 2]
        table[frequent[bytes_[frequent] > 0]] = np.arange(1, 1 + int((bytes_[frequent] > 0).sum()))
        return table

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The classes of the words' first bytes, and the log-probabilities of the words, given those."""
        data, sizes = _joined(words)
        ends = np.cumsum(sizes)
        own = self.table[data]
        own[ends - 1] = 0
        before = np.r_[0, own[:-1]]
        logs = self.logs[(np.r_[0, before[:-1]] * self.classes + before) * self.classes + own] + self.within[data]
        firsts = ends - sizes
        logs[firsts] = self.within[data[firsts]]  # their classes are the network's
        logs[ends - 1] -= self.within[0]  # the place after a word is no byte
        return own[firsts], np.add.reduceat(logs, firsts)

    def log(self, word: bytes) -> float:
        return float(self.of([word])[1][0])


def _joined(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, each with a place after it, and how long each is with it."""
    return np.frombuffer(b"\0".join([*data, b""]), np.uint8), np.fromiter(map(len, data), np.int64, len(data)) + 1


def _flat(words: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return _joined([w.encode() for w in words])


def _bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key: a byte, or 256 more for a first byte."""
    total = np.zeros(512, np.int64)
    for rows in batches:
        if len(rows):
            data, sizes = _flat(rows["word"])
            ends = np.cumsum(sizes)
            n = np.repeat(rows["n"].to_numpy(), sizes)
            n[ends - 1] = 0
            total[:256] += np.bincount(data, weights=n, minlength=256).astype(np.int64)
            total[256:] += np.bincount(data[ends - sizes], weights=rows["n"], minlength=256).astype(np.int64)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"key": at, "n": total[at]})


def _triples(table: np.ndarray, classes: int):
    def triples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(classes**3, np.int64)
        for rows in batches:
            if len(rows):
                data, sizes = _flat(rows["word"])
                ends = np.cumsum(sizes)
                of = table[data]
                of[ends - 1] = 0
                n = np.repeat(rows["n"].to_numpy(), sizes)
                n[ends - sizes] = 0  # first bytes are the network's
                before = np.r_[0, of[:-1]]
                total += np.bincount((np.r_[0, before[:-1]] * classes + before) * classes + of, weights=n, minlength=classes**3).astype(np.int64)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"key": at, "n": total[at]})

    return triples


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r in rows.groupBy("key").agg(F.sum("n").alias("n")).collect():
        out[r.key] = r.n
    return out


def spelling(counted: DataFrame, ranked: list[bytes], shape: Shape) -> Spelling:
    """From all words but the ranked ones, each as often as it is there; what comes back has a fixed size."""
    rest = counted.where(~F.col("word").isin([w.decode() for w in ranked])) if ranked else counted
    both = _summed(rest.mapInPandas(_bytes, "key long, n long"), 512)
    table = Spelling.byte_table(both[:256], shape.buckets)
    counts = _summed(rest.mapInPandas(_triples(table, shape.buckets), "key long, n long"), shape.buckets**3)
    return Spelling(table, counts.reshape((shape.buckets,) * 3), both[:256], np.bincount(table, weights=both[256:], minlength=shape.buckets))


class Words(dict):
    """Word -> slot: the most frequent words by rank, others as they come, until a batch has filled up the room for them."""

    def __init__(self, ranked: list[bytes], spelled: Spelling, shape: Shape):
        super().__init__()
        self.ranked, self.spelled, self.shape = ranked, spelled, shape
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.update((w, i) for i, w in enumerate(self.ranked))
        self._fresh: list[bytes] = []
        self._ids, self._logs = np.arange(len(self.ranked), dtype=np.int32), np.zeros(len(self.ranked))

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = len(self)
        self._fresh.append(word)
        return slot

    def coded(self, texts: Iterable[str]) -> list[tuple[np.ndarray, float]]:
        """For each text the network's ids of its words, and the log-probability of the spelling of the others. New words are spelled together."""
        if len(self) > len(self.ranked) + FLUSH:
            self._reset()
        slots = []
        for text in texts:
            words = text.encode().lower().split()
            slots.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
        if self._fresh:
            first, logs = self.spelled.of(self._fresh)
            self._ids = np.r_[self._ids, (self.shape.words - self.shape.buckets + first).astype(np.int32)]
            self._logs = np.r_[self._logs, logs]
            self._fresh = []
        return [(self._ids[s], float(self._logs[s].sum())) for s in slots]

    def ids(self, text: str) -> np.ndarray:
        return self.coded([text])[0][0]


class Network:
    """params: place tables (places x (words + 1) x size; the last row stands for beyond the text), bias, class and word weights."""

    def __init__(self, params: dict[str, np.ndarray], shape: Shape):
        self.params, self.shape = params, shape

    @classmethod
    def new(cls, frequency: np.ndarray, shape: Shape) -> Network:
        """Small random weights; output biases give the words' own shares."""
        rng = np.random.default_rng(shape.seed)
        share = (frequency + 1.0) / (frequency + 1.0).sum()
        by_class = share.reshape(shape.classes, shape.per_class)
        p = {
            "place": rng.normal(0, 0.1, (2 * shape.reach, shape.words + 1, shape.size)),
            "bias": np.zeros(shape.size),
            "c": rng.normal(0, 0.1, (shape.size, shape.classes)),
            "cb": np.log(by_class.sum(axis=1)),
            "w": rng.normal(0, 0.1, (shape.classes, shape.size, shape.per_class)),
            "wb": np.log(by_class / by_class.sum(axis=1, keepdims=True)),
        }
        return cls({k: v.astype(np.float32) for k, v in p.items()}, shape)

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        z = self.params["bias"] + self.params["place"][0][around[:, 0]]
        for k in range(1, around.shape[1]):
            z += self.params["place"][k][around[:, k]]
        return np.tanh(z)

    def _outputs(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Rows in the order of their target's class: that order, log-probabilities, class shares, and for each class its run of rows and their word shares.

        States are within (-1, 1) and weights small, so exponentials need no shift.
        """
        p, per = self.params, self.shape.per_class
        of = target // per
        order = np.argsort(of.astype(np.uint8 if self.shape.classes <= 256 else np.uint16), kind="stable")
        h, of, word = h[order], of[order], target[order] % per
        shares = np.exp(h @ p["c"] + p["cb"])
        shares /= shares.sum(axis=1, keepdims=True)
        chance = shares[np.arange(len(h)), of]
        cuts = np.searchsorted(of, np.arange(self.shape.classes + 1))
        parts = []
        for c in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[c], cuts[c + 1]
            own = np.exp(h[a:b] @ p["w"][c] + p["wb"][c])
            own /= own.sum(axis=1, keepdims=True)
            chance[a:b] *= own[np.arange(b - a), word[a:b]]
            parts.append((c, a, b, own))
        return order, np.log(chance), shares, parts

    def log_probs(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, found, *_ = self._outputs(self._hidden(around), target)
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradients(self, around: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, n, size = self.params, len(target), self.shape.size
        h = self._hidden(around)
        order, out, dc, parts = self._outputs(h, target)
        h, around, target = h[order], around[order], target[order]
        dc[np.arange(n), target // self.shape.per_class] -= 1
        dh = dc @ p["c"].T
        word = target % self.shape.per_class
        g = {"c": h.T @ dc, "cb": dc.sum(axis=0), "w": np.zeros_like(p["w"]), "wb": np.zeros_like(p["wb"])}
        for c, a, b, dw in parts:
            dw[np.arange(b - a), word[a:b]] -= 1
            dh[a:b] += dw @ p["w"][c].T
            g["w"][c], g["wb"][c] = h[a:b].T @ dw, dw.sum(axis=0)
        dz = dh * (1 - h * h)
        g["bias"] = dz.sum(axis=0)
        cells, flat = np.arange(size), dz.ravel()
        g["place"] = np.stack([
            np.bincount((around[:, k][:, None] * size + cells).ravel(), weights=flat, minlength=(self.shape.words + 1) * size).reshape(-1, size) for k in range(around.shape[1])
        ])
        return float(-out.mean()), {k: (v / n).astype(np.float32) for k, v in g.items()}

    def train(self, windows: np.ndarray) -> None:
        """One pass of Adagrad; windows: neighbours, then target."""
        past = {k: np.full_like(v, 1e-6) for k, v in self.params.items()}
        order = np.random.default_rng(self.shape.seed).permutation(len(windows))
        for at in range(0, len(windows), self.shape.batch):
            own = windows[order[at : at + self.shape.batch]].astype(np.int64)
            _, g = self.gradients(own[:, :-1], own[:, -1])
            for k, v in g.items():
                past[k] += v * v
                self.params[k] -= self.shape.step * v / np.sqrt(past[k])

    def flat(self) -> np.ndarray:
        return np.concatenate([self.params[k].ravel() for k in sorted(self.params)])

    def unflat(self, values: np.ndarray) -> Network:
        out, at = {}, 0
        for k in sorted(self.params):
            out[k] = values[at : at + self.params[k].size].reshape(self.params[k].shape).astype(np.float32)
            at += self.params[k].size
        return Network(out, self.shape)


def neighbours(ids: list[np.ndarray], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Of all tokens of some texts one after another: neighbours (tokens x places) and targets."""
    pad = np.full(shape.reach, shape.words, np.int32)
    line = np.concatenate([x for i in ids for x in (i, pad)] or [pad])
    line = np.concatenate([pad, line, pad])
    real = np.flatnonzero(line != shape.words)
    return np.stack([line[real + k] for k in shape.places], axis=1), line[real]


def _coded(words: Words, shape: Shape, shards: int):
    """Every document's ids, packed, with its shard; windows are made of them where they are used, as they are five times as large."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, text, (ids, spelled) in zip(rows["doc_id"], rows["text"], words.coded(rows["text"]), strict=True):
                mark = zlib.crc32(text.encode())
                out.append((zlib.crc32(f"{shape.seed}:{doc}:{mark}".encode()) % shards, doc, mark, ids.astype("<u2").tobytes(), spelled))
            yield pd.DataFrame(out, columns=["shard", "doc", "mark", "ids", "spelled"])

    return take


def windows_of(rows: pd.DataFrame, shape: Shape) -> np.ndarray:
    """Neighbours and target of every rate-th place of every document, from a place that follows from its id."""
    out = []
    for doc, ids in zip(rows["doc"], rows["ids"], strict=True):
        around, target = neighbours([np.frombuffer(ids, "<u2").astype(np.int32)], shape)
        first = zlib.crc32(f"{shape.seed}:{doc}".encode()) % shape.rate
        out.append(np.concatenate([around, target[:, None]], axis=1)[first :: shape.rate].astype(np.uint16))
    return np.concatenate(out)


def _train_shard(network: Network, chunk: int):
    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc", "mark"], na_position="first", kind="stable")
        windows = windows_of(rows, network.shape)
        own = Network({k: v.copy() for k, v in network.params.items()}, network.shape)
        own.train(windows)
        flat = own.flat().astype(np.float64) * len(windows)
        at = range(0, len(flat), chunk)
        return pd.DataFrame({"shard": rows["shard"].iloc[0], "part": [i // chunk for i in at], "n": len(windows), "values": [flat[i : i + chunk].tobytes() for i in at]})

    return train


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("shard")
    total = sum(np.frombuffer(v) for v in rows["values"])
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "part": [rows["part"].iloc[0]], "n": [rows["n"].sum()], "values": [total.tobytes()]})


def count_words(texts: DataFrame) -> DataFrame:
    """word, n: every word of the texts, materialized."""
    return materialize(small_batches(texts).mapInPandas(_counting, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


@dataclass
class Model:
    """All of a fixed size: the ranked words, the spelling of others, the network."""

    ranked: list[bytes]
    spelled: Spelling
    network: Network


def coded_texts(texts: DataFrame, shape: Shape) -> tuple[DataFrame, list[tuple[bytes, int]], Spelling, int]:
    """texts (doc_id string, text) as ids (materialized: shard, doc, mark, ids, spelled), the ranked words with their numbers, the spelling, and the number of shards."""
    counted = count_words(texts)
    top = counted.orderBy(F.desc("n"), "word").limit(shape.words - shape.buckets)
    ranked = [(r.word.encode(), r.n) for r in top.collect()]
    spelled = spelling(counted, [w for w, _ in ranked], shape)
    total = counted.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(total / shape.rate / shape.shard_windows))
    words = Words([w for w, _ in ranked], spelled, shape)
    coded = materialize(texts.mapInPandas(_coded(words, shape, shards), "shard long, doc string, mark long, ids binary, spelled double"), "coded")
    return coded, ranked, spelled, shards


def train(coded: DataFrame, ranked: list[tuple[bytes, int]], spelled: Spelling, shards: int, shape: Shape) -> Network:
    frequency = np.zeros(shape.words)
    frequency[: len(ranked)] = [n for _, n in ranked]
    frequency[shape.words - shape.buckets :] = spelled.first
    network = Network.new(frequency, shape)
    chunk = 1 << 14
    schema = "shard long, part int, n long, values binary"
    for _ in range(shape.rounds):
        models = coded.where(F.octet_length("ids") > 0).select("shard", "doc", "mark", "ids").groupBy("shard").applyInPandas(_train_shard(network, chunk), schema)
        left = shards
        while left > 1:
            models = models.withColumn("group", F.expr(f"shard div {FAN}")).groupBy("part", "group").applyInPandas(lambda rows: _add(rows).assign(shard=rows["group"].iloc[0]), schema)
            left = math.ceil(left / FAN)
        parts = sorted(models.collect(), key=lambda r: r.part)
        if not parts or not parts[0].n:
            break
        network = network.unflat(np.concatenate([np.frombuffer(r["values"]) for r in parts]) / parts[0].n)
    return network


def fit(texts: DataFrame, shape: Shape = Shape()) -> Model:  # noqa: B008
    """texts: doc_id (string), text."""
    coded, ranked, spelled, shards = coded_texts(small_batches(texts), shape)
    return Model([w for w, _ in ranked], spelled, train(coded, ranked, spelled, shards, shape))


#: Tokens that are scored at once.
GROUP_TOKENS = 1 << 13


def pseudo_likelihood(docs: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """One row per row of docs: doc_id, n_tokens, log_likelihood (summed, natural), per_token, perplexity.

    Tokens are words between white space, with A-Z lower-cased. Null and empty texts have no
    tokens, log_likelihood 0 and null means. An empty table gives an empty result. Repeated rows are scored alike,
    and count in training as often as they are there; null ids are keys like others. Other columns are ignored.
    """
    texts = small_batches(docs.select(as_key(F.col(id_col)).alias("doc_id"), whole_text(text_col).alias("text")))
    coded, ranked, spelled, shards = coded_texts(texts, shape)
    shared = docs.sparkSession.sparkContext.broadcast(train(coded, ranked, spelled, shards, shape))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for rows in batches:
            sums, sizes = [], []

            def flush(group: list[np.ndarray]) -> None:
                around, target = neighbours(group, shape)
                scores = np.concatenate([net.log_probs(around[a : a + GROUP_TOKENS], target[a : a + GROUP_TOKENS]).astype(np.float64) for a in range(0, len(target), GROUP_TOKENS)] or [np.empty(0)])
                n = np.array([len(i) for i in group])
                total = np.r_[0.0, np.cumsum(scores)]
                ends = np.cumsum(n)
                sums.extend(total[ends] - total[ends - n])
                sizes.extend(n)

            group, held = [], 0
            for ids in rows["ids"]:
                group.append(np.frombuffer(ids, "<u2").astype(np.int32))
                held += len(group[-1])
                if held >= GROUP_TOKENS:
                    flush(group)
                    group, held = [], 0
            if group:
                flush(group)
            yield pd.DataFrame({"doc_id": list(rows["doc"]), "n_tokens": np.array(sizes, np.int64), "log_likelihood": np.array(sums, np.float64) + rows["spelled"].to_numpy()})

    scored = as_id(coded.select("doc", "ids", "spelled").mapInPandas(run, "doc_id string, n_tokens long, log_likelihood double"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return scored.withColumn("per_token", mean).withColumn("perplexity", F.exp(-F.col("per_token")))
