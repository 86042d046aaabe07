import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from labelloom.llm.pseudo_likelihood import Network, Shape, Spelling, Words, count_words, fit, neighbours, pseudo_likelihood, spelling, windows_of

SMALL = Shape(words=64, buckets=8, per_class=8, size=6, rate=1, shard_windows=3000, rounds=3, batch=128)


def prose(rng, n):
    """Words in an order: each is followed by one of two."""
    at, out = 0, []
    for _ in range(n):
        out.append(f"w{at}")
        at = (3 * at + rng.randrange(2)) % 40
    return " ".join(out)


def test_gradients():
    rng = np.random.default_rng(1)
    net = Network.new(np.arange(64.0), SMALL)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    around, target = rng.integers(0, 65, (30, 4)), rng.integers(0, 64, 30)
    _, grads = net.gradients(around, target)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, got = net.params[k][at], []
        for d in (1e-4, -1e-4):
            net.params[k][at] = old + d
            got.append(net.gradients(around, target)[0])
        net.params[k][at] = old
        assert abs((got[0] - got[1]) / 2e-4 - g[at]) < 1e-4, k


def test_probabilities_sum_to_one():
    net = Network.new(np.arange(64.0), SMALL)
    around = np.array([[1, 2, 3, 64]])
    assert math.isclose(sum(math.exp(net.log_probs(around, np.array([t]))[0]) for t in range(64)), 1, rel_tol=1e-4)


def test_neighbours():
    around, target = neighbours([np.array([5, 6, 7], np.int32), np.array([], np.int32), np.array([8], np.int32)], SMALL)
    assert target.tolist() == [5, 6, 7, 8] and around.tolist() == [[64, 64, 6, 7], [64, 5, 7, 64], [5, 6, 64, 64], [64] * 4]


def test_held_out_text_is_likelier_than_by_shares_and_than_shuffled(spark, docs):
    rng = random.Random(6)
    rows = [(i, prose(rng, 150)) for i in range(120)]
    texts = docs(rows).selectExpr("cast(doc_id as string) doc_id", "text")
    model = fit(texts, SMALL)
    net, words = model.network, Words(model.ranked, model.spelled, SMALL)
    new = prose(rng, 4000).split()
    mixed = new[:]
    rng.shuffle(mixed)
    mean = lambda w: float(net.log_probs(*neighbours([words.ids(" ".join(w))], SMALL)).mean())
    share = math.log(1 / 40)
    assert mean(new) > share + 1.0 and mean(new) > mean(mixed) + 1.5


def test_rows(docs):
    rng = random.Random(7)
    rows = [(i, prose(rng, 60)) for i in range(40)] + [(100, None), (101, ""), (102, " \n"), (103, "W1 w3"), (103, "W1 w3"), (None, "w1 w3"), (104, "w1 " * 50000)]
    got = pseudo_likelihood(docs(rows).repartition(4), SMALL).collect()
    again = {(r.doc_id, r.n_tokens): r.log_likelihood for r in pseudo_likelihood(docs(rows).repartition(2), SMALL).collect()}
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.log_likelihood, again[r.doc_id, r.n_tokens], rel_tol=1e-3, abs_tol=1e-3)  # whatever the partitions
        if r.doc_id in (100, 101, 102):
            assert (r.n_tokens, r.log_likelihood, r.per_token, r.perplexity) == (0, 0.0, None, None)
        else:
            assert math.isclose(r.per_token * r.n_tokens, r.log_likelihood, rel_tol=1e-9) and math.isclose(r.perplexity, math.exp(-r.per_token), rel_tol=1e-9)
    assert len({r.log_likelihood for r in got if r.doc_id in (103, None)}) == 1
    assert pseudo_likelihood(docs([]), SMALL).count() == 0


def test_words_beyond_the_vocabulary_are_scored_as_themselves(docs):
    """Network and spelling by loops over windows, words and bytes."""
    rng = random.Random(8)
    texts = [prose(rng, 60) + " " + " ".join(f"R{rng.randrange(12) ** 2} \u00c4x{i}\n" for _ in range(20)) for i in range(40)]
    rows = [*enumerate(texts), (900, "once w1"), (901, "r0 w1"), (902, "r0 w1"), (902, "r0 w1"), (None, "R0 w1"), (903, "z\0z \0")]
    shape = Shape(words=32, buckets=8, per_class=8, size=6, rate=1, shard_windows=3000, rounds=1, batch=128)
    frame = docs(rows)
    lower = lambda t: t.encode().lower().split()
    counts = Counter(w for _, t in rows for w in lower(t))
    texts_of = frame.selectExpr("cast(doc_id as string) doc_id", "text")
    assert {r.word.encode(): r.n for r in count_words(texts_of).collect()} == counts
    model = fit(texts_of, shape)
    assert model.ranked == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:24]
    rest = {w: n for w, n in counts.items() if w not in model.ranked}
    often = Counter()
    for w, n in rest.items():
        for c in w:
            often[c] += n
    frequent = [c for c, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))][:6]
    of = lambda c: frequent.index(c) + 1 if c in frequent else 7
    three, two = Counter(), Counter()
    for w, n in rest.items():
        k = [0, *map(of, w), 0]
        for i in range(2, len(k)):
            three[tuple(k[i - 2 : i + 1])] += n
            two[tuple(k[i - 1 : i + 1])] += n

    def spelled(w):
        k = [0, *map(of, w), 0]
        out = sum(math.log((often[c] + 0.5) / sum(often[d] + 0.5 for d in range(256) if of(d) == of(c))) for c in w)
        for i in range(2, len(k)):
            a, b, c = k[i - 2 : i + 1]
            one = (two[b, c] + 0.5) / (sum(two[b, d] for d in range(8)) + 4)
            out += math.log((three[a, b, c] + 4 * one) / (sum(three[a, b, d] for d in range(8)) + 4))
        return out

    p = {k: v.astype(float) for k, v in model.network.params.items()}

    def score(t):
        words, out = lower(t), 0.0
        ids = [model.ranked.index(w) if w in model.ranked else 24 + of(w[0]) for w in words]
        for i, own in enumerate(ids):
            h = p["bias"].copy()
            for place, k in enumerate((-2, -1, 1, 2)):
                h += p["place"][place][ids[i + k] if 0 <= i + k < len(ids) else 32]
            h = np.tanh(h)
            c, w = divmod(own, 8)
            for logits, at in ((h @ p["c"] + p["cb"], c), (h @ p["w"][c] + p["wb"][c], w)):
                out += logits[at] - math.log(np.exp(logits).sum())
            if words[i] not in model.ranked:
                out += spelled(words[i])
        return out

    got = pseudo_likelihood(frame, shape).collect()
    assert len(got) == len(rows)
    for a, b in zip(sorted((str(i), score(t)) for i, t in rows), sorted((str(r.doc_id), r.log_likelihood) for r in got), strict=True):
        assert a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-4)
    assert all(math.isclose(r.per_token * r.n_tokens, r.log_likelihood, rel_tol=1e-9) for r in got)


def test_spelling_is_a_distribution(spark):
    counted = spark.createDataFrame([("ab", 3), ("abc", 2), ("b", 5), ("\u00e9a", 1)], "word string, n long")
    own = spelling(counted, [], Shape(buckets=8))
    for a in range(8):
        for b in range(8):
            assert math.isclose(sum(math.exp(own.logs[(a * 8 + b) * 8 + c]) for c in range(8)), 1)
    for k in range(1, 8):
        assert math.isclose(sum(math.exp(own.within[c]) for c in range(256) if own.table[c] == k), 1, rel_tol=1e-9) or k not in own.table
    assert own.log(b"ab") > own.log(b"ac") and own.log(b"abc") > own.log(b"abx") and Spelling.byte_table(np.zeros(256), 8).tolist() == [7] * 256


def test_random_strings_and_shuffled_words_score_below_text(spark):
    """On a corpus with more words than the network has."""
    rng = random.Random(12)
    parts = ["an", "ber", "con", "de", "er", "fal", "ing", "lo", "men", "ter", "tion", "ver"]
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(3000)]
    follow = {w: rng.sample(vocabulary, 3) for w in vocabulary}

    def text(n):
        w, out = rng.choice(vocabulary[:300]), []
        for _ in range(n):
            out.append(w)
            w = rng.choice(follow[w]) if rng.random() < 0.8 else vocabulary[min(2999, int(rng.expovariate(1 / 300)))]
        return " ".join(out)

    good = [text(rng.randint(60, 200)) for _ in range(400)]
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(100)) for _ in range(5)]
    rows = [*enumerate(good), *((1000 + i, t) for i, t in enumerate(noise))]
    got = {r.doc_id: r.per_token for r in pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string"), Shape(shard_windows=20000, batch=512)).collect()}
    worst = sorted(got[i] for i in range(400))[0]
    assert max(got[1000 + i] for i in range(5)) < worst - 3


def test_every_place_is_trained_on():
    shape = Shape()
    ids = [np.array(i, "<u2") for i in ([5], [6, 7, 8], range(100, 140))]
    got = windows_of(pd.DataFrame({"doc": ["1", None, "3"], "ids": [i.tobytes() for i in ids]}), shape)
    around, target = neighbours([i.astype(np.int32) for i in ids], shape)
    assert got.tolist() == np.concatenate([around, target[:, None]], axis=1).tolist()
