import random

import numpy as np

from labelloom.llm.components import components
from labelloom.llm.shingle_join import PIECE, CountTree, Join, bounds, index_length, odd_groups, point, prefix_length, reaches, shingle_join, shingles, word_hashes


def brute(rows, percent=80):
    def own(text):
        w = "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [own(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j = rows[b][0]
            shared = len(sets[a] & sets[b])
            if i is not None and j is not None and sets[a] and sets[b] and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(((i, len(s), root(i) if i is not None else None) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def texts(rng, groups, size):
    word = lambda: "w%d" % rng.randrange(3000)
    out, passage = [], " ".join(word() for _ in range(30))
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own) + (" " + passage if rng.random() < 0.4 else ""))
    return out


def run(frame, join=Join()):  # noqa: B008
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in shingle_join(frame, join).collect()), key=str)


def test_against_brute_force(docs):
    rng = random.Random(8)
    rows = [(3 * i % 911, t) for i, t in enumerate(texts(rng, 60, 5))]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "one"), (2004, "ONE\n"), (2005, "a b c d"), (2006, "A b\tc d"), (None, rows[0][1]), (None, None), (2007, "É a b c d e"), (2008, "é a b c d e")]
    rows += [(rows[5][0], rows[40][1]), (rows[5][0], rows[5][1]), (2100, "q " * 30000), (2101, "q " * 40000)]
    assert run(docs(rows).repartition(5)) == brute(rows)


def test_large_group_of_near_copies_in_tiles(docs):
    rng = random.Random(1)
    base = ["w%d" % rng.randrange(5000) for _ in range(60)]
    rows = []
    for i in range(220):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = "x%d" % rng.randrange(10**6)
        rows.append((i, " ".join(own)))
    for join in (Join(tile=50, leaf=8), Join()):
        assert run(docs(rows).repartition(4), join) == brute(rows)


def test_long_texts_of_distinct_words(docs):
    rng = random.Random(5)
    long = ["w%d" % rng.randrange(10**6) for _ in range(20000)]
    other = list(long)
    for i in range(0, 20000, 400):
        other[i] = "x%d" % i
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long[:15000])), (4, " ".join(reversed(long)))]
    assert run(docs(rows)) == brute(rows)


def test_inner_nodes_rule_out_whole_subtrees():
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.poisson(0.1, (64, 64)) + 9 * np.eye(64, dtype=int)[k] * 4 for k in range(16)]).astype(np.uint8)
    tree = CountTree(points, points.sum(axis=1, dtype=np.int64), 8)
    assert len(tree.near(np.arange(4), 80)) < len(points) / 2


def test_word_hashes_tell_words_apart():
    rng = random.Random(9)
    words = ["".join(rng.choice("ab\u00e9\0\x1c\x85") for _ in range(rng.randint(1, 7))) for _ in range(4000)] + ["a" * n for n in range(1, 300)]
    text = "".join(w + rng.choice([" ", "\t", "\n", "\x0b", "\x0c", "\r", "  \n"]) for w in words)
    assert text.encode().split() == [w.encode() for w in words]
    got = word_hashes(text.encode())
    assert len(got) == len(words)
    by = {}
    for w, h in zip(words, got.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    long = (text + " ") * 12 + "z" * 9000
    assert len(long) > PIECE and word_hashes(long.encode()).tolist() == got.tolist() * 12 + word_hashes(b"z" * 9000).tolist()
    assert len(word_hashes(b"")) == len(word_hashes(b" \n")) == 0 and len(word_hashes(b"x")) == 1


def test_empty(docs):
    assert shingle_join(docs([])).count() == 0 and run(docs([(5, None)])) == [(5, 0, 5)]


def test_bound_and_tree_lose_nothing():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 6, (400, 16)).astype(np.uint8)
    points[200:] = np.maximum(points[:200].astype(int) + rng.integers(-1, 2, (200, 16)), 0)
    sizes = points.sum(axis=1, dtype=np.int64)
    tree = CountTree(points, sizes, 16)
    assert sorted(tree.order.tolist()) == list(range(400)) and len(tree.levels) == 3
    everything = np.arange(400)
    ok = reaches(bounds(points, everything, everything), sizes[:, None], sizes[None, :], 80)
    for at in range(0, 400, 7):
        rows = np.arange(at, min(at + 7, 400))
        near = set(tree.near(rows, 80).tolist())
        assert near >= set(np.nonzero(ok[rows].any(axis=0))[0].tolist())
    a, b = shingles("a b c d e f g h", 5), shingles("A  B c\nd e f g x", 5)
    assert len(a) == 4 and len(np.intersect1d(a, b)) == 3 and prefix_length(10, 80) == 3


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(300)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefixes_and_odd_groups_lose_nothing():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64 - 1, rng.integers(1, 200), dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.95], rng.integers(0, 2**64 - 1, rng.integers(0, 9), dtype=np.uint64)])
        if not len(b) or not reaches(shared := len(np.intersect1d(a, b)), len(a), len(b), 80):
            continue
        small, large = sorted((a, b), key=len)
        assert len(np.intersect1d(small[: index_length(len(small), 80)], large[: prefix_length(len(large), 80)]))
        p, q = (np.frombuffer(point(x, 16), np.uint8).astype(int) for x in (a, b))
        differ = np.bitwise_count(np.frombuffer(odd_groups(a, 16), np.uint8) ^ np.frombuffer(odd_groups(b, 16), np.uint8)).sum()
        assert np.minimum(p, q).sum() >= shared and (len(a) + len(b) - differ) // 2 >= shared
