import math

import numpy as np
import pytest

from labelloom.llm import common
from labelloom.llm.cap_filters import Caps, codes_for, near_vectors, spread
from labelloom.llm.vectors import units

SCHEMA = "vec_id long, embedding array<float>, label int, n long, filter string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def brute(rows, cosine=0.95):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    vectors = [np.array(v, np.float32).astype(float) if f else None for (_, v), f in zip(rows, fine)]
    linked = lambda a, b: len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine
    near = [[k for k, b in enumerate(vectors) if k != j and a is not None and b is not None and linked(a, b)] for j, a in enumerate(vectors)]
    out = []
    for j, (i, _) in enumerate(rows):
        seen, todo = {j}, [j]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        least = min(rows[k][0] for k in seen) if fine[j] else i
        out.append((i, len(near[j]), least, i == least))
    return sorted(out, key=str)


def result(frame, caps=Caps()):
    return sorted((tuple(r) for r in near_vectors(frame, caps).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def cloud(draw, centre, n, noise):
    return [(centre + noise * draw.standard_normal(len(centre))).astype(np.float32).tolist() for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    vectors = [v.astype(np.float32).tolist() for v in units(draw.standard_normal((60, 24)))]
    vectors += cloud(draw, np.array(vectors[0]), 90, 0.012)  # a hot group within a core
    vectors += cloud(draw, np.array(vectors[1]), 40, 0.02)  # spread over more than a core
    vectors += [vectors[2]] * 30 + [[2 * x for x in vectors[2]]] * 3  # copies, and the same direction
    vectors += [vectors[3][:12], vectors[3][:12], [1.0], [2.0], [-1.0]]  # other lengths
    vectors += [None, [], [0.0] * 24, [-0.0] * 24, [float("nan")] * 24, [float("inf")] + vectors[4][1:], [None] + vectors[4][1:], [3e38] * 24, [3e38] * 24, [1e-42] * 24]
    return [(7 * i % 1009, v) for i, v in enumerate(vectors)] + [(None, vectors[2]), (5, vectors[5]), (5, vectors[6]), (5, vectors[5])]


@pytest.mark.parametrize("tile", [8, 2048])
def test_equals_all_pairs(spark, rows, tile):
    # a pair right at the bound may be missed: there is none here
    caps = Caps(hot=tile, tile=tile, recall=0.99)
    assert result(table(spark, rows).repartition(3), caps) == brute([(i, v) for i, v in rows])


def test_shuffled_joins_give_the_same(spark, rows, monkeypatch):
    caps = Caps(hot=8, tile=8)
    want = result(table(spark, rows), caps)
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert result(table(spark, rows), caps) == want


def test_no_link_is_wrong_and_few_are_missed(spark, rows):
    draw = np.random.default_rng(4)
    rows = rows + [(2000 + k, v) for k, v in enumerate(cloud(draw, np.array(rows[7][1]), 60, 0.042))]  # on both sides of the bound
    got, want = result(table(spark, rows)), brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)


def test_pairs_at_the_bound_meet_as_often_as_asked():
    caps = Caps(vectors=4096)
    draw = np.random.default_rng(11)
    one, off = units(draw.standard_normal((600, 64))), draw.standard_normal((600, 64))
    two = 0.95 * one + math.sqrt(1 - 0.95**2) * units(off - (off * one).sum(axis=1)[:, None] * one)
    met = np.zeros(600, bool)
    for code in codes_for(64, caps)[0]:
        a, b = (set(zip(*(np.concatenate(x).tolist() for x in zip(*spread(code, side))), strict=True)) for side in (one, two))
        met[[row for row, _ in a & b]] = True
    assert met.mean() >= caps.recall - 0.02


def test_decoding_leaves_out_no_filter():
    code = codes_for(12, Caps(vectors=64))[0][0]
    rows = units(np.random.default_rng(5).standard_normal((20, 12)))
    row, name = (np.concatenate(x) for x in zip(*spread(code, rows)))
    a, b = ((rows @ code.turn)[:, k * 6 : k * 6 + 6] @ code.blocks[k].T for k in (0, 1))
    i, x, y = np.nonzero(a[:, :, None] + b[:, None, :] >= code.least)
    assert sorted(zip(row.tolist(), name.tolist(), strict=True)) == sorted(zip(i.tolist(), (x * b.shape[1] + y).tolist(), strict=True))


def test_empty_table(spark):
    assert result(table(spark, [])) == []


def test_only_vectors_that_link_with_nothing(spark):
    assert result(table(spark, [(1, None), (2, [0.0, 0.0]), (None, None)])) == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=str)
