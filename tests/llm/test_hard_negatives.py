import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm.hard_negatives import Mining, hard_negatives, products

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, is_anchor string"


def table(spark, rows, kind=SCHEMA):
    return spark.createDataFrame([(i, v, label, 3, "x") for i, v, label in rows], kind)


def brute(rows, every, positives=5, negatives=5):
    """Loops over anchors and all rows, in Python's integers."""
    fine = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for i, label, v in (r for r in fine if r[0] % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other == label) for j, other, w in fine if j != i)
        for ps, p, _ in [s for s in scored if s[2]][:positives]:
            band = [(ns, n) for ns, n, same in scored if not same and 80 * -ps <= 100 * -ns <= 100 * -ps][:negatives]
            found += [(i, p, k, n, -ps, -ns) for k, (ns, n) in enumerate(band, 1)]
    return sorted(found)


def result(frame, every, mining=Mining()):
    got = hard_negatives(frame, F.col("vec_id") % every == 0, mining)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((4, 20))
    vectors = [(centres[k % 4] + 0.6 * draw.standard_normal(20)).astype(np.float32).tolist() for k in range(240)]
    vectors += [vectors[0]] * 25 + [vectors[1]] * 3  # copies tie
    out = [(3 * k, v, (k * 7) % 3) for k, v in enumerate(vectors)]
    odd = [None, [], [None] * 20, [float("nan")] * 20, vectors[3][:7], [0.0] * 20]
    out += [(900 + 3 * k, v, 1) for k, v in enumerate(odd)] + [(None, vectors[2], 1), (10, vectors[2], None), (30, vectors[5], 0), (30, vectors[6], 1), (4, vectors[7], 2), (4, vectors[7], 2), (-20, vectors[8], 9)]
    return out


@pytest.mark.parametrize("mining", [Mining(), Mining(anchor_bytes=4000), Mining(parts=1), Mining(parts=20), Mining(positives=2, negatives=1)])
def test_equals_loops(spark, rows, mining):
    want = brute(rows, 10, mining.positives, mining.negatives)
    assert want and result(table(spark, rows).repartition(3), 10, mining) == want


def test_scores_beyond_doubles_are_exact(spark):
    draw = np.random.default_rng(2)
    rows = [(k, (1e6 * draw.standard_normal(6)).tolist(), k % 2) for k in range(40)]
    rows += [(k + 50, rows[k][1], k % 2) for k in range(4)]
    wide = SCHEMA.replace("array<float>", "array<double>")
    fine = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows]
    got = result(table(spark, rows, wide), 10)
    assert got and all(p == sum(x * y for x, y in zip(fine[[f[0] for f in fine].index(a)][1], fine[[f[0] for f in fine].index(j)][1])) for a, j, _, _, p, _ in got)
    a = np.array([[2.0**40, 3.0]])
    assert products(a, a).tolist() == [2**63 - 1] and products(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0]])).tolist() == [2**60 + 1]


def test_huge_components_end_nothing(spark):
    rows = [(k, [3e38 * (-1) ** k, float(k)], k % 2) for k in range(20)]
    assert all(r[4] == 2**63 - 1 for r in result(table(spark, rows), 10))


def test_nothing_to_find(spark, rows):
    assert result(table(spark, []), 10) == [] and result(table(spark, rows[1:20]), 100_003) == result(table(spark, rows[:1]), 1) == []
