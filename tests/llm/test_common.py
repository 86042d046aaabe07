from pathlib import Path

import pytest

from labelloom.llm import common
from labelloom.llm.exact_dedup import exact_dedup
from labelloom.llm.line_dedup import line_dedup
from labelloom.llm.shingle_join import shingle_join


@pytest.fixture
def no_broadcast(monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_shuffled_join_equals_broadcast(spark, monkeypatch, how):
    big = spark.createDataFrame([(i % 7, i) for i in range(200)] + [(None, 1000)], "k long, v long").repartition(3)
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (9, "d")], "k long, w string")
    want = sorted(map(str, common.checked_join(big, small, ["k"], how).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert sorted(map(str, common.checked_join(big, small, ["k"], how).collect())) == want


def test_operators_give_the_same_beyond_the_broadcast_bound(docs, monkeypatch):
    rows = [(i, f"one two three four five six seven {i % 5}\nown {i}") for i in range(40)] + [(100, None), (None, "one two three four five six seven 1\nown")]
    frame = docs(rows).repartition(3)
    runs = []
    for bound in (common.BROADCAST_ROWS, -1):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        runs.append([sorted(map(str, f(frame).collect())) for f in (exact_dedup, line_dedup, shingle_join)])
    assert runs[0] == runs[1]


def test_materialized_tables_are_read_back(spark, docs):
    frame = docs([(1, "a"), (None, None)])
    for narrow in (False, True):
        back = common.materialize(frame, "t", narrow)
        assert back.schema == frame.schema and sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))


def test_joins_of_narrow_tables_broadcast_fewer_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "NARROW_ROWS", 3)
    small = spark.range(4)
    assert common.small_enough(small) and not common.small_enough(small, narrow=True) and common.small_enough(spark.range(3), narrow=True)
    big = spark.range(10).repartition(2)
    assert sorted(common.checked_join(big, small, ["id"], "inner", narrow=True).collect()) == sorted(common.checked_join(big, small, ["id"], "inner").collect())


def test_materialized_tables_have_no_marker(docs):
    files = common.materialize(docs([(1, "a")]), "t").inputFiles()
    assert not list(Path(files[0].removeprefix("file:")).parent.glob("*SUCCESS*"))
