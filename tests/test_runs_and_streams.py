"""Streams in pieces against the batch, events in order and resumed, parameters turned and renamed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.functions import tensors
from labelloom.operators import track
from labelloom.plans.events import Run
from labelloom.streaming.tracked import tracked


@pytest.mark.parametrize("largest", [True, False])
def test_a_stream_in_pieces_equals_the_batch(spark, tmp_path, largest):
    draw = np.random.default_rng(4)
    rows = [(k, i, float(draw.integers(0, 6)) / 2) for k, n in (("a", 40), ("b", 3), ("c", 1)) for i in range(n)]
    schema = "name string, step long, value double"
    frame = spark.createDataFrame(rows, schema)
    source, target, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    for low, high in ((0, 1), (1, 7), (7, 8), (8, 99)):  # each piece is a run of its own
        frame.where(f"step >= {low} and step < {high}").coalesce(2).write.mode("append").parquet(source)
        stream = tracked(spark.readStream.schema(schema).parquet(source), alpha=0.9, largest=largest)
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(target)
    want = track.best_so_far(frame, "name", "step", "value", largest)
    told = {(r.name, r.step): (r.best, r.is_best) for r in got.collect()}
    assert got.count() == len(rows) and told == {(r.name, r.step): (r.best, r.is_best) for r in want.collect()}
    last = {r.name: (r.steps, round(r.ema, 9)) for r in got.collect() if r.steps == {"a": 40, "b": 3, "c": 1}[r.name]}
    assert last == {r.name: (r.steps, round(r.ema, 9)) for r in track.moving_average(frame, "name", "step", "value", 0.9).collect()}


def test_values_that_are_missing_change_nothing(spark, tmp_path):
    schema = "name string, step long, value double"
    spark.createDataFrame([("a", 0, None), ("a", 1, 2.0), ("a", 2, float("nan")), ("a", 3, 4.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tracked(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), alpha=0.5)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("step").collect()
    assert [(r.steps, r.is_best) for r in got] == [(0, False), (1, True), (1, False), (2, True)] and got[3].ema == 3.0 and got[2].best == 2.0


def handlers(spark, seen, breaks=()):
    def add(name, n):
        def run(state, event):
            if name in breaks:
                raise ValueError("broke off")
            seen.append((event, name, state["v"].first()[0]))
            return {"v": state["v"].select((F.col("x") * 10 + n).alias("x"))}

        return run

    return [("a", add("a", 1)), ("b", add("b", 2)), ("c", add("c", 3))]


def test_handlers_run_in_order_and_resume(spark, tmp_path):
    start = {"v": spark.createDataFrame([(7,)], "x long")}

    def go(breaks=()):
        seen, run = [], Run(spark, str(tmp_path / "run"))
        for name, h in handlers(spark, seen, breaks):
            run.on("epoch", name, h)
        run.on("end", "a", handlers(spark, seen)[0][1])
        try:
            state = start
            for event in ("epoch", "nothing", "epoch", "end"):
                state = run.fire(event, state)
            return seen, run.called, state["v"].first()[0]
        except RuntimeError as wrong:
            return seen, run.called, str(wrong)

    seen, called, said = go(breaks=("b",))
    assert seen == [("epoch", "a", 7)] and said == "handler b of epoch: broke off"
    seen, called, x = go()
    # a is not called again; b and c go on from what it left
    assert seen == [("epoch", "b", 71), ("epoch", "c", 712), ("epoch", "a", 7123), ("epoch", "b", 71231), ("epoch", "c", 712312), ("end", "a", 7123123)]
    assert x == 71231231 and called[0] == "epoch.b"
    assert go() == ([], [], 71231231)
    with pytest.raises(ValueError, match="already"):
        run = Run(spark, str(tmp_path / "other"))
        run.on("e", "a", len)
        run.on("e", "a", len)


@pytest.mark.parametrize("shape, axes", [((2, 3, 4, 5), (3, 2, 0, 1)), ((1, 1, 2, 7), (3, 2, 0, 1)), ((4, 6), (1, 0)), ((2, 3, 4), (1, 2, 0)), ((5,), (0,)), ((0, 2, 3, 1), (3, 2, 0, 1))])
def test_arrays_are_turned_as_numpy_turns_them(spark, shape, axes):
    made = np.arange(int(np.prod(shape))).reshape(shape)
    frame = spark.createDataFrame([(list(shape), made.ravel().tolist())], "shape array<int>, v array<long>")
    got = frame.select(tensors.transposed(F.col("v"), F.col("shape"), axes).alias("v"), tensors.turned_shape(F.col("shape"), axes).alias("s")).first()
    assert got.v == made.transpose(axes).ravel().tolist() and tuple(got.s) == made.transpose(axes).shape


def test_missing_names_and_wrong_shapes_end_the_job(spark):
    params = spark.createDataFrame([("conv/W", [1, 1, 1, 2], [1.0, 2.0]), ("linear/W", [1], [3.0]), ("new/W", [1], [1.0])], "name string, shape array<int>, values array<double>")
    names = spark.createDataFrame([("conv/W", "d.conv.w")], "old string, new string")
    assert [(r.name, r.shape) for r in tensors.renamed(params.where("name != 'new/W'"), names).collect()] == [("d.conv.w", [2, 1, 1, 1])]
    with pytest.raises(Exception, match="no new name for new/W"):
        tensors.renamed(params, names).collect()
    with pytest.raises(Exception, match="do not fill"):
        params.select(tensors.transposed(F.col("values"), F.array(F.lit(3)), (0,))).collect()
