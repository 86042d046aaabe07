"""Parameters of a network as rows: flat arrays with a shape, renamed by a table and turned by index arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: how the axes (height, width, in, out) of a convolution's weights are turned to (out, in, height, width).
CONVOLUTION = (3, 2, 0, 1)


def transposed(values: Column, shape: Column, axes: tuple[int, ...] = CONVOLUTION) -> Column:
    """A flat array, row by row, with its axes in another order. Place i of the result is read at the sum of its coordinates times the strides they had."""
    n = len(axes)
    size = lambda k: F.get(shape, F.lit(k))
    stride = [F.lit(1)] * n
    for k in range(n - 2, -1, -1):
        stride[k] = stride[k + 1] * size(k + 1)
    # the result's strides: axis m of the result is axis axes[m] of the array
    own = [F.lit(1)] * n
    for m in range(n - 2, -1, -1):
        own[m] = own[m + 1] * size(axes[m + 1])

    def source(i: Column) -> Column:
        parts = [F.floor(i / own[m]).cast("long") % size(axes[m]) * stride[axes[m]] for m in range(n)]
        return sum(parts[1:], parts[0]).cast("int")

    places = F.sequence(F.lit(0), F.size(values) - 1)
    wrong = F.raise_error(F.lit("an array's values do not fill its shape"))
    whole = F.aggregate(shape, F.lit(1).cast("long"), lambda p, s: p * s)
    turned = F.when(F.size(values) == 0, values).otherwise(F.transform(places, lambda i: F.get(values, source(i))))
    return F.when((F.size(shape) == n) & (whole == F.size(values)), turned).otherwise(wrong)


def turned_shape(shape: Column, axes: tuple[int, ...] = CONVOLUTION) -> Column:
    return F.array(*(F.get(shape, F.lit(k)) for k in axes))


def renamed(params: DataFrame, names: DataFrame, skip: str = "linear", keep: list[str] | None = None) -> DataFrame:
    """params: name, shape, values, and columns to keep; names: old, new. Parameters under their new names, but for those whose old name holds `skip`; a name that the table lacks ends the job.

    Weights of convolutions, which are neither of a normalisation nor a bias, and of shortcuts are turned, once for each of both reasons, as the names say.
    """
    kept = params.where(~F.col("name").contains(skip)).join(names.select(F.col("old").alias("name"), "new"), "name", "left")
    lost = F.raise_error(F.concat(F.lit("no new name for "), F.col("name"))).cast("string")
    new = F.coalesce("new", lost)
    kept = kept.select(*(keep or []), new.alias("name"), "shape", "values")
    has = lambda part: F.col("name").contains(part)
    for which in (has("conv") & ~has("bn") & ~has("bias"), has("shortcut")):
        kept = kept.select(*(keep or []), "name", F.when(which, turned_shape(F.col("shape"))).otherwise(F.col("shape")).alias("shape"), F.when(which, transposed(F.col("values"), F.col("shape"))).otherwise(F.col("values")).alias("values"))
    return kept
