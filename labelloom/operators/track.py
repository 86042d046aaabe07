"""Tracked values of training: moving averages, best so far, upserts of statistics, losses, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def moving_average(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.95) -> DataFrame:
    """old * alpha + new * (1 - alpha), seeded by the first value: key, steps, ema after the last.

    The value that is k steps from the last weighs alpha to the k, all but the first times 1 - alpha: a sum, so no row holds a key's history.
    """
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(value))) - 1
    ranked = rows.select(key, F.col(value).cast("double").alias("_v"), last.alias("_k"))
    ranked = ranked.withColumn("_first", F.lead("_k").over(Window.partitionBy(key).orderBy("_k")).isNull())
    weight = F.pow(F.lit(alpha), F.col("_k")) * F.when(F.col("_first"), 1.0).otherwise(1 - alpha)
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("steps"), F.sum(weight * F.col("_v")).alias("ema"))


def best_so_far(rows: DataFrame, key: str, order: str, value: str, largest: bool = True) -> DataFrame:
    """Whether each row is the best of its key up to itself, ties included; a strict comparison with a history that holds the row is never true."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    best = (F.max if largest else F.min)(value).over(w)
    return rows.withColumns({"best": best, "is_best": F.col(value) == best})


def upsert_stats(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Old values win."""
    o, n = old.select(*keys, F.col(value).alias("_o")), new.select(*keys, F.col(value).alias("_n"))
    return o.join(n, keys, "full_outer").select(*keys, F.coalesce("_o", "_n").alias(value))


def cross_entropy(p: Column, truth: Column) -> Column:
    """Mean over rows of -truth * ln p, p clamped away from 0 and 1; classes are rows."""
    return -F.log(F.least(F.greatest(p, F.lit(10e-8)), F.lit(1 - 10e-8))) * truth


def dice_loss(truth: str, guess: str, smooth: float = 1e-3) -> Column:
    return 1.0 - (2.0 * F.sum(F.col(truth) * F.col(guess)) + smooth) / (F.sum(truth) + F.sum(guess) + smooth)


def squared_error(truth: str, guess: str) -> Column:
    return F.avg((F.col(guess) - F.col(truth)) * (F.col(guess) - F.col(truth)))


def step_rate(epoch: Column, rate: float = 1e-4, every: int = 25, factor: float = 0.1) -> Column:
    return F.lit(rate) * F.pow(F.lit(factor), F.floor(epoch / every))


def cross_entropy_classes(truth: Column, guess: Column) -> Column:
    """Of arrays over classes: guesses scaled to sum to 1, clamped away from 0 and 1, -sum of truth * ln guess."""
    total = F.aggregate(guess, F.lit(0.0), lambda s, p: s + p)
    logs = F.transform(guess, lambda p: F.log(F.least(F.greatest(p / total, F.lit(10e-8)), F.lit(1 - 10e-8))))
    return -F.aggregate(F.zip_with(truth, logs, lambda t, g: t * g), F.lit(0.0), lambda s, x: s + x)


def dice_losses(channels: list[tuple[str, str]], smooth: float = 1e-3) -> Column:
    """Sum of the channels' losses; a channel is a column of truth and one of guesses."""
    return sum((dice_loss(t, p, smooth) for t, p in channels), F.lit(0.0))


def gradient_error(first: DataFrame, second: DataFrame, focus: Column) -> DataFrame:
    """Per image, of the differences between truth and guess in two channels (image_id, y, x, v): the first's change along y, the second's along x,
    squared, summed where focus is 1 and divided by twice its sum."""
    from .raster import gradient_weights, stencil

    along_y, along_x = gradient_weights()
    d = stencil(first, along_y).withColumnRenamed("out", "a").join(stencil(second, along_x).withColumnRenamed("out", "b"), ["image_id", "y", "x"])
    return d.groupBy("image_id").agg((F.sum(focus * (F.col("a") * F.col("a") + F.col("b") * F.col("b"))) / (2 * F.sum(focus) + 1e-8)).alias("loss"))


def weighted_total(terms: DataFrame, weights: DataFrame) -> DataFrame:
    """terms: step, branch, loss, value; weights: branch, loss, weight. step, total; terms without a weight count nothing. Catalyst sizes weights, and broadcasts a handful."""
    return terms.join(weights, ["branch", "loss"]).groupBy("step").agg(F.sum(F.col("weight") * F.col("value")).alias("total"))


def fixed_histogram(rows: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """keys, bin (from 0), n: counts of values in bins of equal width over [low, high], empty bins too.

    The last bin holds high itself; values outside, NULL and NaN are in none. A key has all its bins, even if no value falls in any.
    Counts of parts of the rows add up to those of all: merged_histogram().
    """
    share = (F.col(value).cast("double") - low) / (high - low)
    at = F.when((share >= 0) & (share <= 1), F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int"))
    counts = rows.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # the keys are a partial aggregation of what was counted, not of the rows
    every = counts.groupBy(*keys).agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))).alias("_"), F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))).alias("_c"))
    found = F.map_from_entries("_c")
    each = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(b.cast("int").alias("bin"), F.coalesce(F.try_element_at(F.col("_m"), b.cast("int")), F.lit(0)).cast("long").alias("n")))
    return every.withColumn("_m", found).select(*keys, F.explode(each).alias("h")).select(*keys, "h.bin", "h.n")


def merged_histogram(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms of the same bins, of parts of the rows, as one: keys, bin, n."""
    return parts.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def gradient_flow(rows: DataFrame) -> DataFrame:
    """layer, value of gradients: mean and largest absolute value of every layer but biases."""
    return rows.where(~F.col("layer").contains("bias")).groupBy("layer").agg(F.avg(F.abs("value")).alias("mean_abs"), F.max(F.abs("value")).alias("max_abs"))


def flattened(outputs: DataFrame, engine: str) -> DataFrame:
    """outputs: epoch, kind, values (map of name to number). epoch, kind, name '<engine>-<name>', value; names without a value are left out."""
    rows = outputs.select("epoch", "kind", F.explode("values").alias("name", "value")).where("value is not null")
    return rows.select("epoch", "kind", F.concat_ws("-", F.lit(engine), "name").alias("name"), "value")


def serialised(rows: DataFrame, how: str) -> DataFrame:
    """flattened() rows as they are written: 'console' has text with five places, 'json' the numbers; only scalars go there."""
    scalars = rows.where("kind = 'scalar'")
    if how == "console":
        return scalars.withColumn("value", F.format_string("%.5f", F.col("value").cast("double")))
    if how == "json":
        return scalars
    raise ValueError(f"no such format: {how}")


def confusion_long(wide: DataFrame, key: str, columns: dict[str, int]) -> DataFrame:
    """True, Pred and value of a wide table with a column for each predicted type."""
    pairs = F.array(*(F.struct(F.lit(k).alias("Pred"), F.col(c).alias("value")) for c, k in columns.items()))
    return wide.select(F.col(key).alias("True"), F.explode(pairs).alias("p")).select("True", "p.Pred", "p.value")


def accumulated(steps: list[DataFrame]) -> DataFrame:
    """The outputs of several steps, one after another; columns that a step lacks are NULL."""
    out = steps[0]
    for more in steps[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def saves(rows: DataFrame, key: str, order: str, value: str, comparator: str) -> DataFrame:
    """Whether each row is to be saved: its value compares so with the best of its key up to itself. The history holds the row, so '>' and '<' never do."""
    if comparator not in (">", "<", ">=", "<="):
        raise ValueError(f"no such comparator: {comparator}")
    best = best_so_far(rows, key, order, value, largest=comparator[0] == ">")
    return best.withColumn("is_best", F.col("is_best") if len(comparator) == 2 else F.lit(False))


def every(rows: DataFrame, order: str, period: int) -> DataFrame:
    """Rows at which a periodic save is due."""
    return rows.where(F.col(order) % period == 0)


def last_epoch(stats: DataFrame, order: str = "epoch") -> DataFrame:
    """One row: the last epoch of the statistics."""
    return stats.agg(F.max(order).alias(order))


def with_epoch(stats: DataFrame, epochs: DataFrame, metric: str) -> DataFrame:
    """epochs (epoch) with the value of one metric; NULL where there is none."""
    return epochs.join(stats.where(F.col("metric") == metric).select("epoch", "value"), "epoch", "left")
