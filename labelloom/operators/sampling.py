"""Orders, batches and samples by seeded digests of keys: the same rows whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def digest(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def numbered(df: DataFrame, order: Column, name: str = "rank", digits: int = 3) -> DataFrame:
    """Rows numbered from 0 by a key of hexadecimal digits. Ranges of its first digits are counted first, so no task ranks all rows."""
    rows = df.withColumns({"_o": order, "_g": F.substring(order, 1, digits)})
    counts = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_g")) - F.col("_c")).drop("_c")
    rank = F.row_number().over(Window.partitionBy("_g").orderBy("_o")) - 1
    return rows.withColumn("_r", rank).join(before, "_g").withColumn(name, F.col("_r") + F.col("_before")).drop("_o", "_g", "_r", "_before")


def shuffled(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """df with `rank`, its place in a seeded order."""
    return numbered(df, digest(seed, key))


def batches(ranked: DataFrame, size: int, total: int | None = None) -> DataFrame:
    """ranked rows with their batch and place in it; total: of all rows, if a last batch that is not full is to be dropped."""
    out = ranked.withColumns({"batch": F.expr(f"rank div {size}"), "place": F.col("rank") % size})
    return out if total is None else out.where(F.col("batch") < total // size)


def training_order(df: DataFrame, key: Column, size: int, seed: int, train: bool) -> DataFrame:
    """Batches of a run: shuffled and full ones for training, for which rows are counted first; in the order of keys, all of them, otherwise.

    Keys are numbers or texts; rows without a key come first.
    """
    if train:
        return batches(numbered(df, digest(seed, F.coalesce(key.cast("string"), F.lit("")))), size, df.count())
    return batches(numbered(df, F.coalesce(in_order(df, key), F.lit("")), digits=13), size)


def in_order(df: DataFrame, key: Column) -> Column:
    """Hexadecimal digits that sort as the key does: its bytes for a text, for a whole number itself with the sign turned."""
    kind = df.select(key).schema[0].dataType.simpleString()
    if kind == "string":
        return F.hex(F.encode(key, "UTF-8"))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.lpad(F.hex(key.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    raise ValueError(f"keys are whole numbers or texts, not {kind}")


def drawn(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """n rows with replacement, as `draw` 0 to n - 1: seeded places joined to seeded ranks. Rows are counted first."""
    share = F.conv(F.substring(digest(seed + 1, F.col("id")), 1, 8), 16, 10).cast("double") / 4294967296.0
    places = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(share * df.count()).alias("rank"))
    return shuffled(df, key, seed).join(places, "rank").drop("rank")
