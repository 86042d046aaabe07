"""Segmentation metrics over a contingency table of label maps.

One shuffle by (image, true, predicted) counts overlaps; all else works on that small
table. Undefined ratios are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-6


def located(truth: DataFrame, guess: DataFrame) -> DataFrame:
    """Two sparse label maps (image_id, y, x, inst_id) joined by place: image_id, y, x, true_id, pred_id, 0 where one has no object.

    Images of guess alone or of truth alone are there as well; see missing_truth().
    """
    side = lambda df, name: df.select("image_id", "y", "x", F.col("inst_id").alias(name))
    both = side(truth, "true_id").join(side(guess, "pred_id"), ["image_id", "y", "x"], "full_outer")
    return both.select("image_id", "y", "x", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("true_id", "pred_id")))


def by_stem(truth: DataFrame, guess: DataFrame, path: str = "path") -> DataFrame:
    """Files of predictions with the truth of the same stem: stem, true_path, pred_path. A prediction without a truth ends the job."""
    from labelloom.functions.scalar import stem

    side = lambda df, name: df.select(stem(F.col(path)).alias("stem"), F.col(path).alias(name))
    joined = side(guess, "pred_path").join(side(truth, "true_path"), "stem", "left")
    found = F.when(F.col("true_path").isNull(), F.raise_error(F.concat(F.lit("no truth for "), F.col("pred_path")))).otherwise(F.col("true_path"))
    return joined.select("stem", found.cast("string").alias("true_path"), "pred_path")


def missing_truth(truth: DataFrame, guess: DataFrame) -> DataFrame:
    """Images that guess has and truth lacks."""
    return guess.select("image_id").distinct().join(truth.select("image_id").distinct(), "image_id", "left_anti")


def contingency(pixels: DataFrame) -> DataFrame:
    """image_id, true_id, pred_id, n; background is 0."""
    return pixels.groupBy("image_id", "true_id", "pred_id").agg(F.count(F.lit(1)).alias("n"))


def measured(table: DataFrame) -> DataFrame:
    """The table with what all metrics need: areas, union, iou, and flags t_first, p_first (one row of each object), best (the object's best match),
    t_alone, p_alone (objects without one).

    The table is dealt out by image once; its rows are pairs of objects, and windows over objects of an image need no further shuffle.
    """
    by = lambda *c: Window.partitionBy("image_id", *c)
    pair = (F.col("true_id") > 0) & (F.col("pred_id") > 0)
    t = table.repartition("image_id")
    t = t.withColumns({"true_area": F.sum("n").over(by("true_id")), "pred_area": F.sum("n").over(by("pred_id"))})
    t = t.withColumn("union_area", F.col("true_area") + F.col("pred_area") - F.col("n"))
    share = F.when(pair, F.col("n") / (F.col("union_area") + EPS)).otherwise(-1.0)
    t = t.withColumns({
        "iou": F.when(pair, F.col("n") / F.col("union_area")), "t_first": (F.row_number().over(by("true_id").orderBy("pred_id")) == 1) & (F.col("true_id") > 0),
        "p_first": (F.row_number().over(by("pred_id").orderBy("true_id")) == 1) & (F.col("pred_id") > 0), "best": pair & (F.row_number().over(by("true_id").orderBy(F.desc(share), "pred_id")) == 1),
    })
    chosen = F.max(F.col("best").cast("int"))
    return t.withColumns({"t_alone": F.col("t_first") & (chosen.over(by("true_id")) == 0), "p_alone": F.col("p_first") & (chosen.over(by("pred_id")) == 0)})


def per_image(table: DataFrame, match_iou: float = 0.5) -> DataFrame:
    """image_id, dice1, dice2, aji, tp, fp, fn, dq, sq, pq in one pass over measured()."""
    if match_iou < 0.5:
        raise ValueError("below 0.5 pairs need an assignment: see matching.assigned_pairs")
    t, p = F.col("true_id") > 0, F.col("pred_id") > 0
    s = lambda c, v="n": F.sum(F.when(c, F.col(v)).otherwise(0))
    count = lambda c: F.sum(c.cast("int"))
    hit = F.coalesce(F.col("iou") > match_iou, F.lit(False))
    sums = measured(table).groupBy("image_id").agg(
        F.try_divide(2 * s(t & p), s(t) + s(p)).alias("dice1"),
        F.try_divide(2 * s(t & p), s(t & p, "true_area") + s(t & p, "pred_area")).alias("dice2"),
        F.try_divide(s(F.col("best")), s(F.col("best"), "union_area") + s(F.col("t_alone"), "true_area") + s(F.col("p_alone"), "pred_area")).alias("aji"),
        count(hit).alias("tp"), (count(F.col("p_first")) - count(hit)).alias("fp"), (count(F.col("t_first")) - count(hit)).alias("fn"),
        (F.coalesce(F.sum(F.when(hit, F.col("iou"))), F.lit(0.0)) / (count(hit) + EPS)).alias("sq"),
    )
    dq = F.try_divide(F.col("tp").cast("double"), F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn"))
    return sums.withColumn("dq", dq).withColumn("pq", F.col("dq") * F.col("sq")).select("image_id", "dice1", "dice2", "aji", "tp", "fp", "fn", "dq", "sq", "pq")


def overlaps(table: DataFrame) -> DataFrame:
    """Overlapping pairs of objects: inter, true_area, pred_area, union_area, iou. Areas are sums over the table, not over pixels."""
    t, p = Window.partitionBy("image_id", "true_id"), Window.partitionBy("image_id", "pred_id")
    both = table.repartition("image_id").withColumns({"true_area": F.sum("n").over(t), "pred_area": F.sum("n").over(p)}).where("true_id > 0 and pred_id > 0")
    union = F.col("true_area") + F.col("pred_area") - F.col("n")
    return both.select("image_id", "true_id", "pred_id", F.col("n").alias("inter"), "true_area", "pred_area", union.alias("union_area"), (F.col("n") / union).alias("iou"))


def dice1(table: DataFrame) -> DataFrame:
    """2 |T and P| / (|T| + |P|) of the foregrounds."""
    t, p = F.col("true_id") > 0, F.col("pred_id") > 0
    s = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return table.groupBy("image_id").agg(F.try_divide(2 * s(t & p), s(t) + s(p)).alias("dice1"))


def dice2(pairs: DataFrame) -> DataFrame:
    """2 * overlap / (both areas), summed over overlapping pairs."""
    return pairs.groupBy("image_id").agg(F.try_divide(2 * F.sum("inter"), F.sum(F.col("true_area") + F.col("pred_area"))).alias("dice2"))


def aji(table: DataFrame) -> DataFrame:
    """Overlap of every true object with its best match over their unions and the areas of all objects without one; a predicted object may serve several."""
    return per_image(table).select("image_id", "aji")


def pq(table: DataFrame, match_iou: float = 0.5) -> DataFrame:
    """Above one half pairs are unique, so a filter is the assignment."""
    return per_image(table, match_iou).select("image_id", "tp", "fp", "fn", "dq", "sq", "pq")


def with_chosen(table: DataFrame, chosen: DataFrame) -> DataFrame:
    """measured(), with `best` set by chosen 1-1 pairs (image_id, true_id, pred_id) instead."""
    marked = table.join(chosen.select("image_id", "true_id", "pred_id", F.lit(True).alias("_c")), ["image_id", "true_id", "pred_id"], "left")
    by = lambda *c: Window.partitionBy("image_id", *c)
    own = measured(marked).withColumn("best", F.coalesce("_c", F.lit(False))).drop("_c")
    any_ = F.max(F.col("best").cast("int"))
    return own.withColumns({"t_alone": F.col("t_first") & (any_.over(by("true_id")) == 0), "p_alone": F.col("p_first") & (any_.over(by("pred_id")) == 0)})


def chosen_ratio(table: DataFrame, chosen: DataFrame, name: str) -> DataFrame:
    """Overlap of chosen pairs over their unions and the areas of all objects without a pair."""
    s = lambda c, v: F.sum(F.when(F.col(c), F.col(v)).otherwise(0))
    ratio = F.try_divide(s("best", "n"), s("best", "union_area") + s("t_alone", "true_area") + s("p_alone", "pred_area"))
    return with_chosen(table, chosen).groupBy("image_id").agg(ratio.alias(name))


def chosen_panoptic(table: DataFrame, chosen: DataFrame) -> DataFrame:
    """tp, fp, fn, dq, sq, pq of chosen 1-1 pairs."""
    count = lambda c: F.sum(F.col(c).cast("int"))
    x = with_chosen(table, chosen).groupBy("image_id").agg(
        count("best").alias("tp"), (count("p_first") - count("best")).alias("fp"), (count("t_first") - count("best")).alias("fn"),
        (F.coalesce(F.sum(F.when(F.col("best"), F.col("iou"))), F.lit(0.0)) / (count("best") + EPS)).alias("sq"),
    )
    dq = F.try_divide(F.col("tp").cast("double"), F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn"))
    return x.withColumn("dq", dq).select("image_id", "tp", "fp", "fn", "dq", "sq", (F.col("dq") * F.col("sq")).alias("pq"))


#: The type of true objects that nobody has judged, where annotation is not exhaustive.
UNJUDGED = -1


def pair_f1(kind: Column, weights: tuple[float, float, float, float] = (2, 2, 1, 1), exhaustive: bool = True) -> Column:
    """Aggregate: F1 of one type over pairs and unpaired rows (true_type, pred_type; null where unpaired), without the term that is always zero.

    Where annotation is not exhaustive, pairs whose truth is UNJUDGED are no false ones.
    """
    t, p = F.col("true_type"), F.col("pred_type")
    c = lambda x: F.sum(F.when(x, 1).otherwise(0))
    paired = t.isNotNull() & p.isNotNull()
    wrong = paired & (t != kind) & (p == kind)
    tp, fp_dt, fn_dt = c(paired & (t == kind) & (p == kind)), c(wrong if exhaustive else wrong & (t != UNJUDGED)), c(paired & (t == kind) & (p != kind))
    fp_d, fn_d = c(t.isNull() & (p == kind)), c(p.isNull() & (t == kind))
    w = weights
    return F.try_divide((2 * tp).cast("double"), 2 * tp + w[0] * fp_dt + w[1] * fn_dt + w[2] * fp_d + w[3] * fn_d)


def detection_scores(exhaustive: bool = True) -> list[Column]:
    """Aggregates f1_d and acc_type over all rows of pairs."""
    t, p = F.col("true_type"), F.col("pred_type")
    c = lambda x: F.sum(F.when(x, 1).otherwise(0))
    tp = c(t.isNotNull() & p.isNotNull())
    judged = tp if exhaustive else tp - c(p.isNotNull() & (t == UNJUDGED))
    return [F.try_divide((2 * tp).cast("double"), 2 * tp + c(t.isNull()) + c(p.isNull())).alias("f1_d"), F.try_divide(c(t == p).cast("double"), judged).alias("acc_type")]


def detection(pairs: DataFrame, exhaustive: bool = True) -> DataFrame:
    return pairs.agg(*detection_scores(exhaustive))
