"""Mixing sources to target weights through a domain-language-source tree, in DataFrame operations only.

A budget of tokens goes down the tree: at every node it is shared among the children by
weight, up to what each child's leaves can give (their tokens times max_epochs); what a
short child can't take goes to its siblings, and only what a whole subtree can't take is
shared anew one level up. All shares are integers and add up exactly.

A leaf's target is some full epochs and a token prefix of one more, whose order is a
seeded hash of epoch and document. The prefix is found by token sums of hash ranges; only
the one range per leaf that the prefix ends in is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked_join, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one hash range of a leaf holds, about.
RANGE_ROWS = 2048


@dataclass(frozen=True)
class Mix:
    """weights: of tree paths joined by '/', integers; a path that is not listed has default_weight, 0 leaves a subtree out.

    budget: tokens to take, or None for budget_percent of all.
    """

    weights: dict[str, int] = field(default_factory=dict)
    default_weight: int = 1
    budget: int | None = None
    budget_percent: int = 60
    max_epochs: int = 4
    seed: int = 1


def _fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes: path, weight, cap, and total, what the siblings under `parent` share; adds target."""
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = siblings.orderBy("_ratio", "path")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    d = lambda c: F.col(c).cast("decimal(19,0)")
    nodes = (
        nodes.withColumn("_ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(0.0))
        .withColumn("_total_left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("_weight_left", F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_full", (d("cap") * d("_weight_left") <= d("weight") * d("_total_left")).cast("int"))
        .withColumn("_full", F.min("_full").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total_left", F.col("total") - F.coalesce(F.sum(F.when(F.col("_full") == 1, F.col("cap"))).over(siblings), F.lit(0)))
        .withColumn("_weight_left", F.sum(F.when(F.col("_full") == 0, F.col("weight"))).over(siblings))
        .withColumn("_share", F.when(F.col("_full") == 1, F.col("cap")).otherwise(F.expr("(cast(weight as decimal(19,0)) * cast(_total_left as decimal(19,0))) div _weight_left")))
        .withColumn("_over", F.col("_total_left") - F.sum(F.when(F.col("_full") == 0, F.col("_share"))).over(siblings))
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*(parent or [F.lit(0)]), "_full").orderBy("path")))
    )
    target = F.col("_share") + F.when((F.col("_full") == 0) & (F.col("_rank") <= F.col("_over")), 1).otherwise(0)
    return nodes.withColumn("target", target.cast("long")).drop("_ratio", "_total_left", "_weight_left", "_full", "_share", "_over", "_rank")


def _weight(path: Column, mix: Mix) -> Column:
    if not mix.weights:
        return F.lit(mix.default_weight).cast("long")
    listed = F.create_map(*(F.lit(x) for pair in mix.weights.items() for x in pair))
    return F.coalesce(F.element_at(listed, path), F.lit(mix.default_weight)).cast("long")


def targets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: domain, lang, source, tokens (materialized). Adds target, full_epochs and rest, the tokens of the last epoch's prefix."""
    budget = F.lit(mix.budget if mix.budget is not None else (leaves.agg(F.sum("tokens")).first()[0] or 0) * mix.budget_percent // 100).cast("long")
    paths = {
        "domain": F.col("domain"),
        "lang": F.concat_ws("/", "domain", "lang"),
        "source": F.concat_ws("/", "domain", "lang", "source"),
    }
    weighed = leaves.withColumn("_w", F.least(*(_weight(p, mix) for p in paths.values())))
    # a leaf below a node of weight 0 gives nothing
    caps = weighed.withColumn("cap", F.when(F.col("_w") > 0, F.col("tokens") * mix.max_epochs).otherwise(0).cast("long")).withColumn("budget", budget)
    by_domain = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.first("budget").alias("total"))
    by_lang = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))

    def level(nodes: DataFrame, name: str, parent: list[str]) -> DataFrame:
        return _fill(nodes.withColumn("path", paths[name]).withColumn("weight", F.when(F.col("cap") > 0, _weight(F.col("path"), mix)).otherwise(F.lit(0)).cast("long")), parent)

    domains = level(by_domain, "domain", []).select("domain", F.col("target").alias("total"))
    langs = level(by_lang.join(domains, "domain"), "lang", ["domain"]).select("domain", "lang", F.col("target").alias("total"))
    filled = level(caps.select("domain", "lang", "source", "tokens", "docs", "cap").join(langs, ["domain", "lang"]), "source", ["domain", "lang"])
    return filled.select(
        "domain", "lang", "source", "tokens", "docs", "target",
        F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(0).cast("long").alias("full_epochs"),
        F.when(F.col("tokens") > 0, F.expr("target % tokens")).otherwise(0).cast("long").alias("rest"),
    )


def _order(seed: int, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc))


def _range(order: Column, docs: Column) -> Column:
    """The hash range of an order key; a leaf has about docs / RANGE_ROWS of them, a power of two."""
    bits = F.least(F.lit(31), F.greatest(F.lit(0), F.ceil(F.log2(docs / RANGE_ROWS)).cast("int")))
    return F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") / F.pow(F.lit(2.0), 32 - bits)).cast("long")


def mix_sources(docs: DataFrame, mix: Mix, domain: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs with a struct column _mix: domain, lang, source, n_tokens, full_epochs, tail_tokens, copies.

    tail_tokens: how many of the document's tokens the last, partial epoch takes; only
    the document that a leaf's prefix ends in is cut. copies: full_epochs, plus one if
    tail_tokens is not 0. Tokens are words between white space. Null domain, language
    or source count as the leaf 'none'; null texts have no tokens. Rows without an id are
    told apart by their texts, equal ids in a leaf are ordered by theirs; equal rows are
    interchangeable. An empty table gives an empty result. Columns of docs stay, whatever
    their names, but for one called _mix, which is replaced.
    """
    named = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    leaf = ["_m_domain", "_m_lang", "_m_source"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(f"`{c}`") for c in docs.columns if c != "_mix"]
    # the columns of docs go along in a struct, so that none clashes with those made here
    rows = docs.select(
        F.struct(*own).alias("_row"), named(domain).alias(leaf[0]), named(F.col(lang_col)).alias(leaf[1]), named(F.col(source_col)).alias(leaf[2]),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("_m_tokens"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("none:"), F.md5(text))).alias("_m_doc"), F.md5(text).alias("_m_tie"),
    )
    narrow = materialize(rows.select(F.col("_m_doc").alias("doc"), *leaf, "_m_tokens"), "token-counts", narrow=True)
    sizes = materialize(
        narrow.groupBy(*(F.col(c).alias(c[3:]) for c in leaf)).agg(F.sum("_m_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "leaf-sizes"
    )
    shares = materialize(targets(sizes, mix).select(*(F.col(c[3:]).alias(c) for c in leaf), "docs", "full_epochs", "rest"), "leaf-targets")
    order = _order(mix.seed, F.col("full_epochs"), F.col("doc"))
    sums = checked_join(narrow, shares, leaf, "inner").withColumn("_m_range", _range(order, F.col("docs"))).groupBy(*leaf, "_m_range").agg(F.sum("_m_tokens").alias("n"), F.first("rest").alias("rest"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*leaf).orderBy("_m_range")))
    # the range in which the prefix ends; none if it is empty
    edge = upto.where("rest > 0 and upto >= rest and upto - n < rest").select(*leaf, F.col("_m_range").alias("_m_edge"), (F.col("upto") - F.col("n")).alias("_m_before"))
    plan = materialize(
        shares.join(edge, leaf, "left").select(*leaf, F.col("docs").alias("_m_docs"), F.col("full_epochs").alias("_m_epochs"), F.col("rest").alias("_m_rest"), F.coalesce("_m_edge", F.lit(-1)).alias("_m_edge"), F.coalesce("_m_before", F.lit(0)).alias("_m_before")),
        "leaf-plan",
    )
    placed = checked_join(rows, plan, leaf, "inner").withColumn("_m_order", _order(mix.seed, F.col("_m_epochs"), F.col("_m_doc")))
    placed = placed.withColumn("_m_range", _range(F.col("_m_order"), F.col("_m_docs")))
    clear = placed.where("_m_range != _m_edge").withColumn("_m_tail", F.when(F.col("_m_range") < F.col("_m_edge"), F.col("_m_tokens")).otherwise(F.lit(0)))
    last = Window.partitionBy(*leaf).orderBy("_m_order", "_m_tie").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.where("_m_range = _m_edge").withColumn("_m_start", F.col("_m_before") + F.coalesce(F.sum("_m_tokens").over(last), F.lit(0)))
    cut = cut.withColumn("_m_tail", F.greatest(F.lit(0), F.least(F.col("_m_tokens"), F.col("_m_rest") - F.col("_m_start")))).drop("_m_start")
    result = F.struct(
        F.col("_m_domain").alias("domain"), F.col("_m_lang").alias("lang"), F.col("_m_source").alias("source"), F.col("_m_tokens").alias("n_tokens"),
        F.col("_m_epochs").alias("full_epochs"), F.col("_m_tail").cast("long").alias("tail_tokens"),
        (F.col("_m_epochs") + (F.col("_m_tail") > 0).cast("long")).alias("copies"),
    )
    return clear.unionByName(cut).select("_row.*", result.alias("_mix"))


def prefix(text: Column, tokens: Column) -> Column:
    """The text up to the end of so many words, with the white space between them as it is."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), tokens.cast("int")), "")


def mixed(docs: DataFrame, mix: Mix, domain: Column, text_col: str = "text", **columns: str) -> DataFrame:
    """The mixture itself: every row of docs as often as mix_sources() takes it, so that every leaf gives its target to the token.

    The last copy of the document that a leaf's prefix ends in has its first tail_tokens words.
    """
    taken = mix_sources(docs, mix, domain, text_col=text_col, **columns)
    taken = taken.select("*", F.explode(F.expr("sequence(1L, greatest(_mix.copies, 1L))")).alias("_copy")).where("_mix.copies > 0")
    ends = (F.col("_copy") > F.col("_mix.full_epochs")) & (F.col("_mix.tail_tokens") < F.col("_mix.n_tokens"))
    whole = F.col(f"`{text_col}`")
    return taken.withColumn(text_col, F.when(ends, prefix(whole, F.col("_mix.tail_tokens"))).otherwise(whole)).select(*(f"`{c}`" for c in docs.columns if c != "_mix"))
