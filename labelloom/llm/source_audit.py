"""How far the sources of a language differ in their words: distances between sources, and each source's own terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_enough

#: What stands between terms, which are runs of letters and of anything beyond ASCII.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Probabilities are whole numbers of this part of one.
UNIT = 1_000_000_000
#: Documents of a language that hold a term, at least; what is added to each count; terms listed for a source.
MIN_DOCS, ADDED, TOP = 30, 5, 50


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it).

    A row hands out its terms twice, all of them and each once, and one aggregation counts both: no row is shuffled to find
    out which of its terms it holds. The map side combines, so a task sends a row for each term of a group.
    """
    text = F.coalesce("text", F.lit(""))
    # lower() would change letters beyond ASCII; translate() looks every character up in a map
    small = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.split(small, GAP).alias("words"))
    rows = rows.select("lang", "source", F.posexplode(F.array("words", F.array_distinct("words"))).alias("kind", "words"))
    rows = rows.select("lang", "source", "kind", F.explode("words").alias("term")).where("term != ''")
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("kind").cast("long")).alias("n"), F.sum(F.col("kind").cast("long")).alias("docs"))


def _share(count: str, size: str, added: int) -> str:
    """SQL of a smoothed probability; decimals hold the product of any two longs."""
    return f"(1 + cast({UNIT} * cast({count} + {added} as decimal(19,0)) div cast({size} + {added} * vocabulary as decimal(19,0)) as bigint))"


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, added: int = ADDED, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value (long), rank (int): for each (lang, source) its distance to every other source of
    the language (part `pair`: sums over all kept terms of the difference of probabilities, all ranks), and the terms
    that it has more of than the language as a whole (part `term`: the difference, the first `top`).

    A kept term becomes one row with an array of probabilities, a place for each source of its language. Each row emits
    the differences of its pairs of places, and the map side of the aggregation sums them, so a task sends one row for
    each pair of sources. The arrays are as long as a language has sources, and the result has a row for each two of them.
    A hot source is one place of an array: it makes no row longer, and its counts are combined in every task before the shuffle.

    Null text, lang and source count as empty. A group without terms has equal probabilities for all; a language without
    kept terms has pairs at distance 0 and no terms. Repeated rows are documents each; an empty table gives no rows.
    Only text, lang and source are read, whatever else the table has.
    """
    entry = F.struct("source", "n")
    kept = materialize(
        term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(entry)).alias("counts")).where(F.col("docs") >= min_docs).drop("docs"),
        "terms", narrow=True,
    )
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sizes = kept.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = materialize(groups.join(sizes, ["lang", "source"], "left").fillna(0, ["size"]), "sources", narrow=True)
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("total").alias("all_size"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "size"))).alias("sources"))
    langs = materialize(langs.join(vocabulary, "lang", "left").fillna(0), "languages", narrow=True)
    sized = F.broadcast if small_enough(groups) else (lambda df: df)  # langs holds what groups holds

    count = "coalesce(try_element_at(counts, s.source), 0L)"
    wide = kept.join(sized(langs), "lang").withColumn("p", F.expr(f"transform(sources, s -> {_share(count, 's.size', added)})"))

    each = "transform(p, (x, i) -> transform(slice(p, i + 2, size(p)), (y, j) -> struct(i as a, i + 1 + j as b, abs(x - y) as f)))"
    sums = wide.select("lang", F.explode(F.expr(f"flatten({each})")).alias("d")).groupBy("lang", "d.a", "d.b").agg(F.sum("d.f").alias("value"))
    places = "transform(sources, (x, i) -> transform(slice(sources, i + 2, size(sources)), (y, j) -> struct(i as a, i + 1 + j as b)))"
    alike = langs.where("vocabulary = 0").select("lang", F.explode(F.expr(f"flatten({places})")).alias("d")).select("lang", "d.a", "d.b", F.lit(0).cast("long").alias("value"))
    both = sums.unionByName(alike).select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("d"))
    pairs = both.join(sized(langs.select("lang", "sources.source")), "lang").select("lang", F.expr("source[d.own]").alias("source"), F.lit("pair").alias("part"), F.expr("source[d.other]").alias("item"), "value")

    overall = wide.withColumn("q", F.expr(_share("total", "all_size", added)))
    more = F.expr("filter(transform(sources, (s, i) -> struct(s.source as source, p[i] - q as value, try_element_at(counts, s.source) as n)), d -> d.n > 0 and d.value > 0)")
    terms = overall.select("lang", F.col("term").alias("item"), F.explode(more).alias("d")).select("lang", "d.source", F.lit("term").alias("part"), "item", "d.value")
    return _ranked(pairs).unionByName(_ranked(terms).where(F.col("rank") <= top))


def _ranked(rows: DataFrame) -> DataFrame:
    by: list[Column] = [F.col("value").desc(), F.col("item")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by)))
