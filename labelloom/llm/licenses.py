"""License scans by ordered signature rules, in DataFrame operations only.

Rules are regular expressions with a label, a priority and a keyword. A text is first
tried for the words of which every finding holds one; in those that pass, the keywords
it holds pick the rules that are run. Detections that lie within one of at least their priority are
suppressed by a sweep over the sorted intervals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import LEVELS, SIGNATURES, WORD_CHAR, literals, rules

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Words that many rules hold; rules without any of them add their own.
GATE = ("licen", "copyright", "permi", "warrant", "rights", "reserv", "distribut", "reproduc", "domain", "public", "commons", "gpl", "cc0", "software", "apache", "bsd", "perl", "fuck", "mining", "train", "clause", "notice", "unencumbered")
#: What the gate's words don't tell: two letters are in too many words.
GATE_PATTERN = f"(?i)cc{BETWEEN}by"


#: Keywords of the signatures.
SPELLED = frozenset(literals(pattern)[0] for _, _, pattern in SIGNATURES)


def gate_words() -> list[str]:
    """Every match of a rule, and every base phrase, holds one of these in lower case, or a match of GATE_PATTERN; none has a blank, as white space varies."""
    words = set(GATE)
    held = [[k] for _, keyword, pattern, _ in rules() if keyword not in SPELLED and not _always(pattern) for k in keyword.split("|")]
    held += [runs for _, _, pattern in SIGNATURES if not _always(f"({pattern})") for runs in [literals(pattern)]]
    for runs in held:
        if not any(g in run for g in words for run in runs) and runs[0] not in ("cc by", "cc-by"):
            words.add(max(runs[0].split(), key=len))
    return sorted(words)


def _always(pattern: str) -> bool:
    depth = 0
    for i, c in enumerate(pattern):
        depth += (c == "(") - (c == ")")
        if depth == 1 and pattern.startswith(("licen[sc]", "license"), i):
            return True
    return False


def quoted(text: str) -> str:
    """A literal of SQL: large tables of constants are parsed from one text, as each call to build one by itself costs the driver a round trip."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any_in(column: str, words: list[str]) -> str:
    return " or ".join(f"contains({column}, {quoted(w)})" for w in words)


def gated(text: str, low: str) -> Column:
    """Names of the text's column and of the one in lower case."""
    return F.expr(f"{_any_in(low, gate_words())} or rlike({text}, {quoted(GATE_PATTERN)})")


def phrase_pattern(phrase: str) -> str:
    return rf"(?i)(?<!{WORD_CHAR}){BETWEEN.join(phrase.split())}(?!{WORD_CHAR})"


def count_words(text: Column) -> Column:
    """Pieces between separators, but for the empty ones before a first and after a last separator."""
    edges = [F.substring(text, at, 1).rlike(BETWEEN).cast("long") for at in (1, -1)]
    return F.when(text == "", 0).otherwise(F.size(F.split(text, BETWEEN, -1)) - edges[0] - edges[1]).cast("long")


def _rules_of(keywords: Column) -> Column:
    """The rules of these keywords. `keywords` stands outside of any lambda, so it is worked out once a row."""
    by: dict[str, list[str]] = {}
    for rank, (label, keyword, pattern, priority) in enumerate(rules()):
        by.setdefault(keyword, []).append(f"named_struct('label', {quoted(label)}, 'pattern', {quoted(pattern)}, 'priority', {priority}, 'rank', {rank})")
    table = F.expr(f"map({', '.join(f'{quoted(k)}, array({", ".join(own)})' for k, own in by.items())})")
    return F.flatten(F.transform(keywords, lambda k: F.element_at(table, k)))


NO_SPANS = "cast(array() as array<struct<start:int,end:int,label:string,priority:int,rank:int>>)"
#: Elements of a block: a fold that makes an array copies it at every step, so long arrays are folded block by block.
BLOCK = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _in_blocks(values: Column, start: Column, total: Callable[[Column], Column], add: Callable[[Column, Column], Column], fold: Callable[[Column, Column], Column]) -> Column:
    """A fold over an array that is not empty: what stands before each block is start, to which the totals of earlier blocks are added; fold makes an array of a block and that."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))

    def walk(blocks: Column) -> Column:
        first = F.struct(start.alias("at"), F.slice(F.array(start), 2, 1).alias("out"))
        before = F.aggregate(F.transform(blocks, total), first, lambda acc, n: F.struct(add(acc["at"], n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, before, fold))

    return _let(cut, walk)


def _spans(text: Column, rule: Column) -> Column:
    """Every match of the rule: start, end (code points), label, priority."""

    def placed(block: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            span = F.struct(start.alias("start"), (start + x["own"]).alias("end"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["rank"].alias("rank"))
            return F.struct((start + x["own"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), F.expr(NO_SPANS).alias("out")), step, lambda acc: acc["out"])

    def walked(matches: Column) -> Column:
        pieces = F.slice(F.split(text, rule["pattern"], -1), 1, F.size(matches))
        zipped = F.zip_with(matches, pieces, lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("own")))
        length = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["own"])
        return F.when(F.size(matches) > 0, _let(zipped, lambda z: _in_blocks(z, F.lit(0), length, lambda a, n: a + n, placed))).otherwise(F.expr(NO_SPANS))

    return _let(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), walked)


def _suppressed(spans: Column) -> Column:
    """Without spans that lie within another of their priority or more; of equal ones the first rule's stays.

    In order of start and falling end, a span lies within an earlier one exactly if one
    of its priority or more reached as far: one furthest end per priority is kept.
    """
    order = lambda a, b: (
        F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).when(a["priority"] != b["priority"], b["priority"] - a["priority"]).otherwise(a["rank"] - b["rank"])
    )
    levels = [f"upto{n}" for n in range(1, LEVELS + 1)]
    none = F.struct(*(F.lit(-1).alias(c) for c in levels))

    def reach(upto: Column, x: Column) -> Column:
        return F.struct(*(F.when(x["priority"] == n, F.greatest(upto[c], x["end"])).otherwise(upto[c]).alias(c) for n, c in enumerate(levels, 1)))

    def step(acc: Column, x: Column) -> Column:
        upto, reached = acc["upto"], F.lit(-1)
        for n in range(LEVELS, 0, -1):
            reached = F.when(x["priority"] == n, F.greatest(*(upto[c] for c in levels[n - 1 :]), F.lit(-1))).otherwise(reached)
        return F.struct(reach(upto, x).alias("upto"), F.when(reached >= x["end"], acc["out"]).otherwise(F.concat(acc["out"], F.array(x))).alias("out"))

    both = lambda a, b: F.struct(*(F.greatest(a[c], b[c]).alias(c) for c in levels))
    kept = lambda block, upto: F.aggregate(block, F.struct(upto.alias("upto"), F.expr(NO_SPANS).alias("out")), step, lambda acc: acc["out"])
    swept = lambda s: _in_blocks(s, none, lambda block: F.aggregate(block, none, reach), both, kept)
    return F.when(F.size(spans) > 0, _let(F.array_sort(spans, order), swept)).otherwise(F.expr(NO_SPANS))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: the detections that stay, in code points. score: the highest priority found
    over LEVELS, at least 0.5 with a base phrase; 0 without findings. Null and empty
    texts have no words, empty labels and score 0; an empty table gives an empty result. Repeated rows are scanned alike;
    other columns are ignored. Nothing is shuffled.
    """
    keywords = sorted({k for _, k, _, _ in rules()})
    text = F.col("_text")
    spot = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_lower", F.lower(text)).withColumn("_gate", gated("_text", "_lower"))
    when = lambda x: F.when(F.col("_gate"), x)
    counts = {label: F.coalesce(when(F.regexp_count(text, F.lit(phrase_pattern(p)))), F.lit(0)) for label, p in BASE.items()}
    spot = spot.withColumns({"_n_" + label: n for label, n in counts.items()} | {"n_words": count_words(text)})

    def piece(label: str, last: bool) -> Column:
        pieces = F.split(text, phrase_pattern(BASE[label]), -1)
        words = count_words(F.element_at(pieces, -1 if last else 1))
        return F.when(F.col(f"`_n_{label}`") > 0, F.col("n_words") - words - len(BASE[label].split()) if last else words)

    base_labels = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"`_n_{label}`") > 0, label) for label in BASE))))
    held = ", ".join(f"if({_any_in('_low', k.split('|'))}, {quoted(k)}, null)" for k in keywords)
    found = (
        spot.withColumn("_low", when(F.regexp_replace("_lower", r"\s+", " ")))
        .withColumn("_keywords", when(F.expr(f"array_compact(array({held}))")))
        .withColumn("spans", F.coalesce(when(_let(F.flatten(F.transform(_rules_of(F.col("_keywords")), lambda r: _spans(text, r))), _suppressed)), F.expr(NO_SPANS)))
        .withColumn("_base", base_labels)
    )
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["priority"])) / LEVELS, F.lit(0.0))
    return found.select(
        "doc_id", "n_words",
        sum((F.col(f"`_n_{label}`") for label in BASE), F.lit(0)).cast("long").alias("n_base"),
        F.least(*(piece(label, False) for label in BASE)).alias("first_word"),
        F.greatest(*(piece(label, True) for label in BASE)).alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.transform("spans", lambda s: s["label"])))), ",").alias("labels"),
        F.greatest(best, F.when(F.size("_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.transform("spans", lambda s: s.dropFields("rank")).alias("spans"),
    )
