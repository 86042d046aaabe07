"""Quality rules: base counts, and the divergence of a document from the references of its language.

Two histograms of a document, of character classes and of the language's common words,
are held against those of all documents in its language by Jensen-Shannon distance
(square root, base 2). Each test has a guard: short texts are not judged by it.
References are counted over the whole corpus in one pass with partial sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_id, as_key, materialize, small_batches

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "beyond")
#: Marks keys of character classes among words, which never hold white space.
_CLASS = "\n"
FLUSH = 100_000


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat_percent: base rules. The rest: guards and limits of the divergence tests.

    The limit on common words is max_word_distance + word_slack / sqrt(words), since a
    short text's shares stray further from its language's by chance. reference_chars: code points of other documents that a language's reference
    has at least; under that a document would be its own judge, and is held against the nearest other reference. most_references: a language needs
    that part of all code points to have a reference, so that there are no more of them, whatever the column holds. max_languages: None
    keeps the references of all such languages.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    guard_chars: int = 400
    max_class_distance: float = 0.3
    guard_words: int = 60
    max_word_distance: float = 0.62
    word_slack: float = 1.2
    common_words: int = 64
    reference_chars: int = 800
    most_references: int = 2000
    max_languages: int | None = None


def _class_table() -> np.ndarray:
    """For each byte of UTF-8 its class, -1 for bytes that go on a code point."""
    of = np.full(256, CLASSES.index("mark"), np.int8)
    of[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    of[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    of[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    of[list(SPACES)] = CLASSES.index("space")
    of[list(b".,;:'\"-")] = CLASSES.index("stop")
    of[list(SYMBOLS)] = CLASSES.index("symbol")
    of[0x80:0xC0] = -1
    of[0xC0:] = CLASSES.index("beyond")
    return of


_OF = _class_table()
_MEMBER = np.stack([_OF == c for c in range(len(CLASSES))], axis=1).astype(np.int64)


def byte_counts(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def repeat_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words that stand in windows of `width` words which occur twice or more."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    window = np.zeros(n, np.uint64)
    for i in range(width):
        window = window * np.uint64(0x9E3779B97F4A7C15) + (hashes[i : i + n] ^ (hashes[i : i + n] >> np.uint64(29)))
    ordered = np.sort(window)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    edges = np.zeros(len(hashes) + 1, np.int64)
    twice = np.flatnonzero(counts[inverse] > 1)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, of counts or shares; rows without counts are at distance 0."""
    p, q = (x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300) for x in (p.astype(float), q.astype(float)))
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    none = (p.sum(axis=1) == 0) | (q.sum(axis=1) == 0)
    return np.where(none, 0.0, np.sqrt(np.clip(parts / 2, 0, 1)))


def _counting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: dict[str, Counter] = {}
    bytes_of: dict[str, np.ndarray] = {}

    def flush() -> pd.DataFrame:
        rows = [(lang, w.decode(), n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, f"{_CLASS}{k}", int(n)) for lang, b in bytes_of.items() for k, n in zip(CLASSES, b @ _MEMBER, strict=True) if n]
        words.clear()
        bytes_of.clear()
        return pd.DataFrame(rows, columns=["lang", "key", "n"])

    for rows in batches:
        for lang, text in zip(rows["lang"], rows["text"], strict=True):
            data = text.encode()
            words.setdefault(lang, Counter()).update(data.split())
            bytes_of[lang] = bytes_of.get(lang, 0) + byte_counts(data)
        if sum(map(len, words.values())) > FLUSH:
            yield flush()
    yield flush()


@dataclass
class Reference:
    classes: np.ndarray
    words: list[bytes]
    counts: np.ndarray


def references(docs: DataFrame, rules: Rules) -> dict[str, Reference]:
    """By language, about 72 rows of each, for at most most_references languages; those of the max_languages largest, if that is set. Under None, that of rows without a language, if no row has one."""
    counted = small_batches(docs).mapInPandas(_counting, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    is_class = F.col("key").startswith(_CLASS)
    order = Window.partitionBy("lang", "is_class").orderBy(F.desc("n"), "key")
    top = materialize(
        counted.withColumn("is_class", is_class).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(rules.common_words, len(CLASSES))),
        "language-references",
    )
    sizes = top.where("is_class").groupBy("lang").agg(F.sum("n").alias("size"))
    total = top.where("is_class").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = top.where("lang is not null").join(sizes.where(F.col("size") * rules.most_references >= total), "lang", "left_semi")
    if rules.max_languages is not None:
        size = known.where("is_class").groupBy("lang").agg(F.sum("n").alias("size"))
        known = known.join(F.broadcast(size.orderBy(F.desc("size"), "lang").limit(rules.max_languages)), "lang")
    rows = known.select("lang", "key", "n").collect() or top.select("lang", "key", "n").collect()
    own_rows: dict[str | None, dict[str, int]] = {}
    for r in rows:
        own_rows.setdefault(r.lang, {})[r.key] = r.n
    found: dict[str | None, Reference] = {}
    for lang, own in own_rows.items():
        words = sorted((k for k in own if not k.startswith(_CLASS)), key=lambda k: (-own[k], k))[: rules.common_words]
        classes = np.array([own.get(f"{_CLASS}{c}", 0) for c in CLASSES])
        found[lang] = Reference(classes, [w.encode() for w in words], np.array([own[w] for w in words], np.int64))
    return found


class Nearest:
    """All references, to find the one that a text of no known language is nearest to."""

    def __init__(self, refs: dict[str | None, Reference], rules: Rules):
        self.langs = sorted(refs, key=str)
        self.at = {w: i for i, w in enumerate(sorted({w for r in refs.values() for w in r.words}))}
        # places beyond a reference's words point at a word that no text has
        self.places = np.full((len(refs), rules.common_words), len(self.at), np.int64)
        self.counts = np.zeros((len(refs), rules.common_words), np.int64)
        for i, lang in enumerate(self.langs):
            self.places[i, : len(refs[lang].words)] = [self.at[w] for w in refs[lang].words]
            self.counts[i, : len(refs[lang].words)] = refs[lang].counts
        self.classes = np.array([refs[lang].classes for lang in self.langs])

    def language(self, words: list[bytes], of_class: np.ndarray, but: str | None = None) -> str | None:
        """By common words, then by character classes; a reference that shares no word is as far as can be. but: a language that is left out, unless it is the only one."""
        own = np.zeros(len(self.at) + 1, np.int64)
        for w, n in Counter(words).items():
            if w in self.at:
                own[self.at[w]] = n
        common = own[self.places]
        by_words = np.where(common.sum(axis=1) > 0, js_distance(common, self.counts), 1.0)
        by_class = js_distance(np.broadcast_to(of_class, self.classes.shape), self.classes)
        order = np.lexsort((by_class, by_words))
        return next((self.langs[i] for i in order if self.langs[i] != but), but)


def measures(langs: list[str], texts: list[str], refs: dict[str | None, Reference], rules: Rules) -> pd.DataFrame:
    table = {lang: np.array([hash(w) for w in r.words], np.int64) for lang, r in refs.items()}
    sort = {lang: np.argsort(h) for lang, h in table.items()}
    nearest: Nearest | None = None
    out, classes, class_refs, commons, common_refs = [], [], [], [], []
    for lang, text in zip(langs, texts, strict=True):
        data = text.encode()
        per_byte = byte_counts(data)
        of_class = per_byte @ _MEMBER
        words = data.split()
        lines = [x for x in data.split(b"\n") if x.strip()]
        hashes = np.fromiter(map(hash, words), np.int64, len(words))
        n_points = int(of_class.sum())
        key = lang
        if refs and (lang not in refs or refs[lang].classes.sum() - n_points < rules.reference_chars):
            nearest = nearest or Nearest(refs, rules)
            key = nearest.language(words, of_class, lang if lang in refs else None)
        ref = refs.get(key)
        common = np.zeros(rules.common_words, np.int64)
        common_ref = np.zeros(rules.common_words, np.int64)
        if ref is not None and len(ref.words) and len(words):
            known = table[key][sort[key]]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            common[: len(known)] = np.bincount(sort[key][at[hit]], minlength=len(known))
            common_ref[: len(known)] = ref.counts
        classes.append(of_class)
        class_refs.append(ref.classes if ref is not None else np.zeros(len(CLASSES), np.int64))
        commons.append(common)
        common_refs.append(common_ref)
        out.append((len(words), n_points - int(of_class[CLASSES.index("space")]), int(of_class[CLASSES.index("symbol")]), len(lines) - len(set(lines)), repeat_words(hashes.view(np.uint64)), n_points))
    frame = pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_points"])
    if len(frame):
        frame["class_distance"] = js_distance(np.array(classes), np.array(class_refs))
        frame["n_common"] = np.array(commons).sum(axis=1)
        frame["word_distance"] = js_distance(np.array(commons), np.array(common_refs))
    else:
        frame = frame.assign(class_distance=0.0, n_common=0, word_distance=0.0)
    return frame


def verdicts(langs: list[str], texts: list[str], refs: dict[str | None, Reference], rules: Rules) -> pd.DataFrame:
    m = measures(langs, texts, refs, rules)
    m["base_failed"] = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
    strange_classes = (m["n_points"] >= rules.guard_chars) & (m["class_distance"] > rules.max_class_distance)
    limit = rules.max_word_distance + rules.word_slack / np.sqrt(np.maximum(m["n_words"], 1))
    # a text without any common word has no histogram to compare: it is as far as can be
    m["judged_distance"] = np.where(m["n_common"] > 0, m["word_distance"], 1.0)
    strange_words = (m["n_words"] >= rules.guard_words) & (m["judged_distance"] > limit)
    m["kept"] = ~(m["base_failed"] | strange_classes | strange_words)
    return m


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _inputs(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:  # noqa: B008
    """One row per row of docs: doc_id, base counts, base_failed, kept, class_distance, word_distance, judged_distance: that of words as the verdict takes it,
    1 where a text has none of the common words.

    Null and empty texts have no words and fail the base rules. Documents of a null
    language, or of one without a reference of other documents' texts, are held against
    the nearest of all references. An empty table gives an empty result. Repeated rows are judged alike; other columns are ignored.
    """
    refs = references(_inputs(docs, text_col, lang_col), rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            m = verdicts(list(rows["lang"]), list(rows["text"]), refs, rules)
            m.insert(0, "doc_id", list(rows["doc_id"]))
            yield m[["doc_id", *_COLUMNS, "base_failed", "kept", "class_distance", "word_distance", "judged_distance"]]

    schema = "doc_id string, " + ", ".join(f"{c} long" for c in _COLUMNS) + ", base_failed boolean, kept boolean, class_distance double, word_distance double, judged_distance double"
    texts = docs.select(as_key(F.col(id_col)).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return as_id(texts.mapInPandas(run, schema))


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:  # noqa: B008
    """The rows of docs that quality() keeps, with all of their columns."""
    refs = references(_inputs(docs, text_col, lang_col), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = [None if x is None else str(x) for x in batch.column(lang_col).to_pylist()]
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(verdicts(langs, texts, refs, rules)["kept"].to_numpy(bool)))

    return docs.mapInArrow(run, docs.schema)
