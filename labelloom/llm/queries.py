"""The registered queries of the text operators and the SQL that they are held against."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cap_filters import near_vectors
from .common import table
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .html_text import main_text
from .licenses import license_scan
from .line_dedup import line_dedup
from .mixing import Mix, mix_sources
from .pii import pii
from .pseudo_likelihood import pseudo_likelihood
from .quality import quality
from .shingle_join import shingle_join
from .source_audit import source_divergence
from .subword_lattice import sample_encode

#: Weights of the tree of `documents`; sources that are not listed weigh alike within their domain and language.
DOMAIN_WEIGHTS = {"web": 50, "forum": 20, "books": 30}
LANG_WEIGHTS = {"en": 60, "de": 15, "fr": 15, "es": 10}
DOCUMENT_MIX = Mix(weights=DOMAIN_WEIGHTS | {f"{d}/{lang}": w for d in DOMAIN_WEIGHTS for lang, w in LANG_WEIGHTS.items()} | {"web/en/src0": 3}, budget_percent=60, max_epochs=4, seed=7)


def document_domain() -> Column:
    """The domain of a source of `documents`: src0 to src9 web, to src14 forum, from src15 books."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    return F.when(number >= 15, "books").when(number >= 10, "forum").otherwise("web")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), DOCUMENT_MIX, document_domain()).select("doc_id", "_mix.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join(table(spark, sf_dir, "documents"))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), digest=True)


#: Vocabulary of SentencePiece pieces; the folder of tokenizers is a parameter.
PIECE_MODEL = os.environ.get("TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"


def op7_subword_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_encode(table(spark, sf_dir, "documents"), PIECE_MODEL, k=2, seed=7, digest=True)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_mix_sources": op2_mix_sources,
    "op3_quality": op3_quality,
    "op4_shingle_join": op4_shingle_join,
    "op5_pseudo_likelihood": op5_pseudo_likelihood,
    "op6_line_dedup": op6_line_dedup,
    "op7_subword_samples": op7_subword_samples,
    "op8_license_scan": op8_license_scan,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_html_text": op10_html_text,
    "op11_source_audit": op11_source_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_near_vectors": op13_near_vectors,
}


def _mix_sql(mix: Mix) -> str:
    """DuckDB SQL for mix_sources() over `documents`."""
    weights = ", ".join(f"('{k}', {v})" for k, v in mix.weights.items())

    def fill(name: str, source: str, parent: str) -> str:
        part = f"PARTITION BY {parent}" if parent else ""
        parts = f"PARTITION BY {parent}, full_" if parent else "PARTITION BY full_"
        return f"""
        {name}_a AS (SELECT n.*, CASE WHEN cap > 0 THEN coalesce(w.weight, {mix.default_weight}) ELSE 0 END AS weight FROM ({source}) n LEFT JOIN weights w ON w.path = n.path),
        {name}_b AS (SELECT *, total - coalesce(sum(cap) OVER before, 0) AS total_left, sum(weight) OVER ({part}) - coalesce(sum(weight) OVER before, 0) AS weight_left
            FROM (SELECT *, CASE WHEN weight > 0 THEN cap / weight ELSE 0.0 END AS ratio FROM {name}_a)
            WINDOW before AS ({part} ORDER BY ratio, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        {name}_c AS (SELECT * EXCLUDE (total_left, weight_left), min(CASE WHEN cap::HUGEINT * weight_left <= weight::HUGEINT * total_left THEN 1 ELSE 0 END) OVER ({part} ORDER BY ratio, path ROWS UNBOUNDED PRECEDING) AS full_ FROM {name}_b),
        {name}_d AS (SELECT *, total - coalesce(sum(CASE WHEN full_ = 1 THEN cap END) OVER ({part}), 0) AS total_left, sum(CASE WHEN full_ = 0 THEN weight END) OVER ({part}) AS weight_left,
            row_number() OVER ({parts} ORDER BY path) AS rank FROM {name}_c),
        {name}_e AS (SELECT *, CASE WHEN full_ = 1 THEN cap ELSE (weight::HUGEINT * total_left::HUGEINT) // weight_left END AS share FROM {name}_d),
        {name}_f AS (SELECT *, total_left - sum(CASE WHEN full_ = 0 THEN share END) OVER ({part}) AS over_ FROM {name}_e),
        {name} AS (SELECT *, CAST(share + CASE WHEN full_ = 0 AND rank <= over_ THEN 1 ELSE 0 END AS BIGINT) AS target FROM {name}_f)"""

    return f"""
        WITH weights(path, weight) AS (VALUES {weights}),
        rows_ AS (SELECT doc_id, lang, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
            CASE WHEN number >= 15 THEN 'books' WHEN number >= 10 THEN 'forum' ELSE 'web' END AS domain
            FROM (SELECT *, try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS number FROM documents)),
        leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {mix.max_epochs} AS BIGINT) AS cap FROM rows_ GROUP BY ALL),
        {fill("domains", f"SELECT domain, domain AS path, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(sum(tokens) AS BIGINT) * {mix.budget_percent} // 100 FROM leaves) AS total FROM leaves GROUP BY domain", "")},
        {fill("langs", "SELECT l.domain, l.lang, l.domain || '/' || l.lang AS path, CAST(sum(l.cap) AS BIGINT) AS cap, any_value(d.target) AS total FROM leaves l JOIN domains d ON d.domain = l.domain GROUP BY l.domain, l.lang", "domain")},
        {fill("sources", "SELECT l.domain, l.lang, l.source, l.tokens, l.domain || '/' || l.lang || '/' || l.source AS path, l.cap, g.target AS total FROM leaves l JOIN langs g ON g.domain = l.domain AND g.lang = l.lang", "domain, lang")},
        placed AS (SELECT r.doc_id, r.domain, r.lang, r.source, r.n_tokens, r.text, CASE WHEN s.tokens > 0 THEN s.target // s.tokens ELSE 0 END AS full_epochs, CASE WHEN s.tokens > 0 THEN s.target % s.tokens ELSE 0 END AS rest
            FROM rows_ r JOIN sources s ON s.domain = r.domain AND s.lang = r.lang AND s.source = r.source),
        started AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{mix.seed}:' || full_epochs || ':' || doc_id), md5(coalesce(text, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed)
        SELECT doc_id, domain, lang, source, n_tokens, full_epochs, CAST(greatest(0, least(n_tokens, rest - start)) AS BIGINT) AS tail_tokens,
            CAST(full_epochs + CASE WHEN rest - start > 0 AND n_tokens > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies
        FROM started
    """


ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": _mix_sql(DOCUMENT_MIX),
    "op4_shingle_join": """
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM split)
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        rare AS (SELECT s.doc_id, s.h, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.c, s.h) AS r FROM s JOIN (SELECT h, count(*) AS c FROM s GROUP BY h) f ON f.h = s.h),
        p AS (SELECT r.doc_id, r.h FROM rare r JOIN n ON n.doc_id = r.doc_id WHERE r.r <= n.n - (80 * n.n + 99) // 100 + 1),
        cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.h = b.h AND a.doc_id < b.doc_id),
        link AS (
            SELECT c.a, c.b FROM cand c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.h = x.h JOIN n na ON na.doc_id = c.a JOIN n nb ON nb.doc_id = c.b
            GROUP BY c.a, c.b, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
        ),
        both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ e ON e.a = r.b)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
        FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op6_line_dedup": """
        WITH lines AS (
            SELECT doc_id, n_lines, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, len(parts) AS n_lines, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
        ),
        firsts AS (SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key),
        marked AS (
            SELECT l.doc_id, l.n_lines, l.pos, l.line, coalesce(l.doc_id <> f.keeper, false) AS gone
            FROM lines l LEFT JOIN firsts f ON l.key = f.key
        )
        SELECT doc_id, CAST(any_value(n_lines) AS BIGINT) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op9_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op11_source_audit": """
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
            FROM documents
        ),
        c AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY lang, term HAVING count(*) >= 30),
        counts AS (SELECT c.lang, c.source, c.term, sum(c.n) AS n FROM c JOIN kept k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
        g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN counts c ON c.lang = x.lang AND c.source = x.source GROUP BY x.lang, x.source),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 5)) // (v.n + 5 * v.v) AS q
            FROM g JOIN v ON v.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ),
        found AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.f, 0) AS value
            FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
            LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL) f
                ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
            UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
        ),
        ranked AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
    "op12_hard_negatives": """
        WITH r AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) AS INT) AS rank,
            n.id AS negative_id, positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) <= 5
    """,
}
