import random

import pytest
from pyspark.sql import functions as F

from labelloom.llm.mixing import mix_sources
from labelloom.llm.quality import quality
from labelloom.llm.queries import DOCUMENT_MIX, document_domain

from .test_exact_dedup import exact_dedup
from .test_quality import prose
from .test_shingle_join import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(80, 160)), rng.choice(["en", "de"]), f"src{rng.randrange(20)}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "src0") for i in range(10)]
    rows += [(200 + i, rows[i][1] + " and one more", "en", "src0") for i in range(5, 15)]
    rows += [(300, None, "en", "src1"), (301, "short", "en", None), (302, " ".join(w.upper() + "%%" for w in rows[0][1].split()), "en", "src2")]
    return rows


def test_stages(spark, docs, tmp_path):
    rows = corpus()
    frame = docs(rows)
    kept = corpus_pipeline.quality_rules(spark, frame, "")
    assert kept.columns == frame.columns
    good = {r.doc_id for r in kept.collect()}
    assert good == {r.doc_id for r in quality(frame).where("kept").collect()} and good == {r[0] for r in rows if r[0] < 300}
    once = corpus_pipeline.drop_copies(spark, kept, "")
    texts = {}
    for i, t, *_ in rows:
        if i in good:
            texts[t] = max(i, texts.get(t, -1))
    assert {r.doc_id for r in once.collect()} == set(texts.values()) == {r.doc_id for r in exact_dedup(kept).where("kept").collect()}
    apart = corpus_pipeline.drop_near_copies(spark, once, "")
    groups = brute([(r.doc_id, r.text) for r in once.collect()])
    assert {r.doc_id for r in apart.collect()} == {i for i, _, c in groups if i == c}
    taken = corpus_pipeline.mix(spark, apart, "")
    copies = {r.doc_id: r.copies for r in mix_sources(apart, DOCUMENT_MIX, document_domain()).select("doc_id", "_mix.copies").collect()}
    counts = {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in copies.items() if n} and taken.columns == frame.columns
    coded = corpus_pipeline.encode(spark, taken, "").collect()
    assert {r.doc_id for r in coded} == set(counts) and all(r.round_trip and r.n_pieces == len(r.ids) for r in coded)


def test_run(spark, docs, tmp_path):
    docs(corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "ids"} <= set(out.columns) and [n for n, _ in corpus_pipeline.STAGES][-1] == "subword encoding"


def test_repeated_rows_and_missing_ids(spark, docs):
    rows = [(1, "same"), (1, "same"), (2, "same"), (2, "same"), (2, "other"), (None, "other"), (None, "lone"), (None, "lone"), (3, None), (4, "")]
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_copies(spark, docs(rows), "").collect()), key=str)
    assert got == sorted([(2, "same"), (2, "other"), (None, "lone"), (4, "")], key=str)
    empty = docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_columns_may_have_any_names(spark, docs):
    rows = [(1, "same"), (1, "same"), (1, "other"), (2, "same"), (None, "lone")]
    frame = docs(rows).withColumnsRenamed({"h": "sha", "kept": "id"}).withColumn("row", F.lit(1))
    got = corpus_pipeline.drop_copies(spark, frame, "")
    assert got.columns == frame.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "other"), (2, "same"), (None, "lone")], key=str)
    assert corpus_pipeline.mix(spark, frame, "").columns == frame.columns
