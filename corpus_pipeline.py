"""A pipeline over documents: quality rules, exact dedup, near-copy groups, mixing, subword encoding.

Every stage takes what its predecessor kept, as (spark, docs, sf_dir), and returns a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import checked_join, materialize, table
from labelloom.llm.exact_dedup import exact_dedup
from labelloom.llm.mixing import mixed
from labelloom.llm.quality import keep_good
from labelloom.llm.queries import DOCUMENT_MIX, PIECE_MODEL, document_domain
from labelloom.llm.shingle_join import shingle_join
from labelloom.llm.subword_lattice import sample_encode


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the ids of gone."""
    return checked_join(docs, materialize(gone.where("doc_id is not null").distinct(), "gone"), ["doc_id"], "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a base rule, or are far from their language's histograms, go.

    Null and empty texts have no words and go. Documents without a language are held against the nearest one.
    Repeated rows are judged alike; an empty table stays empty. All columns are handed on.
    """
    return keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, once.

    Null texts count as empty, and empty texts are equal. An id tells which rows go. Rows without an id, or with
    an id that several rows share, are told apart by their texts as well. An empty table stays empty.
    """
    told = materialize(exact_dedup(docs), "copies")
    shared = materialize(told.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "shared-ids")
    gone = told.where("not kept and doc_id is not null").select("doc_id").distinct()
    plain = _without(docs.where("doc_id is not null"), gone.unionByName(shared))
    odd = checked_join(docs, shared, ["doc_id"], "left_semi").unionByName(docs.where("doc_id is null"))
    # the columns of docs go along in a struct, so that none clashes with the keys
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("id")
    odd = odd.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), named, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    stay = told.where("kept").select(named, F.col("text_sha256").alias("sha"))
    return plain.unionByName(odd.dropDuplicates(["id", "sha"]).join(stay, ["id", "sha"], "left_semi").select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies the document with the smallest id stays.

    Rows without an id, and null and empty texts, link to nothing and stay; an empty table stays empty.
    """
    told = shingle_join(docs)
    return _without(docs, told.where("component_id != doc_id").select("doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share of the mixture, to the token: documents as often as they are taken, one of each source cut where its share ends.

    n_chars follows a text that was cut. Null and empty texts have no tokens: they are in full epochs only. An empty table stays empty.
    """
    taken = mixed(docs, DOCUMENT_MIX, document_domain())
    return taken.withColumn("n_chars", F.least("n_chars", F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else taken


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, with their piece ids: with one alone a model would see no text in two ways.

    Null and empty texts have the empty segmentation, alone; copies of a document get equal samples. An empty table stays empty.
    """
    return sample_encode(docs, PIECE_MODEL, k=2, seed=7, group_chars=200_000)


STAGES = [("quality rules", quality_rules), ("exact dedup", drop_copies), ("near copies", drop_near_copies), ("mixing", mix), ("subword encoding", encode)]

#: SQL can express neither the divergence tests nor the lattice samples.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again; the files go when the driver's JVM ends."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
