"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Every sender (a hash share of the rows, about SENDER_ROWS of them, more where there are many owners)
sorts its distinct 64-bit fingerprints, cuts them by owner (a range of fingerprints) and sends each owner
one Rice-coded block. Owners decode, find fingerprints that several senders hold, and
return one bit per fingerprint. Only rows under a set bit, or repeated within their
sender, are suspects; only suspects' texts are shuffled, and they are grouped by
their bytes. A group of any size costs a sender one fingerprint and, through partial
aggregation, a task one text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked_join, materialize, whole_text

SENDER_ROWS = 1 << 16
OWNER_ROWS = 1 << 20
#: Fingerprints of a block, at least on average: shorter ones cost more than they save.
BLOCK_ROWS = 64

_BLOCK = "sender long, owner long, n long, k int, unary binary, rest binary"
_BITS = "sender long, owner long, bits binary"


def rice_encode(values: np.ndarray, base: int, span_bits: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct uint64 values of [base, base + 2**span_bits): parameter, unary quotients, packed remainders."""
    if not len(values):
        return 0, b"", b""
    gaps = np.diff(values, prepend=np.uint64(base))
    k = max(0, span_bits - max(1, len(values)).bit_length())
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes, base: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
    low = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if k else np.zeros(n, np.uint64)
    return np.cumsum((quotients << np.uint64(k)) + low, dtype=np.uint64) + np.uint64(base)


def _unsigned(h: pd.Series) -> np.ndarray:
    return h.to_numpy(np.int64).view(np.uint64)


def shares(total: int) -> tuple[int, int]:
    """Bits of an owner's number, and senders. A sender's rows meet all owners, so with n rows a block has BLOCK_ROWS of them if senders have BLOCK_ROWS * n / OWNER_ROWS."""
    owner_bits = max(4, math.ceil(math.log2(max(1, total / OWNER_ROWS))))
    return owner_bits, max(1, math.ceil(total / max(SENDER_ROWS, BLOCK_ROWS << owner_bits)))


def _cuts(values: np.ndarray, owner_bits: int) -> Iterator[tuple[int, int, int]]:
    """Owner, start and end of each owner's run of sorted values."""
    owners = values >> np.uint64(64 - owner_bits)
    starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]]) if len(values) else np.empty(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True):
        yield int(owners[a]), a, b


def _sends(owner_bits: int):
    span = 64 - owner_bits

    def send(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(_unsigned(rows["h"]))
        sender = int(rows["sender"].iloc[0])
        out = [(sender, owner, b - a, *rice_encode(values[a:b], owner << span, span)) for owner, a, b in _cuts(values, owner_bits)]
        return pd.DataFrame(out, columns=["sender", "owner", "n", "k", "unary", "rest"])

    return send


def _answers(owner_bits: int):
    span = 64 - owner_bits

    def answer(blocks: pd.DataFrame) -> pd.DataFrame:
        base = int(blocks["owner"].iloc[0]) << span
        sent = [rice_decode(b.n, b.k, b.unary, b.rest, base) for b in blocks.itertuples()]
        values, counts = np.unique(np.concatenate(sent), return_counts=True)
        shared = values[counts > 1]
        bits = [np.packbits(np.isin(own, shared, assume_unique=True)).tobytes() for own in sent]
        return pd.DataFrame({"sender": blocks["sender"], "owner": blocks["owner"], "bits": bits})

    return answer


def _marks(owner_bits: int, columns: list[str]):
    def mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        values, inverse, counts = np.unique(_unsigned(rows["h"]), return_inverse=True, return_counts=True)
        shared = counts > 1
        told = dict(zip(answers["owner"], answers["bits"], strict=True))
        for owner, a, b in _cuts(values, owner_bits):
            shared[a:b] |= np.unpackbits(np.frombuffer(told[owner], np.uint8))[: b - a].astype(bool)
        return rows.assign(suspect=shared[inverse])[columns]

    return mark


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal. Of rows with equal bytes
    the one with the largest id stays (null ids rank lowest); of repeated rows that
    share that id exactly one stays, the others carry kept = false. An empty table
    gives an empty result. Other columns of docs are ignored.
    """
    text = whole_text(text_col)
    row = F.monotonically_increasing_id()
    narrow = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), row.alias("row")), "fingerprints", narrow=True
    )
    owner_bits, senders = shares(narrow.count())
    narrow = narrow.withColumn("sender", F.pmod(F.xxhash64("row"), F.lit(senders)).cast("long"))
    sent = narrow.select("sender", "h").groupBy("sender").applyInPandas(_sends(owner_bits), _BLOCK)
    bits = sent.groupBy("owner").applyInPandas(_answers(owner_bits), _BITS)
    schema = f"{narrow._jdf.schema().toDDL()}, suspect boolean"
    marked = materialize(
        narrow.groupBy("sender").cogroup(bits.groupBy("sender")).applyInPandas(_marks(owner_bits, [*narrow.columns, "suspect"]), schema),
        "suspects",
    )
    suspects = marked.where("suspect")
    ids = suspects.select("doc_id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # null ids match nothing in a join; their texts are few and go along
    texts = checked_join(texts, ids, ["doc_id"], "left_semi").unionByName(texts.where("doc_id is null"))
    groups = materialize(
        texts.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.xxhash64("text").alias("h"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "keep_id", "group_size"),
        "equal-texts",
    )
    found = checked_join(suspects, groups, ["h", "sha"], "left")
    found = found.withColumn("stays", F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # among the rows that carry the kept id one is chosen; a group has as many of them as its row is repeated
    one = Window.partitionBy("h", "sha", "stays").orderBy("row")
    kept = found.where("stays").withColumn("kept", F.row_number().over(one) == 1).drop("stays")
    gone = found.where("not stays").withColumn("kept", F.lit(False)).drop("stays")
    alone = marked.where("not suspect").withColumns({"keep_id": F.lit(None).cast("long"), "group_size": F.lit(None).cast("long"), "kept": F.lit(True)})
    return kept.unionByName(gone).unionByName(alone).select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"),
    )
