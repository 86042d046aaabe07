"""Line deduplication over range-partitioned line hashes.

Lines are range-partitioned by (hash, document, position), so a line that is in every
document spreads over many tasks, and sorted by it. Each task streams its rows: the
first document of a run of equal hashes keeps its lines, all others lose theirs. The
run that a partition begins with may go on from the partition before; its first rows
are settled by the anchors that every partition leaves of its last run, one row each.
What comes back is a compressed bitmap of kept lines per document, no text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import as_id, as_key, checked_join, materialize, small_batches, whole_text

STRIPPED = " \t\n\x0b\x0c\r"
#: Stands for a null id: such rows are one document, after all others.
NO_ID = (1 << 63) - 1
DROP, PENDING, ANCHOR = 0, 1, 2


def line_key(line: str, least: int) -> bytes | None:
    """The line stripped and with A-Z lower-cased; None if it has under `least` code points."""
    line = line.strip(STRIPPED)
    return line.encode().lower() if len(line) >= least else None


def _lines(least: int):
    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            docs, versions, at, counts, digests = [], [], [], [], []
            for doc, version, text in zip(rows["doc"], rows["version"], rows["text"], strict=True):
                lines = text.split("\n")
                for i, line in enumerate(lines):
                    if (key := line_key(line, least)) is not None:
                        docs.append(doc)
                        versions.append(version)
                        at.append(i)
                        counts.append(len(lines))
                        digests.append(xxhash.xxh3_128_digest(key))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "doc": docs, "version": versions, "pos": at, "n_lines": counts})

    return explode


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (h1, h2, doc): dropped lines, lines of the first run still in doubt, and one anchor."""
    run, first_run, nothing = None, True, True
    for rows in batches:
        if not len(rows):
            continue
        h1, h2, doc = (rows[c].to_numpy() for c in ("h1", "h2", "doc"))
        starts = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        if run is not None and (h1[0], h2[0]) == run[:2]:
            starts[0] = False
        of = np.cumsum(starts)
        keepers = np.r_[run[2] if run is not None else 0, doc[starts]][of]
        first = (of == 0) & first_run if not nothing else of == 1
        nothing, first_run = False, first_run and bool(first.all())
        kind = np.where(doc != keepers, DROP, PENDING)
        out = (kind == DROP) | first
        yield rows[out].assign(kind=kind[out].astype(np.int8))
        run = (h1[-1], h2[-1], keepers[-1])
    if run is not None:
        yield pd.DataFrame({"h1": [run[0]], "h2": [run[1]], "doc": [run[2]], "version": [0], "pos": [0], "n_lines": [0], "kind": [np.int8(ANCHOR)]})


@F.pandas_udf(BinaryType())
def _bitmap(positions: pd.Series, n_lines: pd.Series) -> pd.Series:
    out = []
    for at, n in zip(positions, n_lines, strict=True):
        keep = np.ones(n, np.uint8)
        keep[np.asarray(at)] = 0
        out.append(zlib.compress(np.packbits(keep).tobytes()))
    return pd.Series(out)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """Bitmaps of kept lines, for the documents that lose any: doc, version (hash of the text), n_lines, n_dropped, keep (zlib of packed bits)."""
    text = whole_text(text_col)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))
    lines = small_batches(texts).mapInPandas(_lines(least), "h1 long, h2 long, doc long, version long, pos int, n_lines int")
    order = ["h1", "h2", "doc", "version", "pos"]
    schema = "h1 long, h2 long, doc long, version long, pos int, n_lines int, kind byte"
    told = materialize(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_stream, schema), "line-runs")
    # one anchor a partition: small whatever the input
    anchors = told.where(F.col("kind") == ANCHOR).groupBy("h1", "h2").agg(F.min("doc").alias("keeper"))
    late = told.where(F.col("kind") == PENDING).join(F.broadcast(anchors), ["h1", "h2"]).where("keeper < doc").select("doc", "version", "pos", "n_lines")
    dropped = told.where(F.col("kind") == DROP).select("doc", "version", "pos", "n_lines").unionByName(late)
    return dropped.groupBy("doc", "version").agg(F.collect_set("pos").alias("at"), F.first("n_lines").alias("n_lines")).select(
        "doc", "version", "n_lines", F.size("at").cast("long").alias("n_dropped"), _bitmap("at", "n_lines").alias("keep")
    )


def kept_text(text: str, keep: bytes | None) -> tuple[int, str]:
    """Number of lines, and the lines that stay."""
    if keep is None:
        return text.count("\n") + 1, text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return len(lines), "\n".join(line for line, bit in zip(lines, bits, strict=False) if bit)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, digest: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped and the kept text, or with `digest` its kept_sha256.

    A key (line stripped of white space, A-Z lower-cased, `least` code points or more)
    of two documents or more stays only in the one with the smallest id. Null and empty
    texts are one empty line; an empty table gives an empty result. Rows that share an id are one document; rows with a null
    id are one document after all others. Other columns are ignored.
    """
    bitmaps = materialize(keep_bitmaps(docs, id_col, text_col, least), "keep-bitmaps")
    text = whole_text(text_col)
    texts = docs.select(as_key(F.col(id_col)).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))
    both = checked_join(texts, bitmaps.select("doc", "version", "n_dropped", "keep"), ["doc", "version"], "left")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = [kept_text(t, k) for t, k in zip(rows["text"], rows["keep"], strict=True)]
            last = [hashlib.sha256(t.encode()).hexdigest() if digest else t for _, t in done]
            yield pd.DataFrame({"doc_id": list(rows["doc_id"]), "n_lines": [n for n, _ in done], "n_dropped": rows["n_dropped"].fillna(0).astype("int64"), name: last})

    name = "kept_sha256" if digest else "text"
    return as_id(both.select("doc_id", "text", "n_dropped", "keep").mapInPandas(apply, f"doc_id string, n_lines long, n_dropped long, {name} string"))
