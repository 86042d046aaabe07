"""Many small groups at a time in numpy, and rows dealt out before they grow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows in as many partitions as the session has for shuffles. The number is given, as adaptive execution would gather few small rows
    into few tasks, and what comes next makes each of them many."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def over_groups(rows: DataFrame, keys: list[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], columns: str) -> DataFrame:
    """As groupBy(*keys).applyInPandas(), for groups so small that a call for each would take longer than its work: rows come sorted, batch by batch.

    run gets the other columns of whole groups, one after another, and where each begins; its column `group` says whose a row is.
    columns: the other columns that it returns. Keys of any kind are handed on, null too. A task holds a batch and a group.
    """
    return over_sorted(dealt(rows, *keys).sortWithinPartitions(*keys), keys, run, columns)


def over_sorted(rows: DataFrame, keys: list[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], columns: str, at_once: int = 0) -> DataFrame:
    """over_groups() of rows that lie group by group already, each group in one partition; run gets `at_once` rows or more, but at the end."""
    others = [c for c in rows.columns if c not in keys]
    kinds = dict(rows.dtypes)
    wanted = to_arrow_schema(StructType.fromDDL(columns))

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def done(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = run(table.select(others).to_pandas(), starts)
        ids = table.select(keys).take(pa.array(starts[out["group"].to_numpy(np.int64)]))
        told = pa.Table.from_pandas(out[wanted.names], wanted, preserve_index=False, safe=False)
        for c in told.column_names:
            ids = ids.append_column(c, told.column(c))
        yield from ids.combine_chunks().to_batches()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        held, due = 0, at_once
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(pa.Table.from_batches([batch]))
            held += batch.num_rows
            if held < due:
                continue
            table = pa.concat_tables(rest)
            starts = begins(table)
            if len(starts) > 1:
                yield from done(table.slice(0, starts[-1]), starts[:-1])
            rest = [table.slice(starts[-1])]
            held = rest[0].num_rows
            due = max(at_once, 2 * held)  # a group that goes on is not looked through at every batch
        if rest:
            table = pa.concat_tables(rest)
            yield from done(table, begins(table))

    return rows.select(*keys, *others).mapInArrow(stream, ", ".join([*(f"{k} {kinds[k]}" for k in keys), columns]))
