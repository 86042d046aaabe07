"""What the text operators share: reading, shared storage, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows, and so many bytes of strings, may be broadcast: under 100 MB with its few narrow columns.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20
#: The same for joins of narrow tables, which cost little to shuffle: many follow one another, and what the driver has sent stays in its heap until a collection finds it.
NARROW_ROWS = 200_000
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Without it a temporary folder serves a local master only; on a cluster each node would write its own half.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    base = f"file://{tempfile.mkdtemp(prefix='labelloom')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs no rerun.

    The job runs at once, while a query is being built.

    narrow: df is a small part of a large scan; it is gathered into files of the advisory
    size instead of one for each task. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    if narrow:
        df = df.hint("rebalance")
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # without a marker of success, for which Hadoop would start two more processes on the driver
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a file of a narrow table.
FILE_ROWS = 200_000


def gathered(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """materialize() of a narrow table of about `rows` rows in few files: what makes it keeps its tasks, and only the writing is gathered.

    Without native libraries Hadoop starts a process for every file on a local disk, which takes longer than a small table's rows.
    """
    return materialize(df.hint("rebalance").coalesce(max(1, (rows or 0) // FILE_ROWS)), label)


def small_enough(df: DataFrame, narrow: bool = False) -> bool:
    """Whether df, which should be materialized, may be broadcast: its rows and the bytes of its strings are counted. narrow: the other side is narrow, too."""
    wide = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    sums = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in wide]
    n, *sizes = df.agg(F.count(F.lit(1)), *sums).first()
    return n <= broadcast_rows(narrow) and sum(sizes) <= BROADCAST_BYTES


def broadcast_rows(narrow: bool) -> int:
    return min(NARROW_ROWS, BROADCAST_ROWS) if narrow else BROADCAST_ROWS


def checked_join(big: DataFrame, small: DataFrame, on: list[str], how: str, narrow: bool = False) -> DataFrame:
    """Join small (materialized, as its size is measured) onto big: broadcast within the bounds above, else a plain shuffle join.

    small has a key once, so a key that holds much of big is a large partition of one side only, and adaptive execution splits it.
    """
    return big.join(F.broadcast(small) if small_enough(small, narrow) else small, on, how)


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose texts go to Python in batches of BATCH_ROWS, unless the session has a size of its own: a batch stands in memory several times."""
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if df.sparkSession.conf.get(key) == default:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


def as_key(column: Column) -> Column:
    """A long id on its way through pandas, which turns a column with nulls into floats; as_id() turns it back."""
    return column.cast("long").cast("string")


def as_id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))
