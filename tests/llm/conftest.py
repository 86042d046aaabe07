import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def docs(spark):
    """Builds documents with the usual columns; an extra column clashes with names that operators use."""

    def build(rows):
        full = [(i, t, *((rest + ["en", "src0"][len(rest):]) if rest else ["en", "src0"]), len(t or ""), 7, "x") for i, t, *rest in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, h long, kept string")

    return build
