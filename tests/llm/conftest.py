import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )


def docs_of(spark, rows):
    """Rows of (doc_id, text), beside columns whose names clash with those that operators use inside."""
    full = [(i, t, "en", "s", len(t or ""), 1, "x", "y") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, component int, digest string, norm string")


ODD = [(None, None), (None, "same text here"), (1, ""), (2, None), (3, " \t\n"), (4, "Same Text Here"), (4, "Same Text Here"), (5, "same text here"), (6, "É" * 50), (7, "é" * 50), (8, "word " * 30000), (9, "one two three four five six")]
