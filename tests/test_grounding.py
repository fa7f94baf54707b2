"""x10_grounding against its SQL on first words that the rubric's own list leaves out, and on texts without any."""

import duckdb
from pyspark.sql import functions as F

from siltstone.operators.explain import STOPWORDS, code_references
from siltstone.plans import ORACLES, QUERIES


def test_stopwords_of_the_sql(spark, tmp_path):
    texts = [*STOPWORDS, *(f"{w} = password_1" for w in STOPWORDS), "", None, "12 ab", "invented words", "X y Zeta"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["x10_grounding"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['x10_grounding']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) == len(texts)


def test_stopwords_of_the_rubric_stay(spark):
    refs = spark.createDataFrame([("`password(x)` and `token(y)` and `frobnicate(z)`",)], "t string").select(code_references(F.col("t"))).first()[0]
    assert refs == ["frobnicate"]
