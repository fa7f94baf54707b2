"""Every stage and operator on tables whose other columns have the names that operators use inside."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import bm25_packing, cnn_toxicity, exact_lsm, katz, kn_quality, langmask, postings, repeats, tensor_minhash, tiered_shards, unigram_piece, voronoi_negatives

HERE = Path(exact_lsm.__file__).parent
#: Every word in quotes that the subpackage's files name as a column.
NAMES = sorted({w.lower() for f in HERE.glob("*.py") for w in re.findall(r"[\"']([a-z][a-z0-9_]{0,20})[\"']", f.read_text())} | {f"{n}__{k}" for n in ("dropped", "key", "own") for k in range(3)} | {"dropped__id", "dropped__sha", "dropped__hash", "rejected__id", "rejected__digest", "row__", "trusted__id"})
TEXTS = ["the quick brown fox jumps over the lazy dog again and again"] * 3 + [None, "", "a quite different text about nothing in particular, number 5"] + [f"document {k} says word{k} and other{k} things to whoever{k} reads it" for k in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    own = {"doc_id", "text", "lang", "source", "n_chars"}
    rows = spark.createDataFrame([(i, t, "en" if i % 3 else "de", "s", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *[F.lit(k).alias(n) for k, n in enumerate(n for n in NAMES if n not in own)]).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 7 > 0, int(i % 5 == 0)) for i in range(36)], "doc_id long, q boolean, toxic int").select("doc_id", F.col("q").cast("int").alias("quality"), "toxic", *[F.lit(k).alias(n) for k, n in enumerate(n for n in NAMES if n not in ("doc_id", "quality", "toxic"))])


def test_names_are_many():
    assert len(NAMES) > 200


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, labels, tmp_path, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
    if stage < 4:
        assert out.columns == docs.columns
    assert out.count()


@pytest.mark.parametrize("run", [
    lambda d, m: exact_lsm.exact_groups(d), lambda d, m: langmask.identify_held_out(d), lambda d, m: unigram_piece.encode_documents(d), lambda d, m: tensor_minhash.near_groups(d), lambda d, m: bm25_packing.pack_documents(d),
    lambda d, m: tiered_shards.shard_table(d), lambda d, m: kn_quality.classify(d, m), lambda d, m: katz.katz_scores(d), lambda d, m: cnn_toxicity.toxicity_held_out(d, m),
    lambda d, m: postings.rank_documents(d, d.withColumnRenamed("item_id", "item_id_").withColumnRenamed("doc_id", "item_id")), lambda d, m: repeats.cut_repeats(d, length=20, gram=8),
    lambda d, m: voronoi_negatives.hard_negatives(d.drop("vec_id", "embedding", "label").withColumnRenamed("doc_id", "vec_id").withColumn("embedding", F.array(*[F.hash("vec_id", F.lit(k)) % 5 / 1.0 for k in range(4)])).withColumn("label", F.col("vec_id") % 3)),
])
def test_operators(docs, labels, run):
    assert run(docs, labels).count() > 0
