"""Pieces shared by the training-data operators: scratch tables, size-checked joins, row splits."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a join side whose rows have a fixed width may be broadcast.
BROADCAST_ROWS = 400_000
#: Rows and bytes of one Arrow batch; texts can be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 1_000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of very long texts fits in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where none is set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/siltstone-scratch"  # one machine only
    return f"{root.rstrip('/')}/siltstone-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/siltstone-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; only results that were written elsewhere stay readable."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count proves it small, else df as it is.  df should be a written table."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")


def one_of_each(docs: DataFrame, repeated: DataFrame, *own: F.Column) -> DataFrame:
    """docs with one row for each key in repeated, a written table of distinct non-null keys or of keys that may be null; other rows stay.

    own: the expressions over docs that make up a key.  Of rows with a key the one whose columns hash lowest
    stays; they are reduced in partial aggregates, so that a hot key is a row per task.
    """
    if repeated.isEmpty():
        return docs
    names = [fresh(docs, f"key__{k}") for k in range(len(own))]
    keys = sized(repeated.toDF(*names))
    same = F.lit(True)
    for name, x in zip(names, own):
        same = same & x.eqNullSafe(F.col(name))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    one = docs.join(keys, same, "left_semi").groupBy(*[x.alias(f"own__{k}") for k, x in enumerate(own)]).agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("row__"))
    return docs.join(keys, same, "left_anti").unionByName(one.select("row__.*"))


def without(docs: DataFrame, dropped: DataFrame, *own: F.Column) -> DataFrame:
    """docs less the rows whose own expressions equal a row of dropped, a written table; null equals null.  No column name of docs gets in the way."""
    names = [fresh(docs, f"dropped__{k}") for k in range(len(own))]
    same = F.lit(True)
    for name, x in zip(names, own):
        same = same & x.eqNullSafe(F.col(name))
    return docs.join(sized(dropped.toDF(*names)), same, "left_anti")


def ascii_lower(text: F.Column) -> F.Column:
    """Lower-case A-Z only; null counts as empty.  Pure ASCII takes the fast built-in."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def remainder(doc_id: F.Column, modulus: int = 5) -> F.Column:
    """crc32 of the id as text, modulo modulus; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
