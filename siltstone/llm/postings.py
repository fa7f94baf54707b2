"""Ranked lexical search: term-bucketed postings, integer scores, sums by item and document.

* postings: each task counts the terms of its documents; a posting is (term, row, doc_id, n, tf), row being a
  number of the document's own.  They are dealt into buckets by a hash of the term and written so: a bucket is a
  folder, sorted by term.  Buckets are rebalanced while they are written, so that a term of every document is
  spread over several tasks and files.  Only terms that an item asks for are written, unless all are wanted.
* search: document frequencies are counts over the postings; a term's weight and a posting's impact are integers.
  Hits go from the buckets to partitions by row; there the items' terms, broadcast if they are few, join them, and
  sums by (item, row) need no further shuffle.  The k best of each item are kept task by task before they meet.

Terms are the maximal runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are
lower-cased.  N counts the documents with a term, L their terms with repeats, n a document's, tf a term's in it.
w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 75 + (25 n N) div L, score = sum of w ((10^9 tf) div (1000 tf + 12 m)).

Semantics: a null text has no terms and does not count in N.  Rows that repeat an id are documents of their own, and so
are rows without one; a document's id may then stand twice in a ranking, in the order of rows.  Item rows that repeat an
id are one item with the terms of all of them; a null item id is an id like any other.  Equal scores go by ascending
doc_id, nulls first.  Documents of score 0 are left out; items without terms or hits have no rows.  Empty tables give
an empty result.  Other columns are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize, prepare, scratch_path, sized

POSTING = "term string, row long, doc_id long, n long, tf long"
_SCHEMA = pa.schema([("term", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("tf", pa.int64())])
#: Bytes of terms after A-Z were lowered: digits, letters, and all of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[97:123] = TERM[128:] = True


def terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of all documents in order, dictionary-encoded, and for each the number of its document."""
    data = K.FOLD[data]
    full = TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    begins = full & (edge[:-1] | ~np.append(False, full[:-1]))
    start = np.flatnonzero(begins)
    lens = np.diff(np.append(np.flatnonzero(begins[full]), full.sum()))
    ends = np.append(0, np.cumsum(lens)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[full])))
    return found.dictionary_encode(), np.searchsorted(off, start, "right") - 1


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> postings, and for each piece of a batch a row without a term: n terms in tf documents."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        data, off = K.utf8(batch.column(1))
        for a, b in K.pieces(off, 1_000_000):
            found, doc = terms(data[off[a] : off[b]], off[a : b + 1] - off[a])
            known = max(1, len(found.dictionary))
            key, tf = np.unique(doc * known + found.indices.to_numpy(), return_counts=True)
            at, n = key // known, np.bincount(doc, minlength=b - a)
            own = [found.dictionary.take(pa.array(key % known)), pa.array(number + at), batch.column(0).take(pa.array(a + at)), pa.array(n[at]), pa.array(tf)]
            yield pa.RecordBatch.from_arrays(own, schema=_SCHEMA)
            yield pa.RecordBatch.from_pylist([{"n": len(doc), "tf": int((n > 0).sum())}], schema=_SCHEMA)
            number += b - a
        K.release()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, times)."""
    rows = items.select(items[id_col].cast("long").alias("doc_id"), items[text_col].cast("string").alias("text")).mapInArrow(_postings, POSTING)
    return rows.filter("term is not null").groupBy(F.col("doc_id").alias("item_id"), "term").agg(F.sum("tf").alias("times"))


def write_postings(docs: DataFrame, path: str, wanted: DataFrame | None = None, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings of docs in buckets under path, with rows of bucket -1 that hold n terms in tf documents.

    wanted: a written table (term) of distinct terms; postings of others are left out, but count in n and L.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(_postings, POSTING)
    if wanted is not None:
        asked = sized(wanted.select(F.col("term").alias("asked")))
        rows = rows.join(asked, F.col("term") == F.col("asked"), "left").filter("term is null or asked is not null").drop("asked")
    bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int")
    rows = rows.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    rows.write.partitionBy("bucket").parquet(path)
    return spark.read.schema(POSTING + ", bucket int").parquet(path)


def search(index: DataFrame, asked: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item.  index: as write_postings gives it; asked: a written table as of item_terms."""
    n_docs, n_terms = index.filter("bucket = -1").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    postings = index.filter("bucket >= 0")
    weight = F.floor(1000 * F.log((F.lit(2 * n_docs + 2).cast("double")) / (2 * F.col("df") + 1).cast("double")))
    weights = materialize(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", weight.alias("w")).filter("w > 0"), "lex-weights")
    items = materialize(asked.join(weights, "term").select("term", "item_id", (F.col("times") * F.col("w")).alias("w")), "lex-items")
    wanted = sized(items.select("term").distinct() if items.limit(1).count() else items.select("term"))
    length = F.expr(f"75 + (25 * n * {n_docs}L) div {max(1, n_terms)}L")
    hits = postings.join(wanted, "term", "left_semi").withColumn("m", length).select("row", "doc_id", "term", F.expr("(1000000000 * tf) div (1000 * tf + 12 * m)").alias("impact"))
    pairs = hits.repartition("row").join(sized(items), "term").groupBy("row", "doc_id", "item_id").agg(F.sum(F.col("w") * F.col("impact")).alias("score"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "row"))
    return pairs.filter("score > 0").withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of each item: postings of the terms that items hold are written, then searched."""
    prepare(docs.sparkSession)
    asked = materialize(item_terms(items, item_col, item_text), "lex-asked")
    wanted = materialize(asked.select("term").distinct(), "lex-wanted")
    index = write_postings(docs, scratch_path(docs.sparkSession, "lex-postings"), wanted, None, id_col, text_col)
    return search(index, asked, k)
