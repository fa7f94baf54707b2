"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

* memtables: one pass over the texts gives (digest, id) rows, dealt by scan task, or by row, into as many batches as
  keep each to about `memtable_rows` rows, 64 at most.  A batch is reduced to one row per digest - smallest and largest id, copies - and
  flushed as a run sorted by digest, beside a Bloom filter of its digests: bitmaps of 32,768 bits, one for each of
  the index's slots, a slot being a share of the digests.
* compaction: `fan_in` runs of a level become one run of the next, so that levels grow with the data.  A row whose
  digest no other run's filter knows passes as it is; only the others are merged by digest, smallest identifier first.
  The new run's filter is the union of theirs, and the old runs are deleted.
* probes ask the filters first, and only digests that one of them knows are looked up in its run.
* verification: the texts of digests that occur more than once, and only those, are compared byte for
  byte by grouping on (digest, text); texts that merely share a digest fall apart again.

Semantics: texts are equal if they are identical after lower-casing A-Z.  Null text counts as
empty, so null and empty texts form one group.  A null id loses against any other id; where all
ids of a group are null, keep_id is null and every row of it is kept by exact_groups.  Rows that repeat both
id and text are separate rows with the same keep_id; all of them are kept, as their id is.  drop_copies
leaves one row of each group in every case.  Other columns are never looked at.  An empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, materialize, one_of_each, scratch_path, sized, without

#: Bits of a slot's bitmap, digests that it should hold, and bits that one digest sets.
BITS, SLOT_ROWS, HASHES = 32_768, 3_000, 3


@dataclass
class Run:
    """level; rows (slot, digest, smallest, largest, copies), sorted by digest; filter (slot, bits)."""

    level: int
    rows: DataFrame
    filter: DataFrame


def _positions(digest: F.Column) -> list[F.Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(BITS)) for k in range(HASHES)]


def _known(digest: F.Column, bits: F.Column) -> F.Column:
    """Whether a bitmap may hold a digest; no bitmap holds none."""
    out = bits.isNotNull()
    for p in _positions(digest):
        byte = F.conv(F.hex(F.substring(bits, (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        out = out & (F.floor(byte / F.pow(F.lit(2), p % 8)) % 2 == 1)
    return out


class LsmIndex:
    """Runs of digests on levels; grows by flush(), which compacts levels that are full."""

    def __init__(self, expected: int, fan_in: int = 4):
        """expected: about how many digests there will be; with more, filters only grow less sharp."""
        self.slots, self.fan_in = max(1, expected // SLOT_ROWS), fan_in
        self.runs: list[Run] = []
        self.merges: list[int] = []  # the levels that merges have made

    def _slot(self, digest: F.Column) -> F.Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.slots))

    def flush(self, batch: DataFrame) -> None:
        """Write a memtable (digest, doc_id) as a run of level 0."""
        ids = F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest"), F.count(F.lit(1)).alias("copies")
        rows = batch.groupBy("digest").agg(*ids).select(self._slot(F.col("digest")).alias("slot"), "digest", *("smallest", "largest", "copies"))
        rows = materialize(rows.sortWithinPartitions("digest"), "lsm-run")
        spread = rows.select("slot", F.explode(F.array(*_positions(F.col("digest")))).alias("at"))
        bits = spread.groupBy("slot").agg(F.bitmap_construct_agg("at").alias("bits"))
        self.runs.append(Run(0, rows, materialize(bits, "lsm-filter")))
        for level in range(1 + max(r.level for r in self.runs)):
            if sum(r.level == level for r in self.runs) >= self.fan_in:
                self._merge([r for r in self.runs if r.level == level])

    def compact(self) -> DataFrame:
        """Merge what is left into one run; its rows."""
        if len(self.runs) > 1:
            self._merge(list(self.runs))
        return self.runs[0].rows

    def _merge(self, old: list[Run]) -> None:
        rows = _union([r.rows.withColumn("run", F.lit(k)) for k, r in enumerate(old)])
        bits = _union([r.filter.withColumn("run", F.lit(k)) for k, r in enumerate(old)])
        # for each slot the filters of all runs: a row asks those of the others
        every = materialize(bits.groupBy("slot").agg(*[F.max(F.when(F.col("run") == k, F.col("bits"))).alias(f"bits{k}") for k in range(len(old))]), "lsm-filters")
        known = F.lit(False)
        for k in range(len(old)):
            known = known | ((F.col("run") != k) & _known(F.col("digest"), F.col(f"bits{k}")))
        tested = rows.join(_few(every), "slot").withColumn("known", known).drop("run", *[f"bits{k}" for k in range(len(old))])
        shared = tested.filter("known").groupBy("slot", "digest").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("copies").alias("copies"))
        new = materialize(_union([shared, tested.filter(~F.col("known")).drop("known")]).sortWithinPartitions("digest"), "lsm-run")
        filter_ = materialize(bits.groupBy("slot").agg(F.bitmap_or_agg("bits").alias("bits")), "lsm-filter")
        self.runs = [r for r in self.runs if r not in old] + [Run(1 + max(r.level for r in old), new, filter_)]
        self.merges.append(1 + max(r.level for r in old))
        for df in (every, *[x for run in old for x in (run.rows, run.filter)]):
            discard(df)

    def probe(self, batch: DataFrame) -> DataFrame:
        """(doc_id, digest, smallest, largest, copies) of the rows of batch (doc_id, digest) whose digest a run holds; a row per run."""
        rows = materialize(batch.select("doc_id", "digest", self._slot(F.col("digest")).alias("slot")), "lsm-batch")
        found = []
        for run in self.runs:
            asked = rows.join(_few(run.filter), "slot").filter(_known(F.col("digest"), F.col("bits"))).select("doc_id", "digest")
            found.append(asked.join(run.rows.drop("slot"), "digest").select("doc_id", "digest", "smallest", "largest", "copies"))
        return _union(found)


def _few(filters: DataFrame, most: int = 2_000) -> DataFrame:
    """Bitmaps of 4 kB: broadcast if they are few."""
    return sized(filters, most)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _normal(docs: DataFrame, id_col: str, text_col: str, digest_bits: int) -> DataFrame:
    """doc_id, norm, sha and digest; the digest is the hash, or the beginning of it."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), ascii_lower(docs[text_col]).alias("norm"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    return rows.withColumn("digest", F.col("sha") if digest_bits >= 256 else F.unhex(F.substring(F.hex("sha"), 1, digest_bits // 4)))


def index_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, memtable_rows: int = 16_384, most: int = 64) -> tuple[LsmIndex, DataFrame]:
    """An index of all rows, and the rows (doc_id, digest, sha).  Beyond `most` memtables they grow, each a fraction of the cluster's work."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "lsm-memtables")
    n = docs.count()
    memtables = min(most, max(1, -(-n // memtable_rows)))
    rows = _normal(docs, id_col, text_col, digest_bits).select("doc_id", "digest", *(["sha"] if digest_bits < 256 else []))
    by_task = memtables <= rows.rdd.getNumPartitions()  # then a task writes one file
    rows = rows.withColumn("memtable", F.pmod(F.spark_partition_id() if by_task else F.xxhash64(F.monotonically_increasing_id()), F.lit(memtables)).cast("int"))
    rows.write.partitionBy("memtable").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    index = LsmIndex(n)
    for k in range(memtables):
        index.flush(rows.filter(F.col("memtable") == k).select("digest", "doc_id"))
    return index, rows.select("doc_id", "digest", F.col("digest" if digest_bits >= 256 else "sha").alias("sha"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest_bits: int = 256, memtable_rows: int = 16_384) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.  keep: "smallest" or "largest"."""
    index, rows = index_of(docs, id_col, text_col, digest_bits, memtable_rows)
    hits = materialize(index.compact().filter("copies > 1").select("digest"), "lsm-hits")
    # A verified text that is alone under its digest is decided by the digest; others by their full hash.
    found = _normal(docs, id_col, text_col, digest_bits).join(sized(hits), "digest", "left_semi").groupBy("digest", "norm")
    found = found.agg((F.min if keep == "smallest" else F.max)("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    found = materialize(found.select("digest", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "keep_id", "copies", F.lit(True).alias("hit")), "lsm-verified")
    # by digest, and by full hash where several texts share one
    out = rows.join(sized(found), ["digest", "sha"], "left")
    keep_id = F.when(F.col("hit"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs with one row of each group of equal texts, that of exact_groups' keep_id; all columns stay as they are."""
    groups = materialize(exact_groups(docs, id_col, text_col, keep).select("doc_id", F.unhex("text_sha256").alias("sha"), "kept"), "lsm-groups")
    key = docs[id_col].cast("long"), F.unhex(F.sha2(ascii_lower(docs[text_col]).cast("binary"), 256))
    dropped = materialize(groups.filter(~F.col("kept")).select("doc_id", "sha").distinct(), "lsm-dropped")
    rest = without(docs, dropped, *key)
    again = materialize(groups.filter("kept").groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "sha"), "lsm-repeated")
    text = F.col(f"`{text_col}`")
    return one_of_each(rest, again, F.col(f"`{id_col}`").cast("long"), F.unhex(F.sha2(ascii_lower(text).cast("binary"), 256)))
