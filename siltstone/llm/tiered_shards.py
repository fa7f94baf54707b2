"""Sharding by size-tiered compaction, in DataFrame operations only.

A store is a folder: data/<commit>/part-*.parquet are immutable shards, manifest/<version>.json
lists the shards of a version.  append() writes an arrival as small shards; compact() merges runs of
`fan_in` shards of a tier - tier t holds sizes from target / fan_in**t up to fan_in times that - into shards of the
tier above, smallest tiers first, until files have about `target_bytes`.  Full runs of a tier are merged side by
side, each by a job without a shuffle, and committed together.  Each commit writes its data first and then
creates the next manifest by renaming a finished file to a name that must not exist, so readers see
one whole version or another, and a writer that lost the race tries again on the newer version.
Files of a task that ran twice are not listed by Spark's committed output, hence never in a manifest.
The rename is atomic and refuses a name that exists on HDFS and local file systems; a store that lacks
this needs a conditional create in its place.  Versions are kept until vacuum() deletes those before the
last few, with the files that no remaining version lists.

Semantics: rows are never changed, dropped or repeated; nulls, ties, empty texts and repeated rows
are data like any other.  An empty arrival commits a version without new shards.  A row larger
than the target has a shard that is larger.  The driver holds file names and sizes only.
"""

from __future__ import annotations

import json
import math
import uuid
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, scratch_path


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.root}/manifest"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "shards": [{"file", "bytes"}]} of a version, the newest by default."""
        known = self.versions()
        if not known:
            return {"version": 0, "shards": []}
        name = f"{self.root}/manifest/{known[-1] if version is None else version}.json"
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, change) -> dict:
        """Apply change(manifest) -> shards or None (obsolete) to the newest version, atomically."""
        while True:
            base = self.manifest()
            shards = change(base)
            if shards is None:
                return base
            new = {"version": base["version"] + 1, "shards": shards}
            temporary = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
            stream = self.fs.create(temporary, False)
            stream.write(bytearray(json.dumps(new).encode()))
            stream.close()
            final = self._path(f"{self.root}/manifest/{new['version']}.json")
            if not self.fs.exists(final) and self.fs.rename(temporary, final):
                return new
            self.fs.delete(temporary, False)

    def _listed(self, folder: str) -> list[dict]:
        return [{"file": f"{folder}/{s.getPath().getName()}", "bytes": s.getLen()} for s in self.fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")]

    def _write(self, df: DataFrame) -> list[dict]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", 0).parquet(folder)
        return self._listed(folder)

    def append_parts(self, df: DataFrame, part: str) -> None:
        """Commit one arrival for each value of the column part, in order; df is read once, and the column is not stored."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", 0).partitionBy(part).parquet(folder)
        for name in sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)) if s.isDirectory()):
            new = self._listed(f"{folder}/{name}")
            self._commit(lambda base, new=new: base["shards"] + new)

    def vacuum(self, keep: int = 1) -> int:
        """Delete all versions but the last `keep`, and the files that only they list; how many files went.

        Only files that an old manifest names are touched, so that writers at work lose nothing.
        """
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        held = {s["file"] for v in kept for s in self.manifest(v)["shards"]}
        gone = {s["file"] for v in old for s in self.manifest(v)["shards"]} - held
        for v in old:
            self.fs.delete(self._path(f"{self.root}/manifest/{v}.json"), False)
        for file in gone:
            self.fs.delete(self._path(file), False)
        return len(gone)

    def append(self, df: DataFrame) -> dict:
        """Commit an arrival; its shards are as the tasks of df write them."""
        new = self._write(df)
        return self._commit(lambda base: base["shards"] + new)

    def tier(self, size: int) -> int:
        """0 for target-sized shards, more for smaller ones."""
        return 0 if size >= self.target / 2 else max(1, math.ceil(math.log(self.target / max(size, 1), self.fan_in)))

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """All rows of a version."""
        files = [s["file"] for s in self.manifest(version)["shards"]]
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*files) if files else self.spark.createDataFrame([], schema)

    def plan(self) -> list[list[dict]]:
        """Runs to merge: the smallest tier that has fan_in shards, in runs of fan_in, smaller shards first; what is left over stays."""
        tiers: dict[int, list[dict]] = {}
        for s in sorted(self.manifest()["shards"], key=lambda s: (s["bytes"], s["file"])):
            tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        full = [t for t, shards in tiers.items() if t > 0 and len(shards) >= self.fan_in]
        shards = tiers[max(full)] if full else []
        return [shards[k : k + self.fan_in] for k in range(0, len(shards) - self.fan_in + 1, self.fan_in)]

    def merge(self, runs: list[list[dict]]) -> dict:
        """Replace the shards of each run by larger ones, in one commit; nothing changes if one of them is gone by then."""
        def larger(run: list[dict]) -> list[dict]:
            return self._write(self.spark.read.parquet(*(s["file"] for s in run)).coalesce(max(1, round(sum(s["bytes"] for s in run) / self.target))))

        with ThreadPool(min(8, len(runs))) as pool:  # Spark runs the jobs side by side
            merged = [s for shards in pool.map(larger, runs) for s in shards]
        gone = {s["file"] for run in runs for s in run}

        def swap(base: dict) -> list[dict] | None:
            here = {s["file"] for s in base["shards"]}
            return None if not gone <= here else [s for s in base["shards"] if s["file"] not in gone] + merged

        return self._commit(swap)

    def compact(self, at_once: int = 32, keep: int | None = None) -> list[int]:
        """Merge until no tier has fan_in shards, at most at_once runs in a commit; the tier of each run that was merged.

        keep: how many versions vacuum() leaves after each commit; without it all stay.
        """
        done = []
        while runs := self.plan()[:at_once]:
            done += [self.tier(run[0]["bytes"]) for run in runs]
            self.merge(runs)
            if keep:
                self.vacuum(keep)
        return done


def arrivals(store: ShardStore, docs: DataFrame, id_col: str, number: int) -> None:
    """Append docs in `number` arrivals, by a hash of the id; docs is read once, and each task adds a shard to an arrival it has rows of."""
    name = fresh(docs, "arrival")
    store.append_parts(docs.withColumn(name, F.pmod(F.xxhash64(id_col), number)), name)


def _task_bytes(docs: DataFrame) -> int:
    """What one task reads of docs at most, by the optimiser's estimate, in which files count with their size."""
    state = docs.sparkSession._jsparkSession.sessionState().conf()
    held = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(held // max(1, len(docs.inputFiles())), int(state.filesMaxPartitionBytes()))


def shard_table(docs: DataFrame, id_col: str = "doc_id", number: int | None = None, target_bytes: int = 32 << 20, fan_in: int = 4, root: str | None = None) -> DataFrame:
    """Stores docs by arrivals and compaction; all their rows and columns as the last version holds
    them, with the columns shard (file), shard_bytes and store_version (underscores are added to
    names that docs has).

    number: of arrivals; as many as make shards of target_bytes / fan_in ** 2 by default, fan_in ** 2 at least, so that two
    tiers are merged on the way to the target.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or scratch_path(spark, "shards"), target_bytes, fan_in)
    if number is None:
        number = fan_in**2 * max(1, math.ceil(_task_bytes(docs) / target_bytes))
    arrivals(store, docs, id_col, number)
    store.compact(keep=2)  # readers of the version before the last may go on
    store.vacuum()
    manifest = store.manifest()
    rows = store.read(schema=docs.schema)
    names = []
    for name in ("shard", "shard_bytes", "store_version"):
        while name.lower() in {c.lower() for c in docs.columns}:
            name += "_"
        names.append(name)
    if not manifest["shards"]:
        return rows.select("*", F.lit("").alias(names[0]), F.lit(0).cast("long").alias(names[1]), F.lit(manifest["version"]).cast("long").alias(names[2]))
    file = F.regexp_extract("_metadata.file_path", "/data/([^/]+/.*)$", 1)
    return rows.select("*", file.alias(names[0]), F.col("_metadata.file_size").alias(names[1]), F.lit(manifest["version"]).cast("long").alias(names[2]))
