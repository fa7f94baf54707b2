"""A durable table of replies: what was asked of a slow or paid service is stored once, and never asked again.

A store is a folder: data/<commit>/ holds the rows of a commit, log/<n>.json names its files.  A commit writes its
rows first and then creates the next log entry, which must not exist: that is the compare-and-set.  A writer that lost the race
reads the entries which came between, leaves out the keys that these hold, and tries again; so each key is stored once,
whoever asks.  Readers see the entries up to a version, never part of a commit.  Entries may also replace files: compact().

Requests are asked in parts by a hash of the key, and each part is a commit: a run that is killed leaves its
finished parts, and the next one asks only what no commit holds, by an anti-join.  Requests are read, told apart and
dealt into a folder for each part once; a part then reads its own folder and the commits that others made meanwhile.  Empty replies are stored as known absences.
Failed ones (ok = false) are returned but not stored, so that they are asked again.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPLY = "key string, reply string, ok boolean, error string, latency_s double"


def request_key(*parts: Column | str) -> Column:
    """md5 of what makes up a request: service, model, settings, texts; null parts count as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]).cast("binary"))


class ReplyStore:
    def __init__(self, spark: SparkSession, root: str, schema: str = REPLY, key: str = "key"):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.root}/log"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def version(self) -> int:
        """The number of the newest entry; 0 for an empty store."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/log"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _entry(self, number: int) -> dict:
        stream = self.fs.open(self._path(f"{self.root}/log/{number}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _created(self, number: int, entry: dict) -> bool:
        """Whether the entry is ours; false if there is one already.  Neither way leaves half an entry."""
        draft, final = self._path(f"{self.root}/log/.{uuid.uuid4().hex}"), self._path(f"{self.root}/log/{number}.json")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        try:
            if self.fs.getUri().getScheme() != "file":
                return self.fs.rename(draft, final)  # refuses a name that exists
            local = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
            try:  # a local rename would overwrite; a link does not
                self.jvm.java.nio.file.Files.createLink(local(final), local(draft))
                return True
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
        finally:
            self.fs.delete(draft, False)

    def files(self, first: int = 1, last: int | None = None) -> list[str]:
        """Files of the entries first .. last, less those that one of them replaced."""
        held: dict[str, None] = {}
        for n in range(first, (self.version() if last is None else last) + 1):
            entry = self._entry(n)
            held = {f: None for f in held if f not in set(entry["gone"])} | dict.fromkeys(entry["files"])
        return list(held)

    def _read(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows as of a version, the newest by default; one for each key."""
        return self._read(self.files(last=version))

    def _write(self, rows: DataFrame) -> list[str]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return [f"{folder}/{s.getPath().getName()}" for s in self.fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")]

    def commit(self, rows: DataFrame, base: int | None = None, against: list[str] | None = None) -> int:
        """Store the rows whose key no commit holds yet; the version that has them.

        against: the files up to version base that may hold keys of rows, all of them by default.
        """
        base = self.version() if base is None else base
        against = self.files(last=base) if against is None else against
        fresh = rows.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        if against:
            fresh = fresh.join(self._read(against).select(self.key), self.key, "left_anti")
        files = self._write(fresh.select(*self._read([]).columns))
        while not self._created(base + 1, {"files": files, "gone": []}):
            now = self.version()
            between = self._read(self.files(base + 1, now)).select(self.key)
            if not self._read(files).join(between, self.key, "left_semi").isEmpty():
                files = self._write(self._read(files).join(between, self.key, "left_anti"))
            base = now
        return base + 1

    def compact(self, target_rows: int = 1_000_000) -> int:
        """Rewrite all rows as files of about target_rows; older versions stay readable until their files are deleted.  The version."""
        while True:
            base = self.version()
            old = self.files(last=base)
            rows = self._read(old)
            files = self._write(rows.repartition(max(1, math.ceil(rows.count() / target_rows))))
            if self._created(base + 1, {"files": files, "gone": old}):
                return base + 1

    def ask(self, requests: DataFrame, fetch: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], part_rows: int = 10_000, largest: int | None = None) -> DataFrame:
        """A reply for each different key of requests, with the column cached; what is new is stored part by part.

        fetch: batches of requests -> batches of the store's columns.  largest: replies with more bytes become known absences.
        Keys that fetch gives nothing for have no row; null keys are not asked.
        """
        before = self.version()
        known = self._read(self.files(last=before))
        asked = requests.filter(F.col(self.key).isNotNull())
        parts = max(1, math.ceil(asked.count() / part_rows))
        names, part, slot = self._read([]).columns, "ask__part", "ask__slot"
        hashed = F.xxhash64(self.key)
        missing = asked.dropDuplicates([self.key]).join(known.select(self.key), self.key, "left_anti").select(*asked.columns, F.pmod(hashed, F.lit(parts)).alias(part), F.pmod(F.floor(hashed / parts), F.lit(4)).alias(slot))
        folder = f"{self.root}/ask/{uuid.uuid4().hex}"
        missing.repartition(part, slot).drop(slot).write.partitionBy(part).parquet(folder)
        failed, others, own, seen = [], {}, set(), before
        try:
            for k in range(parts):
                if not self.fs.exists(self._path(f"{folder}/{part}={k}")):
                    continue
                now = self.version()
                for n in range(seen + 1, now + 1):
                    if n not in own:  # our own commits hold other parts
                        entry = self._entry(n)
                        others = {f: None for f in others if f not in set(entry["gone"])} | dict.fromkeys(entry["files"])
                seen = now
                rows = self.spark.read.schema(asked.schema).parquet(f"{folder}/{part}={k}")
                if others:
                    rows = rows.join(self._read(list(others)).select(self.key), self.key, "left_anti")
                    if rows.isEmpty():
                        continue
                new = rows.mapInPandas(fetch, self.schema)
                if largest is not None:
                    new = new.withColumn("reply", F.when(F.octet_length("reply") <= largest, F.col("reply")).otherwise(""))
                files = self._write(new)  # each request is made once, whatever happens to the commit
                if "ok" in names:
                    failed += files
                own.add(self.commit(self._read(files).filter("ok") if "ok" in names else self._read(files), seen, list(others)))
        finally:
            self.fs.delete(self._path(folder), True)
        keys = asked.select(self.key).distinct()
        old, now = known.join(keys, self.key, "left_semi").withColumn("cached", F.lit(True)), self.read().join(keys, self.key, "left_semi").join(known.select(self.key), self.key, "left_anti").withColumn("cached", F.lit(False))
        out = old.unionByName(now)
        if failed:
            out = out.unionByName(self._read(failed).filter("not ok").join(self.read().select(self.key), self.key, "left_anti").withColumn("cached", F.lit(False)))
        return out


def stub_replies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A model that answers from the hash of the prompt; columns key, prompt -> REPLY."""
    from .readers import stub_model

    for b in stub_model(batches):
        yield b.assign(ok=True, error="", latency_s=0.0)
