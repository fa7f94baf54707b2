"""Sources and sinks: JSON lines, JSON arrays, CSV, zipped members, folders, create-only outputs, cached fetches."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.functions.text import SKIPPED_FOLDERS


def json_lines(spark: SparkSession, paths: str | list[str], schema: StructType | str, tolerant: bool = False, glob: str | None = None) -> DataFrame:
    """One object per line.  Tolerant: bad lines are dropped and missing paths skipped; else both raise."""
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    names = [paths] if isinstance(paths, str) else list(paths)
    if tolerant:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def exists(name: str) -> bool:
            path = jvm.org.apache.hadoop.fs.Path(name)
            return bool(path.getFileSystem(conf).globStatus(path))

        names = [n for n in names if exists(n)]
    return reader.json(names) if names else spark.createDataFrame([], schema)


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one array each."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def zip_members(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(archive, member, text) of the members of zip files; archives are spread over tasks, members come one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if member.endswith(suffix):
                            yield pd.DataFrame([(name, member, z.read(member).decode("utf-8", "replace"))], columns=["archive", "member", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, text string")


def zipped_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Members as objects; those that do not parse, or are no objects, are left out."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    valid = F.startswith(F.trim("text"), F.lit("{")) & F.try_parse_json("text").isNotNull()
    return zip_members(spark, path).filter(valid).select("member", F.from_json("text", kind).alias("o")).select("member", "o.*")


def zipped_csv(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, row) of the CSV members of zip files, each row a map from the header's names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv as reader

        for batch in batches:
            for archive, member, text in zip(batch["archive"], batch["member"], batch["text"]):
                rows = [{k: v for k, v in r.items() if k is not None and v is not None} for r in reader.DictReader(io.StringIO(text))]
                yield pd.DataFrame({"archive": archive, "member": member, "row": rows}, columns=["archive", "member", "row"])

    return zip_members(spark, path, ".csv").mapInPandas(run, "archive string, member string, row map<string,string>")


def catalog_rows(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a zipped catalogue of weakness classes."""
    names = ("CWE-ID", "Name", "Weakness Abstraction", "Description", "Related Weaknesses")
    return zipped_csv(spark, path).select(*[F.col("row")[n].alias(n) for n in names])


def folder(spark: SparkSession, root: str, largest: int = 400_000, suffixes: list[str] | None = None, skip: bool = True) -> DataFrame:
    """(path, length, content) of the files below root; size and folder tests are made before any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(F.col("length") <= largest)
    if suffixes:
        files = files.filter(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$"))
    if skip:
        inside = F.split(F.regexp_replace("path", "^.*" + root.rstrip("/").replace(".", r"\."), ""), "/")
        files = files.filter(~F.arrays_overlap(inside, F.array(*map(F.lit, SKIPPED_FOLDERS))))
    return files.select("path", "length", F.decode("content", "UTF-8").alias("content"))


def create_only(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write a run's output; a path that exists is an error, never overwritten."""
    df.write.mode("errorifexists").format(kind).save(path)


def with_cache(requests: DataFrame, cache: DataFrame, key: str, fetch: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, largest: int | None = None, of: str = "reply") -> DataFrame:
    """Replies to requests: from the cache, else from fetch, which sees the misses only.

    A cached empty reply is a known absence and is not asked for again.  schema: that of the cache.  largest, of:
    replies whose column `of` has more bytes are given as empty, and so are absences from then on.
    """
    cached = cache.join(requests.select(key).distinct(), key, "left_semi")
    misses = requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    new = misses.mapInPandas(fetch, schema)
    if largest is not None:
        new = new.withColumn(of, F.when(F.octet_length(of) <= largest, F.col(of)).otherwise(""))
    return cached.unionByName(new)


def stub_model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A model that answers from the hash of the prompt; columns key, prompt -> key, reply."""
    import hashlib

    for b in batches:
        bits = [int(hashlib.md5(p.encode()).hexdigest()[:2], 16) for p in b["prompt"]]
        yield pd.DataFrame({"key": b["key"], "reply": [json.dumps({"vulnerable": x % 2 == 1, "cwe": f"CWE-{x}" if x % 2 else None, "reason": "stub"}) for x in bits]})


#: Reports of three scanners.
REPORTS = {
    "semgrep": "results array<struct<path:string,start:struct<line:int>,check_id:string,extra:struct<severity:string,message:string,metadata:struct<cwe:string>>>>",
    "bandit": "results array<struct<filename:string,line_number:int,test_id:string,issue_severity:string,issue_text:string,issue_cwe:struct<id:int>>>",
    "gitleaks": "File string, StartLine int, RuleID string, Secret string",
}


def tool_findings(spark: SparkSession, path: str, tool: str = "semgrep") -> DataFrame:
    """Static findings (tool, file, line, rule, cwe, severity, message, redacted) from a scanner's JSON report.

    Secrets are never carried on: redacted tells whether the report had them removed.
    """
    rows = spark.read.schema(REPORTS[tool]).option("multiLine", True).json(path)
    if tool == "gitleaks":
        hidden = F.coalesce("Secret", F.lit("")).isin("", "REDACTED")
        message = F.concat(F.lit("Hardcoded secret detected ("), F.coalesce("RuleID", F.lit("")), F.lit(")"))
        return rows.select(F.lit(tool).alias("tool"), F.col("File").alias("file"), F.col("StartLine").alias("line"), F.coalesce("RuleID", F.lit("")).alias("rule"), F.lit("CWE-798").alias("cwe"), F.lit("HIGH").alias("severity"), message.alias("message"), hidden.alias("redacted"))
    r = rows.select(F.explode("results").alias("r"))
    if tool == "semgrep":
        level, number = F.upper("r.extra.severity"), F.regexp_extract(F.coalesce("r.extra.metadata.cwe", F.lit("")), r"CWE-(\d{1,4})", 1).try_cast("int")
        fields = ["r.path", "r.start.line", F.element_at(F.split("r.check_id", r"\."), -1), "r.extra.message"]
    else:
        level, number = F.upper("r.issue_severity"), F.col("r.issue_cwe.id")
        fields = ["r.filename", "r.line_number", F.col("r.test_id"), "r.issue_text"]
    severity = F.when(level.isin("ERROR", "HIGH"), "HIGH").when(level.isin("INFO", "LOW"), "LOW").when(level == "CRITICAL", "CRITICAL").otherwise("MEDIUM")
    return r.select(F.lit(tool).alias("tool"), F.col(fields[0]).alias("file"), F.col(fields[1]).alias("line"), fields[2].alias("rule"), F.when(number > 0, F.concat(F.lit("CWE-"), number)).alias("cwe"), severity.alias("severity"), F.col(fields[3]).alias("message"), F.lit(None).cast("boolean").alias("redacted"))


def windows(spark: SparkSession, start: str, stop: str, days: int = 100) -> DataFrame:
    """(start, stop) of the paging windows between two dates."""
    first = F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(stop)), F.expr(f"interval {days} days")))
    return spark.range(1).select(first.alias("start")).select("start", F.least(F.date_add("start", days - 1), F.to_date(F.lit(stop))).alias("stop"))


def paged(pages: DataFrame, fetch: Callable[..., tuple[list[str], int]], size: int = 2_000, tries: int = 4, pause: float = 0.0) -> DataFrame:
    """(start, stop, place, record) of a paged service, a task per window of pages (start, stop).

    fetch(start, stop, at, size) gives the records from place `at` on, and how many there are in all; it is asked
    until the window is complete, and again after a failure, with pauses that double.  Windows that fail every time raise.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in batches:
            for start, stop in zip(batch["start"], batch["stop"]):
                at, total = 0, 1
                while at < total:
                    for k in range(tries):
                        try:
                            records, total = fetch(start, stop, at, size)
                            break
                        except OSError:
                            if k == tries - 1:
                                raise
                            time.sleep(pause * 2**k)
                    yield pd.DataFrame({"start": [start] * len(records), "stop": stop, "place": range(at, at + len(records)), "record": records})
                    at += max(1, len(records))

    kinds = dict(pages.dtypes)
    return pages.select("start", "stop").mapInPandas(run, f"start {kinds['start']}, stop {kinds['stop']}, place long, record string")


def html_report(rows: DataFrame, path: str, title: str, most: int = 5_000) -> int:
    """Write an aggregate as one page with a table; raises if it has more than `most` rows.  How many rows it has."""
    from html import escape

    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report has {most} rows at most; aggregate first")
    line = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape('' if c is None else str(c))}</{tag}>" for c in cells) + "</tr>"
    body = "\n".join([line(rows.columns, "th"), *(line(r, "td") for r in got)])
    page = f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><table>\n{body}\n</table>\n"
    spark = rows.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, False)
    stream.write(bytearray(page.encode()))
    stream.close()
    return len(got)
