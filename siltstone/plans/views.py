"""Stand-ins: the engine's tables over the synthetic test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Samples: documents as function bodies, with labels where they exist."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    i = F.col("doc_id")
    return d.join(lab, "doc_id", "left").select(
        i.alias("sample_id"), F.col("text").alias("code"), F.col("lang").alias("language"), F.col("source").alias("repo"), "n_chars",
        T.norm_hash(F.col("text")).alias("func_hash"), F.when(i % 2 == 0, "pre").otherwise("post").alias("version"), F.floor(i / 2).alias("pair_id"),
        (1 - F.col("quality")).alias("label"), F.concat(F.lit("CWE-"), i % 12).alias("cwe"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("loc"),
    )


CORPUS = r"""corpus AS (SELECT d.doc_id AS sample_id, d.text AS code, d.lang AS language, d.source AS repo, d.n_chars,
 md5(trim(regexp_replace(d.text, '\s+', ' ', 'g'))) AS func_hash, CASE WHEN d.doc_id % 2 = 0 THEN 'pre' ELSE 'post' END AS version, d.doc_id // 2 AS pair_id,
 1 - l.quality AS label, 'CWE-' || (d.doc_id % 12) AS cwe, length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS loc
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

RULES = {
    "short": "n_chars < 300",
    "noise": r"(\*\*\*|###|%%%|\$\$\$|&&&)",
    "pii": r'(token = "|@mail|([0-9]{1,3}\.){3}[0-9]{1,3})',
    "license": "[Ll]icense",
    "bars": r"\|.*\|.*\|",
    "shout": "[A-Z]{3}",
}


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of six rule configurations on the labelled samples; every 17th reply is unparsed."""
    c = corpus(spark, sf).filter("label is not null")
    flags = [F.struct(F.lit(k).alias("config"), (F.expr(r) if k == "short" else F.col("code").rlike(r)).cast("int").alias("raw")) for k, r in RULES.items()]
    p = c.select("sample_id", "repo", "language", F.col("label").alias("truth"), F.explode(F.array(*flags)).alias("x")).select("*", "x.*").drop("x")
    i = F.col("sample_id")
    p = p.withColumn("pred", F.when(i % 17 != 0, F.col("raw"))).drop("raw")
    return p.withColumn("true_cwe", F.when(F.col("truth") == 1, F.concat(F.lit("CWE-"), i % 12))).withColumn("pred_cwe", F.when(F.col("pred") == 1, F.concat(F.lit("CWE-"), (i + (i % 3 == 0).cast("int")) % 12)))


_ARMS = " UNION ALL ".join(f"SELECT '{k}' AS config, *, CAST({r if k == 'short' else f"regexp_matches(code, '{r}')"} AS INTEGER) AS raw FROM corpus WHERE label IS NOT NULL" for k, r in RULES.items())
PREDICTIONS = f"""raw_preds AS ({_ARMS}),
preds AS (SELECT sample_id, repo, language, label AS truth, config, pred, CASE WHEN label = 1 THEN 'CWE-' || (sample_id % 12) END AS true_cwe,
 CASE WHEN pred = 1 THEN 'CWE-' || ((sample_id + CAST(sample_id % 3 = 0 AS INTEGER)) % 12) END AS pred_cwe
 FROM (SELECT *, CASE WHEN sample_id % 17 <> 0 THEN raw END AS pred FROM raw_preds))"""


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings: events, their kinds and levels spread by id."""
    i = F.col("event_id")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(i / n) % len(names) + 1).cast("int"))
    return table(spark, sf, "events").select(
        i, F.concat(F.lit("r"), F.col("user_id") % 60).alias("repo"), F.concat(F.lit("f"), F.col("user_id")).alias("file"), "event_type", "value",
        pick(["vulnerability", "secret", "dependency", "supply_chain", "malware"], 3).alias("pillar"), pick(["LOW", "MEDIUM", "HIGH", "LOW", "CRITICAL", None], 2).alias("severity"),
        pick(["C", "B", "C", "B", "A"], 7).alias("tier"), pick(["known", "known_location", "novel", "unconfirmed", None], 1).alias("novelty"),
        F.minute("ts").alias("line"), F.concat(F.lit("CWE-"), i % 4).alias("cwe"),
    )


def _pick(names: list[str | None], n: int) -> str:
    return "CASE (event_id // %d) %% %d %s END" % (n, len(names), " ".join(f"WHEN {k} THEN " + (f"'{x}'" if x else "NULL") for k, x in enumerate(names)))


FINDINGS = f"""findings AS (SELECT event_id, 'r' || (user_id % 60) AS repo, 'f' || user_id AS file, event_type, value,
 {_pick(["vulnerability", "secret", "dependency", "supply_chain", "malware"], 3)} AS pillar, {_pick(["LOW", "MEDIUM", "HIGH", "LOW", "CRITICAL", None], 2)} AS severity,
 {_pick(["C", "B", "C", "B", "A"], 7)} AS tier, {_pick(["known", "known_location", "novel", "unconfirmed", None], 1)} AS novelty,
 minute(ts) AS line, 'CWE-' || (event_id % 4) AS cwe FROM events)"""

PATHS = ["src/app.py", "tests/test_app.py", "package.json", ".env", "lib/jquery.min.js", "setup.py", "conf/settings.yml", "docs/readme.md", ".github/workflows/ci.yml", "pom.xml", "src/Main.java", "spec/data.json", "bin/tool", "a/dist/x.bundle.js"]


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Files: one per document, at one of a few kinds of path."""
    names = F.array(*map(F.lit, PATHS))
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("repo"), F.concat(F.lit("p"), F.col("doc_id"), F.lit("/"), F.element_at(names, (F.col("doc_id") % len(PATHS) + 1).cast("int"))).alias("path"), F.col("text").alias("content"), "n_chars")


FILES = "files AS (SELECT doc_id, source AS repo, 'p' || doc_id || '/' || list_extract([%s], CAST(doc_id %% %d + 1 AS INTEGER)) AS path, text AS content, n_chars FROM documents)" % (", ".join(f"'{p}'" for p in PATHS), len(PATHS))


def advisories(spark: SparkSession, sf: str) -> DataFrame:
    """Advisories: parts with affected versions, several per package."""
    size = F.col("p_size")
    return table(spark, sf, "part").filter("p_size % 4 > 0").select(
        F.col("p_partkey").alias("advisory_id"), F.col("p_type").alias("ecosystem"), (F.col("p_partkey") % 500).alias("package"),
        F.sequence(F.lit(1), size % 4).alias("versions"), F.when(size > 37, "CRITICAL").when(size > 25, "HIGH").when(size > 12, "MODERATE").otherwise("LOW").alias("severity"), (size % 2 == 0).alias("has_cve"),
    )


ADVISORIES = """advisories AS (SELECT p_partkey AS advisory_id, p_type AS ecosystem, p_partkey % 500 AS package, range(1, p_size % 4 + 1) AS versions,
 CASE WHEN p_size > 37 THEN 'CRITICAL' WHEN p_size > 25 THEN 'HIGH' WHEN p_size > 12 THEN 'MODERATE' ELSE 'LOW' END AS severity, p_size % 2 = 0 AS has_cve FROM part WHERE p_size % 4 > 0)"""


def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Dependencies: order lines; every fifth has no version."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("ecosystem"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("manifest"), "l_partkey", F.col("l_linenumber").alias("number"))
    return li.join(p, li.l_partkey == p.p_partkey).select("manifest", "number", "ecosystem", (F.col("l_partkey") % 700).alias("package"), F.when(F.col("l_partkey") % 5 != 0, F.col("number")).alias("version"))


DEPENDENCIES = """deps AS (SELECT l_orderkey AS manifest, l_linenumber AS number, p_type AS ecosystem, l_partkey % 700 AS package, CASE WHEN l_partkey % 5 <> 0 THEN l_linenumber END AS version FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def plain(text):
    """Whole texts without what would end a string literal or an object."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N} .,;:]", " ")


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies in six shapes, each with a whole document as its prose: strict, fenced, truncated, verdict cues, no verdict."""
    i, q, text = F.col("doc_id"), F.lit, plain(F.col("text"))
    bad = F.when(i % 3 == 0, "true").otherwise("false")
    shape = (F.when(i % 6 == 0, F.concat(q('{"vulnerable": '), bad, q(', "cwe": "CWE-'), i % 900, q('", "reason": "'), text, q('"}')))
             .when(i % 6 == 1, F.concat(text, q('\n```json\n{"vulnerable": '), bad, q(', "cwe": null}\n```\n'), text))
             .when(i % 6 == 2, F.concat(q('{"vulnerable": '), bad, q(', "cwe": "CWE-'), i % 90, q('", "reason": "'), text))
             .when(i % 6 == 3, F.concat(text, q(" Vulnerability: NO. It is vulnerable to CWE-"), i % 50))
             .when(i % 6 == 4, F.concat(q("Vulnerability: YES, type CWE-0"), i % 50, q(". "), text)).otherwise(text))
    return table(spark, sf, "documents").select(i, shape.alias("reply"))


REPLIES = "replies AS (SELECT doc_id FROM documents)"  # what a reply says follows from its document's id

VIEWS = {"corpus": CORPUS, "preds": PREDICTIONS, "findings": FINDINGS, "files": FILES, "advisories": ADVISORIES, "deps": DEPENDENCIES, "replies": REPLIES}


def with_views(body: str, *names: str) -> str:
    """SQL body with the definitions of the named stand-ins before it (corpus is implied by preds)."""
    if "preds" in names and "corpus" not in names:
        names = ("corpus", *names)
    recursive = "RECURSIVE " if body.lstrip().upper().startswith("RECURSIVE") else ""
    rest = body.lstrip()[9:].lstrip() if recursive else body.lstrip()
    defs = ", ".join(VIEWS[n] for n in names)
    if rest.upper().startswith("WITH "):
        return f"WITH {recursive}{defs}, {rest[5:]}"
    return f"WITH {recursive}{defs} {rest}"
