"""Advisory records: two JSON feeds to rows of flaws, fixes and affected packages.

Fixed values: the shape of commit addresses and identifiers, placeholder classes, scores of severities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMIT = r"https?://github\.com/([A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]+)/commits?/([0-9a-fA-F]{7,40})"
IDENTIFIER = r"^CVE-\d{4}-\d+$"
PLACEHOLDERS = ["CWE-noinfo", "CWE-Other", "NVD-CWE-noinfo", "NVD-CWE-Other"]
SCORE_OF_SEVERITY = {"CRITICAL": 9.5, "HIGH": 7.5, "MODERATE": 5.5, "MEDIUM": 5.5, "LOW": 3.0}
LANGUAGE_OF_ECOSYSTEM = {"PyPI": "python", "npm": "javascript", "Maven": "java"}

#: A record of the first feed; metrics of three versions, the newest that is there counts.
METRIC = "array<struct<cvssData:struct<baseScore:double,baseSeverity:string>,baseSeverity:string>>"
FLAW = (
    "id string, published string, vulnStatus string, descriptions array<struct<lang:string,value:string>>, weaknesses array<struct<description:array<struct<value:string>>>>, "
    f"references array<struct<url:string,tags:array<string>>>, metrics struct<cvssMetricV31:{METRIC},cvssMetricV30:{METRIC},cvssMetricV2:{METRIC}>"
)
#: A record of the second feed.
ADVISORY = (
    "id string, published string, summary string, aliases array<string>, database_specific struct<cwe_ids:array<string>,severity:string>, references array<struct<type:string,url:string>>, "
    "affected array<struct<package:struct<name:string,ecosystem:string>,versions:array<string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>>>"
)


def _list(array: Column, kind: str) -> Column:
    return F.coalesce(array, F.array().cast(f"array<{kind}>"))


def commits(references: Column, tagged) -> Column:
    """array<struct(repo, sha, tagged_patch, url)> of the references that are commits.

    tagged: a reference -> whether it is marked as the fix.  The first of equal commits stays, letters' case aside;
    marked ones come first, else the order stays.
    """
    found = F.transform(
        F.filter(references, lambda r: r["url"].rlike(COMMIT)),
        lambda r: F.struct(F.regexp_replace(F.regexp_extract(r["url"], COMMIT, 1), r"\.git$", "").alias("repo"), F.regexp_extract(r["url"], COMMIT, 2).alias("sha"), F.coalesce(tagged(r), F.lit(False)).alias("tagged_patch"), r["url"].alias("url")),
    )
    key = lambda c: F.lower(F.concat_ws("@", c["repo"], c["sha"]))
    first = F.filter(found, lambda c, i: ~F.exists(F.slice(found, F.lit(1), i), lambda b: key(b) == key(c)))
    return F.concat(F.filter(first, lambda c: c["tagged_patch"]), F.filter(first, lambda c: ~c["tagged_patch"]))


def flaws(records: DataFrame, text: str = "record") -> DataFrame:
    """Usable records of the first feed: not rejected, with a class that tells something and a commit.

    Adds cve_id, published, cwe_ids, cwe_primary, description, cvss_score, cvss_severity, commit_refs.
    """
    r = records.withColumn("r", F.from_json(text, FLAW)).filter(F.coalesce(F.col("r.vulnStatus") != "Rejected", F.lit(True)))
    values = F.flatten(F.transform(_list(F.col("r.weaknesses"), "struct<description:array<struct<value:string>>>"), lambda w: _list(F.transform(w["description"], lambda d: F.trim(d["value"])), "string")))
    classes = F.array_distinct(F.filter(values, lambda v: v.startswith("CWE-") & ~v.isin(*PLACEHOLDERS)))
    metric = F.coalesce(*[F.get(F.col(f"r.metrics.{m}"), 0) for m in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])
    english = F.get(F.filter("r.descriptions", lambda d: d["lang"] == "en"), 0)["value"]
    out = r.select(
        *records.columns, F.col("r.id").alias("cve_id"), F.col("r.published").alias("published"), classes.alias("cwe_ids"), F.get(classes, 0).alias("cwe_primary"), F.coalesce(english, F.lit("")).alias("description"),
        metric["cvssData"]["baseScore"].alias("cvss_score"), F.coalesce(metric["cvssData"]["baseSeverity"], metric["baseSeverity"]).alias("cvss_severity"),
        commits(F.col("r.references"), lambda x: F.array_contains(x["tags"], "Patch")).alias("commit_refs"),
    )
    return out.filter((F.size("cwe_ids") > 0) & (F.size("commit_refs") > 0))


def _alias(r: str) -> Column:
    return F.get(F.filter(f"{r}.aliases", lambda a: a.rlike(IDENTIFIER)), 0)


def _classes(r: str) -> Column:
    return F.filter(_list(F.col(f"{r}.database_specific.cwe_ids"), "string"), lambda c: c.startswith("CWE-"))


def _severity(r: str) -> Column:
    up = F.upper(f"{r}.database_specific.severity")
    return F.when(up != "", up)


def advisories(records: DataFrame, text: str = "record") -> DataFrame:
    """Usable records of the second feed in the first one's form: cve_id is the first alias that is one, else the id."""
    r = records.withColumn("r", F.from_json(text, ADVISORY))
    scores = F.create_map(*[F.lit(x) for kv in SCORE_OF_SEVERITY.items() for x in kv])
    out = r.select(
        *records.columns, F.coalesce(_alias("r"), F.col("r.id")).alias("cve_id"), F.col("r.id").alias("osv_id"), F.col("r.published").alias("published"), _classes("r").alias("cwe_ids"), F.get(_classes("r"), 0).alias("cwe_primary"),
        scores[F.coalesce(_severity("r"), F.lit(""))].alias("cvss_score"), _severity("r").alias("cvss_severity"), commits(F.col("r.references"), lambda x: x["type"] == "FIX").alias("commit_refs"),
    )
    return out.filter((F.size("cwe_ids") > 0) & (F.size("commit_refs") > 0))


def fixed_versions(ranges: Column) -> Column:
    """Versions that end a range of ecosystem or semantic versions."""
    known = F.filter(ranges, lambda x: x["type"].isin("ECOSYSTEM", "SEMVER"))
    ends = F.flatten(F.transform(known, lambda x: F.transform(F.filter(x["events"], lambda e: e["fixed"] != ""), lambda e: e["fixed"])))
    return _list(ends, "string")


def affected_packages(records: DataFrame, text: str = "record", newest: int = 25) -> DataFrame:
    """One row per package that a record of the second feed lists with versions, the last `newest` of them."""
    r = records.withColumn("r", F.from_json(text, ADVISORY)).select(*records.columns, "r", F.explode("r.affected").alias("a"))
    versions, languages = F.col("a.versions"), F.create_map(*[F.lit(x) for kv in LANGUAGE_OF_ECOSYSTEM.items() for x in kv])
    fit = (F.col("a.package.name") != "") & F.col("a.package.ecosystem").isin(*LANGUAGE_OF_ECOSYSTEM) & (F.size(versions) > 0)
    last = F.slice(versions, F.greatest(F.size(versions) - newest + 1, F.lit(1)), newest)
    return r.filter(fit).select(
        *records.columns, F.col("r.id").alias("advisory_id"), _alias("r").alias("cve_id"), F.col("a.package.ecosystem").alias("ecosystem"), languages[F.col("a.package.ecosystem")].alias("language"), F.col("a.package.name").alias("package"),
        last.alias("vulnerable_versions"), fixed_versions(F.col("a.ranges")).alias("fixed_versions"), _classes("r").alias("cwe_ids"), F.get(_classes("r"), 0).alias("cwe_primary"), _severity("r").alias("severity"), F.substring(F.coalesce("r.summary", F.lit("")), 1, 300).alias("summary"), F.col("r.published").alias("published"),
    )


def identifier(cve: Column, advisory: Column) -> Column:
    return F.coalesce(F.when(cve != "", cve), F.when(advisory != "", advisory), F.lit("unidentified"))


def remediation(fixed: Column) -> Column:
    """What to upgrade to; null if nothing fixes it."""
    return F.concat(F.lit("upgrade to "), F.get(fixed, 0))


def named_classes(samples: DataFrame, names: DataFrame) -> DataFrame:
    """samples with cwe_name, from names (cwe, name), a catalogue of fixed size, where label is 1; others keep theirs.  changed: whether it is new."""
    listed = names.select(F.col("cwe").alias("listed__"), F.col("name").alias("name__"))
    out = samples.join(F.broadcast(listed), (F.col("cwe") == F.col("listed__")) & (F.col("label") == 1), "left")
    own = (F.col("label") == 1) & F.col("cwe").isNotNull()
    new = F.when(own, F.col("name__")).otherwise(F.col("cwe_name"))
    return out.select(*[c for c in samples.columns if c != "cwe_name"], new.alias("cwe_name"), F.coalesce(own & ~new.eqNullSafe(F.col("cwe_name")), F.lit(False)).alias("changed"))


def class_catalog(rows: DataFrame) -> DataFrame:
    """(cwe, name, abstraction, description, parents, children) of a catalogue's CSV rows; ids that are no numbers are left out."""
    ids = rows.filter(F.trim("`CWE-ID`").rlike("^[0-9]+$"))
    parents = F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce("`Related Weaknesses`", F.lit("")), F.lit(r"ChildOf:CWE ID:(\d+)"), F.lit(1))), lambda p: F.concat(F.lit("CWE-"), p))
    trimmed = lambda c: F.trim(F.coalesce(f"`{c}`", F.lit("")))
    out = ids.select(F.concat(F.lit("CWE-"), F.trim("`CWE-ID`")).alias("cwe"), trimmed("Name").alias("name"), trimmed("Weakness Abstraction").alias("abstraction"), F.substring(trimmed("Description"), 1, 400).alias("description"), parents.alias("parents"))
    below = out.select(F.explode("parents").alias("parent"), "cwe").groupBy("parent").agg(F.array_sort(F.collect_set("cwe")).alias("children"))
    return out.join(below, out.cwe == below.parent, "left").select(*out.columns, _list(F.col("children"), "string").alias("children"))
