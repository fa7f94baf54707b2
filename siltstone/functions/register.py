"""The column expressions that SQL lacks, as temporary SQL functions; Catalyst inlines them like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

_VERSION = r"trim(split_part(regexp_replace(regexp_replace(trim(raw), r'^[\x22\x27]+|[\x22\x27]+$', ''), r'^[\^~>=<!\s]*', ''), ',', 1))"

FUNCTIONS = {
    "norm_hash(code STRING) RETURNS STRING": r"md5(CAST(trim(regexp_replace(code, r'(?U)[\s\x1c-\x1f]+', ' ')) AS BINARY))",
    "hash_unit(text STRING) RETURNS BIGINT": "CAST(conv(substring(md5(CAST(coalesce(text, '') AS BINARY)), 1, 8), 16, 10) AS BIGINT)",
    "normal_package(ecosystem STRING, name STRING) RETURNS STRING": "CASE ecosystem WHEN 'PyPI' THEN lower(regexp_replace(trim(name), '[-_.]+', '-')) WHEN 'npm' THEN lower(trim(name)) ELSE trim(name) END",
    "clean_version(raw STRING) RETURNS STRING": rf"CASE WHEN {_VERSION} RLIKE r'^\d+(?:\.\w+)*(?:[-+.]\w+)*$' THEN {_VERSION} END",
    "normal_severity(severity STRING) RETURNS STRING": "CASE WHEN upper(severity) = 'MODERATE' THEN 'MEDIUM' ELSE upper(severity) END",
    "severity_rank(severity STRING) RETURNS INT": "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
