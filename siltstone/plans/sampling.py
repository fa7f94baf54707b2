"""Queries of top-k, sampling and allocation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import severity_rank
from siltstone.operators import evaluate as E
from siltstone.operators import sampling as S
from siltstone.operators.lookup import top_per

from .evaluation import CELLS, _metrics
from .registry import query
from .views import advisories, corpus, files, findings, predictions, table

_H = "CAST(('0x' || substr(md5('%s' || '|' || %s), 1, 8)) AS BIGINT)"
_BASE = "lower(split_part(path, '/', -1))"
_EXT = r"regexp_extract(" + _BASE + r", '^.+\.([^.]+)$', 1)"
_LOW = "len(list_intersect(string_split(lower(path), '/'), ['test', 'tests', 'testing', 'spec', 'specs', 'fixtures', 'benchmark', 'benchmarks', 'migrations', 'locale', 'i18n'])) > 0"
_SKIP = "len(list_intersect(string_split(lower(path), '/'), ['.git', 'node_modules', 'venv', '.venv', '__pycache__', 'dist', 'build', 'vendor', '.idea', '.devcontainer', '.github', 'site-packages', 'third_party', 'docs', 'doc', 'examples', 'example'])) > 0"
_CODE = f"{_EXT} IN ('c', 'h', 'cc', 'cpp', 'cxx', 'hpp', 'hh', 'hxx', 'java', 'py', 'js', 'mjs', 'cjs', 'jsx', 'ts', 'tsx')"
_MANIFEST = f"{_BASE} IN ('requirements.txt', 'package.json', 'pom.xml', 'package-lock.json', 'pipfile', 'build.gradle')"
_SECRET = f"{_EXT} IN ('env', 'yml', 'yaml', 'properties', 'ini', 'cfg', 'json', 'toml')"
PRIORITY_SQL = f"""CASE WHEN {_MANIFEST} THEN 0 WHEN starts_with({_BASE}, '.env') OR {_BASE} IN ('credentials', 'secrets.yml') THEN 1
 WHEN {_CODE} THEN CASE WHEN {_LOW} THEN 5 WHEN {_BASE} IN ('setup.py', '__init__.py') THEN 2 WHEN contains({_BASE}, '.min.') OR ends_with({_BASE}, '.bundle.js') OR ends_with({_BASE}, '.pack.js') THEN 7 ELSE 3 END
 WHEN {_SECRET} THEN CASE WHEN {_LOW} THEN 6 ELSE 4 END ELSE 9 END"""
_ROUTED = f"({_MANIFEST} OR {_CODE} OR {_SECRET} OR starts_with({_BASE}, '.env'))"


@query(f"""WITH f AS (SELECT repo, path, {PRIORITY_SQL} AS priority, doc_id % 4 AS hits, n_chars <= 6000 AS fits FROM files WHERE NOT ({_SKIP}) AND {_ROUTED})
SELECT repo, path, priority, hits, fits AND row_number() OVER (PARTITION BY repo, fits ORDER BY priority > 1, hits = 0, priority, hits DESC, lower(path)) <= 25 AS selected FROM f""", "files")
def k01_budget_topk(spark, sf):
    f = files(spark, sf).select("repo", "path", (F.col("doc_id") % 4).alias("hits"), F.col("n_chars").alias("size"))
    return S.scan_budget(f, 25, 6000).select("repo", "path", "priority", "hits", "selected")


@query(f"SELECT repo, sample_id FROM (SELECT repo, sample_id, row_number() OVER (PARTITION BY repo ORDER BY {_H % ('cap', 'sample_id')}, sample_id) AS k FROM corpus) WHERE k <= 5", "corpus")
def k02_group_cap(spark, sf):
    return S.group_cap(corpus(spark, sf).select("repo", "sample_id"), "repo", "sample_id", 5)


@query("SELECT repo, count(*) FILTER (k <= 12) AS checked, count(*) FILTER (k > 12) AS omitted FROM (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY sample_id) AS k FROM corpus) GROUP BY 1", "corpus")
def k03_first_n(spark, sf):
    k = F.row_number().over(W.partitionBy("repo").orderBy("sample_id"))
    return corpus(spark, sf).select("repo", k.alias("k")).groupBy("repo").agg(F.count_if(F.col("k") <= 12).alias("checked"), F.count_if(F.col("k") > 12).alias("omitted"))


@query("SELECT func_hash, count(*) AS n FROM corpus GROUP BY 1 ORDER BY n DESC, func_hash LIMIT 10", "corpus")
def k04_most_common(spark, sf):
    return corpus(spark, sf).groupBy("func_hash").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "func_hash").limit(10)


@query(f"WITH r AS (SELECT sample_id, language, cwe, row_number() OVER (PARTITION BY language, cwe ORDER BY {_H % ('robin', 'sample_id')}, sample_id) AS round FROM corpus) SELECT sample_id, language, cwe FROM r ORDER BY round, {_H % ('robin', "language || '|' || cwe")}, language, cwe, sample_id LIMIT 60", "corpus")
def k05_round_robin(spark, sf):
    return S.round_robin(corpus(spark, sf).select("sample_id", "language", "cwe"), ["language", "cwe"], "sample_id", 60).drop("round")


@query()
def k06_capped_round_robin(spark, sf):
    return S.capped_round_robin(corpus(spark, sf), "language", "repo", "sample_id", 40, 3)


@query(f"SELECT sample_id, label FROM (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {_H % ('balance', 'sample_id')}, sample_id) AS k FROM corpus WHERE label IS NOT NULL) WHERE k <= CASE WHEN label = 1 THEN 20 ELSE 21 END", "corpus")
def k09_balanced_sample(spark, sf):
    return S.balanced(corpus(spark, sf).filter("label is not null").select("sample_id", "label"), "label", "sample_id", 41)


@query(f"""WITH p AS (SELECT sample_id, language, label FROM corpus WHERE label IS NOT NULL AND NOT (language = 'de' AND loc < 40)), n AS (SELECT language AS pool, sample_id, label, row_number() OVER (PARTITION BY language, label ORDER BY {_H % ('shots', 'sample_id')}, sample_id) AS r FROM p UNION ALL SELECT NULL, sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {_H % ('shots', 'sample_id')}, sample_id) FROM p),
l AS (SELECT language, CASE WHEN (SELECT count(*) FROM p WHERE p.language = c.language) >= 6 THEN language END AS source FROM (SELECT DISTINCT language FROM corpus) c), k AS (SELECT l.*, i AS place FROM l, (SELECT unnest(range(6)) AS i)),
h AS (SELECT pool, least(count(*) FILTER (label = 1), 6) AS bad, least(count(*) FILTER (label = 0), 6) AS good FROM n GROUP BY 1), t AS (SELECT k.*, bad, good, CASE WHEN place % 2 = 0 AND bad > 0 THEN 1 WHEN good > 0 THEN 0 ELSE 1 END AS label, CASE WHEN bad = 0 OR good = 0 THEN place ELSE place // 2 END AS turn FROM k JOIN h ON h.pool IS NOT DISTINCT FROM k.source)
SELECT t.language, CAST(t.place AS INTEGER) AS place, n.sample_id, CAST(n.label AS INTEGER) AS label FROM t JOIN n ON n.pool IS NOT DISTINCT FROM t.source AND n.label = t.label AND n.r = t.turn % CASE WHEN t.label = 1 THEN bad ELSE good END + 1""", "corpus")
def k10_few_shot(spark, sf):
    """Six examples for each language; one language has few samples of its own in the pool, and none of some sizes."""
    c = corpus(spark, sf)
    pool = c.filter("label is not null and not (language = 'de' and loc < 40)").select("sample_id", "language", "label")
    return S.few_shots(c.select("language"), pool, 6)


@query(f"SELECT sample_id FROM corpus ORDER BY {_H % ('limit', 'sample_id')}, sample_id LIMIT 50", "corpus")
def k11_hash_limit(spark, sf):
    return corpus(spark, sf).select("sample_id").orderBy(*S.hash_order("limit", "sample_id")).limit(50)


@query("SELECT sample_id FROM corpus ORDER BY sample_id LIMIT 50", "corpus")
def k12_prefix_limit(spark, sf):
    return corpus(spark, sf).select("sample_id").orderBy("sample_id").limit(50)


@query(f"""WITH c AS (SELECT config, {CELLS}, count(*) FILTER (pred IS NULL) AS unparsed FROM preds GROUP BY 1), m AS (SELECT *, {_metrics()} FROM c)
SELECT config, f1, balanced_accuracy, row_number() OVER (ORDER BY f1 DESC, balanced_accuracy DESC, unparsed, config) AS place FROM m""", "preds")
def k13_rank_configs(spark, sf):
    p = predictions(spark, sf)
    u = p.groupBy("config").agg(F.count_if(F.col("pred").isNull()).alias("unparsed"))
    place = F.row_number().over(W.orderBy(F.desc("f1"), F.desc("balanced_accuracy"), "unparsed", "config")).cast("long")
    return E.scored_by(p, "config").join(u, "config").select("config", "f1", "balanced_accuracy", place.alias("place"))


@query(f"""WITH c AS (SELECT language AS model, config AS strategy, {CELLS}, count(*) AS n, CASE WHEN config IN ('noise', 'pii', 'bars') THEN 1.0::DOUBLE ELSE avg(CAST(pred IS NOT NULL AS INTEGER)) END AS kept, count(*) FILTER (config = 'bars' AND language = 'en') AS errors FROM preds GROUP BY 1, 2),
m AS (SELECT *, {_metrics()} FROM c), v AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, balanced_accuracy DESC, strategy) AS k FROM m WHERE errors = 0 AND kept = 1.0)
SELECT model, strategy, f1, model IS NOT DISTINCT FROM (SELECT model FROM v WHERE k = 1 ORDER BY f1 DESC, model LIMIT 1) AS best FROM v WHERE k = 1""", "preds")
def k13_winners(spark, sf):
    p = predictions(spark, sf)
    kept = F.when(F.first("config").isin("noise", "pii", "bars"), 1.0).otherwise(F.avg(F.col("pred").isNotNull().cast("int")))
    more = p.groupBy("language", "config").agg(F.count(F.lit(1)).alias("n"), kept.alias("format_adherence"), F.count_if((F.col("config") == "bars") & (F.col("language") == "en")).alias("api_errors"))
    scored = E.scored_by(p, "language", "config").join(more, ["language", "config"]).withColumnsRenamed({"language": "model", "config": "strategy"})
    return E.best_strategies(scored).select("model", "strategy", "f1", "best")


@query("SELECT sample_id, (row_number() OVER (PARTITION BY repo ORDER BY sample_id) - 1) % 4 AS generator FROM corpus", "corpus")
def k14_modulo_assign(spark, sf):
    k = F.row_number().over(W.partitionBy("repo").orderBy("sample_id")) - 1
    return corpus(spark, sf).select("sample_id", F.pmod(k, F.lit(4)).cast("long").alias("generator"))


@query("SELECT event_id, row_number() OVER (PARTITION BY repo ORDER BY pillar, -(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END), event_id) AS place FROM findings", "findings")
def k15_report_order(spark, sf):
    w = W.partitionBy("repo").orderBy("pillar", -severity_rank(F.col("severity")), "event_id")
    return findings(spark, sf).select("event_id", F.row_number().over(w).cast("long").alias("place"))


@query(f"""WITH p AS (SELECT p_type AS ecosystem, p_partkey % 20 AS case_id, p_partkey, p_size % 4 > 0 AS vulnerable FROM part), z AS (SELECT *, 3 + CAST(('0x' || substr(md5('case|' || ecosystem || '|' || case_id), 1, 8)) AS BIGINT) % 6 AS size FROM p),
r AS (SELECT *, CAST(greatest(1, round(size * 0.4)) AS BIGINT) AS bad, row_number() OVER (PARTITION BY ecosystem, case_id, vulnerable ORDER BY {_H % ('case', 'p_partkey')}, p_partkey) AS k FROM z)
SELECT ecosystem, case_id, p_partkey, vulnerable, row_number() OVER (PARTITION BY ecosystem, case_id ORDER BY {_H % ('shuffle', 'p_partkey')}, p_partkey) AS place FROM r WHERE k <= CASE WHEN vulnerable THEN bad ELSE size - bad END""")
def k16_manifest_synthesis(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("ecosystem"), (F.col("p_partkey") % 20).alias("case_id"), "p_partkey", (F.col("p_size") % 4 > 0).alias("vulnerable"))
    return S.case_packages(p, ["ecosystem", "case_id"], "vulnerable", "p_partkey", 3, 8, 0.4)


@query(f"WITH c AS (SELECT language, config, {CELLS} FROM preds GROUP BY 1, 2), m AS (SELECT *, {_metrics()} FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY f1 DESC, config) AS k FROM m) SELECT language, config, f1 FROM r WHERE k = 1", "preds")
def k17_best_config(spark, sf):
    return top_per(E.scored_by(predictions(spark, sf), "language", "config"), ["language"], 1, F.desc("f1"), F.col("config")).select("language", "config", "f1")


@query("SELECT ecosystem, package, list(advisory_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MODERATE' THEN 2 ELSE 1 END DESC, has_cve DESC, advisory_id)[1] AS advisory, CASE WHEN bool_or(severity = 'MODERATE') THEN 'MEDIUM' ELSE 'none' END AS has_medium FROM advisories GROUP BY 1, 2", "advisories")
def p17_normal_severity(spark, sf):
    from siltstone.functions.text import normal_severity

    a = advisories(spark, sf)
    order = F.struct(severity_rank(F.col("severity")), F.col("has_cve").cast("int"), -F.col("advisory_id"))
    return a.groupBy("ecosystem", "package").agg(F.max_by("advisory_id", order).alias("advisory"), F.when(F.bool_or(normal_severity(F.col("severity")) == "MEDIUM"), "MEDIUM").otherwise("none").alias("has_medium"))
