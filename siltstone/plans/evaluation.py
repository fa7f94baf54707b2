"""Queries of aggregation, evaluation and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import metrics as M
from siltstone.functions import text as T
from siltstone.operators import evaluate as E
from siltstone.operators import sketches as K

from .registry import query
from .views import corpus, dependencies, advisories, findings, predictions, table

CELLS = "CAST(count(*) FILTER (pred = 1 AND truth = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (pred = 1 AND truth = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (pred = 0 AND truth = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (pred = 0 AND truth = 1) AS BIGINT) AS fn"


def _metrics(empty: str = "0.0") -> str:
    r = lambda a, b: f"CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE {empty} END"
    rec, spec = r("tp", "(tp + fn)"), r("tn", "(tn + fp)")
    t, f, n, m = ("CAST(%s AS DOUBLE)" % c for c in ("tp", "fp", "tn", "fn"))
    out = {"accuracy": r("(tp + tn)", "(tp + fp + tn + fn)"), "precision": r("tp", "(tp + fp)"), "recall": rec, "f1": r("2 * tp", "(2 * tp + fp + fn)"), "balanced_accuracy": f"(({rec}) + ({spec})) / 2",
           "mcc": r(f"({t} * {n} - {f} * {m})", f"sqrt(({t} + {f}) * ({t} + {m}) * ({n} + {f}) * ({n} + {m}))")}
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in out.items())


@query("SELECT language, repo, count(*) AS n, count(DISTINCT func_hash) AS hashes FROM corpus GROUP BY 1, 2", "corpus")
def a01_group_count(spark, sf):
    return corpus(spark, sf).groupBy("language", "repo").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("func_hash").alias("hashes"))


@query(f"SELECT config, {CELLS} FROM preds GROUP BY 1", "preds")
def a02_confusion(spark, sf):
    return E.confusion_by(predictions(spark, sf), "config")


@query(f"WITH c AS (SELECT config, {CELLS} FROM (SELECT config, truth, coalesce(pred, 0) AS pred FROM preds) GROUP BY 1) SELECT *, {_metrics()} FROM c", "preds")
def a03_binary_metrics(spark, sf):
    return E.scored_by(predictions(spark, sf), "config", null_as_negative=True)


@query(f"WITH c AS (SELECT config, language, {CELLS} FROM preds GROUP BY 1, 2) SELECT *, {_metrics('NULL')} FROM c", "preds")
def a03n_metrics_null_on_zero(spark, sf):
    return E.scored_by(predictions(spark, sf), "config", "language", empty=None)


@query(f"""WITH c AS (SELECT config, {CELLS}, count(*) AS n, count(*) FILTER (pred IS NULL) AS unparsed, count(*) FILTER (truth = 1) AS positives,
 count(*) FILTER (truth = 1 AND pred_cwe = true_cwe) AS strict_hits, round(avg((sample_id % 100) / 10.0), 2) AS mean_latency, CAST(sum(1 + sample_id % 3) AS BIGINT) AS calls FROM preds GROUP BY 1)
SELECT *, {_metrics()}, round((n - unparsed) / CAST(n AS DOUBLE), 6) AS adherence, round(CASE WHEN positives > 0 THEN strict_hits / CAST(positives AS DOUBLE) ELSE 0 END, 6) AS cwe_accuracy FROM c""", "preds")
def a04_score_summary(spark, sf):
    p = predictions(spark, sf)
    more = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred").isNull()).alias("unparsed"), F.count_if(F.col("truth") == 1).alias("positives"), F.count_if((F.col("truth") == 1) & (F.col("pred_cwe") == F.col("true_cwe"))).alias("strict_hits")]
    # what a call took, and how many a sample needed
    more += [F.round(F.avg((F.col("sample_id") % 100) / 10.0), 2).alias("mean_latency"), F.sum(1 + F.col("sample_id") % 3).alias("calls")]
    c = p.groupBy("config").agg(*M.confusion(F.col("pred"), F.col("truth")), *more)
    return c.select("*", *[v.alias(k) for k, v in M.binary_metrics().items()], F.round((F.col("n") - F.col("unparsed")) / F.col("n"), 6).alias("adherence"), F.round(M.ratio(F.col("strict_hits"), F.col("positives")), 6).alias("cwe_accuracy"))


_MACRO = """WITH classes AS (SELECT DISTINCT config, true_cwe AS cls FROM preds WHERE truth = 1),
%s
h AS (SELECT p.config, r.cls, count(*) FILTER (p.true_cwe = r.cls) AS tp, count(*) FILTER (p.true_cwe IS DISTINCT FROM r.cls) AS fp FROM preds p JOIN rel r ON r.config = p.config AND r.match = p.pred_cwe GROUP BY 1, 2),
q AS (SELECT config, true_cwe AS cls, count(*) AS p FROM preds WHERE truth = 1 GROUP BY 1, 2)
SELECT q.config, round(avg(2.0 * coalesce(tp, 0) / (coalesce(tp, 0) + coalesce(fp, 0) + p)), 6) AS macro_f1 FROM q LEFT JOIN h ON h.config = q.config AND h.cls = q.cls GROUP BY 1"""


@query(_MACRO % "rel AS (SELECT config, cls, cls AS match FROM classes),", "preds")
def a05_macro_f1_strict(spark, sf):
    return E.macro_f1(predictions(spark, sf))


@query(_MACRO % "edges AS (SELECT 'CWE-' || (n_nationkey % 12) AS truth, 'CWE-' || n_regionkey AS match FROM nation WHERE n_regionkey <> 0), rel AS (SELECT config, cls, cls AS match FROM classes UNION SELECT config, cls, match FROM classes JOIN edges ON truth = cls),", "preds")
def a05_macro_f1_lenient(spark, sf):
    n = table(spark, sf, "nation").filter("n_regionkey <> 0")
    return E.macro_f1(predictions(spark, sf), n.select(F.concat(F.lit("CWE-"), F.col("n_nationkey") % 12).alias("truth"), F.concat(F.lit("CWE-"), "n_regionkey").alias("match")))


@query("SELECT config, count(*) FILTER (truth = 0 AND language = 'en') AS n, round(avg(CASE WHEN truth = 0 AND language = 'en' THEN coalesce(pred, 0) END), 6) AS fp_rate FROM preds GROUP BY 1", "preds")
def a06_subset_fp_rate(spark, sf):
    some = (F.col("truth") == 0) & (F.col("language") == "en")
    return predictions(spark, sf).groupBy("config").agg(F.count_if(some).alias("n"), F.round(F.avg(F.when(some, F.coalesce("pred", F.lit(0)))), 6).alias("fp_rate"))


@query("""WITH v AS (SELECT DISTINCT package, unnest(versions) AS version FROM advisories),
m AS (SELECT d.manifest, count(DISTINCT d.package) FILTER (v.package IS NOT NULL AND d.number % 2 = 1) AS tp, count(DISTINCT d.package) FILTER (v.package IS NULL AND d.number % 2 = 1) AS fp,
 count(DISTINCT d.package) FILTER (v.package IS NOT NULL AND d.number % 2 = 0) AS fn FROM deps d LEFT JOIN v ON v.package = d.package AND v.version = d.version GROUP BY 1)
SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM m""", "advisories", "deps")
def a07_micro_set_metrics(spark, sf):
    v = advisories(spark, sf).select("package", F.explode("versions").alias("version")).distinct().withColumn("bad", F.lit(True))
    d = dependencies(spark, sf).join(v, ["package", "version"], "left")
    odd, bad = F.col("number") % 2 == 1, F.col("bad").isNotNull()
    sets = [F.countDistinct(F.when(cond, F.col("package"))).alias(k) for k, cond in (("tp", bad & odd), ("fp", ~bad & odd), ("fn", bad & ~odd))]
    s = d.groupBy("manifest").agg(*sets).agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return s.select("*", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


@query("""SELECT language, count(*) AS n, round(avg(CAST(n_chars < 2000 AS INTEGER)), 6) AS selected, round(avg(CASE WHEN n_chars < 2000 THEN CAST(loc > 3 AS INTEGER) END), 6) AS hit_given_selected FROM corpus GROUP BY 1""", "corpus")
def a08_conditional_rates(spark, sf):
    small = F.col("n_chars") < 2000
    return corpus(spark, sf).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(small.cast("int")), 6).alias("selected"), F.round(F.avg(F.when(small, (F.col("loc") > 3).cast("int"))), 6).alias("hit_given_selected"))


@query("""WITH w AS (SELECT sample_id, language, max(truth) AS truth, max(CASE WHEN config = 'bars' THEN pred END) AS a, max(CASE WHEN config = 'noise' THEN pred END) AS b FROM preds GROUP BY 1, 2)
SELECT CASE WHEN grouping(language) = 0 THEN language ELSE 'all' END AS slice, count(*) AS n, count(*) FILTER (a IS NULL OR b IS NULL) AS failed, count(*) FILTER (a = 1 AND b = 0) AS lost, count(*) FILTER (a = 0 AND b = 1) AS gained FROM w GROUP BY GROUPING SETS ((), (language))""", "preds")
def a09_paired_flips(spark, sf):
    w = predictions(spark, sf).groupBy("sample_id", "language").agg(F.max(F.when(F.col("config") == "bars", F.col("pred"))).alias("a"), F.max(F.when(F.col("config") == "noise", F.col("pred"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    g = w.rollup("language").agg(F.grouping("language").alias("all"), F.count(F.lit(1)).alias("n"), F.count_if(a.isNull() | b.isNull()).alias("failed"), F.count_if((a == 1) & (b == 0)).alias("lost"), F.count_if((a == 0) & (b == 1)).alias("gained"))
    return g.select(F.when(F.col("all") == 1, "all").otherwise(F.col("language")).alias("slice"), "n", "failed", "lost", "gained")


@query("""SELECT language, count(*) FILTER (a = 1) AS caught, count(*) FILTER (a = 1 AND b = 1) AS still, CASE WHEN count(*) FILTER (a = 1) > 0 THEN round((count(*) FILTER (a = 1) - count(*) FILTER (a = 1 AND b = 1)) / CAST(count(*) FILTER (a = 1) AS DOUBLE), 6) END AS evasion
FROM (SELECT sample_id, language, max(CASE WHEN config = 'short' THEN pred END) AS a, max(CASE WHEN config = 'shout' THEN pred END) AS b FROM preds GROUP BY 1, 2) GROUP BY 1""", "preds")
def a10_evasion_rate(spark, sf):
    w = predictions(spark, sf).groupBy("sample_id", "language").agg(F.max(F.when(F.col("config") == "short", F.col("pred"))).alias("a"), F.max(F.when(F.col("config") == "shout", F.col("pred"))).alias("b"))
    g = w.groupBy("language").agg(F.count_if(F.col("a") == 1).alias("caught"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("still"))
    return g.withColumn("evasion", F.round(M.ratio(F.col("caught") - F.col("still"), F.col("caught"), None), 6))


@query("WITH m AS (SELECT repo, event_type, count(*) AS n FROM findings GROUP BY 1, 2) SELECT event_type AS kind, CAST(sum(n) AS BIGINT) AS total, count(*) AS repos FROM m GROUP BY 1", "findings")
def a11_map_merge(spark, sf):
    per = findings(spark, sf).groupBy("repo", "event_type").count().groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("by_kind"))
    return per.select(F.explode("by_kind").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("repos"))


@query("""WITH c AS (SELECT CASE WHEN count(*) OVER (PARTITION BY cwe) >= 30 THEN cwe ELSE 'other' END AS cls, repo FROM (SELECT cwe || CASE WHEN sample_id % 5 = 0 THEN '-rare' ELSE '' END AS cwe, repo FROM corpus WHERE label IS NOT NULL)) SELECT cls, count(*) AS n, count(DISTINCT repo) AS repos FROM c GROUP BY 1""", "corpus")
def a12_label_space(spark, sf):
    c = corpus(spark, sf).filter("label is not null").withColumn("cwe", F.concat("cwe", F.when(F.col("sample_id") % 5 == 0, "-rare").otherwise("")))
    kept = c.groupBy("cwe").count().select("cwe", F.when(F.col("count") >= 30, F.col("cwe")).otherwise("other").alias("cls"))
    return c.join(kept, "cwe").groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repo").alias("repos"))


@query("""WITH p AS (SELECT pair_id, count(DISTINCT version) AS sides, count(DISTINCT func_hash) AS bodies FROM corpus GROUP BY 1),
t AS (SELECT count(*) FILTER (code = '') AS empty_code, count(*) FILTER (label = 1 AND cwe IS NULL) AS positive_without_cwe, count(*) FILTER (label = 0 AND cwe IS NOT NULL) AS negative_with_cwe, count(*) FILTER (version = 'pre' AND sample_id % 10 = 0) AS pre_without_changed_lines,
 count(*) FILTER (loc <> length(code) - length(replace(code, chr(10), '')) + 1) AS loc_mismatch, count(*) FILTER (language NOT IN ('en', 'de', 'fr')) AS unexpected_language, count(*) - count(DISTINCT func_hash) AS duplicate_hash FROM corpus),
u AS (SELECT count(*) FILTER (sides < 2) AS incomplete_pair, count(*) FILTER (sides = 2 AND bodies = 1) AS identical_pair FROM p)
SELECT name, n FROM (SELECT * FROM t, u) UNPIVOT (n FOR name IN (empty_code, positive_without_cwe, negative_with_cwe, pre_without_changed_lines, loc_mismatch, unexpected_language, duplicate_hash, incomplete_pair, identical_pair))""", "corpus")
def a13_integrity(spark, sf):
    c = corpus(spark, sf).withColumn("changed_lines", F.when(F.col("sample_id") % 10 != 0, F.array(F.lit(1))))
    lines = F.length("code") - F.length(F.replace("code", F.lit("\n"), F.lit(""))) + 1
    t = c.agg(F.count_if(F.col("code") == "").alias("empty_code"), F.count_if((F.col("label") == 1) & F.col("cwe").isNull()).alias("positive_without_cwe"), F.count_if((F.col("label") == 0) & F.col("cwe").isNotNull()).alias("negative_with_cwe"),
              F.count_if((F.col("version") == "pre") & F.col("changed_lines").isNull()).alias("pre_without_changed_lines"), F.count_if(F.col("loc") != lines).alias("loc_mismatch"), F.count_if(~F.col("language").isin("en", "de", "fr")).alias("unexpected_language"), (F.count(F.lit(1)) - F.countDistinct("func_hash")).alias("duplicate_hash"))
    u = c.groupBy("pair_id").agg(F.countDistinct("version").alias("sides"), F.countDistinct("func_hash").alias("bodies")).agg(F.count_if(F.col("sides") < 2).alias("incomplete_pair"), F.count_if((F.col("sides") == 2) & (F.col("bodies") == 1)).alias("identical_pair"))
    return t.crossJoin(F.broadcast(u)).unpivot([], [*t.columns, *u.columns], "name", "n")


@query("""WITH r AS (SELECT language, loc, row_number() OVER (PARTITION BY language ORDER BY loc) AS k, count(*) OVER (PARTITION BY language) AS n FROM corpus),
j AS (SELECT language, loc, k, n, i, greatest(1, least(n - 1, (i * (n + 1)) // 4)) AS j FROM r, (SELECT unnest([1, 2, 3]) AS i) WHERE n > 1),
q AS (SELECT language, i, max(CASE WHEN k = j THEN loc END) AS a, max(CASE WHEN k = j + 1 THEN loc END) AS b, max(i * (n + 1) - j * 4) AS d FROM j GROUP BY 1, 2)
SELECT language, round(max(CASE WHEN i = 1 THEN (a * (4 - d) + b * d) / 4.0 END), 6) AS q1, round(max(CASE WHEN i = 2 THEN (a * (4 - d) + b * d) / 4.0 END), 6) AS q2, round(max(CASE WHEN i = 3 THEN (a * (4 - d) + b * d) / 4.0 END), 6) AS q3 FROM q GROUP BY 1""", "corpus")
def a14_quantiles_exclusive(spark, sf):
    return E.exclusive_quantiles(corpus(spark, sf), "language", "loc")


@query("WITH r AS (SELECT repo, n_chars, row_number() OVER (PARTITION BY repo ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY repo) AS n FROM corpus) SELECT repo, max(CASE WHEN k = n // 2 THEN n_chars END) AS median, max(CASE WHEN k = (9 * n) // 10 THEN n_chars END) AS p90 FROM r GROUP BY 1", "corpus")
def a15_index_quantiles(spark, sf):
    return E.index_quantiles(corpus(spark, sf), "repo", "n_chars", median=(1, 2), p90=(9, 10))


@query("WITH g AS (SELECT language, repo, avg(n_chars) AS m, count(*) AS n FROM corpus GROUP BY 1, 2) SELECT language, round(sum(m * n) / sum(n), 4) AS mean FROM g GROUP BY 1", "corpus")
def a16_weighted_mean(spark, sf):
    g = corpus(spark, sf).groupBy("language", "repo").agg(F.avg("n_chars").alias("m"), F.count(F.lit(1)).alias("n"))
    return g.groupBy("language").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 4).alias("mean"))


@query("SELECT ecosystem, package, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS versions FROM (SELECT DISTINCT ecosystem, package, unnest(versions) AS v FROM advisories) GROUP BY 1, 2", "advisories")
def a17_affected_versions(spark, sf):
    v = advisories(spark, sf).select("ecosystem", "package", F.explode("versions").alias("v"))
    return v.groupBy("ecosystem", "package").agg(F.array_join(F.array_sort(F.collect_set("v")), ",").alias("versions"))


@query("SELECT event_type, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, count(DISTINCT user_id) AS users, min(year(ts)) AS first_year FROM events GROUP BY 1")
def a18_corpus_coverage(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"), F.countDistinct("user_id").alias("users"), F.min(F.year("ts").cast("long")).alias("first_year"))


@query("SELECT config, count(*) FILTER (pred IS NULL) AS empties, round(avg(pred), 6) AS mean_flag, round(avg(CASE WHEN pred_cwe IS NOT NULL THEN CAST(pred_cwe = true_cwe AS INTEGER) END), 6) AS mean_match FROM preds GROUP BY 1", "preds")
def a19_mean_ignoring_nulls(spark, sf):
    return predictions(spark, sf).groupBy("config").agg(F.count_if(F.col("pred").isNull()).alias("empties"), F.round(F.avg("pred"), 6).alias("mean_flag"), F.round(F.avg((F.col("pred_cwe") == F.col("true_cwe")).cast("int")), 6).alias("mean_match"))


@query("SELECT cwe, count(*) AS n, count(*) FILTER (label = 1) AS bad FROM corpus WHERE label IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (label = 1) >= 1 ORDER BY bad DESC, cwe LIMIT 5", "corpus")
def a20_having_topk(spark, sf):
    g = corpus(spark, sf).filter("label is not null").groupBy("cwe").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("bad"))
    return g.filter("bad >= 1").orderBy(F.desc("bad"), "cwe").limit(5)


@query("""WITH w AS (SELECT sample_id, max(CASE WHEN config = 'bars' THEN pred END) AS a, max(CASE WHEN config = 'short' THEN pred END) AS b FROM preds GROUP BY 1), t AS (SELECT a, b FROM w WHERE a IS NOT NULL AND b IS NOT NULL),
s AS (SELECT count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM t) SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM s""", "preds")
def a21_kappa(spark, sf):
    w = predictions(spark, sf).groupBy("sample_id").agg(F.max(F.when(F.col("config") == "bars", F.col("pred"))).alias("a"), F.max(F.when(F.col("config") == "short", F.col("pred"))).alias("b")).filter("a is not null and b is not null")
    s = w.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("po"), F.avg("a").alias("a"), F.avg("b").alias("b"))
    pe = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return s.select("n", F.round("po", 6).alias("agreement"), F.round(M.kappa(F.col("po"), pe), 6).alias("kappa"))


@query("SELECT config, round(avg(CAST(truth = 0 AS INTEGER)), 6) AS always_negative, round(avg(CASE WHEN repo <> 'src0' THEN CAST(coalesce(pred, 0) = truth AS INTEGER) END), 6) AS without_largest, count(*) FILTER (repo <> 'src0') AS n FROM preds GROUP BY 1", "preds")
def a22_exclusion_sensitivity(spark, sf):
    other = F.col("repo") != "src0"
    right = (F.coalesce("pred", F.lit(0)) == F.col("truth")).cast("int")
    return predictions(spark, sf).groupBy("config").agg(F.round(F.avg((F.col("truth") == 0).cast("int")), 6).alias("always_negative"), F.round(F.avg(F.when(other, right)), 6).alias("without_largest"), F.count_if(other).alias("n"))


@query("SELECT config, language, CAST(grouping(config) AS TINYINT) AS g_config, CAST(grouping(language) AS TINYINT) AS g_language, count(*) AS n, count(*) FILTER (pred = truth) AS good FROM preds GROUP BY ROLLUP (config, language)", "preds")
def a25_rollup_breakdown(spark, sf):
    return predictions(spark, sf).rollup("config", "language").agg(F.grouping("config").alias("g_config"), F.grouping("language").alias("g_language"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("truth")).alias("good"))


_DRAW = "CAST(('0x' || substr(md5(%s), 1, 8)) AS BIGINT)"


def _binomial(cell: int, name: str, left: str, whole: str, source: str) -> str:
    """b<cell>: source with the draw of a cell, by the whole distribution function."""
    inner = f"""SELECT *, {left} AS m, CASE WHEN {whole} > 0 THEN {name} / CAST({whole} AS DOUBLE) ELSE 0.0 END AS p, ({_DRAW % f"rep || '|{cell}'"} + 0.5) / 4294967296.0::DOUBLE AS u FROM {source}"""
    mass = "CASE WHEN p <= 0 THEN CAST(k = 0 AS DOUBLE) WHEN p >= 1 THEN CAST(k = m AS DOUBLE) ELSE exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(p) + (m - k) * ln(1 - p)) END"
    return f"""p{cell} AS (SELECT config, rep, min(k) AS drawn{cell} FROM (SELECT config, rep, k, u, sum({mass}) OVER (PARTITION BY config, rep ORDER BY k) AS upto FROM ({inner}) s, LATERAL (SELECT unnest(range(s.m + 1)) AS k)) WHERE upto >= u GROUP BY 1, 2),
b{cell} AS (SELECT s.*, drawn{cell} FROM {source} s JOIN p{cell} USING (config, rep))"""


@query(f"""WITH c AS (SELECT config, {CELLS}, count(*) AS n FROM (SELECT config, truth, coalesce(pred, 0) AS pred FROM preds) GROUP BY 1), b AS (SELECT c.*, rep FROM c, (SELECT unnest(range(200)) AS rep)),
{_binomial(0, "tp", "n", "n", "b")}, {_binomial(1, "fp", "n - drawn0", "(n - tp)", "b0")}, {_binomial(2, "tn", "n - drawn0 - drawn1", "(n - tp - fp)", "b1")},
f AS (SELECT config, rep, 2.0 * drawn0 / greatest(2 * drawn0 + drawn1 + (n - drawn0 - drawn1 - drawn2), 1) AS f1 FROM b2), l AS (SELECT config, list_sort(list(f1)) AS s FROM f GROUP BY 1) SELECT config, round(s[6], 6) AS low, round(s[195], 6) AS high FROM l""", "preds")
def x01_bootstrap_ci(spark, sf):
    return E.bootstrap_f1(predictions(spark, sf))


@query(f"""WITH p AS (SELECT config, repo, count(*) FILTER (coalesce(pred, 0) = truth) AS good, count(*) AS n, row_number() OVER (PARTITION BY config ORDER BY repo) - 1 AS spot, count(*) OVER (PARTITION BY config) AS k FROM preds GROUP BY 1, 2),
s AS (SELECT config, rep, {_DRAW % "rep || '|' || spot"} % k AS spot FROM p, (SELECT unnest(range(200)) AS rep)),
f AS (SELECT s.config, s.rep, sum(good) / CAST(sum(n) AS DOUBLE) AS v FROM s JOIN p ON p.config = s.config AND p.spot = s.spot GROUP BY 1, 2), l AS (SELECT config, list_sort(list(v)) AS s FROM f GROUP BY 1) SELECT config, round(s[6], 6) AS low, round(s[195], 6) AS high FROM l""", "preds")
def x02_cluster_bootstrap(spark, sf):
    return E.cluster_bootstrap(predictions(spark, sf), "repo")


_PAIRS = """pairs AS (SELECT x.config AS a, y.config AS b, count(*) AS n, count(*) FILTER (coalesce(x.pred, 0) = x.truth AND coalesce(y.pred, 0) <> y.truth) AS b10, count(*) FILTER (coalesce(x.pred, 0) <> x.truth AND coalesce(y.pred, 0) = y.truth) AS b01,
 count(*) FILTER (x.truth <> y.truth) AS conflicts FROM preds x JOIN preds y ON x.sample_id = y.sample_id AND x.config < y.config GROUP BY 1, 2 HAVING count(*) >= 10)"""
_TESTS = _PAIRS + """, tests AS (SELECT a || '/' || b AS pair, b01, b10, CASE WHEN b01 + b10 = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(b01 + b10 + 1) - lgamma(i + 1) - lgamma(b01 + b10 - i + 1) - (b01 + b10) * ln(2.0))) FROM (SELECT unnest(range(0, least(b01, b10) + 1)) AS i))) END AS p FROM pairs)"""


def _tests(spark, sf):
    return E.with_mcnemar(E.paired(predictions(spark, sf))).select(F.concat_ws("/", "a", "b").alias("pair"), "b01", "b10", "p")


@query(f"WITH {_PAIRS} SELECT * FROM pairs", "preds")
def j08_pairwise_agreement(spark, sf):
    return E.paired(predictions(spark, sf))


@query(f"WITH {_TESTS} SELECT pair, b01, b10, round(p, 6) AS p FROM tests", "preds")
def x03_mcnemar(spark, sf):
    return _tests(spark, sf).withColumn("p", F.round("p", 6))


_HOLM = f"WITH {_TESTS}, r AS (SELECT pair, p, count(*) OVER () - row_number() OVER (ORDER BY p, pair) + 1 AS left_over FROM tests)"


@query(_HOLM + " SELECT pair, min(CAST(p <= 0.05 / left_over AS INTEGER)) OVER (ORDER BY p, pair ROWS UNBOUNDED PRECEDING) = 1 AS rejected FROM r", "preds")
def x04_holm_flags(spark, sf):
    return E.holm(_tests(spark, sf), "pair").select("pair", "rejected")


@query(_HOLM + " SELECT pair, round(max(least(1.0, p * left_over)) OVER (ORDER BY p, pair ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM r", "preds")
def x05_holm_adjusted(spark, sf):
    return E.holm(_tests(spark, sf), "pair").select("pair", F.round("adjusted", 6).alias("adjusted"))


@query(f"""WITH d AS (SELECT repo, sum(CASE WHEN config = 'bars' THEN CAST(coalesce(pred, 0) = truth AS INTEGER) ELSE -CAST(coalesce(pred, 0) = truth AS INTEGER) END) AS d FROM preds WHERE config IN ('bars', 'short') GROUP BY 1 HAVING d <> 0),
f AS (SELECT rep, abs(sum(d * CASE WHEN {_DRAW % "rep || '|' || repo"} % 2 = 0 THEN 1 ELSE -1 END)) AS flip, abs(sum(d)) AS seen FROM d, (SELECT unnest(range(500)) AS rep) GROUP BY 1)
SELECT round((count(*) FILTER (flip >= seen) + 1) / 501.0, 6) AS p, (SELECT count(*) FROM d) AS clusters, (SELECT CAST(coalesce(sum(d), 0) AS BIGINT) FROM d) AS difference FROM f""", "preds")
def x06_sign_flip(spark, sf):
    return E.sign_flip(predictions(spark, sf), "bars", "short", "repo")


_Z = M.Z95


@query(f"""WITH c AS (SELECT config, count(*) FILTER (coalesce(pred, 0) = truth) AS k, count(*) AS n FROM preds GROUP BY 1), q AS (SELECT *, k / CAST(n AS DOUBLE) AS p FROM c)
SELECT config, k, n, round(p, 6) AS point, round(greatest(0, ((p + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n)) - {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4.0 * n * n)) / (1 + {_Z * _Z} / n)), 6) AS low,
 round(least(1, ((p + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n)) + {_Z} * sqrt(p * (1 - p) / n + {_Z * _Z} / (4.0 * n * n)) / (1 + {_Z * _Z} / n)), 6) AS high, round(1 - pow(0.05, 1.0 / n), 6) AS zero_failure_bound FROM q""", "preds")
def x07_wilson(spark, sf):
    c = predictions(spark, sf).groupBy("config").agg(F.count_if(F.coalesce("pred", F.lit(0)) == F.col("truth")).alias("k"), F.count(F.lit(1)).alias("n"))
    return c.select("config", "k", "n", *[F.round(v, 6).alias(k) for k, v in M.wilson(F.col("k"), F.col("n")).items()], F.round(1 - F.pow(F.lit(0.05), 1 / F.col("n")), 6).alias("zero_failure_bound"))


@query("""WITH c AS (SELECT doc_id, length(text) AS n, unnest(string_split(text, '')) AS ch FROM documents), k AS (SELECT doc_id, n, ch, count(*) AS c FROM c GROUP BY 1, 2, 3) SELECT doc_id, round(-sum(c / CAST(n AS DOUBLE) * log2(c / CAST(n AS DOUBLE))), 6) AS entropy FROM k GROUP BY 1""")
def x13_entropy(spark, sf):
    return table(spark, sf, "documents").filter("text <> ''").select("doc_id", F.round(T.entropy(F.col("text")), 6).alias("entropy"))


@query(f"""WITH c AS (SELECT config, {CELLS}, count(*) AS n FROM (SELECT config, truth, coalesce(pred, 0) AS pred FROM preds) GROUP BY 1),
b AS (SELECT c.*, rep FROM c, (SELECT unnest(range(200)) AS rep)), {_binomial(0, "tp", "n", "n", "b")}, {_binomial(1, "fp", "n - drawn0", "(n - tp)", "b0")}, {_binomial(2, "tn", "n - drawn0 - drawn1", "(n - tp - fp)", "b1")},
d AS (SELECT config, rep, drawn0 AS tp, drawn1 AS fp, drawn2 AS tn, n - drawn0 - drawn1 - drawn2 AS fn FROM b2),
m AS (SELECT *, {_metrics()} FROM d), l AS (SELECT config, metric, list_sort(list(value)) AS s FROM (SELECT config, rep, f1, mcc, balanced_accuracy FROM m) UNPIVOT (value FOR metric IN (f1, mcc, balanced_accuracy)) GROUP BY 1, 2),
q AS (SELECT config, metric, value AS point FROM (SELECT config, f1, mcc, balanced_accuracy FROM (SELECT *, {_metrics()} FROM c)) UNPIVOT (value FOR metric IN (f1, mcc, balanced_accuracy))), u AS (SELECT config, count(*) AS n, round(avg(CAST(pred IS NULL AS INTEGER)), 4) AS parse_fail_rate FROM preds GROUP BY 1)
SELECT u.config, u.n, u.parse_fail_rate, q.metric, q.point, round(s[6], 6) AS low, round(s[195], 6) AS high FROM u JOIN q ON q.config = u.config JOIN l ON l.config = q.config AND l.metric = q.metric""", "preds")
def x09_report(spark, sf):
    return E.report(predictions(spark, sf))[0].select("config", "n", "parse_fail_rate", "metric", "point", "low", "high")


@query(_HOLM + " SELECT pair, rejected, adjusted, b01, b10 FROM (SELECT pair, b01, b10, min(CAST(p <= 0.05 / left_over AS INTEGER)) OVER (ORDER BY p, pair ROWS UNBOUNDED PRECEDING) = 1 AS rejected, round(max(least(1.0, p * left_over)) OVER (ORDER BY p, pair ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM (SELECT r.pair, r.p, r.left_over, tests.b01, tests.b10 FROM r JOIN tests ON tests.pair = r.pair))", "preds")
def x09_pairwise(spark, sf):
    return E.report(predictions(spark, sf))[1].select("pair", "rejected", F.round("adjusted", 6).alias("adjusted"), "b01", "b10")


@query("""WITH n AS (SELECT language, count(DISTINCT loc * 100000 + length(code)) AS n_distinct FROM corpus GROUP BY 1) SELECT language, n_distinct, true AS distinct_within, true AS median_within FROM n""", "corpus")
def a26_mergeable_sketches(spark, sf):
    """Sketches of each language and repo, in two tables that are united and merged; answers against the whole rows, within the stated bounds."""
    c = corpus(spark, sf).select("language", "repo", "version", (F.col("loc") * 100_000 + F.length("code")).alias("size"))
    tables = [K.sketches(c.filter(F.col("version") == v), ["language"], F.col("repo"), "size", "size") for v in ("pre", "post")]
    a = K.answers(tables[0].unionByName(tables[1]), ["language"], (0.5,)).withColumnRenamed("language", "of")
    both = c.join(F.broadcast(a), c.language.eqNullSafe(a.of))  # a row per language
    n = F.count(F.lit(1))
    s = both.groupBy("language").agg(F.countDistinct("size").alias("n_distinct"), F.max("n_distinct").alias("seen"), (F.count_if(F.col("size") < F.col("q50")) / n).alias("below"), (F.count_if(F.col("size") <= F.col("q50")) / n).alias("upto"))
    return s.select("language", "n_distinct", (F.abs(F.col("seen") - F.col("n_distinct")) <= F.greatest(F.lit(2.0), 4 * K.distinct_error() * F.col("n_distinct"))).alias("distinct_within"), ((F.col("below") <= 0.5 + K.rank_error()) & (F.col("upto") >= 0.5 - K.rank_error())).alias("median_within"))
