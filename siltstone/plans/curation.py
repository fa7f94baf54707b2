"""Queries of deduplication, sets, graphs and near duplicates; the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import metrics as M
from siltstone.functions.text import NOISE_MARKERS
from siltstone.operators import curate as C

from .evaluation import CELLS, _metrics
from .registry import query
from .views import advisories, corpus, dependencies, findings, predictions, table

_FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY func_hash ORDER BY coalesce(label, 0) DESC, version <> 'post', sample_id) AS k FROM corpus) WHERE k = 1"


@query(f"""WITH one AS ({_FIRST}), p AS (SELECT preds.* FROM preds JOIN one USING (sample_id)),
c AS (SELECT config, coalesce(language, 'all') AS slice, {CELLS} FROM p GROUP BY GROUPING SETS ((config), (config, language))) SELECT *, {_metrics()} FROM c""", "preds")
def flagship(spark, sf):
    one = C.preference_dedup(corpus(spark, sf)).select("sample_id")
    p = predictions(spark, sf).join(one, "sample_id")
    c = p.groupingSets([["config"], ["config", "language"]], "config", "language").agg(*M.confusion(F.col("pred"), F.col("truth"))).withColumn("slice", F.coalesce("language", F.lit("all"))).drop("language")
    return c.select("config", "slice", "tp", "fp", "tn", "fn", *[v.alias(k) for k, v in M.binary_metrics().items()]).orderBy(F.desc("f1"), "config", "slice")


@query(f"SELECT sample_id, func_hash, label, version FROM ({_FIRST})", "corpus")
def d01_preference_dedup(spark, sf):
    return C.preference_dedup(corpus(spark, sf)).select("sample_id", "func_hash", "label", "version")


@query(f"WITH one AS ({_FIRST}) SELECT sample_id, CASE WHEN count(DISTINCT version) OVER (PARTITION BY pair_id) = 2 THEN pair_id END AS pair_id FROM (SELECT *, version AS v FROM one)".replace("count(DISTINCT version) OVER (PARTITION BY pair_id) = 2", "min(version) OVER (PARTITION BY pair_id) <> max(version) OVER (PARTITION BY pair_id)"), "corpus")
def d02_orphan_pairs(spark, sf):
    return C.repair_pairs(C.preference_dedup(corpus(spark, sf))).select("sample_id", "pair_id")


@query("WITH u AS (SELECT * FROM corpus WHERE sample_id % 3 = 0 UNION ALL SELECT * FROM corpus WHERE sample_id % 3 <> 1) SELECT sample_id, func_hash FROM (SELECT *, row_number() OVER (PARTITION BY func_hash ORDER BY coalesce(label, 0) DESC, version <> 'post', sample_id) AS k FROM u) WHERE k = 1", "corpus")
def d03_merge_shards(spark, sf):
    c = corpus(spark, sf)
    return C.preference_dedup(c.filter("sample_id % 3 = 0").unionByName(c.filter("sample_id % 3 <> 1"))).select("sample_id", "func_hash")


@query("SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def d04_first_wins(spark, sf):
    return C.first_by(table(spark, sf, "events"), ["user_id"], F.col("event_id")).select("user_id", "event_id", "event_type")


@query("SELECT package, advisory_id FROM (SELECT package, advisory_id, row_number() OVER (PARTITION BY package ORDER BY NOT has_cve, advisory_id) AS k FROM advisories) WHERE k = 1", "advisories")
def d05_best_per_key(spark, sf):
    a = advisories(spark, sf).withColumn("cve", F.when(F.col("has_cve"), F.lit(1)))
    return C.best_per_key(a, "package", "cve", "advisory_id").select("package", "advisory_id")


@query("SELECT language, string_agg(repo, ',' ORDER BY first_id) AS repos FROM (SELECT language, repo, min(sample_id) AS first_id FROM corpus GROUP BY 1, 2) GROUP BY 1", "corpus")
def d06_ordered_distinct(spark, sf):
    first = corpus(spark, sf).groupBy("language", "repo").agg(F.min("sample_id").alias("first_id"))
    return first.groupBy("language").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_id", "repo"))), lambda x: x["repo"]), ",").alias("repos"))


@query("""WITH a AS (SELECT DISTINCT package FROM deps), b AS (SELECT DISTINCT package FROM advisories) SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL
SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'only_listed', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""", "advisories", "deps")
def d07_set_ops(spark, sf):
    a, b = dependencies(spark, sf).select("package"), advisories(spark, sf).select("package")
    size = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return size(a.intersect(b), "both").union(size(a.union(b).distinct(), "either")).union(size(a.subtract(b), "only_listed"))


@query("""RECURSIVE WITH n AS (SELECT sample_id, 'h' || func_hash AS v FROM corpus UNION SELECT sample_id, 'p' || pair_id FROM corpus), e AS (SELECT DISTINCT a.sample_id AS x, b.sample_id AS y FROM n a JOIN n b ON a.v = b.v AND a.sample_id <> b.sample_id),
r(sample_id, m) AS (SELECT sample_id, sample_id FROM corpus UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.sample_id WHERE r.m < e.y) SELECT sample_id, min(m) AS component FROM r GROUP BY 1""", "corpus")
def d08_components(spark, sf):
    return C.components(corpus(spark, sf).select("sample_id", "func_hash", "pair_id"), ["func_hash", "pair_id"])


@query("SELECT n_regionkey AS parent, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS children FROM nation GROUP BY 1")
def d09_invert_edges(spark, sf):
    return table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("parent")).agg(F.array_join(F.array_sort(F.collect_set("n_nationkey")), ",").alias("children"))


_SHINGLES = r"""t AS (SELECT sample_id, list_transform(regexp_extract_all(code, '[A-Za-z_$][\p{L}\p{N}_$]*|[0-9]+(?:\.[0-9]+)?|[^\s]'), lambda t: CASE WHEN t IN (%s) THEN t WHEN regexp_matches(t, '^[0-9]') THEN 'NUM' WHEN regexp_matches(t, '^[\p{L}_$]') THEN 'ID' ELSE t END) AS w FROM corpus),
s AS (SELECT DISTINCT sample_id, array_to_string(w[i : i + 4], ' ') AS shingle FROM (SELECT sample_id, w, unnest(range(1, len(w) - 3)) AS i FROM t))""" % ", ".join(f"'{k}'" for k in C.KEYWORDS)


@query(f"WITH {_SHINGLES} SELECT sample_id, count(*) AS n FROM s GROUP BY 1", "corpus")
def d10_shingles(spark, sf):
    return C.shingle_sets(corpus(spark, sf)).select("sample_id", F.size("shingles").cast("long").alias("n")).filter("n > 0")


@query(f"""WITH {_SHINGLES}, z AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n FROM s), a AS (SELECT * FROM z WHERE n >= 20 AND sample_id % 5 = 0), b AS (SELECT * FROM z WHERE n >= 20 AND sample_id % 5 <> 0), f AS (SELECT shingle, count(*) AS df FROM b GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY df, shingle) AS k FROM a JOIN f USING (shingle)), c AS (SELECT k.sample_id AS x, b.sample_id AS y, k.n AS n, b.n AS m, count(*) AS shared FROM k JOIN b ON k.shingle = b.shingle WHERE k.k <= 8 AND least(k.n, b.n) >= 0.85 * greatest(k.n, b.n) GROUP BY 1, 2, 3, 4),
j AS (SELECT c.x, c.y, c.n, c.m, c.shared, count(*) AS q FROM c JOIN a ON a.sample_id = c.x JOIN b ON b.sample_id = c.y AND b.shingle = a.shingle GROUP BY 1, 2, 3, 4, 5), h AS (SELECT x, y, q / CAST(n + m - q AS DOUBLE) AS jaccard, row_number() OVER (PARTITION BY x ORDER BY shared DESC, y) AS k FROM j WHERE q / CAST(n + m - q AS DOUBLE) >= 0.85)
SELECT x AS sample_id, y AS other, round(jaccard, 6) AS jaccard FROM h WHERE k = 1""", "corpus")
def d11_near_duplicates(spark, sf):
    s = C.shingle_sets(corpus(spark, sf))
    return C.near_duplicates(s.filter("sample_id % 5 = 0"), s.filter("sample_id % 5 <> 0")).withColumn("jaccard", F.round("jaccard", 6))


@query("SELECT repo, min(event_id) AS case_id, arg_min(cwe, event_id) AS cwe, count(DISTINCT file) AS n_targets, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM findings GROUP BY 1", "findings")
def d12_nest_cases(spark, sf):
    return findings(spark, sf).groupBy("repo").agg(F.min("event_id").alias("case_id"), F.min_by("cwe", "event_id").alias("cwe"), F.countDistinct("file").alias("n_targets"), F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))


@query("WITH a AS (SELECT func_hash FROM corpus WHERE version = 'pre'), b AS (SELECT func_hash FROM corpus WHERE version = 'post') SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_pre, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_post", "corpus")
def d13_bag_difference(spark, sf):
    c = corpus(spark, sf)
    a, b = (c.filter(F.col("version") == v).select("func_hash") for v in ("pre", "post"))
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_pre")).crossJoin(F.broadcast(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_post"))))


@query("SELECT func_hash, count(*) AS n FROM corpus GROUP BY 1 HAVING count(*) > 1", "corpus")
def d14_duplicate_identity(spark, sf):
    return C.duplicate_keys(corpus(spark, sf), "func_hash")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def d15_content_manifest(spark, sf):
    return C.content_manifest(table(spark, sf, "documents"), "doc_id", "text")


@query("""WITH b AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE n_chars % 13 > 0), a AS (SELECT doc_id, sha256(CASE WHEN n_chars % 5 = 0 THEN text || ' ' ELSE text END) AS h FROM documents WHERE n_chars % 11 > 0)
SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.doc_id = b.doc_id WHERE b.h IS DISTINCT FROM a.h""")
def d15_manifest_changes(spark, sf):
    """What differs between two states of the documents: some are new, some are gone, some have another text."""
    d, n, text = table(spark, sf, "documents"), F.col("n_chars"), F.col("text")
    later = d.filter(n % 11 > 0).select("doc_id", F.when(n % 5 == 0, F.concat(text, F.lit(" "))).otherwise(text).alias("text"))
    return C.manifest_changes(C.content_manifest(d.filter(n % 13 > 0), "doc_id", "text"), C.content_manifest(later, "doc_id", "text"), "doc_id")


@query("SELECT sample_id, md5(regexp_replace(code, '\\s+', ' ', 'g')) AS body, CASE WHEN loc BETWEEN 3 AND 800 THEN 'kept' WHEN loc < 3 THEN 'short' ELSE 'long' END AS reason FROM corpus", "corpus")
def p10_size_filter(spark, sf):
    loc = F.col("loc")
    return corpus(spark, sf).select("sample_id", F.md5(F.regexp_replace("code", r"\s+", " ").cast("binary")).alias("body"), F.when(loc.between(3, 800), "kept").when(loc < 3, "short").otherwise("long").alias("reason"))


_NOISY = " OR ".join(f"contains(lower(code), '{m}')" for m in NOISE_MARKERS)
_REASON = f"CASE WHEN row_number() OVER (PARTITION BY sample_id // 5 ORDER BY sample_id) > 2 THEN 'too_many_commits' WHEN {_NOISY} THEN 'noisy_message' WHEN language IS NULL OR language NOT IN ('en', 'de') THEN 'language' WHEN loc % 11 > 8 THEN 'too_many_files' WHEN n_chars % 15 > 12 THEN 'too_many_functions' ELSE 'kept' END"


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM corpus) GROUP BY 1", "corpus")
def p07_drop_reasons(spark, sf):
    i = F.col("sample_id")
    c = corpus(spark, sf).select(F.floor(i / 5).alias("cve_id"), i.alias("sha"), F.col("code").alias("message"), "language", (F.col("loc") % 11).alias("n_files"), (F.col("n_chars") % 15).alias("n_functions"))
    return C.drop_reasons(c, ["en", "de"]).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query()
def k07_stratified_split(spark, sf):
    return C.stratified_split(corpus(spark, sf).filter("label is not null"), "repo", "language")


@query()
def k08_plain_split(spark, sf):
    return C.plain_split(corpus(spark, sf).filter("label is not null"), "repo")
