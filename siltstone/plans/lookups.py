"""Queries of joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import lookup as L
from siltstone.operators.curate import shared_path
from siltstone.operators.spelling import near_names, suffix_pairs
from siltstone.sources.replies import ReplyStore, request_key, stub_replies

from .registry import query
from .views import advisories, corpus, dependencies, files, findings, table


@query("""WITH e AS (SELECT ecosystem, package, unnest(versions) AS version, advisory_id, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MODERATE' THEN 2 ELSE 1 END AS rank, has_cve FROM advisories),
x AS (SELECT ecosystem, package, version, count(*) AS n, list(advisory_id ORDER BY rank DESC, has_cve DESC, advisory_id)[1] AS advisory FROM e GROUP BY 1, 2, 3), k AS (SELECT DISTINCT ecosystem, package FROM advisories)
SELECT d.manifest, d.number, CASE WHEN k.package IS NULL THEN 'no_advisory_data' WHEN d.version IS NULL THEN 'unpinned' WHEN x.advisory IS NOT NULL THEN 'affected' ELSE 'not_affected' END AS status, x.advisory, coalesce(x.n, 0) AS n_advisories
FROM deps d LEFT JOIN x ON x.ecosystem = d.ecosystem AND x.package = d.package AND x.version = d.version LEFT JOIN k ON k.ecosystem = d.ecosystem AND k.package = d.package""", "advisories", "deps")
def j01_status_lookup(spark, sf):
    return L.dependency_status(dependencies(spark, sf), advisories(spark, sf)).select("manifest", "number", "status", "advisory", "n_advisories")


@query("SELECT manifest, number FROM deps d WHERE EXISTS (SELECT 1 FROM (SELECT ecosystem, package, unnest(versions) AS v FROM advisories) a WHERE a.ecosystem = d.ecosystem AND a.package = d.package AND a.v = d.version)", "advisories", "deps")
def j02_semi_lookup(spark, sf):
    a = advisories(spark, sf).select("ecosystem", "package", F.explode("versions").alias("version"))
    return dependencies(spark, sf).join(a, ["ecosystem", "package", "version"], "left_semi").select("manifest", "number")


@query("""WITH i AS (SELECT sample_id, func_hash, lower(repo) || '::' || (sample_id % 100) AS place FROM corpus WHERE label = 1), h AS (SELECT func_hash, min(sample_id) AS m FROM i GROUP BY 1), p AS (SELECT place, min(sample_id) AS m FROM i GROUP BY 1)
SELECT c.sample_id, CASE WHEN h.m IS NOT NULL THEN 'known' WHEN p.m IS NOT NULL THEN 'known_location' ELSE 'novel' END AS novelty, coalesce(h.m, p.m) AS match FROM corpus c LEFT JOIN h ON h.func_hash = c.func_hash LEFT JOIN p ON p.place = lower(c.repo) || '::' || (c.sample_id % 100)""", "corpus")
def j03_cascade_novelty(spark, sf):
    c = corpus(spark, sf).withColumn("place", F.concat(F.lower("repo"), F.lit("::"), F.col("sample_id") % 100))
    return L.novelty(c.select("sample_id", "func_hash", "place"), c.filter("label = 1")).select("sample_id", "novelty", "match")


@query("SELECT sample_id FROM corpus c WHERE label = 1 AND NOT EXISTS (SELECT 1 FROM corpus t WHERE t.sample_id % 5 = 0 AND t.func_hash = c.func_hash)", "corpus")
def j04_holdout_anti(spark, sf):
    c = corpus(spark, sf)
    return c.filter("label = 1").join(c.filter("sample_id % 5 = 0").select("func_hash"), "func_hash", "left_anti").select("sample_id")


@query("SELECT a.language, a.k, a.sample_id AS post_id, min(b.sample_id) AS pre_id FROM (SELECT *, sample_id % 40 AS k FROM corpus WHERE version = 'post') a JOIN (SELECT *, sample_id % 39 AS k FROM corpus WHERE version = 'pre') b ON a.language = b.language AND a.k = b.k GROUP BY 1, 2, 3", "corpus")
def j05_pair_assembly(spark, sf):
    c = corpus(spark, sf)
    pre = c.filter("version = 'pre'").groupBy("language", (F.col("sample_id") % 39).alias("k")).agg(F.min("sample_id").alias("pre_id"))
    return c.filter("version = 'post'").select("language", (F.col("sample_id") % 40).alias("k"), F.col("sample_id").alias("post_id")).join(pre, ["language", "k"])


@query("SELECT pair_id, max(CASE WHEN version = 'pre' THEN func_hash END) AS pre, max(CASE WHEN version = 'post' THEN func_hash END) AS post FROM corpus GROUP BY 1", "corpus")
def j06_pair_pivot(spark, sf):
    return corpus(spark, sf).groupBy("pair_id").pivot("version", ["pre", "post"]).agg(F.max("func_hash"))


@query("SELECT c.language, count(*) AS n, count(*) FILTER (l.doc_id IS NULL) AS missing FROM corpus c LEFT JOIN labels l ON l.doc_id = c.sample_id GROUP BY 1", "corpus")
def j07_left_join_misses(spark, sf):
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), F.lit(True).alias("there"))
    return corpus(spark, sf).join(marks, "sample_id", "left").groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("""WITH s AS (SELECT *, CASE WHEN sample_id % 10 < 7 THEN 'train' WHEN sample_id % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM corpus), v AS (SELECT DISTINCT 'func_hash' AS key, func_hash AS value, split FROM s UNION SELECT DISTINCT 'repo', repo, split FROM s UNION SELECT DISTINCT 'pair_id', CAST(pair_id AS VARCHAR), split FROM s)
SELECT x.key, x.split AS a, y.split AS b, count(*) AS shared FROM v x JOIN v y ON x.key = y.key AND x.value = y.value AND x.split < y.split GROUP BY 1, 2, 3""", "corpus")
def j09_split_overlap(spark, sf):
    k = F.col("sample_id") % 10
    return L.split_overlap(corpus(spark, sf).withColumn("split", F.when(k < 7, "train").when(k == 7, "val").otherwise("test")), "split", ["func_hash", "repo", "pair_id"])


@query("""WITH r AS (SELECT user_id, event_id, minute(ts) * 20 AS low, minute(ts) * 20 + 120 AS high FROM events), p AS (SELECT user_id, event_id AS point_id, minute(ts) * 20 + second(ts) AS place FROM events)
SELECT r.event_id, count(*) AS touched, min(p.place) AS first_place FROM p JOIN r ON p.user_id = r.user_id AND p.place BETWEEN r.low AND r.high GROUP BY 1""")
def j10_range_containment(spark, sf):
    e, m = table(spark, sf, "events"), F.minute("ts") * 20
    r = e.select("user_id", "event_id", m.alias("low"), (m + 120).alias("high"))
    p = e.select("user_id", F.col("event_id").alias("point_id"), (m + F.second("ts")).cast("long").alias("place"))
    return L.containing(p, r, "user_id", "place", "low", "high").groupBy("event_id").agg(F.count(F.lit(1)).alias("touched"), F.min("place").alias("first_place"))


_BAND = "SELECT a.file, a.event_id AS ai, s.event_id AS static FROM findings a JOIN findings s ON a.file = s.file AND a.event_type = 'click' AND s.event_type = 'error' AND abs(a.line - s.line) <= 12"


def _sides(spark, sf):
    f = findings(spark, sf)
    s = f.filter("event_type = 'error'").select("file", F.col("event_id").alias("static"), F.col("line").alias("line_r"), F.col("cwe").alias("cwe_r"))
    return f.filter("event_type = 'click'").select("file", F.col("event_id").alias("ai"), "line", "cwe"), s


def _candidates(spark, sf, pieces=False):
    a, s = _sides(spark, sf)
    c = L.band_candidates(a, s, "file", "line", 12)
    return c.join(L.band_pieces(a, s, "file", "line", 12), ["file", "line"]) if pieces else c


@query(_BAND, "findings")
def j11_band_candidates(spark, sf):
    return _candidates(spark, sf).select("file", "ai", "static")


@query()
def j11_greedy_match(spark, sf):
    return L.greedy_matches(_candidates(spark, sf, True), "file", "ai", "static", "piece")


@query("""WITH k AS (SELECT 'n' || n_nationkey AS cls, 'Class' AS kind FROM nation UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey = 0 THEN 'Pillar' ELSE 'Class' END FROM region), e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation),
near AS (SELECT cls AS truth, cls AS match FROM k UNION SELECT child, parent FROM e UNION SELECT parent, child FROM e), kept AS (SELECT truth, match FROM near JOIN k ON k.cls = near.match WHERE kind <> 'Pillar')
SELECT truth, match FROM kept UNION ALL SELECT cls, cls FROM k WHERE cls NOT IN (SELECT truth FROM kept)""")
def j12_hierarchy_match(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    nk, rk = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")
    kinds = n.select(nk.alias("class"), F.lit("Class").alias("kind")).union(r.select(F.concat(F.lit("r"), "r_regionkey"), F.when(F.col("r_regionkey") == 0, "Pillar").otherwise("Class")))
    return L.related_classes(n.select(nk.alias("child"), rk.alias("parent")), kinds)


@query("""WITH t AS (SELECT DISTINCT repo, file, line FROM findings WHERE event_id % 3 = 0), s AS (SELECT DISTINCT repo, file FROM findings WHERE event_id % 3 = 1), g AS (SELECT repo, file, line FROM findings WHERE event_id % 3 = 1 AND pillar = 'vulnerability')
SELECT repo, bool_or((repo, file) IN (SELECT repo, file FROM s)) AS selected, bool_or((repo, file) IN (SELECT repo, file FROM g)) AS detected, bool_or((repo, file, line) IN (SELECT repo, file, line FROM g)) AS localised, (SELECT count(*) FROM g WHERE g.repo = t.repo AND (g.repo, g.file) NOT IN (SELECT repo, file FROM t)) AS alarms FROM t GROUP BY repo""", "findings")
def j13_target_match(spark, sf):
    f = findings(spark, sf).select("repo", "file", F.col("line").alias("func_hash"), "pillar", (F.col("event_id") % 3).alias("role"))
    return L.target_scores(f.filter("role = 0"), f.filter("role = 1"), f.filter("role = 1 and pillar = 'vulnerability'"), "repo")


@query("SELECT f.doc_id, t.suffix FROM files f JOIN (SELECT unnest(['src/app.py', 'app.py', 'ci.yml', 'x.bundle.js']) AS suffix) t ON ends_with(f.path, '/' || t.suffix)", "files")
def j14_suffix_join(spark, sf):
    wanted = spark.createDataFrame([("src/app.py",), ("app.py",), ("ci.yml",), ("x.bundle.js",)], "suffix string")
    parts = F.split("path", "/")
    tails = files(spark, sf).select("doc_id", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    return tails.join(wanted, "suffix")


@query("SELECT a.sample_id, a.func_hash = b.func_hash AS same FROM corpus a JOIN corpus b ON b.pair_id = a.pair_id AND b.version = 'post' WHERE a.version = 'pre'", "corpus")
def j15_fixture_pairs(spark, sf):
    c = corpus(spark, sf)
    post = c.filter("version = 'post'").select("pair_id", F.col("func_hash").alias("other"))
    return c.filter("version = 'pre'").join(post, "pair_id").select("sample_id", (F.col("func_hash") == F.col("other")).alias("same"))


@query("SELECT manifest, count(DISTINCT package) AS invented FROM deps d WHERE NOT EXISTS (SELECT 1 FROM advisories a WHERE a.package = d.package) GROUP BY 1", "advisories", "deps")
def j16_anti_hallucinated(spark, sf):
    return dependencies(spark, sf).join(advisories(spark, sf).select("package").distinct(), "package", "left_anti").groupBy("manifest").agg(F.countDistinct("package").alias("invented"))


@query("""WITH g AS (SELECT *, file || '.' || line AS place FROM findings), n AS (SELECT DISTINCT repo, CASE WHEN event_id % 2 = 0 THEN '@' || repo || '/' || place ELSE place END AS name FROM g WHERE pillar = 'secret'), o AS (SELECT repo, name FROM n UNION SELECT repo, split_part(name, '/', -1) FROM n)
SELECT DISTINCT f.repo, f.place FROM g f WHERE f.pillar = 'dependency' AND NOT EXISTS (SELECT 1 FROM o WHERE o.repo = f.repo AND o.name = f.place)""", "findings")
def j17_self_suppression(spark, sf):
    """Findings about a repo's own names are left out, also where a name is published under a scope."""
    f = findings(spark, sf).withColumn("place", F.concat_ws(".", "file", "line"))
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("@"), "repo", F.lit("/"), "place")).otherwise(F.col("place"))
    return L.not_own(f.filter("pillar = 'dependency'").select("repo", "place").distinct(), f.filter("pillar = 'secret'").select("repo", name.alias("name")), "place")


@query("""SELECT s.event_id, CASE WHEN c.repo IS NULL THEN 'unknown' WHEN d.file IS NULL THEN 'not_checked' ELSE 'checked' END AS coverage FROM findings s LEFT JOIN (SELECT DISTINCT repo FROM findings WHERE event_type = 'click') c ON c.repo = s.repo
LEFT JOIN (SELECT DISTINCT repo, file FROM findings WHERE event_type = 'click') d ON d.repo = s.repo AND d.file = s.file WHERE s.event_type = 'error'""", "findings")
def j18_coverage_state(spark, sf):
    f = findings(spark, sf)
    done = f.filter("event_type = 'click'").select("repo", "file").distinct()
    repos = done.select("repo").distinct().withColumn("r", F.lit(True))
    out = f.filter("event_type = 'error'").join(repos, "repo", "left").join(done.withColumn("d", F.lit(True)), ["repo", "file"], "left")
    return out.select("event_id", F.when(F.col("r").isNull(), "unknown").when(F.col("d").isNull(), "not_checked").otherwise("checked").alias("coverage"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), l AS (SELECT word AS listed, row_number() OVER (ORDER BY word) AS pos FROM w),
n AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN x WHEN 1 THEN substr(x, 2, 1) || substr(x, 1, 1) || substr(x, 3) WHEN 2 THEN substr(x, 1, length(x) - 1) ELSE x || 's' END AS name FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS x FROM part)),
c AS (SELECT name, listed, pos FROM n JOIN l ON length(listed) >= 4 AND damerau_levenshtein(name, listed) = 1 WHERE name NOT IN (SELECT listed FROM l)) SELECT name, arg_min(listed, pos) AS imitated FROM c GROUP BY 1""")
def j19_typosquat(spark, sf):
    from pyspark.sql import Window as W

    p = table(spark, sf, "part")
    listed = p.select(F.explode(F.split("p_name", " ")).alias("listed")).distinct().withColumn("pos", F.row_number().over(W.orderBy("listed")))
    x, k = F.element_at(F.split("p_name", " "), 1), F.col("p_partkey") % 4
    name = F.when(k == 0, x).when(k == 1, F.concat(F.substring(x, 2, 1), F.substring(x, 1, 1), F.substring(x, F.lit(3), F.length(x)))).when(k == 2, F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(F.concat(x, F.lit("s")))
    return L.lookalikes(p.select(name.alias("name")), listed)


@query("""WITH w AS (SELECT sample_id, max(CASE WHEN config = 'bars' THEN pred END) AS o, max(CASE WHEN config = 'short' THEN pred END) AS c, max(CASE WHEN config = 'noise' THEN pred END) AS t FROM preds GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (o IS NULL OR c IS NULL OR t IS NULL) AS failed, count(*) FILTER (o <> c) AS control_flips, count(*) FILTER (o <> t) AS treated_flips, count(*) FILTER (c <> t) AS disagreements FROM w""", "preds")
def j20_three_arms(spark, sf):
    from .views import predictions

    p = predictions(spark, sf)
    arm = lambda k, name: p.filter(F.col("config") == k).select("sample_id", F.col("pred").alias(name))
    w = arm("bars", "o").join(arm("short", "c"), "sample_id").join(arm("noise", "t"), "sample_id")
    o, c, t = F.col("o"), F.col("c"), F.col("t")
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(o.isNull() | c.isNull() | t.isNull()).alias("failed"), F.count_if(o != c).alias("control_flips"), F.count_if(o != t).alias("treated_flips"), F.count_if(c != t).alias("disagreements"))


@query("WITH w AS (SELECT sample_id, max(CASE WHEN config = 'bars' THEN pred END) AS a, max(CASE WHEN config = 'short' THEN pred END) AS b FROM preds GROUP BY 1) SELECT * FROM w WHERE a <> b ORDER BY sample_id LIMIT 5", "preds")
def j21_disagreements(spark, sf):
    from .views import predictions

    w = predictions(spark, sf).filter("config in ('bars', 'short')").groupBy("sample_id").pivot("config", ["bars", "short"]).agg(F.max("pred")).toDF("sample_id", "a", "b")
    return w.filter("a <> b").orderBy("sample_id").limit(5)


_R14 = f"""WITH c AS ({_BAND}), x AS (SELECT DISTINCT a.event_id FROM findings a JOIN findings s ON a.file = s.file AND a.event_type = 'click' AND s.event_type = 'error' AND abs(a.line - s.line) <= 12 AND a.cwe = s.cwe)
SELECT count(*) AS candidates, count(DISTINCT ai) AS ai_near, count(DISTINCT static) AS static_near, (SELECT count(*) FROM x) AS ai_same_class FROM c"""


@query(_R14, "findings")
def r14_compare_counts(spark, sf):
    c = _candidates(spark, sf)
    return c.agg(F.count(F.lit(1)).alias("candidates"), F.countDistinct("ai").alias("ai_near"), F.countDistinct("static").alias("static_near"), F.countDistinct(F.when(F.col("cwe") == F.col("cwe_r"), F.col("ai"))).alias("ai_same_class"))


@query()
def r14_agreement(spark, sf):
    """Greedy one-to-one matches of the same class, then what is shared and what each scan has alone."""
    f = findings(spark, sf)
    ours = f.filter("event_type = 'click'").select(F.col("event_id").alias("ai"), "cwe")
    theirs = f.filter("event_type = 'error'").select(F.col("event_id").alias("static"), "cwe")
    same = _candidates(spark, sf, True).filter(F.col("cwe") == F.col("cwe_r"))
    return L.comparison(ours, theirs, L.greedy_matches(same, "file", "ai", "static", "piece"), "ai", "static")


@query("SELECT conv_id, turn, ('0x' || substr(md5(coalesce(text, '')), 1, 2))::INT % 2 = 1 AS vulnerable FROM conversations")
def s12_durable_replies(spark, sf):
    """Every turn is put to the stub model, part by part; equal texts are one request, and the answers come from the store."""
    prompt = F.coalesce("text", F.lit(""))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", prompt.alias("prompt"), request_key(F.lit("stub"), prompt).alias("key"))
    answers = ReplyStore(spark, shared_path(spark, "replies")).ask(turns.select("key", "prompt"), stub_replies, part_rows=5_000)
    verdict = F.get_json_object("reply", "$.vulnerable").cast("boolean")
    return turns.join(answers.select("key", verdict.alias("vulnerable")), "key").select("conv_id", "turn", "vulnerable")


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS listed FROM part), n AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN x WHEN 1 THEN substr(x, 2, 1) || substr(x, 1, 1) || substr(x, 3) WHEN 2 THEN substr(x, 2, length(x) - 2) ELSE 's' || x || '-x' END AS name FROM (SELECT p_partkey, string_split(p_name, ' ')[-1] AS x FROM part))
SELECT name, listed, CAST(damerau_levenshtein(name, listed) AS INTEGER) AS distance FROM n JOIN w ON length(listed) >= 4 AND name <> listed AND damerau_levenshtein(name, listed) <= 3""")
def x14_capped_distance(spark, sf):
    """Misspelt last words of part names within three edits of a word that part names hold."""
    p = table(spark, sf, "part")
    x, k = F.element_at(F.split("p_name", " "), -1), F.col("p_partkey") % 4
    name = F.when(k == 0, x).when(k == 1, F.concat(F.substring(x, 2, 1), F.substring(x, 1, 1), F.substring(x, F.lit(3), F.length(x)))).when(k == 2, F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(F.concat(F.lit("s"), x, F.lit("-x")))
    return near_names(p.select(name.alias("name")), p.select(F.explode(F.split("p_name", " ")).alias("listed")), cap=3, once=False)


@query("""WITH l AS (SELECT DISTINCT path AS "left" FROM files), r AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'x/' || path WHEN doc_id % 3 = 1 THEN substr(path, 3) ELSE split_part(path, '/', -1) END AS "right" FROM files) SELECT "left", "right" FROM l JOIN r ON ends_with("left", "right") OR ends_with("right", "left")""", "files")
def j14_suffix_both_ways(spark, sf):
    """Paths of which one ends in the other: shortened, lengthened, and bare file names."""
    f, k, path = files(spark, sf), F.col("doc_id") % 3, F.col("path")
    other = F.when(k == 0, F.concat(F.lit("x/"), path)).when(k == 1, F.substring(path, F.lit(3), F.length(path))).otherwise(F.element_at(F.split(path, "/"), -1))
    return suffix_pairs(f.select(path.alias("left")), f.select(other.alias("right")))
