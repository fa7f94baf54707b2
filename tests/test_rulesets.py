"""Rule sets against rlike, rule by rule."""

import random
import time

import pytest
from pyspark.sql import functions as F

from siltstone.operators import detect as D
from siltstone.operators.rulesets import RuleSet, required_literals, rules_of


@pytest.mark.parametrize(("pattern", "want"), [
    ("os\\.system", {"os.system"}), ("a+bcd", {"bcd"}), ("(?i)Eval\\s*\\(", {"eval"}), ("(foo|barb)x?", {"foo", "barb"}), ("(foo|b)", None), ("x?y*", None), ("[a-z]{3}", None), ("(?:abc){2,}", {"abc"}), ("(?:abc)?de", None),
    ("abc[d]e", {"abcde"}), ("ab(cd)e", {"abcde"}), ("token(?=secret)", {"secret"}), ("(?!nothing)some", {"some"}), ("(?<=before)xyz", {"before"}), ("\\p{L}abc", None), ("(?x)a b c d", None), ("(?i)straße", None), ("straße", {"straße"}), ("\\Qa.b\\Ecd", None),
    ("[", None), ("^import$", {"import"}), ("\\bexec\\b|\\beval\\b", {"xec", "val"}), (D.SUSPICIOUS_HOST.replace("(?i)", ""), None.__class__),
])
def test_required_literals(pattern, want):
    got = required_literals(pattern)
    assert got if want is type(None) else got == (frozenset(want) if want else None)


def test_required_literals_are_required():
    """Whatever a pattern matches holds one of its literals."""
    import re

    rng = random.Random(2)
    parts = ["abc", "b+", "(?:cab|ba)", "a?", "[ab]", "(abb|ca)+", "c{2}", ".", "(?i:CB)", "\\w"]
    for _ in range(400):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.3:
            pattern += "|" + rng.choice(parts)
        found = required_literals(pattern, least=1)
        for _ in range(60):
            text = "".join(rng.choice("abcABC") for _ in range(12))
            if found and re.search(pattern, text):
                assert any(lit in text.lower() for lit in found), (pattern, text, found)


def test_hits_are_those_of_rlike(spark):
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "delta", "os.system", "eval(", "Token", "x1", "naïve", "ÄÖ"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(300)] + [(900, None), (901, ""), (902, "BETA " * 5000)]
    rules = {"one": "alpha\\s+Beta", "two": "(?i)beta gamma", "three": "os\\.(system|popen)", "four": "^$", "five": "\\p{Lu}", "six": "eval\\(.*Token", "seven": "naïve", "eight": "(?i)äö", "nine": "\\Qx1\\E", "ten": "(delta|gamma)\\s\\1"}
    df = spark.createDataFrame(texts, "i int, text string")
    got = {r.i: list(r.rules) for r in RuleSet(rules).hits(df).collect()}
    want = {r.i: list(r.rules or []) for r in df.select("i", D.rule_hits(F.col("text"), rules).alias("rules")).collect()}
    assert got == want and sum(map(len, got.values())) > 200
    assert RuleSet({}).hits(df).filter(F.size("rules") > 0).isEmpty()


def test_time_hardly_grows_with_the_rules(spark):
    """A thousand rules cost a few times what ten do, where rlike one by one would cost a hundred times."""
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    df = spark.createDataFrame([(i, " ".join(name() for _ in range(300))) for i in range(400)], "i int, text string").repartition(2).cache()
    df.count()
    took = []
    for n in (10, 1000, 10, 1000):
        rules = RuleSet({str(k): f"{name()}\\s+\\w+{name()}" for k in range(n)})
        began = time.time()
        rules.hits(df).agg(F.sum(F.size("rules"))).collect()
        took.append(time.time() - began)
    assert took[3] < 12 * took[2] + 3


def test_rules_of_a_table(spark):
    rows = spark.createDataFrame([("b", "y+z"), ("a", "x"), ("c", None)], "name string, pattern string")
    assert rules_of(rows, "name", "pattern").names == ["a", "b"]
    with pytest.raises(ValueError, match="at most"):
        rules_of(rows, "name", "pattern", most=1)
