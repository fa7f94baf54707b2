"""Rule sets of any size over texts: one automaton finds which rules could match, and only those are run.

A pattern's required literals are a set of strings of which each match holds at least one, derived from its syntax.
All rules' literals make one Aho-Corasick automaton, which reads each text once, in Arrow batches; case is folded on both sides, so
that a candidate is never missed.  Patterns without a required literal are candidates everywhere.  The candidates' patterns
are run by Spark's own rlike, so that the result is what rlike, rule by rule, would give.
"""

from __future__ import annotations

import pickle
import re
import warnings
from collections.abc import Iterator
from re import _constants as C
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, the only letters that fold without a flag.
FOLD = {k: k + 32 for k in range(65, 91)}


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The set that is rarer in texts: that with the longer shortest literal, then with fewer."""
    if a is None or b is None:
        return a or b
    rank = lambda s: (min(map(len, s)), -len(s))
    return a if rank(a) >= rank(b) else b


def _required(tokens, most: int) -> frozenset[str] | None:
    best, run = None, ""

    def end() -> None:
        nonlocal best, run
        if run:
            best = _better(best, frozenset([run]))
        run = ""

    for op, arg in tokens:
        if op is C.LITERAL:
            run += chr(arg)
            continue
        if op is C.IN and len(arg) == 1 and arg[0][0] is C.LITERAL:
            run += chr(arg[0][1])
            continue
        if op is C.SUBPATTERN and all(o is C.LITERAL for o, _ in arg[3]):
            run += "".join(chr(a) for _, a in arg[3])
            continue
        end()
        if op is C.SUBPATTERN:
            best = _better(best, _required(arg[3], most))
        elif op is C.ATOMIC_GROUP:
            best = _better(best, _required(arg, most))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            best = _better(best, _required(arg[2], most))
        elif op is C.BRANCH:
            parts = [_required(p, most) for p in arg[1]]
            if all(parts):
                union = frozenset().union(*parts)
                if len(union) <= most:
                    best = _better(best, union)
        elif op is C.ASSERT:
            best = _better(best, _required(arg[1], most))
    end()
    return best


def required_literals(pattern: str, least: int = 3, most: int = 64) -> frozenset[str] | None:
    """Folded strings of which every match of the pattern holds one, each of `least` characters or more; None if there are no such."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # what reads differently in other dialects
            parsed = _parser.parse(pattern)
    except Exception:  # noqa: BLE001 - a dialect that the parser does not know: the rule is run everywhere
        return None
    if parsed.state.flags & C.SRE_FLAG_VERBOSE or "(?U" in pattern or "(?u" in pattern or "\\Q" in pattern:
        return None
    found = _required(parsed, most)
    if found is None:
        return None
    folded = frozenset(s.translate(FOLD) for s in found)
    any_case = re.search(r"\(\?[a-zA-Z]*i", pattern)  # beyond ASCII it may fold more than A-Z
    return folded if all(len(s) >= least and (s.isascii() or not any_case) for s in folded) else None


class RuleSet:
    """Rules by name; patterns as rlike takes them."""

    def __init__(self, rules: dict[str, str], least: int = 3):
        self.names, self.patterns = list(rules), list(rules.values())
        self.everywhere: list[int] = []
        self.literals: dict[str, list[int]] = {}
        for k, pattern in enumerate(self.patterns):
            found = required_literals(pattern, least)
            if found is None:
                self.everywhere.append(k)
            for literal in found or ():
                self.literals.setdefault(literal, []).append(k)

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for literal, rules in self.literals.items():
            out.add_word(literal, tuple(rules))
        if self.literals:
            out.make_automaton()
        return out

    def candidates(self, spark: SparkSession, text: Column) -> Column:
        """array<int>: the rules, in order, that could match; none for a null text.  The automaton is built once and broadcast."""
        shared, everywhere = spark.sparkContext.broadcast(pickle.dumps(self.automaton())), self.everywhere
        some = bool(self.literals)

        @F.pandas_udf("array<int>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = pickle.loads(shared.value)

            def one(t: str | None) -> list[int] | None:
                if t is None:
                    return []
                found = set(everywhere)
                if some:
                    for _, rules in automaton.iter(t.translate(FOLD)):
                        found.update(rules)
                return sorted(found)

            for batch in batches:
                yield batch.map(one)

        return run(text)

    def hits(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """texts with rules, array<string>: the names of the rules that match, in the order of the set."""
        if not self.names:
            return texts.withColumn("rules", F.array().cast("array<string>"))
        spark = texts.sparkSession
        name = next(n for n in ("candidates__" + "_" * k for k in range(99)) if n not in texts.columns)
        found = texts.withColumn(name, self.candidates(spark, F.col(text)))
        rule = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in zip(self.names, self.patterns)])
        tested = F.filter(F.transform(name, lambda k: F.element_at(rule, k + 1)), lambda r: F.rlike(F.col(text), r["pattern"]))
        return found.withColumn("rules", F.transform(tested, lambda r: r["name"])).drop(name)


def rules_of(rows: DataFrame, name: str, pattern: str, most: int = 100_000) -> RuleSet:
    """A rule set kept as a table; raises beyond `most` rules, as every task holds all of them."""
    got = rows.select(name, pattern).filter(F.col(pattern).isNotNull()).orderBy(name).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a rule set has {most} rules at most")
    return RuleSet({str(n): p for n, p in got})
