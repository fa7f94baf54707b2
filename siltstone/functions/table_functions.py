"""Parsers and detectors as table functions of SQL: SELECT ... FROM t, LATERAL patch_hunks(t.patch).

Each gives the rows that its DataFrame form gives for one row; a null text has none.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from siltstone.operators import detect as D
from siltstone.operators import parse as P


def _checked(names: tuple[str, ...], least: int, schema: str, args: tuple[AnalyzeArgument, ...], named: dict[str, AnalyzeArgument]) -> AnalyzeResult:
    """The schema, if the arguments are strings and as many as needed; else the query does not compile."""
    given = dict(zip(names, args)) | named
    if len(args) > len(names) or set(named) - set(names) or len(given) < least:
        raise ValueError(f"takes {', '.join(names)}, {least} of them at least")
    for name, a in given.items():
        if not isinstance(a.dataType, StringType) and a.dataType.simpleString() != "void":
            raise ValueError(f"{name} must be a string, not {a.dataType.simpleString()}")
    kinds = {"string": StringType(), "int": IntegerType(), "array<string>": ArrayType(StringType())}
    return AnalyzeResult(StructType([StructField(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]))


class PatchHunks:
    """patch_hunks(patch): the hunks of a unified diff."""

    @staticmethod
    def analyze(*args: AnalyzeArgument, **named: AnalyzeArgument) -> AnalyzeResult:
        return _checked(("patch",), 1, P.HUNKS, args, named)

    def eval(self, patch: str | None) -> Iterator[tuple]:
        yield from P.diff_hunks(patch or "")


class CodeFunctions:
    """code_functions(code [, language]): outermost functions; Python if no language is given."""

    @staticmethod
    def analyze(*args: AnalyzeArgument, **named: AnalyzeArgument) -> AnalyzeResult:
        return _checked(("code", "language"), 1, "name string, start_line int, end_line int", args, named)

    def eval(self, code: str | None, language: str | None = "python") -> Iterator[tuple]:
        yield from P.functions_of(code or "", language)


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0.0


class TextFindings:
    """text_findings(path, content): what the rules find in a file, with severities as a scan gives them."""

    @staticmethod
    def analyze(*args: AnalyzeArgument, **named: AnalyzeArgument) -> AnalyzeResult:
        return _checked(("path", "content"), 2, "kind string, severity string", args, named)

    def __init__(self) -> None:
        self.known: dict[str, re.Pattern] = {}

    def has(self, pattern: str, text: str) -> re.Match | None:
        """A match as Spark's rlike finds it: classes are those of ASCII."""
        if pattern not in self.known:
            self.known[pattern] = re.compile(pattern, re.ASCII)
        return self.known[pattern].search(text)

    def hooks(self, name: str, text: str) -> Iterator[str]:
        if name == "package.json":
            try:
                scripts = json.loads(text).get("scripts")
            except (ValueError, AttributeError):
                scripts = None
            hooked = [v if isinstance(v, str) else json.dumps(v) for k, v in (scripts if isinstance(scripts, dict) else {}).items() if k in D.INSTALL_HOOKS and v is not None]
            if hooked:
                yield "CRITICAL" if any(self.has(D.DYNAMIC_EXEC, v) or self.has(D.HOOK_FETCH, v) for v in hooked) else "HIGH"
        if name == "setup.py" and self.has(D.SETUP_EXEC, text):
            yield "CRITICAL"
        if name in ("build.gradle", "build.gradle.kts") and self.has(D.GRADLE_EXEC, text):
            yield "HIGH"
        if name == "makefile" and self.has(D.MAKE_FETCH, text):
            yield "CRITICAL"

    def obfuscation(self, text: str) -> Iterator[str]:
        blob = self.has(D.BASE64_TEXT, text)
        if (blob and entropy(blob[0]) >= 4.0) or self.has(D.HEX_TEXT, text) or self.has(D.CHAR_CODES, text):
            runs, decodes = self.has(D.DYNAMIC_EXEC, text), self.has(D.DECODE_CALL, text)
            if runs or decodes:
                yield "CRITICAL" if runs and decodes else "HIGH"

    def network(self, text: str) -> Iterator[str]:
        if self.has(D.SUSPICIOUS_HOST, text):
            yield "CRITICAL"
        if any(not self.has(D.LOCAL_ADDRESS, a[0]) for a in re.finditer(D.RAW_ADDRESS, text, re.ASCII)):
            yield "HIGH"
        near = self.has(D.NEAR_SEND, text)
        if near or (self.has(D.HIGH_VALUE, text) and self.has(D.NET_SEND, text)):
            yield "CRITICAL" if near else "HIGH"

    def eval(self, path: str | None, content: str | None) -> Iterator[tuple]:
        text = content or ""
        if path is None or len(text.encode("utf-8", "replace")) > 400_000:
            return
        name = path.split("/")[-1].lower()
        found = [("install_hook", s) for s in self.hooks(name, text)]
        if self.has(r"(?:^|/)\.github/", path) and self.has(r"\.ya?ml$", path.lower()) and self.has(D.CI_TRIGGER, text) and self.has(D.CI_CHECKOUT, text):
            found.append(("ci_risk", "CRITICAL"))
        found += [("obfuscation", s) for s in self.obfuscation(text)] + [("network", s) for s in self.network(text)]
        lower = self.has(D.TEST_PATH, path) is not None
        for kind, severity in found:
            yield kind, "LOW" if lower and severity in ("CRITICAL", "HIGH") else severity


TABLE_FUNCTIONS = {"patch_hunks": PatchHunks, "code_functions": CodeFunctions, "text_findings": TextFindings}


def register_tables(spark: SparkSession) -> list[str]:
    """Make the table functions known to SQL in this session; their names."""
    from pyspark.sql.functions import udtf

    for name, kind in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(kind))
    return list(TABLE_FUNCTIONS)
