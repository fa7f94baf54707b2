"""Rubric for explanations: do they cite code that exists, this code, the right mechanism, the right place.

Fixed values: the shapes of code references, words that are none, and words of each mechanism.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTED = "(`[^`]+`|'[^']{2,40}'|\"[^\"]{2,40}\")"
LOOKS_LIKE_CODE = r"[_(].|[a-z][A-Z]|^\W*[a-zA-Z_]\w*\W*$"
SHAPES = [r"\b([a-zA-Z_]\w*)\(", r"\b([a-zA-Z_]\w*\.[a-zA-Z_]\w*)\b", r"\b([a-zA-Z]\w*_\w+)\b", r"\b([a-z]+[A-Z]\w+)\b"]
LINE = r"(?i)\bline\s+(\d+)"
STOPWORDS = [
    "the", "this", "that", "code", "function", "method", "input", "output", "user", "data", "value", "variable", "string", "vulnerability", "vulnerable", "attacker", "attack",
    "security", "issue", "malicious", "example", "return", "without", "which", "could", "would", "should", "because", "sanitize", "sanitized", "sanitization", "validate",
    "validated", "validation", "check", "checked", "checking", "properly", "unsafe", "safe", "risk", "buffer", "overflow", "injection", "execute", "executed", "execution",
    "command", "request", "response", "server", "client", "system", "memory", "allocation", "pointer", "null", "array", "index", "length", "size", "bounds", "content", "file",
    "path", "directory", "call", "calls", "called", "parameter", "argument", "object", "class", "field", "session", "token", "password", "credential", "network", "socket",
    "process", "payload", "reason",
]
MECHANISM = {
    "CWE-89": ["sql", "query", "injection", "statement", "database"],
    "CWE-78": ["command", "shell", "os", "exec", "system", "injection"],
    "CWE-79": ["script", "html", "xss", "escap", "sanitiz", "cross-site", "browser"],
    "CWE-22": ["path", "traversal", "directory", "../", "file", "canonical"],
    "CWE-787": ["bound", "overflow", "write", "buffer", "memory", "index", "out-of"],
    "CWE-125": ["bound", "read", "buffer", "memory", "index", "out-of", "over-read"],
    "CWE-476": ["null", "pointer", "dereference", "nullptr", "none"],
    "CWE-190": ["integer", "overflow", "wrap", "arithmetic", "size", "multipl"],
    "CWE-416": ["free", "use-after", "dangling", "freed", "released", "pointer"],
    "CWE-20": ["validat", "input", "check", "sanitiz", "malformed", "untrusted"],
    "CWE-352": ["csrf", "cross-site", "request", "forgery", "token"],
    "CWE-918": ["ssrf", "server-side", "request", "url", "internal", "fetch"],
    "CWE-94": ["code", "inject", "eval", "exec", "dynamic"],
    "CWE-434": ["upload", "file", "extension", "type", "executable"],
    "CWE-798": ["hardcoded", "credential", "password", "key", "secret", "embedded"],
    "CWE-611": ["xml", "xxe", "entity", "external", "dtd"],
    "CWE-502": ["deserial", "pickle", "unmarshal", "object", "untrusted"],
    "CWE-287": ["authentic", "login", "bypass", "credential", "session"],
    "CWE-269": ["privilege", "permission", "escalat", "access"],
}


def code_references(reason: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Distinct lower-case references to code, heads of dotted names included, less the stopwords."""
    quoted = F.filter(F.transform(F.regexp_extract_all(reason, F.lit(QUOTED), F.lit(1)), lambda q: F.substring(q, F.lit(2), F.length(q) - 2)), lambda q: q.rlike(LOOKS_LIKE_CODE))
    names = F.flatten(F.transform(quoted, lambda q: F.regexp_extract_all(q, F.lit(r"([a-zA-Z_]\w*)"), F.lit(1))))
    found = F.concat(names, *[F.regexp_extract_all(reason, F.lit(p), F.lit(1)) for p in SHAPES])
    low = F.transform(found, lambda t: F.lower(t))
    low = F.concat(low, F.transform(low, lambda t: F.element_at(F.split(t, r"\."), 1)))
    return F.filter(F.array_distinct(low), lambda t: (F.length(t) > 2) & ~t.isin(*stopwords))


def present(refs: Column, code: Column) -> Column:
    """The references that occur in the code, whole or as part of a longer name, either way round."""
    terms = F.array_distinct(F.transform(F.regexp_extract_all(code, F.lit(r"([a-zA-Z_]\w*)"), F.lit(1)), lambda t: F.lower(t)))
    return F.filter(refs, lambda t: F.array_contains(terms, t) | F.exists(terms, lambda c: (F.length(c) > 3) & (F.contains(t, c) | F.contains(c, t))))


def explanation_scores(reason: Column, code: Column, cwe: Column, lines: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """struct(grounded, specific, mechanism, located, invented, n_refs, composite, empty).

    mechanism is null for classes without a vocabulary, located without a cited or a true line; an empty
    reason has composite 0 and both null.
    """
    reason = F.trim(F.coalesce(reason, F.lit("")))
    refs = code_references(reason, stopwords)
    here = present(refs, code)
    n, empty = F.size(refs), reason == ""
    grounded = F.when(n > 0, F.size(here) / n).otherwise(0.0)
    cited = F.transform(F.regexp_extract_all(reason, F.lit(LINE), F.lit(1)), lambda x: x.cast("int"))
    specific = F.when((F.size(here) > 0) | (F.size(cited) > 0), 1.0).otherwise(0.0)
    words = F.create_map(*[x for k, v in MECHANISM.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.coalesce(cwe, F.lit(""))]
    mechanism = F.when(~empty & words.isNotNull(), F.exists(words, lambda w: F.contains(F.lower(reason), w)).cast("double"))
    located = F.when(~empty & (F.size(cited) > 0) & (F.size(lines) > 0), F.exists(cited, lambda c: F.exists(lines, lambda t: F.abs(c - t) <= 3)).cast("double"))
    total = 0.5 * grounded + 0.2 * specific + F.coalesce(0.2 * mechanism, F.lit(0.0)) + F.coalesce(0.1 * located, F.lit(0.0))
    weight = 0.7 + F.when(mechanism.isNotNull(), 0.2).otherwise(0.0) + F.when(located.isNotNull(), 0.1).otherwise(0.0)
    return F.struct(F.round(grounded, 4).alias("grounded"), specific.alias("specific"), mechanism.alias("mechanism"), located.alias("located"), (n - F.size(here)).cast("long").alias("invented"), n.cast("long").alias("n_refs"),
                    F.when(empty, 0.0).otherwise(F.round(total / weight, 4)).alias("composite"), empty.alias("empty"))
