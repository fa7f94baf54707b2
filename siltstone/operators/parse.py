"""Parsing of untrusted text: verdicts, manifests, diffs, addresses, advisories, functions.

Fixed values: the patterns that recognise verdicts and manifest entries.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import clean_version, normal_package

CWE = r"(?i)CWE[-_ ]?0*(\d{1,4})"
CWE_BY_CUE = r"(?i)(?:type|cwe)\D{0,20}CWE[-_ ]?0*(\d{1,4})"
NO = r"(?i)vulnerab\w*\s*[:=]\s*[*_`\s]*(?:no|false)\b"
YES = r"(?i)vulnerab\w*\s*[:=]\s*[*_`\s]*(?:yes|true)\b"
SAYS_NO = r"(?i)\b(?:not vulnerable|no vulnerability|not exploitable)\b"
SAYS_YES = r"(?i)\b(?:is|are)\s+vulnerable\b"
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
GRADLE_ENTRY = r"""(?:implementation|api|compile|testImplementation|runtimeOnly|classpath)\s*\(?\s*['"]([^'"\s:]+):([^'"\s:]+)(?::([^'"\s]+))?['"]"""


def _cwe(text: Column, pattern: str = CWE) -> Column:
    n = F.regexp_extract(text, pattern, 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n.cast("int").cast("string")))


def _objects(text: Column, pattern: str, fields: str) -> Column:
    """The objects of these fields among the parts of a text that the pattern's group takes; null for parts that are no valid JSON."""
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.transform(parts, lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, fields)))


def verdict(text: Column) -> Column:
    """struct(vulnerable, cwe, parse_ok): the last object without inner braces, the last fenced one, a truncated one, then cues.

    Only JSON booleans count.  An explicit no beats a yes, both beat what prose says in passing, and cues leave
    parse_ok false.  The class of a cue's yes is the one named next to "type" or "cwe", else the first.
    """
    text, fields = F.coalesce(text, F.lit("")), "vulnerable boolean, cwe string"
    last = lambda found: F.element_at(F.concat(F.array(F.lit(None).cast("struct<vulnerable:boolean,cwe:string>")), F.filter(found, lambda o: o["vulnerable"].isNotNull())), -1)
    obj = F.coalesce(last(_objects(text, r'(\{[^{}]*"vulnerable"[^{}]*\})', fields)), last(_objects(text, FENCED, fields)))
    cut = F.regexp_extract(text, r'(?i)"vulnerable"\s*:\s*(true|false)', 1)
    strict = obj["vulnerable"]
    cue = F.when(text.rlike(NO), False).when(text.rlike(YES), True).when(text.rlike(SAYS_NO), False).when(text.rlike(SAYS_YES), True)
    vulnerable = F.coalesce(strict, F.when(cut != "", F.lower(cut) == "true"), cue)
    cut_cwe = _cwe(F.regexp_extract(text, r'(?i)"cwe"\s*:\s*"?(CWE[-_ ]?\d{1,4})', 1))
    cwe = F.when(strict.isNotNull(), _cwe(obj["cwe"])).when(cut != "", cut_cwe).when(cue, F.coalesce(_cwe(text, CWE_BY_CUE), _cwe(text)))
    return F.struct(vulnerable.alias("vulnerable"), cwe.alias("cwe"), (strict.isNotNull() | (cut != "")).alias("parse_ok"))


def dependency_reply(text: Column) -> Column:
    """struct(packages, parsed): names of a reply's vulnerable_dependencies, from valid JSON, else from an answer that was cut off.

    Valid: a fenced object, or all from the first brace to the last.  An item is an object with a package or a name.
    A cut answer gives the packages it got to, none perhaps; a reply without the field is not parsed.
    """
    text = F.coalesce(text, F.lit(""))
    found = F.concat(_objects(text, FENCED, "vulnerable_dependencies array<string>"), _objects(text, r"(?s)(\{.*\})", "vulnerable_dependencies array<string>"))
    items = F.get(F.filter(found, lambda o: o["vulnerable_dependencies"].isNotNull()), 0)["vulnerable_dependencies"]
    names = F.transform(items, lambda x: F.trim(F.when(x.startswith("{"), F.get_json_object(x, "$.package")).otherwise(x)))
    tail = F.regexp_extract(text, r'(?s)("vulnerable_dependencies"\s*:.*)', 1)
    cut = F.transform(F.regexp_extract_all(tail, F.lit(r'"package"\s*:\s*"([^"]+)"'), F.lit(1)), F.trim)
    none = F.array().cast("array<string>")
    packages = F.when(items.isNotNull(), F.filter(names, lambda n: n.isNotNull() & (n != ""))).when(tail != "", cut).otherwise(none)
    return F.struct(packages.alias("packages"), (items.isNotNull() | (tail != "")).alias("parsed"))


def malware_reply(text: Column) -> Column:
    """struct(malicious, technique, parsed): from a valid object with a boolean malicious, else from cues, which are not parsed."""
    text, fields = F.coalesce(text, F.lit("")), "malicious boolean, technique string"
    found = F.concat(_objects(text, FENCED, fields), _objects(text, r"(?s)(\{.*\})", fields))
    obj = F.get(F.filter(found, lambda o: o["malicious"].isNotNull()), 0)
    low, strict = F.lower(text), obj["malicious"]
    yes = low.rlike(r"\bmalicious\b.{0,12}\b(?:true|yes)\b") | F.contains(low, F.lit('"malicious": true'))
    no = F.contains(low, F.lit("not malicious")) | F.contains(low, F.lit('"malicious": false')) | F.contains(low, F.lit("benign"))
    technique = F.when(strict.isNotNull() & ~obj["technique"].isin("null", "", "none"), obj["technique"])
    return F.struct(F.coalesce(strict, F.when(yes, True).when(no, False)).alias("malicious"), technique.alias("technique"), strict.isNotNull().alias("parsed"))


def strict_boolean(text: Column, field: str) -> Column:
    """The field if the whole text is an object that holds a JSON boolean there, else null."""
    return F.from_json(text, f"{field} boolean", {"mode": "PERMISSIVE", "allowUnquotedFieldNames": "false"})[field]


def requirement_lines(text: Column) -> Column:
    """array<struct(package, version)> of a requirements file; only == and === pin."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(F.element_at(F.split(x, "#"), 1)))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("-") & x.rlike(r"^[A-Za-z0-9._-]+"))

    def entry(x: Column) -> Column:
        pin = F.regexp_extract(x, r"^[A-Za-z0-9._-]+\s*(?:\[[^\]]*\])?\s*===?\s*([^\s;,]+)", 1)
        return F.struct(F.regexp_extract(x, r"^([A-Za-z0-9._-]+)", 1).alias("package"), F.when(pin != "", clean_version(pin)).alias("version"))

    return F.transform(lines, entry)


def package_json(text: Column) -> Column:
    """array<struct(package, version)> of the three dependency sections."""
    parts = [F.coalesce(F.map_entries(F.from_json(F.get_json_object(text, f"$.{s}"), "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>")) for s in ("dependencies", "devDependencies", "optionalDependencies")]
    return F.transform(F.concat(*parts), lambda e: F.struct(e["key"].alias("package"), clean_version(e["value"]).alias("version")))


def package_lock(text: Column) -> Column:
    """array<struct(package, version)> of a lock file: by place under node_modules, then by name; entries without a version are left out."""
    at = lambda section: F.map_entries(F.from_json(F.get_json_object(text, f"$.{section}"), "map<string,struct<name:string,version:string>>"))
    none = F.array().cast("array<struct<key:string,value:struct<name:string,version:string>>>")
    own = F.filter(F.coalesce(at("packages"), none), lambda e: e["key"] != "")
    place = lambda e: F.coalesce(e["value"]["name"], F.element_at(F.split(e["key"], "node_modules/"), -1))
    entries = F.concat(F.transform(own, lambda e: F.struct(place(e).alias("package"), e["value"]["version"].alias("v"))), F.transform(F.coalesce(at("dependencies"), none), lambda e: F.struct(e["key"].alias("package"), e["value"]["version"].alias("v"))))
    return F.transform(F.filter(entries, lambda e: e["v"] != ""), lambda e: F.struct(e["package"].alias("package"), clean_version(e["v"]).alias("version")))


def pom(text: Column) -> Column:
    """array<struct(package, version)> of a Maven project: each dependency is a unit, comments and exclusions aside; any namespace prefix."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->|<((?:\w+:)?exclusions)>.*?</\1>", "")
    units = F.regexp_extract_all(bare, F.lit(r"(?s)<(?:\w+:)?dependency(?:\s[^>]*)?>(.*?)</(?:\w+:)?dependency>"), F.lit(1))
    part = lambda x, name: F.trim(F.regexp_extract(x, rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</", 1))
    named = F.filter(units, lambda x: (part(x, "groupId") != "") & (part(x, "artifactId") != ""))
    return F.transform(named, lambda x: F.struct(F.concat_ws(":", part(x, "groupId"), part(x, "artifactId")).alias("package"), clean_version(part(x, "version")).alias("version")))


def gradle(text: Column) -> Column:
    found = [F.regexp_extract_all(text, F.lit(GRADLE_ENTRY), F.lit(k)) for k in (1, 2, 3)]
    return F.transform(F.arrays_zip(*[f.alias(k) for f, k in zip(found, "gav")]), lambda x: F.struct(F.concat_ws(":", x["g"], x["a"]).alias("package"), clean_version(x["v"]).alias("version")))


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """(manifest columns, package, version) of (filename, ecosystem, content); the first entry of a normalised name stays."""
    name, text = F.lower("filename"), F.col("content")
    entries = F.when(name.isin("requirements.txt", "requirements-dev.txt", "pipfile"), requirement_lines(text)).when(name == "package.json", package_json(text)).when(name == "package-lock.json", package_lock(text)).when(name == "pom.xml", pom(text)).when(name.isin("build.gradle", "build.gradle.kts"), gradle(text))
    rows = manifests.withColumn("e", entries)
    named = F.transform("e", lambda x: F.struct(normal_package(F.col("ecosystem"), x["package"]).alias("package"), x["version"].alias("version")))
    first = F.filter(named, lambda x, i: (x["package"] != "") & ~F.array_contains(F.transform(F.slice(named, F.lit(1), i), lambda y: y["package"]), x["package"]))
    return rows.withColumn("e", F.explode(first)).select(*manifests.columns, "e.package", "e.version")


def repository_of(url: Column) -> Column:
    """owner/name of a repository address, else null."""
    m = F.regexp_extract(url, r"^(?:https?://)?(?:www\.)?[\w.-]+\.[a-z]+/([\w.-]+)/([\w.-]+?)(?:\.git)?/?(?:[#?].*|/.*)?$", 0)
    parts = [F.regexp_extract(url, r"^(?:https?://)?(?:www\.)?[\w.-]+\.[a-z]+/([\w.-]+)/([\w.-]+?)(?:\.git)?/?(?:[#?].*|/.*)?$", k) for k in (1, 2)]
    return F.when(m != "", F.concat_ws("/", *parts))


def subject_of(patch: Column) -> Column:
    """The commit message of a mailed patch: its subject and body up to the diff."""
    return F.trim(F.regexp_extract(patch, r"(?s)Subject: (.*?)(?:\n---|\ndiff |\z)", 1))


HUNKS = "path string, old_start int, old_count int, new_start int, new_count int, lines array<string>"


def diff_hunks(text: str) -> list[tuple]:
    """Hunks of a unified diff; a line state machine."""
    out, path, hunk = [], None, None
    for line in (text or "").split("\n"):
        if line.startswith("diff --git "):
            hunk, path = None, line.rsplit(" b/", 1)[-1]
        elif hunk is None and line.startswith("+++ "):
            path = line[6:] if line[4:6] == "b/" else path
        elif m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            hunk = (path, int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1), [])
            out.append(hunk)
        elif hunk is not None and line[:1] in ("+", "-", " "):
            hunk[5].append(line)
    return out


def parse_patches(patches: DataFrame, key: str = "doc_id", text: str = "patch") -> DataFrame:
    """One row per hunk; sequential in a patch, so in Arrow batches of patches."""
    kind = dict(patches.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *h) for k, t in zip(b[key], b[text]) for h in diff_hunks(t)]
            yield pd.DataFrame(rows, columns=[key, "path", "old_start", "old_count", "new_start", "new_count", "lines"])

    return patches.select(key, text).mapInPandas(run, f"{key} {kind}, {HUNKS}")


def reverse_apply(post: str, hunks: list[tuple]) -> str | None:
    """The text before a patch; None if the patch does not fit."""
    lines, out, at = post.split("\n"), [], 0
    for _, _, _, start, count, body in hunks:
        begin = start - 1 if count else start
        if begin < at or begin > len(lines):
            return None
        out += lines[at:begin]
        at = begin
        for line in body:
            if line[0] in "+ ":
                if at >= len(lines) or lines[at] != line[1:]:
                    return None
                at += 1
            if line[0] in "- ":
                out.append(line[1:])
    return "\n".join(out + lines[at:])


def reverse_patches(rows: DataFrame, key: str = "doc_id", post: str = "post", patch: str = "patch") -> DataFrame:
    """(key, pre): the texts before their patches; null where a patch does not fit."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "pre": [None if t is None else reverse_apply(t, diff_hunks(d)) for t, d in zip(b[post], b[patch])]})

    return rows.select(key, post, patch).mapInPandas(run, f"{key} {kind}, pre string")


def python_functions(code: str) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of the outermost functions of Python code; none if it does not parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return []
    out, todo = [], list(tree.body)
    while todo:
        node = todo.pop(0)
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append((node.name, node.lineno, node.end_lineno))
        else:
            todo = [*ast.iter_child_nodes(node), *todo]
    return out


#: Tokens of languages with braces; what hides braces comes first.
LEXEME = re.compile(r"""(?P<space>[ \t\r\f\v]+|\\\n)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>R"(?P<mark>[^()\s]{0,16})\(.*?\)(?P=mark)"|\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<name>[A-Za-z_$#~\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|::|->|[^\s\w])""", re.S)
#: Words that take parentheses and a block but are no functions, and those that name a block of another kind.
NO_FUNCTION = {"if", "for", "while", "switch", "catch", "return", "do", "else", "try", "synchronized", "with", "new", "using", "lock", "foreach", "sizeof", "throw"}
#: Words that take parentheses beside a declaration.
BESIDE = {"__attribute__", "__declspec", "alignas", "decltype", "noexcept", "requires"}
#: After these a brace opens a list or an object, and what came before goes on behind it.
BEFORE_LIST = {"=", ":", "(", ",", "[", "return", "?", "&&", "||", "default"}
GROUPS = {"class", "interface", "enum", "struct", "union", "namespace", "record", "extern"}
#: After these a slash begins a regular expression.
BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "=>", "return", "typeof", "case", "in", "of", ""}
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/[a-z]*")
PAIRS = {")": "(", "]": "[", "}": "{"}


def lexemes(code: str, language: str | None) -> list[tuple[str, str, int]]:
    """(kind, text, line) of code without comments, white space, lines of a preprocessor and what literals hold.

    A template string is one literal, whatever its parts hold; so is a regular expression of JavaScript.
    """
    out, at, line, begun, script = [], 0, 1, True, language == "javascript"
    while at < len(code):
        c = code[at]
        if c == "#" and begun and language in ("c", "cpp", None):
            end = at
            while True:  # a line ends where no backslash joins the next to it
                end = code.find("\n", end)
                if end < 0 or code[end - 1] != "\\":
                    break
                end += 1
            end = len(code) if end < 0 else end
            line += code.count("\n", at, end)
            at = end
            continue
        if c == "`" and script:
            end, deep = at + 1, 0  # parts in ${ } hold code, and templates again
            stack = ["`"]
            while end < len(code) and stack:
                if code[end] == "\\":
                    end += 1
                elif stack[-1] == "`":
                    if code[end] == "`":
                        stack.pop()
                    elif code.startswith("${", end):
                        stack.append("{")
                        end += 1
                elif code[end] == "}":
                    stack.pop()
                elif code[end] in "{`":
                    stack.append(code[end])
                end += 1
            out.append(("text", "`", line))
            line += code.count("\n", at, end)
            at, begun = end, False
            continue
        if c == "/" and script and (not out or out[-1][1] in BEFORE_REGEX) and not code.startswith(("//", "/*"), at) and (m := REGEX.match(code, at)):
            out.append(("text", "/", line))
            at, begun = m.end(), False
            continue
        m = LEXEME.match(code, at)
        if m is None:
            at += 1
            continue
        kind = m.lastgroup if m.lastgroup != "mark" else "text"
        if kind not in ("space", "line", "comment"):
            out.append((kind, m[0] if kind != "text" else '"', line))
            begun = False
        elif kind == "line":
            begun = True
        line += m[0].count("\n")
        at = m.end()
    return out


def _partners(tokens: list[tuple[str, str, int]]) -> dict[int, int]:
    """Closing brackets to opening ones and back; brackets that fit nothing are left out."""
    stack, out = [], {}
    for k, (_, text, _) in enumerate(tokens):
        if text in ("(", "[", "{"):
            stack.append(k)
        elif text in PAIRS:
            while stack and tokens[stack[-1]][1] != PAIRS[text] and text == "}":
                stack.pop()  # a brace closes what was left open inside it
            if stack and tokens[stack[-1]][1] == PAIRS[text]:
                out[k] = stack.pop()
                out[out[k]] = k
    return out


def _declared(tokens, partner, low: int, high: int) -> tuple[str, int] | None:
    """Name and first token of the function that the tokens low .. high - 1 before a brace declare, in C, C++ or Java; None if they declare none."""
    words = [tokens[k][1] for k in range(low, high)]
    if not words or words[0] in GROUPS and "(" not in words:
        return None
    k = low
    while k < high:
        text = tokens[k][1]
        if text == "operator" and k + 2 < high:
            signs = k + 1 if tokens[k + 1][1] != "(" else k + 3
            rest = next((j for j in range(signs, high) if tokens[j][1] == "("), high)
            return "operator" + "".join(t for _, t, _ in tokens[k + 1 : rest]), low
        if text in BESIDE and k + 1 < high and tokens[k + 1][1] == "(" and k + 1 in partner:
            k = partner[k + 1] + 1
            continue
        if text == "(" and k in partner:
            # a declarator in parentheses: its own parameters follow its name
            if k + 1 < high and tokens[k + 1][1] in ("*", "&", "^") and partner[k] + 1 < high and tokens[partner[k] + 1][1] == "(":
                inner = _declared(tokens, partner, k + 1, partner[k])
                names = [tokens[j][1] for j in range(k + 1, partner[k]) if tokens[j][0] == "name"]
                return (inner[0] if inner else names[-1], low) if names else None
            before = tokens[k - 1] if k > low else ("", "", 0)
            if before[0] == "name" and before[1] not in NO_FUNCTION and not before[1].startswith("@"):
                if k - 2 >= low and tokens[k - 2][1] in ("new", "=", "return", "."):
                    return None
                if k - 2 >= low and tokens[k - 2][1] == "@":  # an annotation with arguments
                    k = partner[k] + 1
                    continue
                return before[1], low
            if before[1] in NO_FUNCTION:
                return None
            return None
        if text == "=":
            return None
        k = partner[k] + 1 if text in ("(", "[", "{") and k in partner else k + 1
    return None


def _assigned(tokens, at: int, low: int) -> str | None:
    """What the function that begins at token `at` is assigned to: a variable, a property, or a key of an object."""
    k = at - 1
    if k >= low and tokens[k][1] in ("=", ":"):
        j = k - 1
        if tokens[k][1] == "=" and j >= low and tokens[j][1] in "+-*/%&|^?!<>=":
            j -= 1
        if j >= low:
            if tokens[j][0] == "name":
                name = tokens[j][1]
                while j - 2 >= low and tokens[j - 1][1] == "." and tokens[j - 2][0] == "name":
                    name, j = f"{tokens[j - 2][1]}.{name}", j - 2
                return name
            if tokens[j][0] == "text":
                return tokens[j][1]
    return None


def _script_function(tokens, partner, low: int, high: int) -> tuple[str, int] | None:
    """The same for JavaScript: declarations, function expressions, arrows and methods, by the name they have or are assigned to."""
    k = high - 1
    if k < low:
        return None
    arrow = tokens[k][1] == "=>"
    if arrow:
        k -= 1
        if k < low:
            return None
    if tokens[k][1] == ")" and k in partner:
        first = partner[k]
        head = first - 1
        if not arrow and head >= low and tokens[head][1] in NO_FUNCTION:
            return None
    elif arrow and tokens[k][0] == "name":
        first = head = k
        head -= 1
    else:
        return None
    if arrow:
        begin = first - 1 if first - 1 >= low and tokens[first - 1][1] == "async" else first
        return _assigned(tokens, begin, low) or "<anonymous>", begin
    star = head >= low and tokens[head][1] == "*"
    at = head - star
    if at >= low and tokens[at][1] == "function":
        begin = at - 1 if at - 1 >= low and tokens[at - 1][1] == "async" else at
        return _assigned(tokens, begin, low) or "<anonymous>", begin
    if head >= low and tokens[head][0] in ("name", "text") and tokens[head][1] not in NO_FUNCTION:
        before = head - 1 - (head - 1 >= low and tokens[head - 1][1] == "*")
        if before >= low and tokens[before][1] == "function":
            begin = before - 1 if before - 1 >= low and tokens[before - 1][1] == "async" else before
            return tokens[head][1], begin
        begin = head
        while begin - 1 >= low and tokens[begin - 1][1] in ("async", "static", "get", "set", "*", "#"):
            begin -= 1
        if begin == low or tokens[begin - 1][1] in (",", "{", "}", ";"):
            return tokens[head][1], begin
    return None


def brace_functions(code: str, language: str | None = None) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of the outermost functions of code whose bodies stand in braces; "<anonymous>" where one has no name.

    A push-down reading: brackets are matched first, and what stands before each brace that opens a block tells whether the block is a
    body, and whose.  Names: of C and C++ the innermost declarator, of JavaScript the function's own or what it is assigned to.
    """
    tokens = lexemes(code, language)
    partner = _partners(tokens)
    scripted = language == "javascript" or (language is None and any(t in ("=>", "function") for _, t, _ in tokens))
    out, begin, done, opened = [], 0, -1, []
    for k, (_, text, _) in enumerate(tokens):
        if k <= done:
            continue
        if text == "{":
            end, low = partner.get(k), begin
            if end is not None and end + 1 < len(tokens) and k and tokens[k - 1][0] == "name" and tokens[end + 1][1] in (",", "{") and any(t == ":" for _, t, _ in tokens[low:k]):
                done = end  # a member of a constructor's list
                continue
            found = _script_function(tokens, partner, low, k) if scripted else None
            if found is None and language != "javascript":
                found = _declared(tokens, partner, low, k)
            if found and end is not None:
                out.append((found[0], tokens[found[1]][2], tokens[end][2]))
                done = end
                inside = found[1] > low or any(o for o, _ in opened[-1:])  # of an expression, which goes on
                begin = begin if scripted and inside else end + 1
                continue
            opened.append((k > 0 and tokens[k - 1][1] in BEFORE_LIST, begin))
            begin = k + 1
        elif text == "}":
            goes_on, before = opened.pop() if opened else (False, 0)
            begin = before if goes_on else k + 1
        elif text == ";":
            begin = k + 1
        elif text == ":" and k - 1 >= begin and tokens[k - 1][1] in ("public", "private", "protected", "default"):
            begin = k + 1
    return out


def functions_of(code: str, language: str | None) -> list[tuple[str, int, int]]:
    return python_functions(code) if language == "python" else brace_functions(code, language)


def extract_functions(files: DataFrame, key: str = "doc_id", code: str = "code", language: str | None = None) -> DataFrame:
    """(key, name, start_line, end_line) of outermost functions: Python by its grammar, other languages by their braces.

    language: a column of names; without it all is Python.
    """
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = b[language] if language else ["python"] * len(b)
            rows = [(k, *f) for k, c, n in zip(b[key], b[code], names) for f in functions_of(c or "", n)]
            yield pd.DataFrame(rows, columns=[key, "name", "start_line", "end_line"])

    return files.select(key, code, *([language] if language else [])).mapInPandas(run, f"{key} {kind}, name string, start_line int, end_line int")


def last_object(text: str, required: str) -> dict:
    """The last complete object of a reply; raises if the reply is cut off, ends in something else, or lacks the key."""
    decoder, at, last, tail = json.JSONDecoder(), 0, None, 0
    while (at := text.find("{", at)) >= 0:
        try:
            last, at = decoder.raw_decode(text, at)
            tail = at
        except json.JSONDecodeError:
            at += 1
    if not isinstance(last, dict) or required not in last or "{" in text[tail:]:
        raise ValueError("no complete object with the required key")
    return last


def last_objects(texts: Column, required: str) -> Column:
    """last_object of each text as JSON, null where it raises."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return json.dumps(last_object(text or "", required))
            except ValueError:
                return None

        return batch.map(one)

    return run(texts)
