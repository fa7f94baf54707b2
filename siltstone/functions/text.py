"""Column expressions over text, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file suffix.
LANGUAGE_OF_SUFFIX = {
    "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
    "java": "java", "py": "python",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript",
}
#: Manifests and their ecosystems, suffixes that may hold secrets, folders.
MANIFESTS = {"requirements.txt": "PyPI", "package.json": "npm", "pom.xml": "Maven", "package-lock.json": "npm", "pipfile": "PyPI", "build.gradle": "Maven"}
SECRET_SUFFIXES = ["env", "yml", "yaml", "properties", "ini", "cfg", "json", "toml"]
SKIPPED_FOLDERS = [".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", "vendor", ".idea", ".devcontainer", ".github", "site-packages", "third_party", "docs", "doc", "examples", "example"]
LOW_VALUE_FOLDERS = ["test", "tests", "testing", "spec", "specs", "fixtures", "benchmark", "benchmarks", "migrations", "locale", "i18n"]
#: Messages of commits that are not about one fix.
NOISE_MARKERS = ["merge branch", "merge pull request", "revert ", "typo", "reformat", "re-format", "indentation", "whitespace", "bump version", "update changelog", "release notes"]
#: Folders of tests and documentation; the stricter form also knows names of test files.
TEST_PATH = r"(?i)(^|[\\/])(tests?|testing|spec|specs|fixtures?|__tests__|examples?|benchmarks?|docs?)([\\/]|$)"

TEST_FILE = r"(?i)(^|/)(tests?|testing|fixtures?|examples?|benchmarks?)(/|$)|(^|/)test_[^/]+|[^/]+_test\.[^/]+$"


def norm_hash(code: Column) -> Column:
    """md5 of the text with white space collapsed; the identity of a function body."""
    return F.md5(F.trim(F.regexp_replace(code, r"(?U)[\s\x1c-\x1f]+", " ")).cast("binary"))


def file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def suffix(path: Column) -> Column:
    """Lower-case suffix without its dot; names that begin with their only dot have none."""
    return F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGE_OF_SUFFIX.items() for x in kv]
    return F.create_map(*pairs)[suffix(path)]


def language_family(language: Column) -> Column:
    return F.when(language.isin("c", "cpp"), "c/cpp").otherwise(language)


#: Scanners by language; the last looks at files of any kind.
TOOLS = {"python": ["semgrep", "bandit"], "javascript": ["semgrep"], "java": ["semgrep"], "c": ["semgrep"], "cpp": ["semgrep"]}
ANY_LANGUAGE_TOOL = "gitleaks"


def tools_for(languages: Column) -> Column:
    """The scanners for an array of languages, each once, in the order in which the languages ask for them."""
    known = F.create_map(*[x for k, v in TOOLS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = F.flatten(F.transform(F.filter(languages, lambda x: x.isin(*TOOLS)), lambda x: known[x]))
    return F.array_distinct(F.concat(asked, F.array(F.lit(ANY_LANGUAGE_TOOL))))


def is_noisy(message: Column) -> Column:
    low = F.lower(message)
    out = F.lit(False)
    for marker in NOISE_MARKERS:
        out = out | F.contains(low, F.lit(marker))
    return out


def folders(path: Column) -> Column:
    return F.split(F.lower(path), "/")


def among(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(folders(path), F.array(*map(F.lit, names)))


def routes(path: Column) -> Column:
    """Checks that should see a file; a file can go to several."""
    name, ext, lang = file_name(path), suffix(path), language_of(path)
    return F.array_compact(F.array(
        F.when(name.isin(*MANIFESTS), "dependency"),
        F.when(lang.isNotNull(), "vulnerability"),
        F.when(lang.isin("python", "javascript") | (name == "package.json"), "malware"),
        F.when(ext.isin(*SECRET_SUFFIXES) | lang.isNotNull() | name.startswith(".env"), "secret"),
    ))


def priority(path: Column) -> Column:
    """Rank of a file for a bounded scan; lower is first."""
    name, low = file_name(path), among(path, LOW_VALUE_FOLDERS)
    small = F.contains(name, F.lit(".min.")) | name.endswith(".bundle.js") | name.endswith(".pack.js")
    code = F.when(low, 5).when(name.isin("setup.py", "__init__.py"), 2).when(small, 7).otherwise(3)
    return (F.when(name.isin(*MANIFESTS), 0).when(name.startswith(".env") | name.isin("credentials", "secrets.yml"), 1)
            .when(language_of(path).isNotNull(), code).when(suffix(path).isin(*SECRET_SUFFIXES), F.when(low, 6).otherwise(4)).otherwise(9))


def normal_package(ecosystem: Column, name: Column) -> Column:
    name = F.trim(name)
    return F.when(ecosystem == "PyPI", F.lower(F.regexp_replace(name, "[-_.]+", "-"))).when(ecosystem == "npm", F.lower(name)).otherwise(name)


def clean_version(raw: Column) -> Column:
    """The exactly pinned version in a specifier, else null.  Fixed values: what may stand before a version, and its form."""
    v = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^[\"']+|[\"']+$", ""), r"^[\^~>=<!\s]*", "")
    v = F.trim(F.element_at(F.split(v, ","), 1))
    return F.when(v.rlike(r"^\d+(?:\.\w+)*(?:[-+.]\w+)*$"), v)


def normal_severity(severity: Column) -> Column:
    up = F.upper(severity)
    return F.when(up == "MODERATE", "MEDIUM").otherwise(up)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 4).when(severity == "HIGH", 3).when(severity.isin("MEDIUM", "MODERATE"), 2).when(severity == "LOW", 1).otherwise(0)


def entropy(text: Column) -> Column:
    """Shannon bits per character; 0 for empty text.  Characters are sorted once; each run of equal ones is one part."""
    n = F.length(text).cast("double")
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(text, "")), ""), F.lit(r"(?s)((.)\2*+)"), F.lit(1))
    bits = F.aggregate(runs, F.lit(0.0), lambda s, r: s - (F.length(r) / n) * F.log2(F.length(r) / n))
    return F.when(n > 0, bits).otherwise(0.0)


def one_edit_apart(a: Column, b: Column) -> Column:
    """Whether strings are one insertion, deletion, substitution or adjacent swap apart."""
    swap = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: (F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b))
    return (F.levenshtein(a, b) == 1) | ((a != b) & (F.length(a) == F.length(b)) & (F.length(a) > 1) & swap)


def hash_unit(*parts: Column) -> Column:
    """A 32-bit number from the md5 of the parts; the same on every engine, hence the seed of all sampling."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
