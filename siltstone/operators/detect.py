"""Rule detectors over text: rows of (kind, severity, detail), risk and verdicts.

Fixed values: the patterns of the rules and their weights.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions.text import TEST_PATH, entropy, severity_rank

INSTALL_HOOKS = ["preinstall", "install", "postinstall", "prepare", "prepublish", "preprepare", "postprepare"]
SETUP_EXEC = r"\b(cmdclass\s*=|class\s+\w*(?:Install|Develop|EggInfo|Build)\w*\s*\(|os\.system|subprocess\.(?:run|call|Popen|check_output)|__import__\s*\(|exec\s*\(|eval\s*\()"
GRADLE_EXEC = r"(doFirst|doLast|exec\s*\{|commandLine|ProcessBuilder|Runtime\.getRuntime)"
CI_TRIGGER = r"pull_request_target|workflow_run"
CI_CHECKOUT = r"ref:\s*\$\{\{\s*github\.event\.pull_request\.head\.(?:sha|ref)|ref:\s*\$\{\{\s*github\.event\.workflow_run\.head_(?:sha|branch)"
LOCAL_ADDRESS = r"^https?://(?:127\.|0\.0\.0\.0|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|255\.)"
BASE64_TEXT = r"['\"][A-Za-z0-9+/]{120,}={0,2}['\"]"
HEX_TEXT = r"['\"](?:\\x[0-9a-fA-F]{2}){40,}['\"]"
CHAR_CODES = r"(?:String\.fromCharCode|chr\s*\()\s*\(?\s*\d+(?:\s*,\s*\d+){15,}"
DYNAMIC_EXEC = r"\b(eval|exec|execSync|Function|compile)\s*\(|child_process\.(?:exec|spawn)|os\.popen|subprocess\.\w+\s*\("
DECODE_CALL = r"(b64decode|atob|base64\.decode|Buffer\.from\s*\([^)]*base64|codecs\.decode|zlib\.decompress|marshal\.loads|pickle\.loads)"
RAW_ADDRESS = r"https?://(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?"
SUSPICIOUS_HOST = r"(?i)\b(?:pastebin\.com|paste\.ee|hastebin|ghostbin|transfer\.sh|anonfiles|bit\.ly|tinyurl\.com|is\.gd|t\.me|discord(?:app)?\.com/api/webhooks|ngrok\.io|trycloudflare\.com|requestbin|webhook\.site|burpcollaborator|oastify|interact\.sh)\b"
HIGH_VALUE = r"(SSH_AUTH_SOCK|\.ssh/id_|\.aws/credentials|\.npmrc|\.pypirc|\.docker/config\.json|wallet\.dat|User Data[\\/].*(Login Data|Cookies)|cookies\.sqlite|key[34]\.db|logins\.json|AWS_SECRET_ACCESS_KEY|GITHUB_TOKEN|NPM_TOKEN)"
BULK_ENVIRONMENT = r"(?:os\.environ|process\.env)\s*(?![.\[\w])"
NET_SEND = r"(requests\.(?:post|put|patch)|urllib\.request\.urlopen|http\.client|fetch\s*\(|axios\.(?:post|put|patch)|XMLHttpRequest|socket\.(?:connect|create_connection)|curl\s|wget\s)"
HOOK_FETCH = r"curl|wget|https?://|\|\s*(?:sh|bash)"
MAKE_FETCH = r"(curl|wget)[^\n|]*\|\s*(ba)?sh"
NEAR_SEND = f"(?s){NET_SEND}(?=.{{0,299}}?(?:{HIGH_VALUE}|{BULK_ENVIRONMENT}))"
SUSPICIOUS_CALL = r"requests|subprocess|urllib|socket|os\.system|os\.environ|\beval\b|\bexec\b|base64|https?\.get|child_process"
SEVERITY_WEIGHT = {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 4, "MODERATE": 4, "LOW": 1}
EVIDENCE_WEIGHT = {"known": 2.0, "known_location": 1.0, "novel": 0.5, "unconfirmed": 0.3}
TECHNIQUES = {
    "exfiltrate-sensitive-data": ["exfiltration", "exfiltrate", "data-theft", "steal"],
    "download-executable": ["download-executable", "dropper", "download"],
    "exec-base64": ["obfuscated-exec", "obfuscation", "base64", "eval"],
    "code-execution": ["install-hook", "code-execution", "command-execution"],
    "reverse-shell": ["reverse-shell", "shell", "bind-shell"],
    "obfuscation": ["obfuscated-exec", "obfuscation"],
    "backdoor": ["backdoor", "auth-bypass", "hardcoded-credential", "hidden-command", "magic", "authorized_keys", "authorized-key"],
    "suspicious-network": ["suspicious-network", "beacon", "c2", "command-and-control", "dns-exfil", "callback", "phone-home", "exfiltration"],
}


INSTALL_MANIFESTS = ["package.json", "setup.py", "setup.cfg", "pyproject.toml", "build.gradle", "build.gradle.kts", "pom.xml", "makefile", "Makefile"]
SCANNED_SUFFIXES = [".py", ".js", ".ts", ".mjs", ".cjs", ".sh", ".bash", ".ps1", ".json", ".yml", ".yaml", ".gradle", ".xml", ".rb", ".pl"]
UNSCANNED_FOLDERS = [".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", "vendor", "site-packages"]
KINDS = ("install_hook", "ci_risk", "obfuscation", "network")


def found(kind: str, severity: str | Column, test: Column) -> Column:
    """A finding struct where test holds, else null."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(test, F.struct(F.lit(kind).alias("kind"), level.alias("severity")))


def install_hooks(name: Column, text: Column) -> list[Column]:
    scripts = F.from_json(F.get_json_object(text, "$.scripts"), "map<string,string>")
    hooked = F.map_filter(F.coalesce(scripts, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*INSTALL_HOOKS))
    runs = F.exists(F.map_values(hooked), lambda v: v.rlike(DYNAMIC_EXEC) | v.rlike(HOOK_FETCH))
    return [
        found("install_hook", F.when(runs, "CRITICAL").otherwise("HIGH"), (name == "package.json") & (F.size(hooked) > 0)),
        found("install_hook", "CRITICAL", (name == "setup.py") & text.rlike(SETUP_EXEC)),
        found("install_hook", "HIGH", name.isin("build.gradle", "build.gradle.kts") & text.rlike(GRADLE_EXEC)),
        found("install_hook", "CRITICAL", (name == "makefile") & text.rlike(MAKE_FETCH)),
    ]


def is_workflow(path: Column) -> Column:
    return path.rlike(r"(?:^|/)\.github/") & F.lower(path).rlike(r"\.ya?ml$")


def ci_risk(path: Column, text: Column) -> Column:
    """A workflow with both the trigger and the checkout of foreign code."""
    return found("ci_risk", "CRITICAL", is_workflow(path) & text.rlike(CI_TRIGGER) & text.rlike(CI_CHECKOUT))


def obfuscation(text: Column) -> Column:
    """The first usable payload - base64 of 4 bits per character or more, hex, character codes - next to execution or decoding."""
    blob = F.regexp_extract(text, BASE64_TEXT, 0)
    usable = ((blob != "") & (entropy(blob) >= 4.0)) | text.rlike(HEX_TEXT) | text.rlike(CHAR_CODES)
    runs, decodes = text.rlike(DYNAMIC_EXEC), text.rlike(DECODE_CALL)
    return found("obfuscation", F.when(runs & decodes, "CRITICAL").otherwise("HIGH"), usable & (runs | decodes))


def network(text: Column) -> list[Column]:
    """Suspicious host; address that is not local; credentials within 300 characters after a send, or anywhere with one."""
    far = F.exists(F.regexp_extract_all(text, F.lit(f"({RAW_ADDRESS})"), F.lit(1)), lambda a: ~a.rlike(LOCAL_ADDRESS))
    near = text.rlike(NEAR_SEND)
    return [
        found("network", "CRITICAL", text.rlike(SUSPICIOUS_HOST)),
        found("network", "HIGH", far),
        found("network", F.when(near, "CRITICAL").otherwise("HIGH"), near | (text.rlike(HIGH_VALUE) & text.rlike(NET_SEND))),
    ]


def scan(files: DataFrame, most_bytes: int = 400_000, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Findings (repo, path, kind, severity) of the rules of these kinds on (repo, path, content), all in one pass.

    Only these kinds' patterns are run.  Findings in test and documentation folders are kept, at LOW.  Texts above
    most_bytes are not checked.
    """
    text, name = F.coalesce("content", F.lit("")), F.lower(F.element_at(F.split("path", "/"), -1))
    rules = {"install_hook": lambda: install_hooks(name, text), "ci_risk": lambda: [ci_risk(F.col("path"), text)], "obfuscation": lambda: [obfuscation(text)], "network": lambda: network(text)}
    hits = F.array_compact(F.array(*[rule for k in kinds for rule in rules[k]()]))
    rows = files.filter(F.octet_length(text) <= most_bytes).select("repo", "path", F.explode(hits).alias("f")).select("repo", "path", "f.*")
    test = F.col("path").rlike(TEST_PATH) & F.col("severity").isin("CRITICAL", "HIGH")
    return rows.withColumn("severity", F.when(test, "LOW").otherwise(F.col("severity")))


def scan_states(files: DataFrame, most_files: int = 400, most_bytes: int = 400_000) -> DataFrame:
    """The files a scan could read, with state scanned, oversized or omitted: in order of paths, most_files of a repo at most.

    The last path within the budget decides, so that a repo of many files is no group of its own: Spark keeps
    the first most_files of a task before it shuffles.
    """
    name, low = F.element_at(F.split("path", "/"), -1), F.lower("path")
    suffixed = reduce(lambda a, b: a | b, [low.endswith(x) & ~F.lower(name).eqNullSafe(F.lit(x)) for x in SCANNED_SUFFIXES])
    skipped = F.arrays_overlap(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), F.array(*map(F.lit, UNSCANNED_FOLDERS)))
    eligible = files.filter((name.isin(*INSTALL_MANIFESTS) | is_workflow(F.col("path")) | suffixed) & ~skipped).withColumn("fits", F.octet_length(F.coalesce("content", F.lit(""))) <= most_bytes)
    first = eligible.filter("fits").select("repo", "path").withColumn("k", F.row_number().over(W.partitionBy("repo").orderBy("path"))).filter(F.col("k") <= most_files)
    last = first.groupBy("repo").agg(F.max("path").alias("last"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == most_files).select(F.col("repo").alias("of"), "last")
    state = F.when(F.col("last").isNotNull() & (F.col("path") > F.col("last")), "omitted").when(F.col("fits"), "scanned").otherwise("oversized")
    return eligible.join(last, F.col("repo") == F.col("of"), "left").withColumn("state", state).drop("of", "last", "fits")


def scan_summary(files: DataFrame, most_files: int = 400, most_bytes: int = 400_000, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Per repo: n_scanned, omitted, oversized, n_findings, worst_severity, clone_safe, status.

    A scan is complete if it read a file and left none out; only then clone_safe tells, else it is null.
    """
    states = scan_states(files, most_files, most_bytes)
    count = lambda s: F.count_if(F.col("state") == s)
    cover = states.groupBy("repo").agg(count("scanned").alias("n_scanned"), count("omitted").alias("omitted"), count("oversized").alias("oversized"))
    hits = scan(states.filter("state = 'scanned'"), most_bytes, kinds).groupBy("repo").agg(F.count(F.lit(1)).alias("n_findings"), F.max(severity_rank(F.col("severity"))).alias("rank"))
    rank, complete = F.coalesce("rank", F.lit(0)), (F.col("n_scanned") > 0) & (F.col("omitted") + F.col("oversized") == 0)
    worst = F.when(rank == 4, "CRITICAL").when(rank == 3, "HIGH").when(rank == 2, "MEDIUM").otherwise("none")
    return cover.join(hits, "repo", "left").select(
        "repo", "n_scanned", "omitted", "oversized", F.coalesce("n_findings", F.lit(0).cast("long")).alias("n_findings"), worst.alias("worst_severity"),
        F.when(complete, rank < 3).alias("clone_safe"), F.when(complete, "complete").otherwise("partial").alias("status"),
    )


def model_findings(replies: DataFrame) -> DataFrame:
    """Findings from checked answers: one pillar's severity and tier follow the evidence, not the model's words.

    replies: pillar, repo, file, line, flagged (boolean, null if not parsed), label (class, package or technique),
    evidence (novelty of a function, advisory status of a dependency), advisory_severity.  Unparsed and negative answers
    give none; so do dependencies the model flags no more than an advisory confirms.  Columns: those and severity, tier, source.
    """
    p, e = F.col("pillar"), F.col("evidence")
    known = (p == "vulnerability") & (e == "known")
    level = F.when(F.upper("advisory_severity") == "MODERATE", "MEDIUM").otherwise(F.upper("advisory_severity"))
    severity = (F.when(p == "vulnerability", F.when(known & level.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), level).otherwise("MEDIUM")).when(p == "secret", "HIGH").when(p == "malware", "CRITICAL")
                .when(e == "affected", F.coalesce(level, F.lit("HIGH"))).when(e == "unpinned", F.coalesce(level, F.lit("MEDIUM"))).otherwise("LOW"))
    sure = known | ((p == "dependency") & (e == "affected"))
    # the advisory database adds what it confirms and the model passed over
    kept = F.col("flagged") | ((p == "dependency") & (e == "affected"))
    source = F.when((p == "dependency") & ~F.coalesce("flagged", F.lit(False)), "advisory").when(sure | ((p == "dependency") & (e == "unpinned")), "ai+advisory").otherwise("ai")
    return replies.filter(F.coalesce(kept, F.lit(False))).select(*replies.columns, severity.alias("severity"), F.when(sure, "A").otherwise("C").alias("tier"), source.alias("source"))


def rule_hits(text: Column, rules: dict[str, str]) -> Column:
    """array<string>: names of the rules (name -> pattern) that match, in order; a null text matches none.  Rules are a list of fixed size."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), name) for name, pattern in rules.items()])) if rules else F.array().cast("array<string>")


def clone_verdicts(findings: DataFrame, coverage: DataFrame) -> DataFrame:
    """(repo, verdict) for each repo of coverage (repo, complete, n_scanned): certain evidence only, and never safe unless complete."""
    f = findings.filter((F.col("tier") == "A") & F.col("pillar").isin("supply_chain", "malware")).groupBy("repo").agg(F.count_if(F.col("severity") == "CRITICAL").alias("crit"), F.count_if(F.col("severity") == "HIGH").alias("high"))
    sure = F.coalesce("complete", F.lit(False)) & (F.coalesce("n_scanned", F.lit(0)) > 0)
    verdict = F.when(F.col("crit") > 0, "dangerous").when(F.col("high") > 0, "caution").when(~sure, "unknown").otherwise("safe")
    return coverage.join(f, "repo", "left").select("repo", verdict.alias("verdict"))


def _weights(table: dict[str, float], key: Column, other: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in (kv[0], float(kv[1]))])[F.coalesce(key, F.lit(""))], F.lit(other))


def risk(findings: DataFrame, analysed: DataFrame) -> DataFrame:
    """(repo, score, level) for each repo of analysed (repo, n_analysed).

    Severity counts by evidence, malware twice; high levels need certain evidence, however much else there is.
    """
    w = _weights(SEVERITY_WEIGHT, F.col("severity"), 3) * F.when(F.col("pillar") == "malware", 2.0).otherwise(1.0) * _weights(EVIDENCE_WEIGHT, F.col("novelty"), 1.0)
    sure = F.col("tier") == "A"
    f = findings.groupBy("repo").agg(F.sum(w).alias("score"), F.bool_or(sure & (F.col("pillar") == "malware")).alias("malware"), F.bool_or(sure & F.coalesce(F.col("severity").isin("CRITICAL", "HIGH"), F.lit(False))).alias("confirmed"))
    norm = F.col("score") / F.greatest("n_analysed", F.lit(1))
    level = (F.when(F.col("score").isNull(), F.when(F.col("n_analysed") > 0, "clean").otherwise("unknown")).when(F.col("malware") | (F.col("confirmed") & (norm >= 4)), "critical")
             .when(F.col("confirmed"), "high").when(norm >= 2, "medium").otherwise("low"))
    return analysed.join(f, "repo", "left").select("repo", F.round(F.coalesce("score", F.lit(0.0)), 1).alias("score"), level.alias("level"))


def technique_matches(truth: Column, claimed: Column) -> Column:
    """Whether the claim names the true technique or a synonym; null without a truth."""
    table = F.create_map(*[x for k, v in TECHNIQUES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    words = F.coalesce(table[truth], F.array(truth))
    return F.when(truth.isNotNull() & (truth != ""), F.coalesce(F.exists(words, lambda w: F.contains(F.lower(claimed), w)), F.lit(False)))
