"""Tool output to memory rows: one expression for each family of tools, one explode."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from memjobs.operators.ledger import any_contains

# Tools by family.
FAMILIES = {
    "tests": ("pytest", "npm_test", "jest", "cargo_test", "go_test"), "diff": ("git_diff", "git"), "search": ("ripgrep", "grep", "rg"),
    "lint": ("mypy", "tsc", "eslint", "rustfmt", "clippy", "flake8", "pylint", "black", "prettier"), "docker": ("docker", "docker_build", "docker_compose"), "terraform": ("terraform", "tf_plan", "tf_apply"),
    "kubernetes": ("kubectl", "k8s", "helm"), "packages": ("pip", "npm", "yarn", "pnpm", "cargo", "go_mod"), "api": ("curl", "http", "api_call"), "security": ("bandit", "snyk", "trivy", "semgrep"), "coverage": ("coverage", "codecov", "cargo_tarpaulin"),
}
# What is read from the tools' output.
PATTERNS = {
    "failed_block": r"(?s)FAILED\s+([\w/_.]+)::?([\w_]+).*?\n(.*?)(?=\nFAILED|\n=+|$)",
    "passed": r"(?i)(\d+)\s+passed",
    "failed": r"(?i)(\d+)\s+failed",
    "diff_file": r"(?m)^diff --git a/(.+?) b/",
    "added_function": r"(?m)^\+.+def\s+(\w+)",
    "removed_function": r"(?m)^-.*def\s+(\w+)",
    "search_hit": r"(?m)^([^\n:]+):\d+:",
    "lint_issue": r"(?mi)^([^\n:]+):(\d+):\s*(error|warning)[\s:]*(.+)$",
    "docker_image": r"Successfully built\s+([a-f0-9]{12})",
    "to_add": r"(\d+) to add",
    "to_change": r"(\d+) to change",
    "to_destroy": r"(\d+) to destroy",
    "pod": r"(?m)^(\S+)\s+\d+/\d+\s+(\w+)",
    "installed": r"Successfully installed\s+(.+)",
    "vulnerabilities": r"(?i)(\d+)\s+(?:vulnerabilities?|high|critical)",
    "http_status": r"HTTP/(\d\.\d)\s+(\d{3})",
    "severity": r"(?i)(high|critical|medium|low)\s+severity",
    "percent": r"(\d+(?:\.\d+)?)%",
}
_FAILED = re.compile(PATTERNS["failed_block"])
_BLOCK = ArrayType(StructType([StructField(n, StringType()) for n in ("file", "test", "detail")]))


@F.pandas_udf(_BLOCK)
def failed_blocks(text: pd.Series) -> pd.Series:
    """The failing tests told in a test run's output."""
    return text.map(lambda t: [{"file": m[1], "test": m[2], "detail": m[3].strip()[:200]} for m in _FAILED.finditer(t or "")], na_action=None)


def _row(kind: str, summary: Column, message: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("memory_type"), summary.cast("string").alias("summary"), (none if message is None else message.cast("string")).alias("message"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def parse_tool_output(events: DataFrame) -> DataFrame:
    """event_id, ordinal, memory_type, summary, message of tool calls with content; other tools give one fact."""
    t, tool = F.col("content"), F.coalesce("tool_name", F.lit(""))
    low = F.lower(t)
    fact = _row("fact", _text(tool, ": ", F.substring(t, 1, 200)))
    head = F.substring(t, 1, 500)
    one = lambda p, g=1: F.nullif(F.regexp_extract(t, PATTERNS[p], g), F.lit(""))
    every = lambda p, g=1: F.regexp_extract_all(t, F.lit(PATTERNS[p]), F.lit(g))
    rows = lambda *xs: F.array_compact(F.array(*xs))

    passed, failed = one("passed"), one("failed")
    status = F.when(failed.cast("int") > 0, "failing").when(passed.cast("int") > 0, "passing").otherwise("unknown")
    told = F.concat_ws(", ", _text(tool, ": ", status), _text(passed, " passed"), _text(failed, " failed"))
    broken = F.transform("_failed", lambda b: _row("error", _text("Test fail: ", b["test"], " in ", b["file"]), F.substring(_text(b["test"], ": ", b["detail"]), 1, 400)))
    files = F.array_distinct(every("diff_file"))
    added, removed = every("added_function"), every("removed_function")
    some = lambda sign, xs: F.when(F.size(xs) > 0, _text(sign, F.array_join(F.slice(xs, 1, 3), ",")))
    changed = (F.size(added) > 0) | (F.size(removed) > 0)
    hits = F.array_distinct(every("search_hit"))
    lint = PATTERNS["lint_issue"]
    issues = every("lint_issue", 4)
    first = F.substring(_text(F.regexp_extract(t, lint, 1), ":", F.regexp_extract(t, lint, 2), ": ", F.trim(F.regexp_extract(t, lint, 4))), 1, 400)
    image = one("docker_image")
    plan = F.concat_ws(" ", *[_text(sign, one(f"to_{word}")) for sign, word in (("+", "add"), ("~", "change"), ("-", "destroy"))])
    states = F.slice(F.zip_with(every("pod", 1), every("pod", 2), lambda a, b: F.concat(a, F.lit(":"), b)), 1, 3)
    installed, flaws = one("installed"), one("vulnerabilities")
    code = one("http_status", 2).cast("int")
    severe = F.transform(every("severity"), F.lower)
    counts = F.array_join(F.transform(F.array_sort(F.array_distinct(severe)), lambda s: F.concat(s, F.lit(":"), F.size(F.filter(severe, lambda x: x == s)).cast("string"))), ", ")
    percent = one("percent").cast("double")
    share = percent.cast("string")
    families = {
        "tests": F.concat(F.array(_row("fact", F.substring(told, 1, 300))), broken),
        "diff": rows(F.when(F.size(files) > 0, _row("code_change", _text("Diff: ", F.array_join(F.slice(files, 1, 3), ", ")))), F.when((F.size(files) > 0) & changed, _row("fact", _text("Changes: ", F.concat_ws(" ", some("+", added), some("-", removed)))))),
        "search": rows(F.when(F.size(hits) > 0, _row("fact", _text("Search found: ", F.array_join(F.slice(hits, 1, 3), ", "))))),
        "lint": rows(F.when(F.size(issues) > 0, _row("error", _text(tool, ": ", F.size(issues).cast("string"), " issues"), first)).otherwise(fact)),
        "docker": rows(F.when(any_contains(low, ("error", "failed")), _row("error", _text(tool, " build failed: ", F.substring(t, 1, 200)), head)).otherwise(fact), F.when(image.isNotNull(), _row("fact", _text("Docker image built: ", image)))),
        "terraform": rows(F.when(plan != "", _row("fact", _text("Terraform plan: ", plan))).otherwise(fact), F.when(low.contains("error"), _row("error", _text("Terraform error: ", F.substring(t, 1, 200)), head))),
        "kubernetes": rows(F.when(F.size(states) > 0, _row("fact", _text("K8s status: ", F.array_join(states, " ")))).otherwise(fact), F.when(any_contains(t, ("CrashLoopBackOff", "Error", "Failed", "OOMKilled")), _row("error", F.lit("K8s pod error detected"), head))),
        "packages": rows(F.when(installed.isNotNull() & tool.isin("pip", "npm", "yarn", "pnpm"), _row("fact", _text("Installed: ", F.substring(installed, 1, 100)))), F.when(flaws.isNotNull(), _row("error", _text("Package vulnerabilities found: ", flaws), head))),
        "api": rows(F.when(code.isNotNull(), _row("fact", _text("API ", F.when(code < 400, "success").otherwise("error"), ": HTTP ", code.cast("string")))).otherwise(fact), F.when(code >= 400, _row("error", _text("API error: HTTP ", code.cast("string")), head))),
        "security": rows(F.when(F.size(severe) > 0, _row("error", _text(tool, " security: ", counts), head)).otherwise(fact)),
        "coverage": rows(F.when(percent.isNotNull(), _row("fact", _text("Coverage: ", share, "%"))).otherwise(fact), F.when(percent < 50, _row("error", _text("Low coverage: ", share, "%"), _text("Coverage ", share, "% below threshold")))),
    }
    families["packages"] = F.when(F.size(families["packages"]) > 0, families["packages"]).otherwise(F.array(fact))
    branch = F.array(fact)
    for family, tools in FAMILIES.items():
        branch = F.when(tool.isin(*tools), families[family]).otherwise(branch)
    calls = events.where("event_type = 'tool_call' and content <> ''")
    blocks = F.when(tool.isin(*FAMILIES["tests"]) & t.contains("FAILED"), failed_blocks(t)).otherwise(F.array().cast(_BLOCK))
    return calls.withColumn("_failed", blocks).select("event_id", F.posexplode(branch).alias("ordinal", "r")).select("event_id", "ordinal", "r.*")


ITEM = "array<struct<memory_type:string,summary:string,status:string,rationale:string,error_kind:string,error_message:string,importance:double,confidence:double,file_references:array<string>>>"
# Memory types.
TYPES = ("event", "intent", "goal", "decision", "error", "task", "fact", "requirement", "code_change", "tool_call", "uncertainty", "reflection", "procedure", "preference")


def from_precomputed(events: DataFrame) -> DataFrame:
    """Rows that a model has extracted before: events (event_id, event_type, llm_extracted JSON list) -> one row for each item; unknown types are facts."""
    items = F.from_json("llm_extracted", F.lit(ITEM))
    rows = events.select("event_id", "event_type", F.posexplode(items).alias("ordinal", "i"))
    kind = F.when(F.col("i.memory_type").isin(*TYPES), F.col("i.memory_type")).otherwise("fact")
    source = F.when(F.col("event_type") == "assistant_response", "assistant_message").when(F.col("event_type") == "tool_call", "tool_output").when(F.col("event_type") == "code_change", "code_diff").otherwise("user_message")
    summary = F.substring(F.coalesce("i.summary", F.lit("")), 1, 500)
    decision = F.when((kind == "decision") | F.col("i.rationale").isNotNull(), F.coalesce("i.status", F.lit("active")))
    error = F.when((kind == "error") | F.col("i.error_kind").isNotNull() | F.col("i.error_message").isNotNull(), F.coalesce("i.error_kind", F.lit("runtime_error")))
    return rows.select("event_id", "ordinal", kind.alias("memory_type"), source.alias("source_type"), summary.alias("summary"), decision.alias("decision_status"), error.alias("error_kind"), F.coalesce("i.importance", F.lit(0.5)).alias("importance"), F.coalesce("i.confidence", F.lit(0.5)).alias("confidence"))
