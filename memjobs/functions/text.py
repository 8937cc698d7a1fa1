"""Column expressions over text: tokens, redaction, protected terms, fields of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"

# Secret patterns in their order of use; (name, pattern, replacement).
SECRETS = [
    ("api_key", r"(?i)\b(?:api[_-]?key|apikey)\s*[:=]\s*['\"]?([a-zA-Z0-9_\-]{16,})['\"]?", REDACTED),
    ("secret", r"(?i)\b(?:secret|client_secret|app_secret)\s*[:=]\s*['\"]?([a-zA-Z0-9_\-]{16,})['\"]?", REDACTED),
    ("token", r"(?i)\b(?:token|access_token|refresh_token|auth_token|bearer)\s*[:=]\s*['\"]?([a-zA-Z0-9_\-\.]{16,})['\"]?", REDACTED),
    ("password", r"(?i)\b(?:password|passwd|pwd)\s*[:=]\s*['\"]?([^'\"\s]{4,})['\"]?", REDACTED),
    ("private_key", r"(?i)-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", REDACTED),
    ("aws_key", r"\b(AKIA[0-9A-Z]{16})\b", REDACTED),
    ("aws_secret", r"\b([0-9a-zA-Z/+]{40})\b", REDACTED),
    ("github_token", r"\b(gh[pousr]_[A-Za-z0-9_]{36,})\b", REDACTED),
    ("slack_token", r"\b(xox[baprs]-[0-9]{10,13}-[0-9]{10,13}(-[a-zA-Z0-9]{24})?)\b", REDACTED),
    ("stripe_key", r"\b((?:sk|pk)_(?:live|test)_[0-9a-zA-Z]{24,})\b", REDACTED),
    ("jwt", r"\b(eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*)\b", REDACTED),
    ("env_var_secret", r"(?i)\b([A-Z_]*(?:SECRET|KEY|TOKEN|PASSWORD|PASS|AUTH)[A-Z_]*)\s*=\s*['\"]?([a-zA-Z0-9_\-\.]{8,})['\"]?", f"$1={REDACTED}"),
    ("connection_string", r"(?i)(\b(?:postgres|mysql|mongodb|redis|amqp)://[^:]+:)([^@]+)(@.*)", f"$1{REDACTED}$3"),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", REDACTED),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", REDACTED),
]


#: What every text that a secret pattern fits has in it: one pass tells most texts apart from those worth fifteen.
SUSPECT = r"(?i)api|secret|token|bearer|pass|pwd|key|auth|-----begin|akia|xox|gh[pousr]_|[sp]k_|eyj|://|@|\d\.\d|[0-9a-z/+]{40}"


def redact_secrets(text: Column) -> Column:
    """All secret patterns replaced, in order; one expression, no shuffle."""
    clean = text
    for _, pattern, replacement in SECRETS:
        clean = F.regexp_replace(clean, pattern, replacement)
    return F.when(text.rlike(SUSPECT), clean).otherwise(text)


def secret_types(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p, _ in SECRETS]))


def has_secrets(text: Column) -> Column:
    out = F.lit(False)
    for _, pattern, _ in SECRETS:
        out = out | F.coalesce(text.rlike(pattern), F.lit(False))
    return out


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of two characters or more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]{2,}"), F.lit(0))


def words(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\S+"), F.lit(0)))


def estimate_tokens(text: Column) -> Column:
    """0 for no text, else a quarter of its length, 1 at least."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


# Identifiers that compression must keep.
TERMS = [
    r"[\w\-/.]+\.(?:py|ts|js|tsx|jsx|rs|go|java|cpp|c|h|yaml|yml|json|toml|md|txt|cfg|ini)", r"/api/[\w/:-]+", r"CVE-\d{4}-\d+", r"\d+\.\d+\.\d+", r"[A-Z][A-Z_0-9]{2,}",
    r"\$\w+|\$\{\w+\}", r"test_\w+|\w+_test\.py", r"ERR_\w+|E\d+|\d{3,4}[A-Z]?", r"[a-z][a-z0-9_-]*>=?[\d.]+|[a-z][a-z0-9_-]*==[\d.]+",
]
# Camel-case names, words that are none, and the shorter list of keywords.
CAMEL = r"\b[a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*\b|\b[A-Z][a-zA-Z0-9]*[a-z][a-zA-Z0-9]*\b"
PLAIN = ("Decision", "Requirement", "Error", "Assistant", "Migration")
KEYWORDS = [(r"[\w\-/]+\.(py|ts|js|yaml|yml|json|toml|md|txt)", 1), (r"/api/[a-zA-Z0-9_\-/]+", 0), (r"\b[A-Z][A-Z0-9_]{2,}\b", 0), (r"\b\d+\.\d+\.\d+\b", 0), (r"CVE-\d{4}-\d+", 0), (r"\b[A-Z][a-z]+Error\b|\b[A-Z_]+_ERROR\b", 0), (r"\b[a-z_][a-zA-Z0-9_]*\(\)", 0)]


def protected_terms(text: Column) -> Column:
    """Sorted distinct identifiers: paths, endpoints, versions, keys, codes, camel-case names over five letters."""
    found = [all_matches(text, p) for p in TERMS]
    camel = F.filter(all_matches(text, CAMEL), lambda w: (F.length(w) > 5) & ~w.isin(*PLAIN))
    return F.array_sort(F.array_distinct(F.concat(*found, camel)))


def protected_keywords(text: Column, k: int = 15) -> Column:
    """The shorter list used in packs: sorted, first k; paths count by their extension."""
    return F.slice(F.array_sort(F.array_distinct(F.concat(*[all_matches(text, p, g) for p, g in KEYWORDS]))), 1, k)


# Labelled fields of free text.
FIELDS = {
    "rationale": r"(?i)(?:Rationale|Because|Reason)[\s:—]+([^\n.]{10,200})",
    "tradeoffs": r"(?i)(?:Tradeoff|Pros? and cons?|Trade-off)[\s:—]+([^\n]{10,300})",
    "root_cause": r"(?is)(?:Root cause|Rootcause|Caused by|Cause)[\s:—]+(.{5,300}?)(?=\n|\.\s+(?:Fix|Verified|Alternative|Tradeoff)|\z)",
    "fix_attempt": r"(?is)(?:Fix attempt|Fix|Attempted fix|Attempt)[\s:—]+(.{5,300}?)(?=\n|\.\s+(?:Verified|Root cause|Alternative|Tradeoff)|\z)",
    "verified_fix": r"(?is)(?:Verified fix|Verified|Confirmed fix|Confirmed)[\s:—]+(.{5,300}?)(?=\n|\.\s+(?:Recurrence|Root cause|Fix|Alternative)|\z)",
}
# Alternatives and file names in free text.
ALTERNATIVE = r"(?i)(?:Alternative|Instead of|Option)[\s:—]+([^\n.]{5,120})"
FILE_REF = r"([a-zA-Z0-9_\-/]+\.(?:py|ts|js|rs|go|java|c|cpp|h|yaml|yml|json|toml|md|txt))"


#: A word of each label, in lower case: without one of them a field's pattern can't fit.
LABELS = {"rationale": ("rationale", "because", "reason"), "tradeoffs": ("trade", "pro"), "root_cause": ("cause",), "fix_attempt": ("fix", "attempt"), "verified_fix": ("verified", "confirmed")}


def _mentions(text: Column, words) -> Column:
    low = F.lower(text)
    out = low.contains(words[0])
    for w in words[1:]:
        out = out | low.contains(w)
    return out


def field(text: Column, name: str) -> Column:
    return F.when(_mentions(text, LABELS[name]), F.trim(F.regexp_extract(text, FIELDS[name], 1))).when(text.isNotNull(), "")


def alternatives(text: Column) -> Column:
    found = F.transform(F.slice(all_matches(text, ALTERNATIVE, 1), 1, 3), F.trim)
    return F.when(_mentions(text, ("alternative", "instead of", "option")), found).otherwise(F.array().cast("array<string>"))


def file_refs(text: Column, k: int = 5) -> Column:
    found = F.slice(F.array_distinct(all_matches(text, FILE_REF, 1)), 1, k)
    return F.when(text.contains("."), found).otherwise(F.array().cast("array<string>"))


def recurrence_risk(text: Column) -> Column:
    """3 high, 2 medium, 1 low, 2 if only mentioned, else 0."""
    low = F.lower(text)
    out = F.when(low.contains("recurrence risk"), 2).otherwise(0)
    for level, n in (("low", 1), ("medium", 2), ("high", 3)):
        out = F.when(low.contains(f"{level} risk") | low.contains(f"{level} recurrence"), n).otherwise(out)
    return out
