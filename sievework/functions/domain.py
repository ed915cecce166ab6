"""Scalar functions of the finding domain: severity ranks, states, identities, text windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from least to most severe.
SEVERITIES = ["Info", "Low", "Medium", "High", "Critical"]
#: Triage states that mean work is still open; unknown states count as open too.
OPEN_STATES = ["Open", "Reviewing", "ToFix"]
FIXED_STATES = ["Fixed", "AutoFixed"]
IGNORED_STATES = ["Ignored", "AutoIgnored"]
#: The OWASP 2021 categories.
OWASP = {
    "A01": "Broken Access Control",
    "A02": "Cryptographic Failures",
    "A03": "Injection",
    "A04": "Insecure Design",
    "A05": "Security Misconfiguration",
    "A06": "Vulnerable and Outdated Components",
    "A07": "Identification and Authentication Failures",
    "A08": "Software and Data Integrity Failures",
    "A09": "Security Logging and Monitoring Failures",
    "A10": "Server-Side Request Forgery",
}


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def severity_rank(severity: Column | str) -> Column:
    """1 for Info to 5 for Critical, null for anything else."""
    out = None
    for rank, name in enumerate(SEVERITIES, 1):
        out = F.when(c(severity) == name, rank) if out is None else out.when(c(severity) == name, rank)
    return out


def severity_of_rank(rank: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), c(rank).cast("int"))


def is_open(state: Column | str) -> Column:
    """Everything that is neither fixed nor ignored."""
    return ~F.coalesce(c(state), F.lit("Open")).isin(*FIXED_STATES, *IGNORED_STATES)


def owasp_code(text: Column | str) -> Column:
    """A01..A10 of a category written as code, code:2021, or name in any case and spacing; else null."""
    folded = F.regexp_replace(F.lower(c(text)), "[^a-z0-9]", "")
    out = F.lit(None).cast("string")
    for code, name in OWASP.items():
        plain = "".join(ch for ch in name.lower() if ch.isalnum())
        out = F.when(folded.isin(code.lower(), f"{code.lower()}2021", plain, f"{code.lower()}{plain}"), code).otherwise(out)
    return out


def fingerprint(rule_id: Column | str, file_path: Column | str, snippet: Column | str) -> Column:
    """Identity of a finding that survives line moves."""
    return F.sha2(F.concat(c(rule_id), c(file_path), F.sha2(c(snippet), 256)), 256)


def dedup_fingerprint(project: Column | str, rule: Column | str, path: Column | str) -> Column:
    """32-bit multiplicative xor hash of project::rule::path, as dedup:%08x."""
    joined = F.concat(c(project), F.lit("::"), c(rule), F.lit("::"), c(path))
    codes = F.transform(F.split(joined, ""), lambda ch: F.ascii(ch).cast("long"))
    h = F.aggregate(codes, F.lit(5381).cast("long"), lambda a, x: (a * 33).bitwiseXOR(x).bitwiseAND(F.lit(4294967295)))
    return F.concat(F.lit("dedup:"), F.lpad(F.lower(F.hex(h)), 8, "0"))


def context_hash(context: Column | str, snippet: Column | str) -> Column:
    """Key of learned suppressions: context and the lower-cased snippet without white space."""
    return F.sha2(F.concat(c(context), F.lit("|"), F.lower(F.regexp_replace(c(snippet), r"\s+", ""))), 256)


def memory_key(snippet: Column | str) -> Column:
    return F.trim(F.regexp_replace(c(snippet), r"\s+", " "))


def lines_of(text: Column | str) -> Column:
    """Lines without their ends; a final newline starts no line, and empty text has none."""
    body = F.regexp_replace(c(text), "\r?\n$", "")
    return F.when(F.char_length(c(text)) > 0, F.split(body, "\r?\n")).otherwise(F.array().cast("array<string>"))


def window_of(lines: Column, line: Column, context: int = 3) -> Column:
    """Of an array of lines those from line - context to line + context, each cut to 100 characters; '' out of range."""
    n = max(0, min(10, context))
    first = F.greatest(line - n, F.lit(1))
    window = F.slice(lines, first, F.least(line + n, F.size(lines)) - first + 1)
    inside = (line >= 1) & (line <= F.size(lines))
    return F.when(inside, F.array_join(F.transform(window, lambda x: F.substring(x, 1, 100)), "\n")).otherwise("")


def snippet_window(text: Column | str, line: Column | str, context: int = 3) -> Column:
    """The lines of a text around a line, see window_of."""
    return window_of(lines_of(text), c(line), context)


def annotated_window(text: Column | str, line: Column | str, context: int = 3) -> Column:
    """Numbered lines around a line, which is marked."""
    lines = lines_of(text)
    first = F.greatest(c(line) - context, F.lit(1))
    window = F.slice(lines, first, F.least(c(line) + context, F.size(lines)) - first + 1)
    numbered = F.transform(
        window,
        lambda x, i: F.concat(
            F.lpad((first + i).cast("string"), 4, " "), F.when(first + i == c(line), " >> ").otherwise("    "), x
        ),
    )
    return F.when((c(line) >= 1) & (c(line) <= F.size(lines)), F.array_join(numbered, "\n")).otherwise("")


def display_snippet(snippet: Column | str, max_lines: int, max_chars: int) -> Column:
    """The first max_lines lines, each cut to max_chars with an ellipsis, and a note on what is left out."""
    lines = F.split(c(snippet), "\n")
    cut = F.transform(
        F.slice(lines, 1, max_lines),
        lambda x: F.when(F.char_length(x) > max_chars, F.concat(F.substring(x, 1, max_chars), F.lit("…"))).otherwise(x),
    )
    more = F.size(lines) - max_lines
    note = F.array(F.concat(F.lit("… ("), more.cast("string"), F.lit(" more lines)")))
    return F.array_join(F.when(more > 0, F.concat(cut, note)).otherwise(cut), "\n")


#: Directories whose children are services, and names that say nothing about a service.
SERVICE_DIRS = ["services", "apps", "microservices", "packages", "modules"]
PLAIN_DIRS = ["src", "lib", "pkg", "internal", "cmd", "app"]


def service_name(path: Column | str) -> Column:
    """Service that a path belongs to, in lower case.

    What follows the first service directory, else the first part that is no plain directory and has no dot,
    else the file's stem. An absolute path's root counts as a part.
    """
    service = F.regexp_extract(c(path), rf"(?:^|/)(?:{'|'.join(SERVICE_DIRS)})/(?:\.?/)*(?!\.(?:/|$))([^/]+)", 1)
    first = F.regexp_extract(c(path), rf"(?i)(?:^|/)(?!(?:{'|'.join(PLAIN_DIRS)})(?:/|$))([^/.]+)(?=/|$)", 1)
    file = F.regexp_extract(c(path), r"([^/]+)(?:/\.?)*$", 1)
    stem = F.when(file.rlike(r"^\.{0,2}$"), "unknown").otherwise(F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""))
    return F.lower(F.when(service != "", service).when(F.startswith(c(path), F.lit("/")), "/").when(first != "", first).otherwise(stem))


def sanitized_tag(tag: Column | str) -> Column:
    return F.regexp_replace(c(tag), r"[^\p{L}\p{N}_-]", "-")


def trace_step(seconds: Column | str, action: Column | str) -> Column:
    return F.concat(F.format_string("%.3f", c(seconds)), F.lit("s: "), c(action))


def comment_body(line: Column | str) -> Column:
    """Text after the first // or # of a line; null without one."""
    body = F.regexp_extract(c(line), r"(?://|#)(.*)$", 1)
    return F.when(c(line).rlike("//|#"), F.trim(F.regexp_replace(body, r"^[/#!\s]+", "")))
