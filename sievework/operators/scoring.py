"""Confidence, exposure and class of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import c, severity_of_rank, severity_rank

#: Weights of reachability, pattern and context.
WEIGHTS = (0.4, 0.3, 0.3)


def reach_score(has_path: Column | str, user_controlled: Column | str) -> Column:
    return F.when(c(has_path) & c(user_controlled), 1.0).when(c(has_path), 0.8).otherwise(0.2)


def pattern_score(nodes: Column | str, predicates: Column | str, api: Column | str, framework: Column | str) -> Column:
    extra = lambda x, w: F.when(c(x), w).otherwise(0.0)
    score = 0.3 + 0.1 * F.least(c(nodes), F.lit(5)) + extra(predicates, 0.1) + extra(api, 0.15) + extra(framework, 0.1)
    return F.least(score, F.lit(1.0))


def context_score(sanitized: Column | str, validated: Column | str, in_test: Column | str, dead: Column | str) -> Column:
    less = lambda x, w: F.when(c(x), w).otherwise(0.0)
    return F.greatest(1.0 - less(sanitized, 0.4) - less(validated, 0.3) - less(in_test, 0.3) - less(dead, 0.5), F.lit(0.0))


def confidence(reach: Column, pattern: Column, context: Column) -> Column:
    total = WEIGHTS[0] * reach + WEIGHTS[1] * pattern + WEIGHTS[2] * context
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def percent(score: Column | str) -> Column:
    return F.concat(F.floor(c(score) * 100 + 0.5).cast("string"), F.lit("%"))


def exposed_severity(severity: Column | str, public: Column | str) -> Column:
    """Critical where the service is public, one step down where it is not, unchanged where unknown."""
    lower = severity_of_rank(F.greatest(severity_rank(severity) - 1, F.lit(1)))
    return F.when(c(public), "Critical").when(~c(public), lower).otherwise(c(severity))


def k8s_public(kind: Column | str, ingress: Column | str) -> Column:
    """Is a Kubernetes service reachable from outside?"""
    return F.coalesce(c(ingress), F.lit(False)) | F.coalesce(c(kind).isin("LoadBalancer", "NodePort", "ExternalName"), F.lit(False))


#: Class, its CWE number, and what a rule id of the class holds; the first that fits counts.
CLASSES = [
    ("sql_injection", "89", "sql.*inject|inject.*sql|sqli"),
    ("xss", "79", "xss|cross-site"),
    ("command_injection", "78", "command.*inject|inject.*command|cmd-inject|os-command"),
    ("path_traversal", "22", "path-traversal|directory-traversal"),
    ("ssrf", "918", "ssrf|server-side-request"),
    ("insecure_deserialization", "502", "deserial|pickle|unsafe-yaml"),
    ("hardcoded_credentials", "798", "hardcoded|hard-coded|secret-in-source"),
    ("open_redirect", "601", "redirect"),
    ("xxe", "611", "xxe|xml-external"),
]


def vulnerability_class(cwe: Column | str, rule_id: Column | str) -> Column:
    """Class by CWE, else by the rule id, else unknown."""
    number = F.trim(F.regexp_replace(F.lower(c(cwe)), "^(cwe-)+", ""))
    out = F.lit("unknown")
    for name, _, words in reversed(CLASSES):
        out = F.when(F.lower(c(rule_id)).rlike(words), name).otherwise(out)
    for name, digits, _ in reversed(CLASSES):
        out = F.when(number == digits, name).otherwise(out)
    return out


#: Line rewrites of our own: template, what it needs, what it becomes.
TEMPLATES = {
    "strong-hash": (r"\b(hashlib\.)(md5|sha1)\(", "$1sha256("),
    "safe-yaml": (r"\byaml\.load\(([^,()]*)\)", "yaml.safe_load($1)"),
    "text-content": (r"\.innerHTML(\s*=)", ".textContent$1"),
    "verify-tls": (r"verify\s*=\s*False", "verify=True"),
    "bound-parameter": (r"""\.execute\(\s*f?(["'])([^"']*?)\{(\w+)\}([^"']*)\1\s*\)""", ".execute($1$2%s$4$1, ($3,))"),
    "argument-list": (r"os\.system\((\w+)\)", "subprocess.run(shlex.split($1), check=True)"),
    "no-shell": (r"shell\s*=\s*True", "shell=False"),
    "base-name": (r"\bopen\((\w+)([,)])", "open(os.path.basename($1)$2"),
    "checked-url": (r"\brequests\.(get|post)\((\w+)([,)])", "requests.$1(allowed_url($2)$3"),
    "json-loads": (r"\bpickle\.loads\(", "json.loads("),
    "from-environment": (r"""\b(password|secret|token|api_key)\s*=\s*["'][^"']+["']""", "$1 = os.environ[\"$1\"]"),
    "local-redirect": (r"\bredirect\((\w+)\)", "redirect(local_path($1))"),
    "no-entities": (r"resolve_entities\s*=\s*True", "resolve_entities=False"),
}


def patched_line(line: Column | str, template: Column | str) -> Column:
    """The line as its template rewrites it, null where the template does not apply; indentation stays."""
    out = F.lit(None).cast("string")
    for name, (pattern, becomes) in TEMPLATES.items():
        out = F.when((c(template) == name) & c(line).rlike(pattern), F.regexp_replace(c(line), pattern, becomes)).otherwise(out)
    return out


def scored(findings: DataFrame) -> DataFrame:
    """Adds confidence_score to findings with the eleven inputs of the score."""
    return findings.withColumn(
        "confidence_score",
        confidence(
            reach_score("has_path", "user_controlled"),
            pattern_score("nodes", "predicates", "api", "framework"),
            context_score("sanitized", "validated", "in_test", "dead"),
        ),
    )
