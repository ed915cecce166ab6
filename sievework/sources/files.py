"""Source trees as rows: collection, languages, exclusions, rules, technologies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.domain import c
from ..operators.filters import any_glob

#: Languages by file extension.
EXTENSIONS = {
    "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "ts": "TypeScript", "tsx": "TypeScript",
    "py": "Python", "pyw": "Python",
    "rs": "Rust", "go": "Go", "java": "Java",
    "rb": "Ruby", "rake": "Ruby", "gemspec": "Ruby",
    "php": "PHP",
}
#: Directories that are never entered.
SKIPPED_DIRS = ["node_modules", ".git", "target", "dist", "build", "__pycache__", ".venv", "venv", ".sievework"]
#: Paths that are excluded unless asked for.
DEFAULT_EXCLUDES = [
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/target/**", "**/.git/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**",
    "**/*.min.js", "**/*.bundle.js", "**/*.map", "**/*.pyc",
    "**/tests/**", "**/test/**", "**/mocks/**", "**/fixtures/**", "**/testdata/**", "**/test-data/**",
    "**/*_test.rs", "**/*_test.js", "**/*_test.ts", "**/*_test.py",
    "**/*.spec.ts", "**/*.spec.js",
    "**/*.test.ts", "**/*.test.tsx", "**/*.test.js", "**/*.test.jsx",
]


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, text) of every file under path, read whole, final newlines included.

    The content is only read for files that filters on the path let through.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("text"))


def language_of(path: Column | str) -> Column:
    """Language by extension, null if unknown."""
    ext = F.regexp_extract(c(path), r"\.([^./]+)$", 1)
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(known, ext)


def spread(files: DataFrame) -> DataFrame:
    """files over as many tasks as the session shuffles into: parsing follows their number, which bytes of packed tables do not tell."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_path", "text")


def in_skipped_dir(path: Column | str) -> Column:
    names = "|".join(d.replace(".", "\\.") for d in SKIPPED_DIRS)
    return c(path).rlike(f"(^|/)({names})/")


def ignore_globs(text: str, tool_file: bool = False) -> list[str]:
    """Globs of an ignore file; comments and negations are left out, a bare name matches anywhere."""
    out = []
    for line in map(str.strip, text.splitlines()):
        if not line or line[0] in "#!":
            continue
        out.append(f"{line}**" if line.endswith("/") else line if "/" in line else f"**/{line}")
    return out


def is_excluded(path: Column | str, globs: Sequence[str] = ()) -> Column:
    """Does a default exclusion or one of the given globs match the path?"""
    return any_glob(path, [*DEFAULT_EXCLUDES, *globs])


def collect(files: DataFrame, globs: Sequence[str] = ()) -> DataFrame:
    """Scannable files, with their language."""
    kept = files.where(~in_skipped_dir("file_path") & ~is_excluded("file_path", globs))
    return kept.withColumn("language", language_of("file_path")).where("language is not null")


def collection_counts(files: DataFrame, globs: Sequence[str] = ()) -> DataFrame:
    """One row: scannable files, and supported ones that exclusions leave out."""
    out = in_skipped_dir("file_path") | is_excluded("file_path", globs)
    known = language_of("file_path").isNotNull()
    return files.agg(F.count_if(known & ~out).alias("files"), F.count_if(known & out).alias("ignored"))


RULE = (
    "rule_id string, name string, severity string, language string, pattern string, cwe_id string, owasp_category string, "
    "test_cases array<struct<code:string,expected:boolean>>, priority int, load_order int"
)


def load_rules(spark: SparkSession, documents: Sequence[str], priority: int = 0) -> DataFrame:
    """Rules of YAML texts; entries without id, pattern or a known severity are left out."""
    import yaml

    rows = []
    for text in documents:
        try:
            found = yaml.safe_load(text) or []
        except yaml.YAMLError:
            continue
        for r in found if isinstance(found, list) else [found]:
            if not isinstance(r, dict) or not r.get("id") or not r.get("pattern") or r.get("severity") not in ("Info", "Low", "Medium", "High", "Critical"):
                continue
            cases = [(t.get("code", ""), t.get("expected") == "TruePositive") for t in r.get("test_cases") or []]
            for lang in r.get("languages") or [None]:
                rows.append((r["id"], r.get("name"), r["severity"], lang, r["pattern"], r.get("cwe_id"), r.get("owasp_category"), cases, priority, len(rows)))
    return spark.createDataFrame(rows, RULE)


def last_rules(rules: DataFrame) -> DataFrame:
    """One row per (rule, language): of the highest priority, the one that was loaded last."""
    w = Window.partitionBy("rule_id", "language").orderBy(F.desc("priority"), F.desc("load_order"))
    return rules.withColumn("__sw_rn", F.row_number().over(w)).where("__sw_rn = 1").drop("__sw_rn")


#: Rules of our own, used where none are given.
DEFAULT_RULES = [
    ("SEC001", "Hard-coded token", "Critical", None, r'token = "([0-9a-f]{40})"', "CWE-798", "A07"),
    ("PII001", "E-mail address", "Medium", None, r"[A-Za-z0-9.]+@[a-z0-9]+[.]example[.]com", "CWE-359", "A02"),
    ("PII002", "IPv4 address", "Low", None, r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "CWE-200", "A05"),
    ("PII003", "16-digit number", "High", None, r"[0-9]{16}", "CWE-359", "A02"),
    ("LIC001", "License line", "Info", None, r"(Released under|Licensed under|licensed under)", None, None),
    ("PY001", "Call of eval or exec", "High", "Python", r"\b(eval|exec)\(", "CWE-95", "A03"),
    ("JS001", "Assignment to inner HTML", "High", "JavaScript", r"\.innerHTML\s*=", "CWE-79", "A03"),
    ("GO001", "Weak hash", "Medium", "Go", r"\bmd5\.(New|Sum)\(", "CWE-327", "A02"),
]


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [(*r, [], -1, k) for k, r in enumerate(DEFAULT_RULES)]
    return spark.createDataFrame(rows, RULE)


#: Technologies as (kind, name, file name pattern, text it must hold or null).
TECHNOLOGIES = [
    ("language", "JavaScript", r"(^|/)package\.json$", None),
    ("language", "TypeScript", r"(^|/)package\.json$", '"(typescript|ts-node)"'),
    ("manager", "npm", r"(^|/)package\.json$", None),
    ("manager", "yarn", r"(^|/)yarn\.lock$", None),
    ("manager", "pnpm", r"(^|/)pnpm-lock\.yaml$", None),
    ("language", "Python", r"(^|/)(requirements\.txt|setup\.py|pyproject\.toml)$", None),
    ("manager", "pip", r"(^|/)(requirements\.txt|setup\.py|pyproject\.toml)$", None),
    ("manager", "poetry", r"(^|/)pyproject\.toml$", r"\[tool\.poetry\]"),
    ("language", "Rust", r"(^|/)Cargo\.toml$", None),
    ("manager", "cargo", r"(^|/)Cargo\.toml$", None),
    ("language", "Go", r"(^|/)go\.mod$", None),
    ("manager", "go modules", r"(^|/)go\.mod$", None),
    ("language", "Java", r"(^|/)(pom\.xml|build\.gradle(\.kts)?)$", None),
    ("manager", "maven", r"(^|/)pom\.xml$", None),
    ("manager", "gradle", r"(^|/)build\.gradle(\.kts)?$", None),
    ("framework", "React", r"(^|/)package\.json$", '"react"'),
    ("framework", "Express", r"(^|/)package\.json$", '"express"'),
    ("framework", "Django", r"(^|/)(requirements\.txt|pyproject\.toml)$", "(?i)django"),
    ("framework", "Flask", r"(^|/)(requirements\.txt|pyproject\.toml)$", "(?i)flask"),
    ("framework", "Spring", r"(^|/)(pom\.xml|build\.gradle(\.kts)?)$", "springframework"),
]


def technologies(files: DataFrame) -> DataFrame:
    """(kind, name) found in (file_path, text): by manifests, and languages by extension as well.

    Only files of a manifest's name are tested against the rules, so other texts are not read.
    """
    names = "|".join(f"(?:{file})" for file in dict.fromkeys(t[2] for t in TECHNOLOGIES))
    rules = files.sparkSession.createDataFrame(TECHNOLOGIES, "kind string, name string, file string, holds string")
    hit = F.expr("file_path rlike file and (holds is null or text rlike holds)")
    by_manifest = files.where(F.col("file_path").rlike(names)).join(F.broadcast(rules), hit).select("kind", "name")
    by_ext = files.select(F.lit("language").alias("kind"), language_of("file_path").alias("name")).where("name is not null")
    return by_manifest.union(by_ext).distinct()


def rule_files(tech: DataFrame, available: DataFrame) -> DataFrame:
    """The available rule files (file_name) that the technologies select; universal.yaml always."""
    stem = F.lower(F.regexp_replace("name", "[ .]", "-"))
    wanted = tech.select(F.when(F.col("kind") == "manager", F.concat(stem, F.lit("-deps.yaml"))).otherwise(F.concat(stem, F.lit(".yaml"))).alias("file_name"))
    universal = tech.sparkSession.createDataFrame([("universal.yaml",)], "file_name string")
    return available.join(wanted.union(universal).distinct(), "file_name", "left_semi")


def estimated_rules(tech: DataFrame) -> DataFrame:
    """Rough number of rules: 5, and 8 per language and 6 per framework."""
    return tech.agg((F.lit(5) + 8 * F.count_if(F.col("kind") == "language") + 6 * F.count_if(F.col("kind") == "framework")).alias("rules"))


def changed_lines(diff: DataFrame) -> DataFrame:
    """(file_path, line) that a unified diff adds, from (pos, text) rows in order of pos.

    A commit's diff is one ordered text: its lines are numbered by running counts over the file's hunks.
    """
    order = Window.partitionBy("diff_id").orderBy("pos")
    rows = diff.withColumn("file_path", F.last(F.when(F.col("text").rlike(r"^\+\+\+ b/"), F.substring("text", 7, 1 << 20)), ignorenulls=True).over(order))
    start = F.regexp_extract("text", r"^@@ -\S+ \+(\d+)", 1)
    rows = rows.withColumn("hunk", F.sum((start != "").cast("int")).over(order))
    rows = rows.withColumn("first", F.max(F.when(start != "", start.cast("int"))).over(Window.partitionBy("diff_id", "hunk")))
    body = rows.where((F.col("hunk") > 0) & F.col("text").rlike(r"^[ +]") & ~F.col("text").rlike(r"^\+\+\+ "))
    at = F.row_number().over(Window.partitionBy("diff_id", "hunk").orderBy("pos"))
    return body.withColumn("line", F.col("first") + at - 1).where(F.col("text").startswith("+")).select("file_path", "line")


def staged_files(index: DataFrame) -> DataFrame:
    """(file_path) of the files to scan in the (text) lines of a repository's index: status, tab, path.

    Deleted files are left out, and a rename or copy counts by its new path, the last one of the line.
    """
    parts = F.split("text", "\t")
    return index.where(F.col("text").rlike(r"^[ACMRT]\d*\t.+")).select(F.element_at(parts, -1).alias("file_path")).distinct()


def refreshed_snippets(findings: DataFrame, context: int = 3) -> DataFrame:
    """Findings (file_path, text, line, snippet, ..) with the snippet taken anew from the text; dependencies keep theirs."""
    from ..functions.domain import snippet_window

    synthetic = F.startswith("file_path", F.lit("<"))
    return findings.withColumn("snippet", F.when(synthetic, F.col("snippet")).otherwise(snippet_window("text", "line", context)))


def with_windows(findings: DataFrame, files: DataFrame, context: int = 3) -> DataFrame:
    """Findings (file_path, line, snippet, ..) whose snippet is the lines around them in files (file_path, text).

    Each file that has findings meets its list of lines once and is split once. Paths that are no files keep their snippets.
    """
    from ..functions.domain import lines_of, window_of

    places = findings.where(~F.startswith("file_path", F.lit("<"))).groupBy("file_path").agg(F.collect_set("line").alias("__sw_lines"))
    split = files.select("file_path", "text").join(places, "file_path").select("file_path", "__sw_lines", lines_of("text").alias("__sw_text"))
    windows = split.select("file_path", F.explode(F.transform("__sw_lines", lambda n: F.struct(n.alias("line"), window_of(F.col("__sw_text"), n, context).alias("__sw_window")))).alias("w"))
    windows = windows.select("file_path", "w.*")
    return findings.join(windows, ["file_path", "line"], "left").withColumn("snippet", F.coalesce("__sw_window", "snippet")).select(*findings.columns)


def contributors(commits: DataFrame, days: int = 90) -> DataFrame:
    """Distinct authors of the last days before the newest commit (author, ts)."""
    last = commits.agg(F.max("ts").alias("__sw_last"))
    rows = commits.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.expr(f"__sw_last - interval {days} days"))
    return rows.agg(F.countDistinct("author").alias("contributors"))
