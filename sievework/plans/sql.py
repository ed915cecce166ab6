"""SQL over the tables: temporary views of all of them, functions of the domain, and reports as SQL texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.domain import FIXED_STATES, IGNORED_STATES, OWASP, SEVERITIES
from ..registry import query
from . import standins

#: Given tables, and those that are made of them.
GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
MADE = ["stored_findings", "scans", "projects", "deps", "src_lines", "call_edges", "marked_lines"]
_N = "(?:0|[1-9][0-9]{0,8})"
_RANK = " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(SEVERITIES, 1))
_CLOSED = ", ".join(f"'{s}'" for s in (*FIXED_STATES, *IGNORED_STATES))

#: (name and parameters, type, body) of the functions.
FUNCTIONS = [
    ("severity_rank(severity STRING)", "INT", f"CASE severity {_RANK} END"),
    ("is_open(state STRING)", "BOOLEAN", f"coalesce(state, 'Open') NOT IN ({_CLOSED})"),
    ("fingerprint(rule_id STRING, file_path STRING, snippet STRING)", "STRING", "sha2(concat(rule_id, file_path, sha2(snippet, 256)), 256)"),
    ("version_key(version STRING)", "DECIMAL(28, 0)", f"""CASE WHEN regexp_extract(trim(version), '^v*([^-+]*)', 1) RLIKE '^{_N}[.]{_N}[.]{_N}$' THEN
        CAST(array_join(transform(split(regexp_extract(trim(version), '^v*([^-+]*)', 1), '[.]'), x -> lpad(x, 9, '0')), '') AS DECIMAL(28, 0)) END"""),
    ("version_between(version STRING, low STRING, high STRING)", "BOOLEAN", "coalesce((low IS NULL OR version_key(version) >= version_key(low)) AND (high IS NULL OR version_key(version) < version_key(high)), true)"),
    ("owasp_name(code STRING)", "STRING", "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OWASP.items()) + " END"),
]


def register(spark: SparkSession, folder: str, tables: list[str] | None = None) -> list[str]:
    """Make views of the tables of a folder (all of them) and the functions known to the session; the names of the views."""
    names = tables or [*GIVEN, *MADE]
    for name in names:
        rows = getattr(standins, name)(spark, folder) if name in MADE else standins.read(spark, folder, name)
        rows.createOrReplaceTempView(name)
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return names


#: Reports by name, with :parameters.
REPORTS = {
    "open_by_project": """
        SELECT project_id, severity, count(*) AS open_findings, min(severity_rank(severity)) AS severity_rank
        FROM stored_findings WHERE is_open(triage_state) AND severity_rank(severity) >= severity_rank(:least) GROUP BY project_id, severity""",
    "time_to_fix": """
        SELECT severity, count(*) AS fixed, CAST(sum(timestampdiff(HOUR, created_at, updated_at)) AS BIGINT) AS hours
        FROM stored_findings WHERE triage_state IN ('Fixed', 'AutoFixed') AND created_at >= CAST(:since AS TIMESTAMP_NTZ) GROUP BY severity""",
    "monthly_trend": """
        SELECT date_format(created_at, 'yyyy-MM') AS month, count(*) AS new_findings, count_if(is_open(triage_state)) AS still_open, count(DISTINCT fingerprint(rule_id, file_path, snippet)) AS distinct_findings
        FROM stored_findings WHERE org_id = :org GROUP BY 1""",
    "affected_versions": """
        SELECT d.package_name, count(*) AS affected FROM deps d WHERE version_between(d.version, :low, :high) GROUP BY d.package_name""",
    "owasp_share": """
        SELECT owasp_name(owasp_category) AS category, count(*) AS findings, count_if(is_open(triage_state)) AS open_findings FROM stored_findings WHERE owasp_category IS NOT NULL GROUP BY ALL""",
}


def report(spark: SparkSession, name: str, **parameters) -> DataFrame:
    """A report over registered views."""
    return spark.sql(REPORTS[name], args=parameters)


@query(
    "sql_open_by_project",
    """SELECT project_id, severity, count(*) AS open_findings, CASE severity WHEN 'Medium' THEN 3 WHEN 'High' THEN 4 ELSE 5 END AS severity_rank FROM stored_findings
    WHERE triage_state NOT IN ('Fixed','AutoFixed','Ignored','AutoIgnored') AND severity IN ('Medium','High','Critical') GROUP BY 1, 2""",
)
def sql_open(spark, d):
    register(spark, d, ["stored_findings"])
    return report(spark, "open_by_project", least="Medium")


@query("sql_time_to_fix", "SELECT severity, count(*) AS fixed, CAST(sum(open_hours) AS BIGINT) AS hours FROM stored_findings WHERE triage_state IN ('Fixed','AutoFixed') AND created_at >= TIMESTAMP '1994-01-01' GROUP BY 1")
def sql_fix(spark, d):
    register(spark, d, ["stored_findings"])
    return report(spark, "time_to_fix", since="1994-01-01 00:00:00")


@query(
    "sql_monthly_trend",
    """SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS new_findings, count(*) FILTER (WHERE triage_state NOT IN ('Fixed','AutoFixed','Ignored','AutoIgnored')) AS still_open,
    count(DISTINCT sha256(concat(rule_id, file_path, sha256(snippet)))) AS distinct_findings FROM stored_findings WHERE org_id = 'o-1' GROUP BY 1""",
)
def sql_trend(spark, d):
    register(spark, d, ["stored_findings"])
    return report(spark, "monthly_trend", org="o-1")


@query(
    "sql_affected_versions",
    """SELECT package_name, count(*) AS affected FROM (SELECT package_name, list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)) AS v FROM deps) WHERE v[1] * 1000000 + v[2] * 1000 + v[3] BETWEEN 1020003 AND 3004999 GROUP BY 1""",
)
def sql_versions(spark, d):
    register(spark, d, ["deps"])
    return report(spark, "affected_versions", low="1.20.3", high="3.5.0")
