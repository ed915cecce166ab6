"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..registry import query
from ..sources.trees import RULE_IDS
from .standins import projects, read, scans, src_lines, stored_findings

OPEN = "triage_state NOT IN ('Fixed','AutoFixed','Ignored','AutoIgnored')"


def sev(cond: str = "true") -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {cond} AND severity = '{s}') AS {s.lower()}" for s in ("Critical", "High", "Medium", "Low", "Info")
    )


@query(
    "agg1_overview",
    f"""SELECT f.*, s.* FROM (SELECT count(*) FILTER (WHERE {OPEN}) AS total_findings, count(*) FILTER (WHERE {OPEN}) AS open_findings,
    count(*) FILTER (WHERE triage_state IN ('Fixed','AutoFixed')) AS fixed_findings,
    count(*) FILTER (WHERE triage_state IN ('Ignored','AutoIgnored')) AS ignored_findings, {sev(OPEN)} FROM stored_findings) f,
    (SELECT count(*) AS total_scans, CAST(floor(avg(duration_ms) + 0.5) AS BIGINT) AS avg_scan_duration_ms FROM scans) s""",
)
def agg1(spark, d):
    return A.overview(stored_findings(spark, d), scans(spark, d))


@query(
    "agg2_overview_all",
    f"""SELECT f.*, s.* FROM (SELECT count(*) AS total_findings, count(*) FILTER (WHERE triage_state NOT IN ('Fixed','Ignored','AutoIgnored')) AS open_findings,
    count(*) FILTER (WHERE triage_state = 'Fixed') AS fixed_findings,
    count(*) FILTER (WHERE triage_state IN ('Ignored','AutoIgnored')) AS ignored_findings, {sev()} FROM stored_findings) f,
    (SELECT count(*) AS total_scans, CAST(sum(duration_ms) // count(*) AS BIGINT) AS avg_scan_duration_ms FROM scans) s""",
)
def agg2(spark, d):
    return A.overview_all(stored_findings(spark, d), scans(spark, d))


@query(
    "agg3_trends",
    f"""SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS new_findings, count(*) FILTER (WHERE {OPEN}) AS open_findings,
    count(*) FILTER (WHERE triage_state = 'Fixed') AS fixed_findings FROM stored_findings GROUP BY 1""",
)
def agg3(spark, d):
    return A.trends(stored_findings(spark, d))


@query(
    "agg4_mttr",
    """SELECT coalesce(severity, 'all') AS severity, count(*) AS fixed,
    avg((epoch_us(updated_at) - epoch_us(created_at)) / 3.6e9) AS mttr_hours
    FROM stored_findings WHERE triage_state = 'Fixed' GROUP BY ROLLUP (severity)""",
)
def agg4(spark, d):
    return A.mttr(stored_findings(spark, d))


@query(
    "agg5_top_projects",
    f"""SELECT t.project_id, coalesce(p.name, 'Unknown') AS name, coalesce(p.repository_url, '') AS repository_url,
    open_findings, critical, high, medium, low, info
    FROM (SELECT project_id, count(*) AS open_findings, {sev()} FROM stored_findings WHERE {OPEN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) t
    LEFT JOIN projects p USING (project_id)""",
)
def agg5(spark, d):
    return A.top_projects(stored_findings(spark, d), projects(spark, d))


RES = "triage_state IN ('Fixed','Ignored','AutoIgnored')"


@query(
    "agg6_owasp_compliance",
    f"""SELECT *, CASE WHEN score >= 80 THEN 'pass' WHEN score >= 50 THEN 'warning' ELSE 'fail' END AS status FROM (
    SELECT *, floor(resolved / total * 1000 + 0.5) / 10 AS score FROM (
    SELECT owasp_category, count(*) AS total, count(*) FILTER (WHERE {RES}) AS resolved, count(*) FILTER (WHERE NOT {RES}) AS open,
    {sev("NOT " + RES)} FROM stored_findings WHERE owasp_category IS NOT NULL GROUP BY 1))""",
)
def agg6(spark, d):
    return A.owasp_compliance(stored_findings(spark, d))


@query(
    "agg7_by_language",
    """SELECT language, count(*) AS scans, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings
    FROM (SELECT scan_id, unnest(languages) AS language FROM scans)
    LEFT JOIN (SELECT scan_id, count(*) AS n FROM stored_findings GROUP BY 1) USING (scan_id) GROUP BY 1""",
)
def agg7(spark, d):
    return A.findings_by_language(scans(spark, d), stored_findings(spark, d))


@query(
    "agg8_mttr_hour_boundaries",
    """SELECT severity, avg(date_diff('hour', created_at, updated_at)) AS mttr_hours FROM stored_findings
    WHERE triage_state = 'Fixed' GROUP BY 1""",
)
def agg8(spark, d):
    return A.mttr_hour_boundaries(stored_findings(spark, d))


@query(
    "agg9_weekly_severity",
    "SELECT strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week, severity, count(*) AS findings FROM stored_findings GROUP BY ALL",
)
def agg9(spark, d):
    return A.weekly_severity(stored_findings(spark, d))


@query(
    "agg10_weekly_triage",
    """SELECT strftime(date_trunc('week', updated_at), '%Y-%m-%d') AS week, triage_state, count(*) AS triaged
    FROM stored_findings WHERE triage_state <> 'Open' GROUP BY ALL""",
)
def agg10(spark, d):
    return A.weekly_triage(stored_findings(spark, d))


@query(
    "agg11_open_by_repository",
    """SELECT repository, severity, count(*) AS open_findings FROM stored_findings JOIN scans USING (scan_id)
    WHERE triage_state = 'Open' AND severity IN ('Critical','High') GROUP BY ALL""",
)
def agg11(spark, d):
    return A.open_by_repository(stored_findings(spark, d), scans(spark, d))


@query(
    "agg12_daily_scans",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS scans, avg(duration_ms) AS avg_duration_ms,
    CAST(sum(files_scanned) AS BIGINT) AS files_scanned FROM scans GROUP BY 1""",
)
def agg12(spark, d):
    return A.daily_scans(scans(spark, d))


WEEK = ("1996-03-04 00:00:00", "1996-03-11 00:00:00")


@query(
    "agg13_weekly_digest",
    f"""SELECT f.*, s.*, t.* FROM (SELECT count(*) FILTER (WHERE created_at >= TIMESTAMP '{WEEK[0]}' AND created_at < TIMESTAMP '{WEEK[1]}') AS new_findings,
    count(*) FILTER (WHERE {OPEN} AND severity = 'Critical') AS critical_open, count(*) FILTER (WHERE {OPEN} AND severity = 'High') AS high_open,
    count(*) FILTER (WHERE triage_state IN ('Fixed','AutoFixed') AND updated_at >= TIMESTAMP '{WEEK[0]}' AND updated_at < TIMESTAMP '{WEEK[1]}') AS fixed FROM stored_findings) f,
    (SELECT count(*) AS scans FROM scans WHERE ts >= TIMESTAMP '{WEEK[0]}' AND ts < TIMESTAMP '{WEEK[1]}') s,
    (SELECT (SELECT project_id FROM stored_findings WHERE created_at >= TIMESTAMP '{WEEK[0]}' AND created_at < TIMESTAMP '{WEEK[1]}'
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_project) t""",
)
def agg13(spark, d):
    return A.weekly_digest(stored_findings(spark, d), scans(spark, d), *WEEK)


@query(
    "agg14_owasp_report",
    f"""SELECT c.code AS owasp_category, c.name AS category_name, count(f.finding_id) AS total,
    {", ".join(f"count(*) FILTER (WHERE f.severity = '{s}') AS {s.lower()}" for s in ("Critical", "High", "Medium", "Low", "Info"))}
    FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in A.OWASP.items())}) c(code, name) LEFT JOIN stored_findings f ON f.owasp_category = c.code GROUP BY ALL
    UNION ALL SELECT NULL, NULL, count(*), {sev()} FROM stored_findings WHERE owasp_category IS NULL HAVING count(*) > 0""",
)
def agg14(spark, d):
    return A.owasp_report(stored_findings(spark, d))


RANK = "CASE severity WHEN 'Critical' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 WHEN 'Info' THEN 1 END"


@query(
    "agg15_findings_of_categories",
    f"""SELECT owasp_category, position, finding_id FROM (SELECT owasp_category, finding_id,
    row_number() OVER (PARTITION BY owasp_category ORDER BY {RANK} DESC, file_path, line, finding_id) AS position
    FROM stored_findings WHERE owasp_category IS NOT NULL)""",
)
def agg15(spark, d):
    return A.findings_of_categories(stored_findings(spark, d))


@query("agg16_scan_summary", f"SELECT scan_id, count(*) AS total, {sev()} FROM stored_findings GROUP BY 1")
def agg16(spark, d):
    return A.scan_summary(stored_findings(spark, d))


@query(
    "agg17_baseline_trend",
    f"""SELECT snapshot_at, tag, count(*) AS total, {sev()} FROM (SELECT *, strftime(created_at, '%Y-%m') AS snapshot_at,
    CASE WHEN reachable THEN 'release' END AS tag FROM stored_findings) GROUP BY 1, 2""",
)
def agg17(spark, d):
    f = stored_findings(spark, d).select(
        "severity", F.date_format("created_at", "yyyy-MM").alias("snapshot_at"), F.when(F.col("reachable"), "release").alias("tag")
    )
    return A.baseline_trend(f)


@query(
    "agg18_scan_detail",
    f"""SELECT scan_id, count(*) AS total, count(*) FILTER (WHERE severity = 'Critical') AS critical,
    count(*) FILTER (WHERE severity = 'High') AS high FROM stored_findings GROUP BY 1""",
)
def agg18(spark, d):
    return A.scan_summary(stored_findings(spark, d)).select("scan_id", "total", "critical", "high")


def _cases(spark, d):
    """Line rules against lines: a case is expected to match where the line holds the rule's marker."""
    from . import scanning

    return scanning.rule_cases(spark, d)


_CASES = """SELECT r.rule_id, contains(line, r.marker) AS expected, regexp_matches(line, r.pattern) AS matched
  FROM src_lines, (VALUES ('SEC001', 'token', 'token = "([0-9a-f]{40})"'), ('PII003', '4', '[0-9]{16}'),
    ('LIC001', 'icensed', '(Released under|Licensed under|licensed under)')) r(rule_id, marker, pattern)"""
_Q = """SELECT rule_id, count(*) FILTER (WHERE expected AND matched) AS tp, count(*) FILTER (WHERE expected AND NOT matched) AS fn,
  count(*) FILTER (WHERE NOT expected AND matched) AS fp, count(*) FILTER (WHERE NOT expected AND NOT matched) AS tn FROM (""" + _CASES + ") GROUP BY 1"
_SHARES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS recall,
  CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS fp_rate"""


@query("agg19_rule_quality", f"SELECT *, {_SHARES}, tp + fn >= 3 AND fp + tn >= 3 AS enough_cases FROM ({_Q})")
def agg19(spark, d):
    return A.rule_quality(_cases(spark, d))


@query(
    "agg20_rules_quality",
    f"""SELECT *, {_SHARES} FROM (SELECT count(*) AS rules, count(*) FILTER (WHERE fn = 0 AND fp = 0) AS clean_rules,
    CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn FROM ({_Q}))""",
)
def agg20(spark, d):
    return A.rules_quality(A.rule_quality(_cases(spark, d)))


@query(
    "agg22_language_breakdown",
    r"""SELECT CASE WHEN e = '' THEN 'other' ELSE e END AS extension, count(*) AS files
    FROM (SELECT lower(regexp_extract(url, '[^/]\.([^./]+)$', 1)) AS e FROM pages) GROUP BY 1""",
)
def agg22(spark, d):
    return A.language_breakdown(read(spark, d, "pages").select(F.col("url").alias("file_path")))


@query(
    "agg24_usage_by_month",
    """SELECT org_id, strftime(ts, '%Y-%m') AS month, count(*) AS scans, CAST(sum(files_scanned) AS BIGINT) AS files,
    CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM scans GROUP BY ALL""",
)
def agg24(spark, d):
    return A.usage_by_month(scans(spark, d))


def _runs(spark, d, parity: int | None = None):
    """Runs by project of all scans, or of those on one of two sides that are compared."""
    s = scans(spark, d)
    if parity is not None:
        s = s.where(F.regexp_extract("scan_id", r"(\d+)", 1).cast("long") % 2 == parity)
    return s.groupBy(F.col("project_id").alias("run_id")).agg(
        F.sum("duration_ms").alias("wall_ms"), F.sum("files_scanned").alias("files"), F.count("*").alias("rules")
    )


def _runs_sql(parity: int | None = None) -> str:
    return f"""SELECT project_id AS run_id, CAST(sum(duration_ms) AS BIGINT) AS wall_ms, CAST(sum(files_scanned) AS BIGINT) AS files, count(*) AS rules
    FROM scans {"" if parity is None else f"WHERE CAST(substr(scan_id, 3) AS BIGINT) % 2 = {parity}"} GROUP BY 1"""


@query(
    "agg25_benchmark_metrics",
    f"SELECT *, files / (wall_ms / 1000) AS files_per_s, files * rules / (wall_ms / 1000) AS rules_per_s FROM ({_runs_sql()})",
)
def agg25(spark, d):
    return A.benchmark_metrics(_runs(spark, d))


@query(
    "agg26_benchmark_comparison",
    f"""SELECT run_id, (c.wall_ms - b.wall_ms) / b.wall_ms * 100 AS wall_ms_delta_pct, (c.files - b.files) / b.files * 100 AS files_delta_pct
    FROM ({_runs_sql(1)}) c JOIN ({_runs_sql(0)}) b USING (run_id)""",
)
def agg26(spark, d):
    return A.benchmark_comparison(_runs(spark, d, 0), _runs(spark, d, 1), "run_id", ["wall_ms", "files"])


@query(
    "agg27_pr_checks",
    """SELECT scan_id, count(*) AS findings, CASE WHEN count(*) FILTER (WHERE severity IN ('Critical','High')) > 0 THEN 'failed' ELSE 'passed' END AS status
    FROM stored_findings GROUP BY 1""",
)
def agg27(spark, d):
    return A.pr_checks(stored_findings(spark, d))


@query(
    "agg28_watch_summary",
    """SELECT count(*) FILTER (WHERE severity = 'Critical') AS critical, count(*) FILTER (WHERE severity = 'High') AS high,
    count(*) FILTER (WHERE severity = 'Medium') AS medium, count(*) FILTER (WHERE severity IN ('Low','Info')) AS low FROM stored_findings""",
)
def agg28(spark, d):
    return A.watch_summary(stored_findings(spark, d))


@query(
    "agg29_distinct_counts",
    "SELECT count(DISTINCT rule_id) AS rules, count(DISTINCT file_path) AS files, count(DISTINCT project_id) AS projects FROM stored_findings",
)
def agg29(spark, d):
    return A.distinct_counts(stored_findings(spark, d))


_SUBS = [("o-0", "pro", "active"), ("o-1", "enterprise", "active"), ("o-2", "pro", "past_due")]


@query(
    "agg30_plan_limit",
    f"""SELECT org_id, month, plan, findings_stored, project_count, CASE WHEN findings_stored + 400 > CASE plan WHEN 'free' THEN 500 WHEN 'pro' THEN 5000 END THEN 'findings'
      WHEN new_project AND project_count >= CASE plan WHEN 'free' THEN 1 WHEN 'pro' THEN 10 END THEN 'projects' END AS reason
    FROM (SELECT org_id, strftime(created_at, '%Y-%m') AS month, count(*) AS findings_stored, count(DISTINCT project_id) AS project_count, count(*) % 2 = 0 AS new_project FROM stored_findings GROUP BY ALL)
    JOIN (VALUES ('o-0', 'pro'), ('o-1', 'enterprise'), ('o-2', 'free'), ('o-3', 'free')) s(org_id, plan) USING (org_id)""",
)
def agg30(spark, d):
    usage = stored_findings(spark, d).groupBy("org_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("findings_stored"), F.countDistinct("project_id").alias("project_count")
    )
    usage = usage.withColumn("incoming", F.lit(400)).withColumn("new_project", F.col("findings_stored") % 2 == 0)
    return A.plan_limit(usage, spark.createDataFrame(_SUBS, "org_id string, plan string, status string")).drop("incoming", "new_project")


def _tree_cases(spark):
    from ..sources import trees

    return trees.self_tests(trees.default_tree_rules(spark))


@query(
    "agg19_rule_self_tests",
    f"SELECT rule_id, 3 AS tp, 0 AS fn, 0 AS fp, 3 AS tn, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 0.0::DOUBLE AS fp_rate, true AS enough_cases FROM (SELECT unnest({RULE_IDS}) AS rule_id)",
)
def agg19b(spark, d):
    """Every tree rule run on its own cases: all must hold."""
    return A.rule_quality(_tree_cases(spark))


@query("agg20_self_tests_together", f"SELECT {len(RULE_IDS)} AS rules, {len(RULE_IDS)} AS clean_rules, {3 * len(RULE_IDS)} AS tp, 0 AS fn, 0 AS fp, {3 * len(RULE_IDS)} AS tn, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 0.0::DOUBLE AS fp_rate")
def agg20b(spark, d):
    return A.rules_quality(A.rule_quality(_tree_cases(spark)))
