"""Dashboard metrics over findings and scans. Every metric is one combinable aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import FIXED_STATES, IGNORED_STATES, OWASP, SEVERITIES, is_open

STATE, SEV = "triage_state", "severity"


def severity_counts(where: Column | None = None, prefix: str = "") -> list[Column]:
    """One count per severity, most severe first, over the rows that ``where`` holds for."""
    cond = F.lit(True) if where is None else where
    return [F.count_if(cond & (F.col(SEV) == s)).alias(f"{prefix}{s.lower()}") for s in reversed(SEVERITIES)]


def js_round(x: Column) -> Column:
    """Half up, for values that are not negative."""
    return F.floor(x + 0.5).cast("long")


def overview(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Production definition: totals and severities count open findings only."""
    f = findings.agg(
        F.count_if(is_open(STATE)).alias("total_findings"),
        F.count_if(is_open(STATE)).alias("open_findings"),
        F.count_if(F.col(STATE).isin(FIXED_STATES)).alias("fixed_findings"),
        F.count_if(F.col(STATE).isin(IGNORED_STATES)).alias("ignored_findings"),
        *severity_counts(is_open(STATE)),
    )
    s = scans.agg(
        F.count("*").alias("total_scans"),
        F.coalesce(js_round(F.avg("duration_ms")), F.lit(0)).alias("avg_scan_duration_ms"),
    )
    return f.crossJoin(s)


def overview_all(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Test-store definition: totals and severities count all findings, AutoFixed is open, mean is cut."""
    f = findings.agg(
        F.count("*").alias("total_findings"),
        F.count_if(~F.col(STATE).isin("Fixed", *IGNORED_STATES)).alias("open_findings"),
        F.count_if(F.col(STATE) == "Fixed").alias("fixed_findings"),
        F.count_if(F.col(STATE).isin(IGNORED_STATES)).alias("ignored_findings"),
        *severity_counts(),
    )
    s = scans.agg(
        F.count("*").alias("total_scans"),
        F.expr("coalesce(sum(duration_ms) div count(*), 0)").alias("avg_scan_duration_ms"),
    )
    return f.crossJoin(s)


def trends(findings: DataFrame, fixed_states: tuple[str, ...] = ("Fixed",)) -> DataFrame:
    """Per creation day: new, still open, fixed."""
    return findings.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("new_findings"),
        F.count_if(is_open(STATE)).alias("open_findings"),
        F.count_if(F.col(STATE).isin(*fixed_states)).alias("fixed_findings"),
    )


def hours_open() -> Column:
    micros = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    return (micros("updated_at") - micros("created_at")) / 3.6e9


def mttr(findings: DataFrame) -> DataFrame:
    """(severity, fixed, mttr_hours) of Fixed findings, and a row 'all'."""
    fixed = findings.where(F.col(STATE) == "Fixed").withColumn("__sw_h", hours_open())
    per = fixed.rollup(SEV).agg(F.count("*").alias("fixed"), F.avg("__sw_h").alias("mttr_hours"), F.grouping(SEV).alias("g"))
    return per.select(F.when(F.col("g") == 1, "all").otherwise(F.col(SEV)).alias(SEV), "fixed", "mttr_hours")


def top_projects(findings: DataFrame, projects: DataFrame, k: int = 10) -> DataFrame:
    """The k projects with most open findings, with names; ties fall to the smaller id."""
    top = (
        findings.where(is_open(STATE))
        .groupBy("project_id")
        .agg(F.count("*").alias("open_findings"), *severity_counts())
        .orderBy(F.desc("open_findings"), "project_id")
        .limit(k)
    )
    named = projects.select("project_id", "name", "repository_url")
    return top.join(named, "project_id", "left").select(
        "project_id",
        F.coalesce("name", F.lit("Unknown")).alias("name"),
        F.coalesce("repository_url", F.lit("")).alias("repository_url"),
        "open_findings",
        *[s.lower() for s in reversed(SEVERITIES)],
    )


def owasp_compliance(findings: DataFrame) -> DataFrame:
    """Per category: totals, resolved share in percent with one decimal, and a verdict."""
    resolved = F.col(STATE).isin("Fixed", *IGNORED_STATES)
    per = (
        findings.where("owasp_category is not null")
        .groupBy("owasp_category")
        .agg(
            F.count("*").alias("total"),
            F.count_if(resolved).alias("resolved"),
            F.count_if(~resolved).alias("open"),
            *severity_counts(~resolved),
        )
    )
    score = js_round(F.col("resolved") / F.col("total") * 1000) / 10
    return per.withColumn("score", score).withColumn(
        "status", F.when(F.col("score") >= 80, "pass").when(F.col("score") >= 50, "warning").otherwise("fail")
    )


def findings_by_language(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Per language: scans that list it and all their findings; a scan counts in full for each language."""
    per = findings.groupBy("scan_id").agg(F.count("*").alias("n"))
    listed = scans.select("scan_id", F.explode("languages").alias("language"))
    return listed.join(per, "scan_id", "left").groupBy("language").agg(
        F.count("*").alias("scans"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings")
    )


def mttr_hour_boundaries(findings: DataFrame) -> DataFrame:
    """BI definition: crossed hour boundaries, by severity."""
    hour = lambda x: F.unix_timestamp(F.date_trunc("hour", F.col(x).cast("timestamp")))
    return (
        findings.where(F.col(STATE) == "Fixed")
        .groupBy(SEV)
        .agg(F.avg((hour("updated_at") - hour("created_at")) / 3600).alias("mttr_hours"))
    )


def weekly_severity(findings: DataFrame) -> DataFrame:
    week = F.date_format(F.date_trunc("week", "created_at"), "yyyy-MM-dd").alias("week")
    return findings.groupBy(week, SEV).agg(F.count("*").alias("findings"))


def weekly_triage(findings: DataFrame) -> DataFrame:
    """Per week of the last change: findings per triage state other than Open."""
    week = F.date_format(F.date_trunc("week", "updated_at"), "yyyy-MM-dd").alias("week")
    return findings.where(F.col(STATE) != "Open").groupBy(week, STATE).agg(F.count("*").alias("triaged"))


def open_by_repository(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Open critical and high findings per repository and severity."""
    open_rows = findings.where((F.col(STATE) == "Open") & F.col(SEV).isin("Critical", "High"))
    return (
        open_rows.select("scan_id", SEV)
        .join(scans.select("scan_id", "repository"), "scan_id")
        .groupBy("repository", SEV)
        .agg(F.count("*").alias("open_findings"))
    )


def daily_scans(scans: DataFrame) -> DataFrame:
    return scans.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("scans"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.sum("files_scanned").alias("files_scanned"),
    )


def weekly_digest(findings: DataFrame, scans: DataFrame, since: str, until: str) -> DataFrame:
    """One row for the half-open interval: what is new, open, fixed, and the project with most new findings."""
    inside = lambda x: (F.col(x) >= F.lit(since).cast("timestamp_ntz")) & (F.col(x) < F.lit(until).cast("timestamp_ntz"))
    f = findings.agg(
        F.count_if(inside("created_at")).alias("new_findings"),
        F.count_if(is_open(STATE) & (F.col(SEV) == "Critical")).alias("critical_open"),
        F.count_if(is_open(STATE) & (F.col(SEV) == "High")).alias("high_open"),
        F.count_if(F.col(STATE).isin(FIXED_STATES) & inside("updated_at")).alias("fixed"),
    )
    s = scans.where(inside("ts")).agg(F.count("*").alias("scans"))
    per = findings.where(inside("created_at")).groupBy("project_id").agg(F.count("*").alias("n"))
    top = per.agg(F.min(F.struct(-F.col("n"), "project_id")).alias("best")).select(F.col("best.project_id").alias("top_project"))
    return f.crossJoin(s).crossJoin(top)


def owasp_report(findings: DataFrame) -> DataFrame:
    """All ten categories, with zeros, and a row for findings without one (category null)."""
    spark = findings.sparkSession
    names = spark.createDataFrame(list(OWASP.items()), "owasp_category string, category_name string")
    per = findings.groupBy("owasp_category").agg(F.count("*").alias("total"), *severity_counts())
    cols = ["total", *[s.lower() for s in reversed(SEVERITIES)]]
    counted = names.join(per, "owasp_category", "left").select(
        "owasp_category", "category_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in cols]
    )
    rest = per.where("owasp_category is null").select("owasp_category", F.lit(None).cast("string").alias("category_name"), *cols)
    return counted.union(rest)


def findings_of_categories(findings: DataFrame) -> DataFrame:
    """(owasp_category, position, finding_id): the findings of each category, severest first.

    Positions come from ranges of the order, so that a category of any size never gathers in one task.
    """
    from ..functions.domain import severity_rank
    from .ordering import positions

    rows = findings.where("owasp_category is not null").select("owasp_category", "finding_id", severity_rank(SEV).alias("r"), "file_path", "line")
    order = [F.desc("r"), F.col("file_path"), F.col("line"), F.col("finding_id")]
    return positions(rows, ["owasp_category"], order).select("owasp_category", "position", "finding_id")


def scan_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id").agg(F.count("*").alias("total"), *severity_counts())


def baseline_trend(snapshots: DataFrame) -> DataFrame:
    """Per snapshot (snapshot_at, tag): totals by severity, in time order."""
    return snapshots.groupBy("snapshot_at", "tag").agg(F.count("*").alias("total"), *severity_counts()).orderBy("snapshot_at", "tag")


def rule_quality(cases: DataFrame, least: int = 3) -> DataFrame:
    """Per rule, from (rule_id, expected, matched): precision, recall, false-positive rate, enough cases."""
    pos, hit = F.col("expected"), F.col("matched")
    per = cases.groupBy("rule_id").agg(
        F.count_if(pos & hit).alias("tp"),
        F.count_if(pos & ~hit).alias("fn"),
        F.count_if(~pos & hit).alias("fp"),
        F.count_if(~pos & ~hit).alias("tn"),
    )
    share = lambda a, b, z: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(z))
    return per.select(
        "*",
        share("tp", "fp", 1.0).alias("precision"),
        share("tp", "fn", 1.0).alias("recall"),
        share("fp", "tn", 0.0).alias("fp_rate"),
        ((F.col("tp") + F.col("fn") >= least) & (F.col("fp") + F.col("tn") >= least)).alias("enough_cases"),
    )


def rules_quality(per_rule: DataFrame) -> DataFrame:
    """One row over all rules."""
    total = per_rule.agg(
        F.count("*").alias("rules"),
        F.count_if((F.col("fn") == 0) & (F.col("fp") == 0)).alias("clean_rules"),
        *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fn", "fp", "tn")],
    )
    share = lambda a, b, z: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(z))
    return total.select("*", share("tp", "fp", 1.0).alias("precision"), share("tp", "fn", 1.0).alias("recall"), share("fp", "tn", 0.0).alias("fp_rate"))


def language_breakdown(files: DataFrame) -> DataFrame:
    """Files by lower-case extension, 'other' without one."""
    ext = F.lower(F.regexp_extract("file_path", r"[^/]\.([^./]+)$", 1))
    return files.groupBy(F.when(ext == "", "other").otherwise(ext).alias("extension")).agg(F.count("*").alias("files"))


def usage_by_month(scans: DataFrame) -> DataFrame:
    return scans.groupBy("org_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("scans"), F.sum("files_scanned").alias("files"), F.sum("duration_ms").alias("duration_ms")
    )


def benchmark_metrics(runs: DataFrame) -> DataFrame:
    """Throughput of timing rows (run_id, wall_ms, files, rules)."""
    seconds = F.col("wall_ms") / 1000
    return runs.select(
        "*",
        F.coalesce(F.try_divide(F.col("files"), seconds), F.lit(0.0)).alias("files_per_s"),
        F.coalesce(F.try_divide(F.col("files") * F.col("rules"), seconds), F.lit(0.0)).alias("rules_per_s"),
    )


def benchmark_comparison(base: DataFrame, current: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Change of each metric in percent, 0 where the baseline is 0."""
    b = base.select(key, *[F.col(m).alias(f"__sw_{m}") for m in metrics])
    delta = lambda m: F.when(F.col(f"__sw_{m}") > 0, (F.col(m) - F.col(f"__sw_{m}")) / F.col(f"__sw_{m}") * 100).otherwise(0.0)
    return current.join(b, key).select(key, *[delta(m).alias(f"{m}_delta_pct") for m in metrics])


def pr_checks(findings: DataFrame) -> DataFrame:
    """Per scan: failed if anything is critical or high, else passed."""
    worst = F.count_if(F.col(SEV).isin("Critical", "High"))
    return findings.groupBy("scan_id").agg(
        F.count("*").alias("findings"), F.when(worst > 0, "failed").otherwise("passed").alias("status")
    )


def watch_summary(findings: DataFrame) -> DataFrame:
    """Counts with Info folded into Low."""
    return findings.agg(
        F.count_if(F.col(SEV) == "Critical").alias("critical"),
        F.count_if(F.col(SEV) == "High").alias("high"),
        F.count_if(F.col(SEV) == "Medium").alias("medium"),
        F.count_if(F.col(SEV).isin("Low", "Info")).alias("low"),
    )


def distinct_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.countDistinct("rule_id").alias("rules"),
        F.countDistinct("file_path").alias("files"),
        F.countDistinct("project_id").alias("projects"),
    )


#: Fixed values: (projects, findings) of each plan; null is unlimited.
PLAN_LIMITS = {"free": (1, 500), "pro": (10, 5000), "team": (None, None), "enterprise": (None, None)}


def plan_limit(usage: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """usage plus plan and reason: what an incoming payload would go over, findings before projects, or null.

    usage (org_id, findings_stored, project_count, incoming, new_project); subscriptions (org_id, plan, status), of
    which none and one past due count as free.
    """
    limits = usage.sparkSession.createDataFrame([(p, *n) for p, n in PLAN_LIMITS.items()], "plan string, most_projects int, most_findings int")
    own = subscriptions.select("org_id", F.when(F.col("status") == "past_due", "free").otherwise(F.col("plan")).alias("plan"))
    joined = usage.join(own, "org_id", "left").withColumn("plan", F.coalesce("plan", F.lit("free"))).join(F.broadcast(limits), "plan", "left")
    reason = F.when(F.col("findings_stored") + F.col("incoming") > F.col("most_findings"), "findings").when(
        F.col("new_project") & (F.col("project_count") >= F.col("most_projects")), "projects"
    )
    return joined.select(*usage.columns, "plan", reason.alias("reason"))
