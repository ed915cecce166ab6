"""Enriching joins of findings, scans, functions and services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import last_mark


def enclosing_function(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """As-of join: the last function of the file that starts on or before the finding's line, or null.

    findings (finding_id, file_path, line), functions (file_path, name, def_line). Files are cut by line, so one
    that holds half of all findings is spread over tasks. Equal lines go to the smallest name.
    """
    defs = functions.groupBy("file_path", "def_line").agg(F.min("name").alias("name"))
    found = last_mark(findings.select("finding_id", "file_path", "line"), defs.select("file_path", "name", "def_line"), ["file_path"], "line", "def_line")
    return found.select("finding_id", "file_path", "line", "mark.name", "mark.def_line")


def resolve_callees(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Each call (call_id, file_path, callee) with the function it names: in its file first, else the first one anywhere."""
    defs = functions.select(F.col("name").alias("callee"), F.col("file_path").alias("def_path"), "def_line")
    local = defs.groupBy("callee", "def_path").agg(F.min("def_line").alias("local_line"))
    anywhere = defs.groupBy("callee").agg(F.min(F.struct("def_path", "def_line")).alias("any"))
    out = calls.join(local, (calls.callee == local.callee) & (calls.file_path == local.def_path), "left").select(
        calls["*"], "local_line"
    )
    out = out.join(anywhere, "callee", "left")
    path = F.when(F.col("local_line").isNotNull(), F.col("file_path")).otherwise(F.col("any.def_path"))
    return out.select("call_id", "file_path", "callee", path.alias("def_path"), F.coalesce("local_line", "any.def_line").alias("def_line"))


def exposure_map(k8s: DataFrame, cloud: DataFrame) -> DataFrame:
    """(service, public) from services (name, public) of both sources: public in any of them wins."""
    names = k8s.select("name", "public").unionByName(cloud.select("name", "public"))
    return names.groupBy(F.lower("name").alias("service")).agg(F.bool_or("public").alias("public"))


def with_exposure(files: DataFrame, exposure: DataFrame) -> DataFrame:
    """Files (.., service) with ``public`` of the service of exactly that name, null if unknown."""
    return files.join(exposure, "service", "left")


def match_contexts(services: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each service with the first context whose name contains it or is contained in it.

    The contexts are the small side of a nested-loop join; equality of trigrams cannot replace it, as names
    may be shorter. The first context is the one with the smallest (length, name).
    """
    a, b = F.lower("service"), F.lower("context")
    hit = F.contains(a, b) | F.contains(b, a)
    found = services.join(contexts, hit, "left")
    first = F.min(F.when(F.col("context").isNotNull(), F.struct(F.char_length("context").alias("n"), "context")))
    return found.groupBy("service").agg(first.alias("m")).select("service", F.col("m.context").alias("context"))


def with_rule_names(findings: DataFrame, rules: DataFrame) -> DataFrame:
    named = findings.join(rules.select("rule_id", "name"), "rule_id", "left")
    return named.withColumn("rule_name", F.coalesce("name", "rule_id")).drop("name")


def scan_listing(scans: DataFrame, findings: DataFrame, projects: DataFrame, orgs: DataFrame) -> DataFrame:
    """Scans with their number of findings and the names of project and organisation."""
    n = findings.groupBy("scan_id").agg(F.count("*").alias("n"))
    p = projects.select("project_id", F.col("name").alias("project_name"))
    o = orgs.select("org_id", F.col("name").alias("org_name"))
    out = scans.join(n, "scan_id", "left").join(p, "project_id", "left").join(o, "org_id", "left")
    return out.select(
        "scan_id",
        F.coalesce("n", F.lit(0)).alias("findings"),
        F.coalesce("project_name", F.lit("Unknown")).alias("project_name"),
        F.coalesce("org_name", F.lit("Unknown")).alias("org_name"),
    )


def check_details(checks: DataFrame, findings: DataFrame) -> DataFrame:
    """Pull-request checks with all findings of their scan nested in order of id; a scan's number is bounded on ingest."""
    nested = findings.join(checks.select("scan_id"), "scan_id", "left_semi").groupBy("scan_id").agg(
        F.array_sort(F.collect_list(F.struct("finding_id", "rule_id", "severity"))).alias("findings")
    )
    empty = F.array().cast("array<struct<finding_id:string,rule_id:string,severity:string>>")
    return checks.join(nested, "scan_id", "left").withColumn("findings", F.coalesce("findings", empty))


def upsert_sides(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """(key, side): of every key of either table, new, known or absent from what came in."""
    a = incoming.select(*key).distinct().withColumn("__sw_in", F.lit(True))
    b = stored.select(*key).distinct().withColumn("__sw_was", F.lit(True))
    side = F.when(F.col("__sw_was").isNull(), "new").when(F.col("__sw_in").isNull(), "absent").otherwise("known")
    return a.join(b, key, "full_outer").select(*key, side.alias("side"))


def memberships(members: DataFrame, orgs: DataFrame, users: DataFrame) -> DataFrame:
    """Memberships of organisations that exist, with the user's name or else the id."""
    out = members.join(orgs.select("org_id", F.col("name").alias("org_name")), "org_id")
    out = out.join(users.select("user_id", F.col("name").alias("user_name")), "user_id", "left")
    return out.withColumn("user_name", F.coalesce("user_name", "user_id"))


def days_since_scan(orgs: DataFrame, scans: DataFrame, today: str) -> DataFrame:
    """Organisations with their latest scan and the days since."""
    last = scans.groupBy("org_id").agg(F.max("ts").alias("last_scan"))
    return orgs.join(last, "org_id", "left").select(
        "org_id", "last_scan", F.datediff(F.lit(today).cast("date"), F.col("last_scan")).cast("long").alias("days_since")
    )


def fix_templates(findings: DataFrame, templates: DataFrame) -> DataFrame:
    """(finding_id, template): by rule id, else by the digits of the CWE."""
    by_rule = templates.where("rule_id is not null").groupBy("rule_id").agg(F.min("template").alias("t1"))
    by_cwe = templates.where("cwe is not null").groupBy("cwe").agg(F.min("template").alias("t2"))
    digits = F.regexp_extract("cwe_id", r"(\d+)", 1)
    out = findings.join(by_rule, "rule_id", "left").join(by_cwe, digits == F.col("cwe"), "left")
    return out.select("finding_id", F.coalesce("t1", "t2").alias("template"))
