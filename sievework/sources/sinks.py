"""Report and export formats of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domain import c, sanitized_tag, severity_rank
from ..operators.ordering import snapshot_of
from ..operators.snapshots import Change, Layout, Store

#: SARIF levels of severities.
SARIF_LEVELS = {"Critical": "error", "High": "error", "Medium": "warning", "Low": "note", "Info": "note"}
#: Columns of the findings export, in order.
EXPORT = [
    "finding_id", "scan_id", "project_id", "org_id", "rule_id", "rule_name", "file_path", "line", "column_num", "snippet",
    "severity", "confidence_score", "reachable", "cloud_exposed", "cwe_id", "owasp_category", "fingerprint", "triage_state",
    "triage_note", "assigned_to", "created_at", "updated_at",
]


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


def findings_json(findings: DataFrame) -> DataFrame:
    """(json): one camel-case object per finding, for write.text."""
    return findings.select(F.to_json(F.struct(*[F.col(x).alias(camel(x)) for x in findings.columns])).alias("json"))


def sarif_level(severity: Column | str) -> Column:
    level = F.lit("note")
    for name, value in SARIF_LEVELS.items():
        level = F.when(c(severity) == name, value).otherwise(level)
    return level


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_id, rule_index) of the rules in the order in which the findings first name them."""
    first = findings.groupBy("rule_id").agg(F.min(F.struct("file_path", "line", "finding_id")).alias("at"))
    return first.select("rule_id", (F.row_number().over(Window.orderBy("at", "rule_id")) - 1).alias("rule_index"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result object per finding; ``sarif_log`` puts a bounded number of them into one document."""
    joined = findings.join(sarif_rules(findings), "rule_id")
    region = F.struct(F.col("line").alias("startLine"), F.col("column_num").alias("startColumn"))
    place = F.struct(
        F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        F.col("rule_index").alias("ruleIndex"),
        sarif_level("severity").alias("level"),
        F.struct(F.col("snippet").alias("text")).alias("message"),
        F.array(place).alias("locations"),
    )
    return joined.select("finding_id", result.alias("result"))


def sarif_log(findings: DataFrame, tool: str = "sievework") -> DataFrame:
    """One SARIF 2.1.0 document of one scan's findings; for whole corpora write sarif_results instead."""
    rules = sarif_rules(findings).agg(F.array_sort(F.collect_list(F.struct("rule_index", "rule_id"))).alias("r"))
    results = sarif_results(findings).agg(F.array_sort(F.collect_list(F.struct("finding_id", "result"))).alias("x"))
    driver = F.struct(
        F.lit(tool).alias("name"), F.transform("r", lambda r: F.struct(r["rule_id"].alias("id"))).alias("rules")
    )
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("x", lambda x: x["result"]).alias("results"))
    log = F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return rules.crossJoin(results).select(F.to_json(log).alias("json"))


#: The manifest that names the dependencies of an ecosystem.
MANIFESTS = {"npm": "package.json", "crates.io": "Cargo.toml", "cargo": "Cargo.toml", "PyPI": "requirements.txt", "pypi": "requirements.txt", "maven": "pom.xml"}


def diagnostics(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """(finding_id, text): severity, rule, place, and the finding's line between its neighbours, the line marked.

    lines (file_path, line_no, line). Dependencies, whose paths are no files, get package and manifest instead.
    """
    at = findings.where(~F.startswith("file_path", F.lit("<"))).select("finding_id", "file_path", "line", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("by"))
    body = at.select("finding_id", "file_path", "by", (F.col("line") + F.col("by")).alias("line_no")).join(lines.select("file_path", "line_no", F.col("line").alias("code")), ["file_path", "line_no"])
    shown = F.concat(F.when(F.col("by") == 0, "> ").otherwise("  "), F.lpad(F.col("line_no").cast("string"), 4, " "), F.lit(" | "), "code")
    body = body.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("line_no", shown.alias("s")))).alias("s"))
    block = F.concat(F.lit("\n"), F.array_join(F.transform("s", lambda x: x["s"]), "\n"))
    head = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "rule_id")
    inner = F.regexp_replace("file_path", "^<|>$", "")
    ecosystem, package = F.regexp_extract(inner, "^([^/]*)/", 1), F.regexp_replace(inner, "^[^/]*/", "")
    known = F.create_map(*[F.lit(x) for pair in MANIFESTS.items() for x in pair])
    manifest = F.coalesce(F.try_element_at(known, ecosystem), F.lit("manifest"))
    dependency = F.concat(head, F.lit("\nDependency: "), package, F.lit(" | Ecosystem: "), ecosystem, F.lit(" | Source: "), manifest, F.lit("\n"), "snippet")
    plain = F.concat(head, F.lit("\n"), "file_path", F.lit(":"), F.col("line").cast("string"), F.coalesce(block, F.lit("")))
    text = F.when(F.startswith("file_path", F.lit("<")), dependency).otherwise(plain)
    return findings.join(body, "finding_id", "left").select("finding_id", text.alias("text"))


def export_rows(findings: DataFrame) -> DataFrame:
    """The export's columns as text, absent and null ones empty, for write.csv(header, emptyValue='')."""
    have = set(findings.columns)
    return findings.select(*[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) if x in have else F.lit("").alias(x) for x in EXPORT])


def write_csv(findings: DataFrame, path: str) -> None:
    export_rows(findings).write.option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def schema_catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, type, nullable) of the exported tables."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string, nullable boolean")


def baseline_name(at: Column | str, tag: Column | str | None = None) -> Column:
    stamp = F.concat(F.date_format(c(at), "yyyyMMdd'T'HHmmss"), F.lit("Z"))
    return stamp if tag is None else F.concat(stamp, F.coalesce(F.concat(F.lit("_"), sanitized_tag(tag)), F.lit("")))


#: Baselines by name: a name's rows lie in a few buckets, which reading one baseline is limited to.
BASELINES = Layout(("name", "fingerprint"), groups=16, parts=4)


def save_baseline(store: Store, findings: DataFrame, at: str, tag: str | None = None) -> str:
    """Write findings (with fingerprint) as a baseline of a time, yyyy-MM-dd HH:mm:ss, and a tag; its name."""
    stamp = F.lit(at).cast("timestamp_ntz")
    (name,) = findings.sparkSession.range(1).select(baseline_name(stamp, None if tag is None else F.lit(tag))).first()
    store.commit({"baselines": Change(findings.withColumns({"name": F.lit(name), "saved_at": stamp, "tag": F.lit(tag).cast("string")}))})
    return name


def find_baseline(store: Store, wanted: str) -> str | None:
    """The name that a tag (the oldest of it) or the beginning of a time (the newest) means."""
    names = store.read("baselines").select(F.substring("name", 1, 16).alias("snapshot_at"), "tag", F.col("name").alias("snapshot_id")).distinct()
    return snapshot_of(names, wanted).first().snapshot_id


def load_baseline(store: Store, wanted: str) -> DataFrame:
    """The findings of the baseline that a tag or the beginning of a time means; none if there is none."""
    name = find_baseline(store, wanted)
    named = store.spark.createDataFrame([(name or "",)], "name string")
    return store.read("baselines", buckets=store.layouts["baselines"].all_of(named)).where(F.col("name") == name).drop("name", "saved_at", "tag")


def telemetry_payload(findings: DataFrame) -> DataFrame:
    """What is published: Medium and above, no synthetic paths, short snippets."""
    rows = findings.where((severity_rank("severity") >= 3) & ~F.startswith("file_path", F.lit("<")))
    return rows.select("scan_id", "rule_id", "file_path", "line", F.substring("snippet", 1, 100).alias("snippet"), "severity")


def published_severity(severity: Column | str) -> Column:
    """Info is published as Low."""
    return F.when(c(severity) == "Info", "Low").otherwise(c(severity))


def webhooks_for(webhooks: DataFrame, event: str) -> DataFrame:
    return webhooks.where(F.col("enabled") & F.array_contains("events", event))


def owasp_markdown(report: DataFrame) -> str:
    """Markdown of the ten-row report."""
    rows = report.where("owasp_category is not null").orderBy("owasp_category").collect()
    head = "| Category | Name | Total | Critical | High | Medium | Low | Info |\n|---|---|---|---|---|---|---|---|\n"
    return head + "".join(
        f"| {r.owasp_category} | {r.category_name} | {r.total} | {r.critical} | {r.high} | {r.medium} | {r.low} | {r.info} |\n" for r in rows
    )
