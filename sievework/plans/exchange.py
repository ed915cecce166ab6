"""Queries over report and export formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import sinks as K
from .standins import call_edges, code_files, deps, marked_lines, projects, scans, src_lines, stored_findings


@query("snk1_findings_json", "SELECT finding_id, rule_id, line FROM stored_findings")
def snk1(spark, d):
    out = K.findings_json(stored_findings(spark, d).select("finding_id", "rule_id", "line"))
    back = F.from_json("json", "findingId string, ruleId string, line int").alias("j")
    return out.select(back).select(F.col("j.findingId").alias("finding_id"), F.col("j.ruleId").alias("rule_id"), F.col("j.line").alias("line"))


@query(
    "snk2_sarif",
    """SELECT finding_id, rule_id, CASE WHEN severity IN ('Critical','High') THEN 'error' WHEN severity = 'Medium' THEN 'warning' ELSE 'note' END AS level, rule_index FROM stored_findings JOIN
    (SELECT rule_id, CAST(row_number() OVER (ORDER BY m, rule_id) - 1 AS INT) AS rule_index FROM (SELECT rule_id, min((file_path, line, finding_id)) AS m FROM stored_findings GROUP BY 1)) USING (rule_id)""",
)
def snk2(spark, d):
    out = K.sarif_results(stored_findings(spark, d))
    return out.select("finding_id", F.col("result.ruleId").alias("rule_id"), F.col("result.level").alias("level"), F.col("result.ruleIndex").alias("rule_index"))


@query(
    "snk3_diagnostics",
    """WITH l AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM src_lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
    SELECT concat(doc_id, ':', line_no) AS finding_id, concat('[HIGH] PII', chr(10), 'doc', doc_id, ':', line_no,
      CASE WHEN line_no > 1 THEN concat(chr(10), '  ', lpad(CAST(line_no - 1 AS VARCHAR), 4, ' '), ' | ', before) ELSE '' END, chr(10), '> ', lpad(CAST(line_no AS VARCHAR), 4, ' '), ' | ', line,
      CASE WHEN after IS NOT NULL THEN concat(chr(10), '  ', lpad(CAST(line_no + 1 AS VARCHAR), 4, ' '), ' | ', after) ELSE '' END) AS text FROM l WHERE contains(line, '@')
    UNION ALL SELECT concat('dep', dep_id), concat('[LOW] sca/X', chr(10), 'Dependency: ', package_name, ' | Ecosystem: ', ecosystem, ' | Source: ',
      CASE ecosystem WHEN 'npm' THEN 'package.json' WHEN 'PyPI' THEN 'requirements.txt' ELSE 'Cargo.toml' END, chr(10), version) FROM deps""",
)
def snk3(spark, d):
    lines = src_lines(spark, d).select(F.concat(F.lit("doc"), "doc_id").alias("file_path"), "line_no", "line", "doc_id")
    found = lines.where(F.contains("line", F.lit("@"))).select(
        F.concat_ws(":", "doc_id", "line_no").alias("finding_id"), "file_path", F.col("line_no").alias("line"), F.lit("High").alias("severity"), F.lit("PII").alias("rule_id"), F.lit("").alias("snippet")
    )
    path = F.concat(F.lit("<"), "ecosystem", F.lit("/"), "package_name", F.lit(">"))
    more = deps(spark, d).select(F.concat(F.lit("dep"), "dep_id").alias("finding_id"), path.alias("file_path"), F.lit(1).alias("line"), F.lit("Low").alias("severity"), F.lit("sca/X").alias("rule_id"), F.col("version").alias("snippet"))
    return K.diagnostics(found.unionByName(more), lines)


@query("snk7_export_rows", "SELECT finding_id, CAST(line AS VARCHAR) AS line, coalesce(owasp_category, '') AS owasp_category, '' AS assigned_to FROM stored_findings")
def snk7(spark, d):
    return K.export_rows(stored_findings(spark, d)).select("finding_id", "line", "owasp_category", "assigned_to")


@query(
    "snk8_schema_catalogue",
    "SELECT * FROM (VALUES ('findings', 17), ('scans', 9), ('projects', 8), ('dependencies', 4), ('lines', 4), ('calls', 2), ('files', 3), ('directives', 3)) t(table_name, columns)",
)
def snk8(spark, d):
    tables = {"findings": stored_findings, "scans": scans, "projects": projects, "dependencies": deps, "lines": src_lines, "calls": call_edges, "files": code_files, "directives": marked_lines}
    out = K.schema_catalogue({name: table(spark, d) for name, table in tables.items()})
    return out.groupBy("table_name").agg(F.count("*").alias("columns"))


@query("snk11_telemetry", "SELECT scan_id, rule_id, file_path, line, left(snippet, 100) AS snippet, severity FROM stored_findings WHERE severity IN ('Critical','High','Medium')")
def snk11(spark, d):
    return K.telemetry_payload(stored_findings(spark, d))


@query("snk14_webhooks", "SELECT * FROM (VALUES ('w1'), ('w4')) t(id)")
def snk14(spark, d):
    rows = [("w1", True, ["scan", "finding"]), ("w2", False, ["scan"]), ("w3", True, ["finding"]), ("w4", True, ["scan"]), ("w5", True, None)]
    return K.webhooks_for(spark.createDataFrame(rows, "id string, enabled boolean, events array<string>"), "scan").select("id")
