"""Smaller queries of the inventory: single functions and lookups on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domain as D
from ..operators import filters as L
from ..operators import scoring as S
from ..registry import query
from ..sources import advisories as A
from ..sources import files as X
from ..sources import sinks as K
from .standins import deps, projects, read, scans, src_lines, stored_findings


@query("fil20_active_releases", "SELECT event_type AS platform, max(event_id) AS version FROM events GROUP BY 1")
def fil20(spark, d):
    from ..operators.mutations import publish_release

    rows = read(spark, d, "events").select(F.col("event_type").alias("platform"), F.col("event_id").alias("version"), F.col("event_id").alias("published_at"))
    return publish_release(rows).where("active").select("platform", "version")


@query("fil20_release_by_version", "SELECT event_type AS platform, event_id AS version FROM events WHERE event_id = 7")
def fil20b(spark, d):
    return read(spark, d, "events").where("event_id = 7").select(F.col("event_type").alias("platform"), F.col("event_id").alias("version"))


@query("fil18_autofix_of_org", "SELECT finding_id, created_at FROM stored_findings WHERE org_id = 'o-2' AND triage_state = 'ToFix' ORDER BY created_at DESC, finding_id")
def fil18b(spark, d):
    rows = stored_findings(spark, d).where("org_id = 'o-2' and triage_state = 'ToFix'").select("finding_id", "created_at")
    return rows.orderBy(F.desc("created_at"), "finding_id")


@query("fil21_projects_of_org", "SELECT project_id, name FROM projects WHERE org_id = 'o-1'")
def fil21c(spark, d):
    return projects(spark, d).where("org_id = 'o-1'").select("project_id", "name")


@query("fil25_role_levels", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS level FROM customer")
def fil25b(spark, d):
    k = F.col("c_custkey") % 4
    role = F.when(k == 0, "admin").when(k == 1, "manager").when(k == 2, "developer").otherwise("owner")
    return read(spark, d, "customer").select("c_custkey", L.role_level(role).cast("int").alias("level"))


_LANGS = "('JavaScript', 'JS001'), ('Python', 'PY001'), ('Go', 'GO001')"
_EVERY = "('SEC001'), ('PII001'), ('PII002'), ('PII003'), ('LIC001')"


@query(
    "joi1_rules_of_files",
    f"""SELECT f.k, r.rule_id FROM (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'JavaScript' WHEN 1 THEN 'Python' WHEN 2 THEN 'Go' ELSE 'Rust' END AS language FROM part) f
    JOIN (SELECT language, rule_id FROM (VALUES {_LANGS}) a(language, rule_id)) r USING (language)
    UNION ALL SELECT p_partkey, rule_id FROM part, (VALUES {_EVERY}) b(rule_id)""",
)
def joi1(spark, d):
    """Files with the rules of their language and those of every language; the rules are the broadcast side."""
    k = F.col("p_partkey")
    language = F.when(k % 4 == 0, "JavaScript").when(k % 4 == 1, "Python").when(k % 4 == 2, "Go").otherwise("Rust")
    files = read(spark, d, "part").select(k.alias("k"), language.alias("file_language"))
    rules = X.default_rules(spark).select("rule_id", "language")
    return files.join(F.broadcast(rules), F.col("language").isNull() | (F.col("language") == F.col("file_language"))).select("k", "rule_id")


@query("str6_osv_ranges", "SELECT * FROM (VALUES (1, '>=1.0.0, <2.0.0'), (2, '<=1.5.0|<2.0.0'), (3, ''), (4, '>=3.0.0')) t(k, ranges)")
def str6(spark, d):
    rows = [
        (1, [("SEMVER", [("1.0.0", None, None), (None, "2.0.0", None)])]),
        (2, [("ECOSYSTEM", [("0", None, None), (None, None, "1.5.0"), (None, "2.0.0", None)])]),
        (3, [("GIT", [("1.0.0", None, None)]), ("SEMVER", [("0", None, None)])]),
        (4, [("SEMVER", [("3.0.0", None, None)]), ("SEMVER", [("3.0.0", None, None)])]),
    ]
    kind = "k int, r array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>"
    return spark.createDataFrame(rows, kind).select("k", F.array_join(A.range_strings(F.col("r")), "|").alias("ranges"))


@query("str9_sanitized_tag", "SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}_-]', '-', 'g') AS tag FROM pages")
def str9(spark, d):
    return read(spark, d, "pages").select("page_id", D.sanitized_tag("url").alias("tag"))


@query(
    "str12_context_hash",
    """SELECT doc_id, line_no, sha256(concat('ctx|', lower(regexp_replace(line, '[ \\t\\n\\v\\f\\r]+', '', 'g')))) AS h, trim(regexp_replace(line, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS k FROM src_lines""",
)
def str12(spark, d):
    return src_lines(spark, d).select("doc_id", "line_no", D.context_hash(F.lit("ctx"), "line").alias("h"), D.memory_key("line").alias("k"))


@query("dat1_stale_feeds", "SELECT scan_id FROM scans WHERE ts <= TIMESTAMP '1995-06-01 00:00:00' - INTERVAL 24 HOUR")
def dat1(spark, d):
    rows = scans(spark, d).select("scan_id", F.col("ts").alias("last_synced_at"))
    return A.stale(rows, F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")).select("scan_id")


@query("dat1_windows", "SELECT scan_id, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(ts, '%Y-%m') AS month FROM scans")
def dat1b(spark, d):
    fmt = lambda c, f: F.date_format(c, f)
    return scans(spark, d).select("scan_id", fmt("ts", "yyyy-MM-dd").alias("day"), fmt(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"), fmt("ts", "yyyy-MM").alias("month"))


@query("arr1_languages", "SELECT scan_id, list_contains(languages, 'go') AS has_go, array_to_string(list_slice(languages, 1, 2), ',') AS two, len(languages) AS n FROM scans")
def arr1(spark, d):
    rows = scans(spark, d)
    return rows.select("scan_id", F.array_contains("languages", "go").alias("has_go"), F.array_join(F.slice("languages", 1, 2), ",").alias("two"), F.size("languages").cast("long").alias("n"))


@query("sco2_reach", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 1.0 WHEN p_partkey % 2 = 0 THEN 0.8 ELSE 0.2 END::DOUBLE AS score FROM part")
def sco2(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("k"), S.reach_score(k % 2 == 0, k % 3 == 0).alias("score"))


@query(
    "sco3_pattern",
    "SELECT k, least(0.3 + 0.1 * least(k % 8, 5) + CASE WHEN k % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 0.15 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 0.1 ELSE 0 END, 1)::DOUBLE AS score FROM (SELECT p_partkey AS k FROM part)",
)
def sco3(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("k"), S.pattern_score(k % 8, k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("score"))


@query(
    "sco4_context",
    "SELECT k, greatest(1 - CASE WHEN k % 2 = 0 THEN 0.4 ELSE 0 END - CASE WHEN k % 3 = 0 THEN 0.3 ELSE 0 END - CASE WHEN k % 5 = 0 THEN 0.3 ELSE 0 END - CASE WHEN k % 7 = 0 THEN 0.5 ELSE 0 END, 0)::DOUBLE AS score FROM (SELECT p_partkey AS k FROM part)",
)
def sco4(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select(k.alias("k"), S.context_score(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0).alias("score"))


@query(
    "mut8_watch_delta",
    """WITH b AS (SELECT DISTINCT file_path, rule_id, line FROM stored_findings WHERE column_num % 2 = 0), a AS (SELECT DISTINCT file_path, rule_id, line FROM stored_findings WHERE column_num % 3 = 0)
    SELECT file_path, rule_id, line, 'new' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT file_path, rule_id, line, 'resolved' FROM (FROM b EXCEPT FROM a)""",
)
def mut8(spark, d):
    """The watch delta of two whole states; the streaming form keeps the state per file."""
    key = ["file_path", "rule_id", "line"]
    rows = stored_findings(spark, d)
    old, new = rows.where("column_num % 2 = 0").select(*key).distinct(), rows.where("column_num % 3 = 0").select(*key).distinct()
    return new.join(old, key, "left_anti").withColumn("change", F.lit("new")).union(old.join(new, key, "left_anti").withColumn("change", F.lit("resolved")))


_OWASP_NAMES = ", ".join(f"('{k}', '{v}')" for k, v in D.OWASP.items())


@query(
    "snk6_owasp_json",
    f"""SELECT c.code AS owasp_category, c.name AS category_name, count(f.finding_id) AS total, count(*) FILTER (WHERE severity = 'Critical') AS critical, count(*) FILTER (WHERE severity = 'High') AS high,
    count(*) FILTER (WHERE severity = 'Medium') AS medium, count(*) FILTER (WHERE severity = 'Low') AS low, count(*) FILTER (WHERE severity = 'Info') AS info
    FROM (VALUES {_OWASP_NAMES}, (NULL, NULL)) c(code, name) LEFT JOIN stored_findings f ON f.owasp_category IS NOT DISTINCT FROM c.code GROUP BY 1, 2""",
)
def snk6(spark, d):
    """The whole report written as JSON files, and read back."""
    from ..operators.analytics import owasp_report
    from ..scratch import scratch_path

    report, path = owasp_report(stored_findings(spark, d)), scratch_path(spark, "owasp-report")
    report.write.json(path)
    return spark.read.schema(report.schema).json(path)


@query("snk11_published_severity", "SELECT finding_id, CASE WHEN severity = 'Info' THEN 'Low' ELSE severity END AS severity FROM stored_findings")
def snk11b(spark, d):
    return stored_findings(spark, d).select("finding_id", K.published_severity("severity").alias("severity"))


@query("src24_indexed_read", "SELECT finding_id, rule_id FROM stored_findings WHERE org_id = 'o-3' AND severity = 'High'")
def src24(spark, d):
    """From a table by organisation, whose other organisations' files are not read."""
    from ..sources.layout import write_findings

    table = write_findings(stored_findings(spark, d))
    return table.where("org_id = 'o-3' and severity = 'High'").select("finding_id", "rule_id")


@query(
    "src24_by_ids",
    """SELECT finding_id, org_id, rule_id, file_path FROM stored_findings WHERE finding_id IN (SELECT max(finding_id) FROM stored_findings WHERE severity = 'High' UNION ALL SELECT min(finding_id) FROM stored_findings WHERE severity = 'Low')""",
)
def src24_ids(spark, d):
    """Findings by their ids from a table in buckets of ids: one bucket each is read."""
    from ..sources.layout import by_ids, write_findings

    table = write_findings(stored_findings(spark, d))
    ends = table.agg(F.max(F.when(F.col("severity") == "High", F.col("finding_id"))).alias("a"), F.min(F.when(F.col("severity") == "Low", F.col("finding_id"))).alias("b")).first()
    return by_ids(table, [x for x in ends if x is not None]).select("finding_id", "org_id", "rule_id", "file_path")


@query(
    "snk9_saved_baselines",
    """WITH f AS (SELECT finding_id, sha256(concat(rule_id, file_path, sha256(snippet))) AS fingerprint, column_num, severity FROM stored_findings)
    SELECT 'v1' AS wanted, finding_id, severity FROM f WHERE column_num = 1 UNION ALL SELECT '20240202', finding_id, severity FROM f WHERE column_num = 3 UNION ALL SELECT 'v/2', finding_id, severity FROM f WHERE column_num = 2""",
)
def snk9_saved(spark, d):
    """Three baselines that are written, found by tag or by the beginning of their time, and read."""
    from ..operators.snapshots import Store
    from ..scratch import scratch_path

    rows = stored_findings(spark, d).select("finding_id", D.fingerprint("rule_id", "file_path", "snippet").alias("fingerprint"), "column_num", "severity")
    store = Store(spark, scratch_path(spark, "baselines"), {"baselines": K.BASELINES})
    for n, at, tag in ((1, "2024-01-01 00:00:00", "v1"), (2, "2024-02-02 10:00:00", "v/2"), (3, "2024-02-02 11:00:00", None)):
        K.save_baseline(store, rows.where(F.col("column_num") == n), at, tag)
    parts = [K.load_baseline(store, w).select(F.lit(w).alias("wanted"), "finding_id", "severity") for w in ("v1", "20240202", "v/2")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "src16_mapped",
    """SELECT dep_id AS ghsa_id, CASE ecosystem WHEN 'npm' THEN 'npm' WHEN 'PyPI' THEN 'PyPI' ELSE 'crates.io' END AS ecosystem,
    CASE dep_id % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 3 THEN 'Low' ELSE 'Medium' END AS severity, CASE WHEN dep_id % 7 = 0 THEN '' ELSE concat('>= 0.1, < ', version) END AS ranges FROM deps""",
)
def src16_mapped(spark, d):
    """Records of one feed's form made of dependencies: ecosystems, severities and ranges as they come."""
    k = F.col("dep_id")
    ecosystem = F.when(F.col("ecosystem") == "npm", "NPM").when(F.col("ecosystem") == "PyPI", "pypi").when(k % 2 == 0, "RUST").otherwise("crates_io")
    severity = F.when(k % 5 == 0, "CRITICAL").when(k % 5 == 1, "HIGH").when(k % 5 == 2, "MODERATE").when(k % 5 == 3, "LOW")
    span = F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" >= 0.1, < "), "version", F.lit(" ")))
    nodes = deps(spark, d).select(k.alias("ghsa_id"), severity.alias("severity"), ecosystem.alias("ecosystem"), "package_name", span.alias("range"))
    return A.import_ghsa(nodes).select("ghsa_id", "ecosystem", "severity", F.array_join("vulnerable_versions", "|").alias("ranges"))


_MEMBERS = """m AS (SELECT concat('u', c_custkey % 50) AS user_id, concat('o-', c_custkey % 50 % 4) AS org_id, CASE WHEN c_custkey % 50 % 7 = 0 THEN 'admin' WHEN c_custkey % 3 = 0 THEN 'manager' ELSE 'developer' END AS role,
    concat('t-', c_nationkey % 6) AS team_id FROM customer)"""


@query(
    "fil25_visible_to_each",
    f"""WITH {_MEMBERS} SELECT DISTINCT user_id, f.finding_id FROM m JOIN (SELECT f.*, p.team_id AS team FROM stored_findings f JOIN projects p USING (project_id)) f
    ON f.org_id = m.org_id AND (m.role = 'admin' OR m.team_id = f.team) WHERE f.column_num = 1 AND f.severity = 'Critical'""",
)
def fil25_each(spark, d):
    """The critical findings that each user sees: admins all of their organisation, others those of their teams' projects."""
    k = F.col("c_custkey") % 50
    role = F.when(k % 7 == 0, "admin").when(F.col("c_custkey") % 3 == 0, "manager").otherwise("developer")
    rows = read(spark, d, "customer").select(F.concat(F.lit("u"), k).alias("user_id"), F.concat(F.lit("o-"), k % 4).alias("org_id"), role.alias("role"), F.concat(F.lit("t-"), F.col("c_nationkey") % 6).alias("team_id"))
    members = rows.groupBy("user_id", "org_id").agg(F.max_by("role", L.role_level("role")).alias("role"), F.collect_set("team_id").alias("team_ids"))
    found = stored_findings(spark, d).where("column_num = 1 and severity = 'Critical'").join(projects(spark, d).select("project_id", "team_id"), "project_id")
    return L.visible_to_each(found, members).select("user_id", "finding_id")


@query(
    "joi13_upsert_sides",
    """SELECT rule_id, file_path, CASE WHEN a.was IS NULL THEN 'new' WHEN b.came IS NULL THEN 'absent' ELSE 'known' END AS side
    FROM (SELECT DISTINCT rule_id, file_path, 1 AS was FROM stored_findings WHERE column_num = 1) a
    FULL JOIN (SELECT DISTINCT rule_id, file_path, 1 AS came FROM stored_findings WHERE column_num = 2) b USING (rule_id, file_path)""",
)
def joi13(spark, d):
    from ..operators.joins import upsert_sides

    rows = stored_findings(spark, d)
    return upsert_sides(rows.where("column_num = 2"), rows.where("column_num = 1"), ["rule_id", "file_path"])


@query("src16_ecosystems", "SELECT dep_id, CASE upper(ecosystem) WHEN 'NPM' THEN 'npm' WHEN 'PYPI' THEN 'PyPI' ELSE ecosystem END AS ecosystem FROM deps")
def src16b(spark, d):
    return deps(spark, d).select("dep_id", A.ghsa_ecosystem(F.upper("ecosystem")).alias("e"), "ecosystem").select(
        "dep_id", F.when(F.col("e") == F.upper("ecosystem"), F.col("ecosystem")).otherwise(F.col("e")).alias("ecosystem")
    )


@query(
    "mut17_record_changes",
    """WITH c AS (SELECT concat('p-', c_custkey % 60) AS project_id, c_custkey AS seq, CASE WHEN c_custkey % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op,
      CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN concat('t-', c_nationkey) END AS team_id FROM customer),
    n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY seq DESC) = 1)
    SELECT coalesce(p.project_id, n.project_id) AS project_id, coalesce(n.name, p.name) AS name, coalesce(n.team_id, p.team_id) AS team_id, p.org_id
    FROM projects p FULL JOIN n ON n.project_id = p.project_id WHERE coalesce(n.op, 'upsert') <> 'delete'""",
)
def mut17(spark, d):
    """Records of any keyed table: created, changed in part, and deleted."""
    from ..operators.mutations import apply_changes

    k = F.col("c_custkey")
    changes = read(spark, d, "customer").select(
        F.concat(F.lit("p-"), k % 60).alias("project_id"), k.alias("seq"), F.when(k % 5 == 0, "delete").otherwise("upsert").alias("op"),
        F.when(k % 3 > 0, F.col("c_name")).alias("name"), F.when(k % 2 == 0, F.concat(F.lit("t-"), "c_nationkey")).alias("team_id"),
    )
    return apply_changes(projects(spark, d).select("project_id", "name", "team_id", "org_id"), changes, ["project_id"])
