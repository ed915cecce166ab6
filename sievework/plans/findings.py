"""Queries over stored findings: filters, orders, lookups and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domain as D
from ..operators import filters as L
from ..operators import joins as J
from ..operators import ordering as O
from ..registry import query
from .standins import marked_lines, projects, read, scans, stored_findings

RANK = "CASE severity WHEN 'Critical' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 WHEN 'Info' THEN 1 END"
COLS = ["finding_id", "rule_id", "file_path", "line", "severity", "triage_state"]
C = ", ".join(COLS)


def f(spark, d, *more: str):
    return stored_findings(spark, d).select(*COLS, *more) if more != ("*",) else stored_findings(spark, d)


@query("fil3_min_severity", f"SELECT {C} FROM stored_findings WHERE {RANK} >= 3")
def fil3(spark, d):
    return L.min_severity(f(spark, d), "Medium")


@query(
    "fil4_path_globs",
    f"SELECT {C} FROM stored_findings WHERE regexp_matches(file_path, '^src/mod1[^/]*/file[^/]*[.]py$') AND NOT regexp_matches(file_path, '/file1[^/]*[.]py$')",
)
def fil4(spark, d):
    return L.by_paths(f(spark, d), include=["src/mod1*/file*.py"], exclude=["**/file1*.py"])


@query("fil5_exclude_rules", f"SELECT {C} FROM stored_findings WHERE rule_id NOT IN ('rule-1', 'rule-7')")
def fil5(spark, d):
    return L.without_rules(f(spark, d), ["rule-1", "rule-7"])


@query(
    "fil6_changed_lines",
    f"SELECT {C} FROM stored_findings WHERE (file_path, line) IN (SELECT file_path, line FROM stored_findings WHERE triage_state = 'Reviewing' AND line % 5 = 0)",
)
def fil6(spark, d):
    rows = f(spark, d)
    return L.on_changed_lines(rows, rows.where("triage_state = 'Reviewing' and line % 5 = 0")).select(*COLS)


@query(
    "fil7_staged_files",
    f"SELECT {C} FROM stored_findings WHERE file_path IN (SELECT concat('src/mod', i % 25, '/file', i, '.py') FROM (SELECT unnest(range(0, 60, 3)) AS i))",
)
def fil7(spark, d):
    i = F.col("id")
    name = F.concat(F.lit("src/mod"), i % 25, F.lit("/file"), i, F.lit(".py"))
    staged = spark.range(0, 60, 3).select(F.when(i % 2 == 0, F.concat(F.lit("/repo/"), name)).otherwise(F.concat(F.lit("./"), name)).alias("file_path"))
    return L.in_files(f(spark, d), staged, root="/repo")


_FOUND = """(SELECT concat('f', p_partkey, '-', r) AS finding_id, concat('src/f', p_partkey % 40, '.py') AS file_path, CAST(p_partkey // 40 + 1 AS INT) AS line, concat('rule-', r) AS rule_id
    FROM part, (SELECT unnest(range(7)) AS r))"""
# the directive's grammar, on the trimmed line t with comment text b
_PARSED = """(SELECT file_path, line_no, t, CASE WHEN NOT in_comment THEN NULL
      WHEN starts_with(b, 'scan-ignore:') AND trim(substr(b, 13)) <> '' THEN trim(substr(b, 13)) WHEN contains(b, 'scan-ignore-next-line') THEN '*'
      WHEN regexp_matches(b, '^(.{0,99}?)scan-ignore($|\\s)') AND NOT regexp_matches(b, '^((.{0,99}?))scan-ignore[^\\s]') THEN '*' END AS target, in_comment
    FROM (SELECT *, t LIKE '%//%' OR t LIKE '%#%' OR t LIKE '<!--%' OR t LIKE '/*%' AS in_comment, trim(CASE WHEN t LIKE '//%' THEN substr(t, 3) WHEN t LIKE '#%' THEN substr(t, 2)
      WHEN t LIKE '<!--%' THEN regexp_replace(substr(t, 5), '-->$', '') WHEN t LIKE '/*%' THEN regexp_replace(substr(t, 3), '[*]/$', '')
      WHEN contains(t, '//') THEN substr(t, instr(t, '//') + 2) ELSE substr(t, instr(t, '#') + 1) END) AS b FROM (SELECT *, trim(line) AS t FROM marked_lines))) m"""


def _found(spark, d):
    """Seven findings on every line."""
    k, r = F.col("p_partkey"), F.col("r")
    rows = read(spark, d, "part").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return rows.select(
        F.concat(F.lit("f"), k, F.lit("-"), r).alias("finding_id"), F.concat(F.lit("src/f"), k % 40, F.lit(".py")).alias("file_path"),
        F.expr("cast(p_partkey div 40 + 1 as int)").alias("line"), F.concat(F.lit("rule-"), r).alias("rule_id"),
    )


@query(
    "fil8_inline_suppression",
    f"""SELECT finding_id, rule_id FROM {_FOUND} f WHERE NOT EXISTS (SELECT 1 FROM {_PARSED}
    WHERE m.file_path = f.file_path AND m.line_no + 1 = f.line AND (target = '*' OR target = f.rule_id))""",
)
def fil8(spark, d):
    return L.suppress_inline(marked_lines(spark, d), _found(spark, d)).select("finding_id", "rule_id")


@query(
    "fil9_secret_suppression",
    f"""SELECT finding_id FROM {_FOUND} f WHERE NOT EXISTS (SELECT 1 FROM {_PARSED}
    WHERE m.file_path = f.file_path AND m.line_no + 1 = f.line AND in_comment AND contains(t, 'scan-ignore-secret'))""",
)
def fil9(spark, d):
    """The directive of the secret scan, which has no rule."""
    return L.suppress_secrets(marked_lines(spark, d), _found(spark, d)).select("finding_id")


@query("fil10_count_directives", f"SELECT file_path, count(target) AS directives FROM {_PARSED} GROUP BY 1")
def fil10(spark, d):
    return L.count_directives(marked_lines(spark, d))


@query(
    "fil11_learned_suppression",
    """SELECT finding_id, rule_id FROM stored_findings WHERE (rule_id, snippet) NOT IN
    (SELECT rule_id, snippet FROM stored_findings WHERE triage_state = 'Ignored' GROUP BY ALL HAVING count(*) >= 3)""",
)
def fil11(spark, d):
    from ..operators.mutations import learn_suppressions

    rows = f(spark, d, "snippet", "created_at").withColumn("ctx_hash", D.context_hash(F.lit("call"), "snippet"))
    learned = learn_suppressions(rows.where("triage_state = 'Ignored'").withColumn("seen_at", F.col("created_at")))
    return L.without_learned(rows, learned).select("finding_id", "rule_id")


@query(
    "fil12_approved",
    """SELECT finding_id FROM stored_findings WHERE (rule_id, snippet) NOT IN
    (SELECT rule_id, snippet FROM stored_findings WHERE triage_state = 'AutoIgnored')""",
)
def fil12(spark, d):
    rows = f(spark, d, "snippet").withColumn("memory_key", D.memory_key("snippet"))
    memory = rows.where("triage_state = 'AutoIgnored'").select("rule_id", "memory_key", F.lit("approved").alias("decision"))
    return L.without_approved(rows, memory).select("finding_id")


@query(
    "fil13_list_findings",
    f"""SELECT {C} FROM stored_findings WHERE severity = 'High' AND triage_state = 'Open' AND confidence_score >= 0.5
    ORDER BY created_at DESC, finding_id LIMIT 50 OFFSET 10""",
)
def fil13(spark, d):
    rows = L.list_findings(f(spark, d, "created_at", "confidence_score"), "High", "Open", 0.5)
    return rows.orderBy(F.desc("created_at"), "finding_id").offset(10).limit(50).select(*COLS)


@query(
    "fil14_search",
    f"""SELECT {C} FROM stored_findings WHERE severity IN ('Critical','High') AND triage_state IN ('Open','Reviewing')
    AND confidence_score BETWEEN 0.1 AND 0.9 AND reachable AND owasp_category = 'A03'
    AND (contains(lower(rule_id), 'le-1') OR contains(lower(file_path), 'le-1') OR contains(lower(snippet), 'le-1'))""",
)
def fil14(spark, d):
    rows = L.search(f(spark, d, "*"), ["Critical", "High"], ["Open", "Reviewing"], 0.1, 0.9, True, owasp="A03", text="LE-1")
    return rows.select(*COLS)


@query("fil15_export_list", f"SELECT {C} FROM stored_findings WHERE severity = 'Low' AND triage_state = 'Fixed'")
def fil15(spark, d):
    return L.list_findings(f(spark, d), "Low", "Fixed")


@query("fil16_by_id", f"SELECT {C} FROM stored_findings WHERE finding_id = 'f-7-1'")
def fil16(spark, d):
    return f(spark, d).where("finding_id = 'f-7-1'")


@query("fil16_critical_of_scan", f"SELECT {C} FROM stored_findings WHERE scan_id = 's-7' AND severity = 'Critical'")
def fil16b(spark, d):
    return L.list_findings(f(spark, d, "scan_id"), "Critical", scan_id="s-7").select(*COLS)


@query(
    "fil17_list_scans",
    """SELECT scan_id, repository, branch, coalesce(n, 0) AS findings FROM scans LEFT JOIN (SELECT scan_id, count(*) AS n FROM stored_findings GROUP BY 1) USING (scan_id)
    WHERE repository = 'repo-3' AND branch = 'main' AND strftime(ts, '%Y-%m-%dT%H:%M:%S') BETWEEN '1994-01-01' AND '1996-12-31T23:59:59'""",
)
def fil17(spark, d):
    rows = L.list_scans(scans(spark, d), "repo-3", "main", "1994-01-01", "1996-12-31T23:59:59")
    n = stored_findings(spark, d).groupBy("scan_id").agg(F.count("*").alias("n"))
    return rows.join(n, "scan_id", "left").select("scan_id", "repository", "branch", F.coalesce("n", F.lit(0)).alias("findings"))


@query(
    "fil18_checks_of_project",
    """SELECT scan_id, project_id, ts FROM scans WHERE project_id = 'p-5' ORDER BY ts DESC, scan_id""",
)
def fil18(spark, d):
    return O.newest_first(scans(spark, d).where("project_id = 'p-5'").select("scan_id", "project_id", "ts"), "ts", "scan_id")


@query(
    "fil19_audit_range",
    """SELECT event_id, user_id, event_type FROM events WHERE user_id % 4 = 1 AND ts BETWEEN
    (SELECT min(ts) + INTERVAL 1 HOUR FROM events) AND (SELECT min(ts) + INTERVAL 5 HOUR FROM events)""",
)
def fil19(spark, d):
    e = read(spark, d, "events")
    lo = e.agg(F.min("ts").alias("lo"))
    rows = e.where("user_id % 4 = 1").crossJoin(F.broadcast(lo))
    return rows.where("ts between lo + interval 1 hour and lo + interval 5 hour").select("event_id", "user_id", "event_type")


@query("fil21_sca_eligible", "SELECT project_id, name FROM projects WHERE coalesce(sca_enabled, true)")
def fil21(spark, d):
    return projects(spark, d).where(F.coalesce("sca_enabled", F.lit(True))).select("project_id", "name")


@query("fil21_by_repository", "SELECT project_id, org_id FROM projects WHERE repository_url = 'https://git.example.com/r8'")
def fil21b(spark, d):
    return projects(spark, d).where("repository_url = 'https://git.example.com/r8'").select("project_id", "org_id")


@query(
    "fil22_api_names",
    """SELECT finding_id AS id, rule_id AS "ruleId", file_path AS "filePath", coalesce(owasp_category, '') AS "owaspCategory" FROM stored_findings""",
)
def fil22(spark, d):
    return stored_findings(spark, d).select(
        F.col("finding_id").alias("id"), F.col("rule_id").alias("ruleId"), F.col("file_path").alias("filePath"),
        F.coalesce("owasp_category", F.lit("")).alias("owaspCategory"),
    )


@query(
    "fil23_payload_violations",
    """SELECT project_id AS scan_id, 'too_many_findings' AS problem, count(*) AS n FROM stored_findings GROUP BY 1 HAVING count(*) > 1150
    UNION ALL SELECT project_id, 'bad_severity', count(*) FROM stored_findings WHERE severity = 'Info' GROUP BY 1""",
)
def fil23(spark, d):
    return L.payload_violations(stored_findings(spark, d).select(F.col("project_id").alias("scan_id"), "severity"), 1150)


MEMBERS = [("u1", "o-0", "admin", ["t-0"], 5), ("u2", "o-0", "developer", ["t-0", "t-4"], 9), ("u3", "o-1", "manager", [], 3), ("u2", "o-1", "developer", ["t-1"], 2)]


def members(spark):
    return spark.createDataFrame(MEMBERS, "user_id string, org_id string, role string, team_ids array<string>, created_at int")


MEMBERS_SQL = "(VALUES " + ", ".join(f"('{u}', '{o}', '{r}', {t}::VARCHAR[], {c})" for u, o, r, t, c in MEMBERS) + ") m(user_id, org_id, role, team_ids, created_at)"


#: Four thousand memberships and more, from customers: users, organisations (one of them unknown) and days.
_MEMB = """(SELECT concat('u', c_custkey % 200) AS user_id, concat('o-', c_nationkey % 4) AS org_id, CASE c_custkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'manager' ELSE 'developer' END AS role,
    c_custkey AS created_at FROM customer) m"""


@query(
    "fil24_new_memberships",
    f"""SELECT m.user_id, created_at, role, coalesce(g.name, 'Unknown Organization') AS org_name FROM {_MEMB} LEFT JOIN (VALUES ('o-0', 'Alpha'), ('o-1', 'Beta'), ('o-2', 'Gamma')) g(org_id, name) USING (org_id)
    LEFT JOIN (SELECT concat('u', user_id % 300) AS user_id, max(user_id) AS seen FROM events WHERE event_type = 'signup' GROUP BY 1) x ON x.user_id = m.user_id WHERE seen IS NULL OR created_at > seen""",
)
def fil24(spark, d):
    k = F.col("c_custkey")
    role = F.when(k % 3 == 0, "admin").when(k % 3 == 1, "manager").otherwise("developer")
    rows = read(spark, d, "customer").select(F.concat(F.lit("u"), k % 200).alias("user_id"), F.concat(F.lit("o-"), F.col("c_nationkey") % 4).alias("org_id"), role.alias("role"), k.alias("created_at"))
    seen = read(spark, d, "events").where("event_type = 'signup'").select(F.concat(F.lit("u"), F.col("user_id") % 300).alias("user_id"), F.col("user_id").alias("dismissed_at"))
    return L.memberships_since(rows, seen, spark.createDataFrame(ORGS, "org_id string, name string")).select("user_id", "created_at", "role", "org_name")


@query(
    "fil25_visible_projects",
    f"""SELECT DISTINCT project_id FROM projects p JOIN {MEMBERS_SQL} ON p.org_id = m.org_id AND m.user_id = 'u2' AND (role = 'admin' OR list_contains(team_ids, p.team_id))""",
)
def fil25(spark, d):
    return L.visible_rows(projects(spark, d), members(spark), "u2").select("project_id")


@query(
    "fil26_exit_code",
    f"SELECT CASE WHEN count(*) FILTER (WHERE NOT (triage_state = 'Ignored') AND {RANK} >= 4 AND confidence_score >= 0.99) > 0 THEN 1 ELSE 0 END AS exit_code FROM stored_findings",
)
def fil26(spark, d):
    rows = stored_findings(spark, d).select("severity", "confidence_score", (F.col("triage_state") == "Ignored").alias("suppressed"))
    return L.exit_code(rows, "High", 0.99)


@query(
    "fil27_normalized_payload",
    """SELECT scan_id, rule_id, rule_id AS rule_name, file_path, line, 0 AS column_num, left(snippet, 100) AS snippet, severity,
    0.0::DOUBLE AS confidence_score, false AS reachable FROM stored_findings""",
)
def fil27(spark, d):
    return L.normalized_payload(stored_findings(spark, d))


# -- orders -----------------------------------------------------------------------------------------


@query("srt1_severity_order", f"SELECT {C} FROM stored_findings ORDER BY {RANK} DESC, file_path, line, rule_id, finding_id")
def srt1(spark, d):
    return O.ranked_by(f(spark, d), O.by_severity())


@query("srt2_search_order", f"SELECT {C} FROM stored_findings ORDER BY confidence_score ASC, finding_id LIMIT 100")
def srt2(spark, d):
    return O.ranked_by(f(spark, d, "confidence_score"), O.search_order("confidence", True), 100).select(*COLS)


@query(
    "srt3_page",
    f"""SELECT {C}, (SELECT count(*) FROM stored_findings WHERE severity = 'Critical') AS total,
    CASE WHEN (SELECT count(*) FROM stored_findings WHERE severity = 'Critical') > 50 THEN 50 END AS next_cursor
    FROM stored_findings WHERE severity = 'Critical' ORDER BY finding_id LIMIT 25 OFFSET 25""",
)
def srt3(spark, d):
    return L.page(f(spark, d).where("severity = 'Critical'"), [F.col("finding_id")], 25, 25)


@query(
    "srt4_neighbours",
    f"""SELECT finding_id, lag(finding_id) OVER w AS previous_id, lead(finding_id) OVER w AS next_id FROM stored_findings
    WHERE severity = 'Critical' WINDOW w AS (ORDER BY confidence_score DESC, finding_id)""",
)
def srt4(spark, d):
    rows = f(spark, d, "confidence_score").where("severity = 'Critical'")
    return L.neighbours(rows, O.search_order("confidence"))


@query("srt5_top_languages", """SELECT language, count(*) AS scans FROM (SELECT unnest(languages) AS language FROM scans) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def srt5(spark, d):
    return scans(spark, d).select(F.explode("languages").alias("language")).groupBy("language").agg(F.count("*").alias("scans")).orderBy(F.desc("scans"), "language").limit(10)


SNAPS = [("20240101T000000Z", "v1", "a"), ("20240201T000000Z", "v1", "b"), ("20240202T000000Z", None, "c"), ("20240202T100000Z", "v2", "d")]
SNAPS_SQL = "(VALUES " + ", ".join(f"('{t}', {repr(g) if g else 'NULL'}, '{i}')" for t, g, i in SNAPS) + ") s(snapshot_at, tag, snapshot_id)"


@query(
    "srt6_baseline_lookup",
    f"""SELECT w AS wanted, coalesce((SELECT snapshot_id FROM {SNAPS_SQL} WHERE tag = w ORDER BY snapshot_at LIMIT 1),
    (SELECT snapshot_id FROM {SNAPS_SQL} WHERE starts_with(snapshot_at, w) ORDER BY snapshot_at DESC LIMIT 1)) AS snapshot_id FROM (VALUES ('v1'), ('20240202'), ('x')) t(w)""",
)
def srt6(spark, d):
    snaps = spark.createDataFrame(SNAPS, "snapshot_at string, tag string, snapshot_id string")
    out = [O.snapshot_of(snaps, w).select(F.lit(w).alias("wanted"), "snapshot_id") for w in ("v1", "20240202", "x")]
    return out[0].union(out[1]).union(out[2])


@query(
    "srt7_newest_duplicates",
    """SELECT finding_id, row_number() OVER (PARTITION BY rule_id, file_path ORDER BY updated_at DESC, finding_id DESC) = 1 AS kept
    FROM stored_findings WHERE triage_state NOT IN ('Fixed','AutoFixed','Ignored','AutoIgnored')""",
)
def srt7(spark, d):
    return O.newest_open_duplicates(stored_findings(spark, d))


@query("srt8_latest_run", "SELECT max(scan_id) AS latest FROM scans")
def srt8(spark, d):
    return scans(spark, d).agg(F.max("scan_id").alias("latest"))


@query(
    "srt9_timeline",
    """SELECT finding_id, 'detected' AS event, created_at AS at FROM stored_findings
    UNION ALL SELECT finding_id, triage_state, updated_at FROM stored_findings WHERE updated_at > created_at""",
)
def srt9(spark, d):
    return O.timeline(stored_findings(spark, d))


@query(
    "srt10_capped_trace",
    """SELECT doc_id, array_to_string(list_transform(list_slice(string_split(text, ' '), 1, 20), lambda s: CASE WHEN length(s) > 8 THEN concat(left(s, 8), '…') ELSE s END), '|') AS trace
    FROM documents""",
)
def srt10(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.array_join(O.capped_trace(F.split("text", " "), 20, 8), "|").alias("trace"))


@query("srt11_memory_newest", "SELECT event_id, user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id")
def srt11(spark, d):
    e = read(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("k"))
    rows = e.join(F.broadcast(kind), F.col("event_type") == F.col("k"))
    return O.newest_first(rows, "ts", "event_id").select("event_id", "user_id")


@query("srt12_projects_newest", "SELECT project_id, name FROM projects ORDER BY created_seq DESC, project_id")
def srt12(spark, d):
    return O.newest_first(projects(spark, d), "created_seq", "project_id").select("project_id", "name")


# -- joins ------------------------------------------------------------------------------------------


@query(
    "joi2_enclosing_function",
    """SELECT f.finding_id, f.file_path, f.line, g.name, g.def_line FROM stored_findings f ASOF LEFT JOIN
    (SELECT file_path, line AS def_line, min(snippet) AS name FROM stored_findings WHERE column_num = 1 AND line % 7 = 0 GROUP BY 1, 2) g
    ON f.file_path = g.file_path AND f.line >= g.def_line""",
)
def joi2(spark, d):
    rows = stored_findings(spark, d)
    defs = rows.where("column_num = 1 and line % 7 = 0").select("file_path", F.col("snippet").alias("name"), F.col("line").alias("def_line"))
    return J.enclosing_function(rows, defs)


@query(
    "joi3_resolve_callees",
    """WITH defs AS (SELECT file_path, snippet AS name, min(line) AS l FROM stored_findings WHERE column_num = 1 GROUP BY 1, 2),
    anyw AS (SELECT name, arg_min(file_path, (file_path, l)) AS p, arg_min(l, (file_path, l)) AS l FROM defs GROUP BY 1)
    SELECT c.finding_id AS call_id, c.file_path, c.snippet AS callee, CASE WHEN d.l IS NOT NULL THEN c.file_path ELSE a.p END AS def_path, coalesce(d.l, a.l) AS def_line
    FROM stored_findings c LEFT JOIN defs d ON d.name = c.snippet AND d.file_path = c.file_path LEFT JOIN anyw a ON a.name = c.snippet WHERE c.column_num = 2""",
)
def joi3(spark, d):
    rows = stored_findings(spark, d)
    defs = rows.where("column_num = 1").select("file_path", F.col("snippet").alias("name"), F.col("line").alias("def_line"))
    calls = rows.where("column_num = 2").select(F.col("finding_id").alias("call_id"), "file_path", F.col("snippet").alias("callee"))
    return J.resolve_callees(calls, defs)


@query(
    "joi5_file_exposure",
    """SELECT finding_id, concat('mod', regexp_extract(file_path, 'mod(\\d+)', 1)) AS service, e.public FROM stored_findings LEFT JOIN
    (SELECT concat('mod', i) AS service, i % 3 = 0 AS public FROM (SELECT unnest(range(20)) AS i)) e ON e.service = concat('mod', regexp_extract(file_path, 'mod(\\d+)', 1))""",
)
def joi5(spark, d):
    i = F.col("id")
    e = spark.range(20).select(F.concat(F.lit("mod"), i).alias("service"), (i % 3 == 0).alias("public"))
    rows = stored_findings(spark, d).select("finding_id", F.concat(F.lit("mod"), F.regexp_extract("file_path", r"mod(\d+)", 1)).alias("service"))
    return J.with_exposure(rows, F.broadcast(e)).select("finding_id", "service", "public")


@query(
    "joi6_service_contexts",
    """SELECT s AS service, arg_min(c, (length(c), c)) AS context FROM (SELECT concat('svc-', i) AS s FROM (SELECT unnest(range(30)) AS i))
    LEFT JOIN (VALUES ('svc-1'), ('prod-svc-12-eu'), ('svc-'), ('SVC-22')) x(c) ON contains(lower(s), lower(c)) OR contains(lower(c), lower(s)) GROUP BY 1""",
)
def joi6(spark, d):
    services = spark.range(30).select(F.concat(F.lit("svc-"), "id").alias("service"))
    contexts = spark.createDataFrame([("svc-1",), ("prod-svc-12-eu",), ("svc-",), ("SVC-22",)], "context string")
    return J.match_contexts(services, contexts)


@query(
    "joi7_rule_names",
    """SELECT finding_id, rule_id, coalesce(r.name, rule_id) AS rule_name FROM stored_findings LEFT JOIN
    (SELECT concat('rule-', i) AS rule_id, concat('Rule number ', i) AS name FROM (SELECT unnest(range(0, 40, 2)) AS i)) r USING (rule_id)""",
)
def joi7(spark, d):
    rules = spark.range(0, 40, 2).select(F.concat(F.lit("rule-"), "id").alias("rule_id"), F.concat(F.lit("Rule number "), "id").alias("name"))
    return J.with_rule_names(stored_findings(spark, d).select("finding_id", "rule_id"), F.broadcast(rules))


@query(
    "joi8_project_names",
    """SELECT project_id, n, coalesce(p.name, 'Unknown') AS name FROM (SELECT project_id, count(*) AS n FROM stored_findings GROUP BY 1) LEFT JOIN projects p USING (project_id)""",
)
def joi8(spark, d):
    n = stored_findings(spark, d).groupBy("project_id").agg(F.count("*").alias("n"))
    return n.join(projects(spark, d).select("project_id", "name"), "project_id", "left").select("project_id", "n", F.coalesce("name", F.lit("Unknown")).alias("name"))


ORGS = [("o-0", "Alpha"), ("o-1", "Beta"), ("o-2", "Gamma")]
ORGS_SQL = "(VALUES ('o-0', 'Alpha'), ('o-1', 'Beta'), ('o-2', 'Gamma')) g(org_id, name)"


@query(
    "joi9_scan_listing",
    f"""SELECT scan_id, coalesce(n, 0) AS findings, coalesce(p.name, 'Unknown') AS project_name, coalesce(g.name, 'Unknown') AS org_name FROM scans s
    LEFT JOIN (SELECT scan_id, count(*) AS n FROM stored_findings GROUP BY 1) USING (scan_id) LEFT JOIN projects p USING (project_id) LEFT JOIN {ORGS_SQL} ON g.org_id = s.org_id""",
)
def joi9(spark, d):
    return J.scan_listing(scans(spark, d), stored_findings(spark, d), projects(spark, d), spark.createDataFrame(ORGS, "org_id string, name string"))


@query(
    "joi10_check_details",
    """SELECT scan_id, coalesce(list_aggregate(l, 'string_agg', ';'), '') AS findings FROM (SELECT scan_id FROM scans WHERE project_id = 'p-3') LEFT JOIN
    (SELECT scan_id, list(concat(finding_id, ',', rule_id, ',', severity) ORDER BY finding_id) AS l FROM stored_findings GROUP BY 1) USING (scan_id)""",
)
def joi10(spark, d):
    checks = scans(spark, d).where("project_id = 'p-3'").select("scan_id")
    out = J.check_details(checks, stored_findings(spark, d))
    text = F.transform("findings", lambda x: F.concat_ws(",", x["finding_id"], x["rule_id"], x["severity"]))
    return out.select("scan_id", F.array_join(text, ";").alias("findings"))


@query(
    "joi11_memberships",
    f"""SELECT user_id, m.org_id, g.name AS org_name, coalesce(u.name, user_id) AS user_name FROM {MEMBERS_SQL} JOIN {ORGS_SQL} ON g.org_id = m.org_id
    LEFT JOIN (VALUES ('u1', 'Ann')) u(id, name) ON u.id = user_id""",
)
def joi11(spark, d):
    users = spark.createDataFrame([("u1", "Ann")], "user_id string, name string")
    out = J.memberships(members(spark), spark.createDataFrame(ORGS, "org_id string, name string"), users)
    return out.select("user_id", "org_id", "org_name", "user_name")


@query(
    "joi15_fix_templates",
    """SELECT finding_id, CASE WHEN rule_id = 'rule-3' THEN 'parameterize' WHEN column_num % 3 = 0 THEN 'escape-html' WHEN column_num % 3 = 1 THEN 'strong-hash' END AS template
    FROM stored_findings""",
)
def joi15(spark, d):
    rows = stored_findings(spark, d).select(
        "finding_id", "rule_id", F.element_at(F.array(F.lit("CWE-79"), F.lit("CWE-327"), F.lit(None)), (F.col("column_num") % 3 + 1).cast("int")).alias("cwe_id")
    )
    t = spark.createDataFrame([("rule-3", None, "parameterize"), (None, "79", "escape-html"), (None, "327", "strong-hash")], "rule_id string, cwe string, template string")
    return J.fix_templates(rows, t)


@query(
    "joi16_days_since_scan",
    f"""SELECT g.org_id, max(ts) AS last_scan, date_diff('day', CAST(max(ts) AS DATE), DATE '1999-01-01') AS days_since FROM {ORGS_SQL} LEFT JOIN scans s ON s.org_id = g.org_id GROUP BY 1""",
)
def joi16(spark, d):
    return J.days_since_scan(spark.createDataFrame(ORGS, "org_id string, name string"), scans(spark, d), "1999-01-01")
