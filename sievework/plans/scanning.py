"""Queries over source text: lines, rules, files, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domain as D
from ..operators import filters as L
from ..operators import scoring as S
from ..registry import query
from ..sources import files as X
from ..sources import trees as T
from .scan import match_rules, scan_code
from .standins import code_files, mixed_files, read, src_lines

LINE_RULES = [r for r in X.DEFAULT_RULES if r[3] is None]
RULES_SQL = "(VALUES " + ", ".join(f"('{r[0]}', '{r[2]}', '{r[4]}')" for r in LINE_RULES) + ") r(rule_id, severity, pattern)"


@query(
    "fil1_line_rules",
    f"""SELECT doc_id, line_no, rule_id, severity, instr(line, regexp_extract(line, pattern, 0)) AS column_num, regexp_extract(line, pattern, 0) AS snippet
    FROM src_lines, {RULES_SQL} WHERE regexp_matches(line, pattern)""",
)
def fil1(spark, d):
    rules = X.default_rules(spark).where("language is null")
    lines = src_lines(spark, d).withColumn("language", F.lit(None).cast("string"))
    return match_rules(lines, rules).select("doc_id", "line_no", "rule_id", "severity", "column_num", "snippet")


def rule_cases(spark, d):
    """(rule_id, expected, matched) of three rules on all lines."""
    rules = [("SEC001", "token", LINE_RULES[0][4]), ("PII003", "4", "[0-9]{16}"), ("LIC001", "icensed", LINE_RULES[4][4])]
    cases = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.contains("line", F.lit(m)).alias("expected"), F.col("line").rlike(p).alias("matched")) for i, m, p in rules])
    return src_lines(spark, d).select(F.explode(cases).alias("c")).select("c.*")


@query(
    "fil2_predicates",
    """SELECT doc_id, line_no, w AS text FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z]+')) AS w FROM src_lines)
    WHERE w = 'Licensed' OR regexp_matches(w, '^(token|Apache)$')""",
)
def fil2(spark, d):
    w = src_lines(spark, d).select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z]+"), 0)).alias("text"))
    named = w.withColumn("name", F.when(F.col("text") == "Licensed", "first").otherwise("other"))
    return L.predicate_captures(named, {"first": "Licensed"}, {"other": "^(token|Apache)$"}).select("doc_id", "line_no", "text")


_MAIL = r"([A-Za-z0-9.]+)@([a-z0-9]+)[.]example[.]com"


@query(
    "fil2_group_captures",
    rf"""WITH m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{_MAIL}', 1)) AS a, unnest(regexp_extract_all(line, '{_MAIL}', 2)) AS b, generate_subscripts(regexp_extract_all(line, '{_MAIL}', 1), 1) - 1 AS match
      FROM src_lines WHERE regexp_matches(line, '{_MAIL}'))
    SELECT doc_id, line_no, CAST(match AS INT) AS match, name, text FROM (SELECT doc_id, line_no, match, unnest(['user', 'host']) AS name, unnest([a, b]) AS text FROM m WHERE regexp_matches(a, '[0-9]') AND regexp_matches(b, '^[a-m]'))""",
)
def fil2_groups(spark, d):
    """Predicates on what a line rule's groups captured: addresses with a digit in the user and a host of the first letters."""
    found = L.group_captures(src_lines(spark, d).select("doc_id", "line_no", "line"), _MAIL, ["user", "host"])
    return L.matches_passing(found, ["doc_id", "line_no"], matches={"user": "[0-9]", "host": "^[a-m]"}).select("doc_id", "line_no", "match", "name", "text")


#: What is planted into a line, and what only looks like it: rule, text that it must find, text that it must not.
PLANTED = [
    ("SEC001", 'token = "0123456789abcdef0123456789abcdef01234567"', 'token = "0123456789abcdef"'), ("PII001", "mail to a.b@site.example.com", "mail to a.b at site.example.org"),
    ("PII002", "host 10.20.30.40", "version 10.20.30"), ("PII003", "card 1234567812345678", "card 1234 5678 1234 5678"), ("LIC001", "Licensed under X", "Licenced by X"),
]


@query(
    "agg19_planted_cases",
    f"""WITH c AS (SELECT r.rule_id, p.k = 0 AS expected, regexp_matches(concat(line, ' ', CASE p.k WHEN 0 THEN yes ELSE no END), pattern) AS matched
      FROM (SELECT line FROM src_lines WHERE NOT regexp_matches(line, '[0-9@]|icensed under|eleased under')), (VALUES (0), (1)) p(k),
      (VALUES {", ".join("('{}', '{}', '{}')".format(*x) for x in PLANTED)}) t(rule_id, yes, no) JOIN {RULES_SQL} ON r.rule_id = t.rule_id)
    SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS recall, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS fp_rate,
      tp + fn >= 3 AND fp + tn >= 3 AS enough_cases FROM (SELECT rule_id, count(*) FILTER (WHERE expected AND matched) AS tp, count(*) FILTER (WHERE expected AND NOT matched) AS fn,
      count(*) FILTER (WHERE NOT expected AND matched) AS fp, count(*) FILTER (WHERE NOT expected AND NOT matched) AS tn FROM c GROUP BY 1)""",
)
def agg19_planted(spark, d):
    """Quality of the line rules on the clean lines of the documents, each with what a rule must find and what it must not."""
    from ..operators.analytics import rule_quality

    clean = src_lines(spark, d).where("not regexp(line, '[0-9@]|icensed under|eleased under')").select("line")
    plant = F.array(*[F.struct(F.lit(r).alias("case_of"), F.lit(kind == 0).alias("expected"), F.lit(t).alias("t")) for r, *texts in PLANTED for kind, t in enumerate(texts)])
    cases = clean.select("line", F.explode(plant).alias("p")).select("p.*", F.concat_ws(" ", "line", "p.t").alias("line"))
    hits = F.array_compact(F.array(*[F.when((F.col("case_of") == r[0]) & F.col("line").rlike(r[4]), F.lit(r[0])) for r in LINE_RULES]))
    return rule_quality(cases.select(F.col("case_of").alias("rule_id"), "expected", (F.size(hits) > 0).alias("matched")))


_TREE_FOUND = """(VALUES (0, 'PY104', 4, 5, 'os.system(''ls '' + request.path)'), (1, 'PY101', 2, 12, 'eval(x)'), (3, 'PY113', 3, 7, 'hashlib.md5(a)'), (5, 'PY127', 2, 5, 'open(''/a/%s'' % name)'),
    (5, 'PY145', 3, 1, 'except:' || chr(10) || '    pass'), (7, 'PY122', 2, 5, 'db.execute(f''SELECT {k}'')'), (7, 'PY122', 3, 5, 'db.execute(f''DELETE {k}'')')) t(form, rule_id, line, column_num, snippet)"""


@query("fil1_tree_rules", f"SELECT file_path, rule_id, line, column_num, snippet FROM code_files JOIN {_TREE_FOUND} USING (form)")
def fil1b(spark, d):
    return T.match_trees(code_files(spark, d), T.default_tree_rules(spark)).select("file_path", "rule_id", "line", "column_num", "snippet")


@query(
    "fil1_bracket_rules",
    """SELECT file_path, rule_id, line, column_num, snippet FROM mixed_files JOIN (VALUES (0, 'JS105', 3, 3, 'db.query(`SELECT ${req.query.id}`)'), (0, 'JS111', 4, 3, 'res.redirect(req.query.next)'),
    (1, 'JS116', 2, 5, 'token: string = ''hunter2hunter'''), (1, 'JS106', 3, 1, 'box.innerHTML = body'), (2, 'GO106', 5, 2, '"math/rand"'), (2, 'GO102', 9, 2, 'db.Query(fmt.Sprintf("SELECT %s", name))'),
    (3, 'JA101', 3, 5, 'Runtime.getRuntime().exec(cmd)'), (4, 'RS101', 2, 5, 'Command::new("sh").arg("-c").arg(cmd)')) t(form, rule_id, line, column_num, snippet) USING (form)""",
)
def fil1c(spark, d):
    return T.match_trees(mixed_files(spark, d), T.default_tree_rules(spark)).select("file_path", "rule_id", "line", "column_num", "snippet")


@query(
    "scan_enriched",
    f"""SELECT file_path, rule_id, line, CASE WHEN regexp_matches(file_path, 'svc[0-2]/') THEN 'Critical' WHEN regexp_matches(file_path, 'svc[3-5]/') THEN down ELSE severity END AS severity,
      regexp_extract(file_path, '(svc[0-9])', 1) AS service, form IN (0, 3, 5) AS reachable, name AS rule_name
    FROM code_files JOIN {_TREE_FOUND} USING (form) JOIN (VALUES ('PY104', 'High', 'Medium', 'Shell command'), ('PY101', 'Critical', 'High', 'eval of a value'), ('PY113', 'Medium', 'Low', 'MD5'),
      ('PY127', 'Medium', 'Low', 'File path from parts'), ('PY145', 'Low', 'Info', 'Errors swallowed'), ('PY122', 'Critical', 'High', 'SQL from parts')) r(rule_id, severity, down, name) USING (rule_id)
    WHERE NOT (form = 7 AND line = 3)
    UNION ALL SELECT '<PyPI/lib>', 'sca/CVE-9', 0, 'High', NULL, true, 'sca/CVE-9'""",
)
def scan_enriched(spark, d):
    """A whole scan: tree rules, inline suppression, dependency findings, reachability, exposure, rule names."""
    from .scan import ScanOptions, scan

    files = code_files(spark, d).select("file_path", "text")
    manifests = spark.createDataFrame([("requirements.txt", "lib==1.4.0\nother==2.0.0\n")], "file_path string, text string")
    advisories = spark.createDataFrame([("CVE-9", "PyPI", "lib", [">= 1, < 2"], "High", "Bad"), ("CVE-8", "PyPI", "other", ["<2"], "High", "Old")], "advisory_id string, ecosystem string, package_name string, vulnerable_versions array<string>, severity string, summary string")
    i = F.col("id")
    exposure = spark.range(6).select(F.concat(F.lit("svc"), i).alias("service"), (i < 3).alias("public"))
    found = scan(files.union(manifests), T.default_tree_rules(spark), ScanOptions(enrich=True, exposure=exposure, advisories=advisories, min_severity="Info"))
    return found.select("file_path", "rule_id", "line", "severity", "service", "reachable", "rule_name")


_DOC_PATH = "concat('services/svc', doc_id % 9, '/src/d', doc_id, '.py')"
#: Severities that exposure makes: public ones are critical, internal ones one step lower.
_SHIFT = "CASE WHEN doc_id % 9 < 3 THEN 'Critical' WHEN doc_id % 9 < 6 THEN CASE severity WHEN 'Critical' THEN 'High' WHEN 'High' THEN 'Medium' WHEN 'Medium' THEN 'Low' ELSE 'Info' END ELSE severity END"


def _exposed_sql(ranks: str) -> str:
    """The scan's order in SQL: match, exposure, dependencies with their own severity, filter, windows of one line."""
    return f"""WITH f AS (SELECT doc_id, line_no, rule_id, {_SHIFT} AS severity FROM src_lines, {RULES_SQL} WHERE regexp_matches(line, pattern)),
    w AS (SELECT doc_id, line_no, line, lag(line) OVER o AS before, lead(line) OVER o AS after FROM src_lines WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
    r AS (SELECT {_DOC_PATH.replace("doc_id", "f.doc_id")} AS file_path, rule_id, f.line_no AS line, severity, concat('svc', f.doc_id % 9) AS service,
      array_to_string(list_transform(list_filter([w.before, w.line, w.after], lambda x: x IS NOT NULL), lambda x: left(x, 100)), chr(10)) AS snippet
      FROM f JOIN w ON w.doc_id = f.doc_id AND w.line_no = f.line_no
      UNION ALL SELECT DISTINCT concat('<PyPI/', replace(p_brand, '#', ''), '>'), 'sca/ADV', 0, 'Low', NULL, concat(replace(p_brand, '#', ''), '@', p_size % 3, '.', p_size, '.0 - Old') FROM part WHERE p_size % 3 < 2)
    SELECT * FROM r WHERE severity IN ({ranks})"""


def _exposed(spark, d, least):
    from .scan import ScanOptions, scan

    k = F.col("doc_id")
    docs = read(spark, d, "documents").select(F.concat(F.lit("services/svc"), k % 9, F.lit("/src/d"), k, F.lit(".py")).alias("file_path"), "text")
    part = read(spark, d, "part").withColumn("p_brand", F.replace("p_brand", F.lit("#"), F.lit("")))
    used = part.select("p_brand", F.concat(F.col("p_size") % 3, F.lit("."), "p_size", F.lit(".0")).alias("v"), (F.col("p_partkey") % 16).alias("folder"))
    lines = used.distinct().groupBy("folder").agg(F.array_join(F.array_sort(F.collect_set(F.concat("p_brand", F.lit("=="), "v"))), "\n").alias("text"))
    manifests = lines.select(F.concat(F.lit("m"), "folder", F.lit("/requirements.txt")).alias("file_path"), "text")
    advisories = part.select("p_brand").distinct().select(
        F.lit("ADV").alias("advisory_id"), F.lit("PyPI").alias("ecosystem"), F.col("p_brand").alias("package_name"), F.array(F.lit("<2")).alias("vulnerable_versions"), F.lit("Low").alias("severity"), F.lit("Old").alias("summary")
    )
    i = F.col("id")
    exposure = spark.range(6).select(F.concat(F.lit("svc"), i).alias("service"), (i < 3).alias("public"))
    options = ScanOptions(min_severity=least, enrich=True, exposure=exposure, advisories=advisories, context=1)
    found = scan(docs.unionByName(manifests), X.default_rules(spark).where("language is null"), options)
    return found.select("file_path", "rule_id", "line", "severity", "service", "snippet")


@query("scan_exposed_low", _exposed_sql("'Low', 'Medium', 'High', 'Critical'"))
def scan_exposed_low(spark, d):
    """A whole scan of documents and manifests: what exposure lowers below Low goes, and what it raises to Low stays."""
    return _exposed(spark, d, "Low")


@query("scan_exposed_high", _exposed_sql("'High', 'Critical'"))
def scan_exposed_high(spark, d):
    """The same from High on: a Medium finding of a public service is one."""
    return _exposed(spark, d, "High")


FILES = [
    "src/app.js", "src/app.min.js", "src/lib/util.ts", "lib/node_modules/x/index.js", "tests/test_a.py", "app/main.py", "app/main_test.py", "README.md",
    "cmd/server/main.go", "build/out.java", "src/Main.java", "a/b/c.rs", "x.rake", "docs/generated/api.py", "service.spec.ts", "noext", "web/index.php", "k.pyw",
]
LANG_SQL = "CASE regexp_extract(file_path, '[.]([^./]+)$', 1) " + " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in X.EXTENSIONS.items()) + " END"
FILES_SQL = "(VALUES " + ", ".join(f"('{f}')" for f in FILES) + ") f(file_path)"
SKIP_SQL = "regexp_matches(file_path, '(^|/)(node_modules|[.]git|target|dist|build|__pycache__|[.]venv|venv)/')"
EXCL_SQL = """(regexp_matches(file_path, '(^|/)(tests|test|mocks|fixtures|testdata|test-data)/') OR regexp_matches(file_path, '[.](min[.]js|bundle[.]js|map|pyc)$')
  OR regexp_matches(file_path, '_test[.](rs|js|ts|py)$') OR regexp_matches(file_path, '[.]spec[.](ts|js)$') OR regexp_matches(file_path, '[.]test[.](ts|tsx|js|jsx)$')
  OR starts_with(file_path, 'docs/generated/'))"""


def _files(spark):
    return spark.createDataFrame([(f,) for f in FILES], "file_path string")


@query("src1_collect", f"SELECT file_path, {LANG_SQL} AS language FROM {FILES_SQL} WHERE NOT {SKIP_SQL} AND NOT {EXCL_SQL} AND {LANG_SQL} IS NOT NULL")
def src1(spark, d):
    return X.collect(_files(spark), ["docs/generated/**"])


@query(
    "src2_ignored_count",
    f"""SELECT count(*) FILTER (WHERE NOT ({SKIP_SQL} OR {EXCL_SQL})) AS files, count(*) FILTER (WHERE {SKIP_SQL} OR {EXCL_SQL}) AS ignored FROM {FILES_SQL} WHERE {LANG_SQL} IS NOT NULL""",
)
def src2(spark, d):
    return X.collection_counts(_files(spark), ["docs/generated/**"])


@query("src3_language", f"SELECT page_id, {LANG_SQL} AS language FROM (SELECT page_id, url AS file_path FROM pages)")
def src3(spark, d):
    return read(spark, d, "pages").select("page_id", X.language_of("url").alias("language"))


IGNORE = "# build output\n*.log\nout/\n!keep.log\nsrc/gen/*.py\n"


@query(
    "src4_exclusion",
    f"""SELECT file_path, {SKIP_SQL} OR {EXCL_SQL.replace("starts_with(file_path, 'docs/generated/')", "regexp_matches(file_path, '^src/gen/[^/]*[.]py$') OR regexp_matches(file_path, '^out/') OR regexp_matches(file_path, '(^|/)[^/]*[.]log$')")} AS excluded
    FROM (SELECT * FROM {FILES_SQL} UNION ALL VALUES ('a/b.log'), ('out/x.js'), ('src/gen/m.py'), ('src/gen/n/m.py'))""",
)
def src4(spark, d):
    more = spark.createDataFrame([("a/b.log",), ("out/x.js",), ("src/gen/m.py",), ("src/gen/n/m.py",)], "file_path string")
    return _files(spark).union(more).select("file_path", X.is_excluded("file_path", X.ignore_globs(IGNORE)).alias("excluded"))


YAML = """
- id: A1
  name: first
  severity: High
  languages: [Python, Go]
  pattern: 'eval\\('
- id: A1
  name: second
  severity: Low
  languages: [Python]
  pattern: 'exec\\('
- id: B1
  severity: Unheard
  pattern: x
- name: no id
"""


@query("src5_load_rules", "SELECT * FROM (VALUES ('A1', 'Python', 'second', 'Low'), ('A1', 'Go', 'first', 'High')) t(rule_id, language, name, severity)")
def src5(spark, d):
    return X.last_rules(X.load_rules(spark, [YAML, "- ]["])).select("rule_id", "language", "name", "severity")


@query("src6_default_rules", "SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', '{r[2]}')" for r in X.DEFAULT_RULES) + ") t(rule_id, severity)")
def src6(spark, d):
    return X.default_rules(spark).select("rule_id", "severity")


@query(
    "src7_rule_precedence",
    """SELECT concat('R', i) AS rule_id, CASE WHEN i % 3 = 0 THEN 'user' WHEN i % 2 = 0 THEN 'disk' ELSE 'embedded' END AS origin FROM (SELECT unnest(range(12)) AS i)""",
)
def src7(spark, d):
    def layer(name, step, priority):
        return spark.range(0, 12, step).select(F.concat(F.lit("R"), "id").alias("rule_id"), F.lit(None).cast("string").alias("language"), F.lit(name).alias("origin"), F.lit(priority).alias("priority"), F.lit(0).alias("load_order"))

    return X.last_rules(layer("embedded", 1, 0).union(layer("disk", 2, 1)).union(layer("user", 3, 2))).select("rule_id", "origin")


DIFF = ["diff --git a/x.py b/x.py", "--- a/x.py", "+++ b/x.py", "@@ -1,3 +1,4 @@", " a", "+b", "-c", " d", "+e", "@@ -10,2 +11,3 @@ def f", " g", "+h", " i", "--- a/y.js", "+++ b/y.js", "@@ -0,0 +1,2 @@", "+j", "+k"]


@query("src19_changed_lines", "SELECT * FROM (VALUES ('x.py', 2), ('x.py', 4), ('x.py', 12), ('y.js', 1), ('y.js', 2)) t(file_path, line)")
def src19(spark, d):
    diff = spark.createDataFrame([("d", i, t) for i, t in enumerate(DIFF)], "diff_id string, pos int, text string")
    return X.changed_lines(diff)


@query("src20_staged", "SELECT DISTINCT url AS file_path FROM pages WHERE page_id % 4 <> 3 AND page_id % 7 <> 0")
def src20(spark, d):
    """From the index of a repository: status letter, tab, path (renames name the old one first)."""
    k = F.col("page_id")
    letter = F.element_at(F.array(*map(F.lit, ["M", "A", "R100", "D"])), (k % 4 + 1).cast("int"))
    text = F.when(k % 7 == 0, F.lit("")).otherwise(F.concat_ws("\t", letter, F.when(k % 4 == 2, F.lit("old/name.py")), F.col("url")))
    return X.staged_files(read(spark, d, "pages").select(text.alias("text")))


@query("src21_contributors", "SELECT count(DISTINCT user_id) AS contributors FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 90 DAY FROM events)")
def src21(spark, d):
    return X.contributors(read(spark, d, "events").select(F.col("user_id").alias("author"), "ts"))


TREE = [
    ("package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"typescript": "5"}}'), ("yarn.lock", ""), ("pyproject.toml", "[tool.poetry]\ndjango = 4"),
    ("src/a.go", "package a"), ("Cargo.lock", ""),
]


def _tree(spark):
    return spark.createDataFrame(TREE, "file_path string, text string")


@query(
    "src22_technologies",
    """SELECT * FROM (VALUES ('language', 'JavaScript'), ('language', 'TypeScript'), ('language', 'Python'), ('language', 'Go'), ('manager', 'npm'), ('manager', 'yarn'),
    ('manager', 'pip'), ('manager', 'poetry'), ('framework', 'React'), ('framework', 'Django')) t(kind, name)""",
)
def src22(spark, d):
    return X.technologies(_tree(spark))


@query("src23_rule_files", "SELECT * FROM (VALUES ('universal.yaml'), ('python.yaml'), ('react.yaml'), ('npm-deps.yaml')) t(file_name)")
def src23(spark, d):
    have = spark.createDataFrame([(x,) for x in ("universal.yaml", "python.yaml", "ruby.yaml", "react.yaml", "npm-deps.yaml", "npm.yaml")], "file_name string")
    return X.rule_files(X.technologies(_tree(spark)), have)


@query("src23_estimated_rules", "SELECT 5 + 8 * 4 + 6 * 2 AS rules")
def src23b(spark, d):
    return X.estimated_rules(X.technologies(_tree(spark)))


@query(
    "src25_skip_synthetic",
    r"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'kept' WHEN len(ls) >= 2 THEN array_to_string(list_transform(list_slice(ls, 1, 3), lambda x: left(x, 100)), chr(10)) ELSE '' END AS snippet
    FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM documents)""",
)
def src25(spark, d):
    """Snippets taken anew from the text, but not those of dependencies, whose paths are no files."""
    docs = read(spark, d, "documents")
    path = F.when(F.col("doc_id") % 5 == 0, F.lit("<npm/left-pad>")).otherwise(F.concat(F.lit("doc"), "doc_id"))
    rows = docs.select("doc_id", path.alias("file_path"), "text", F.lit(2).alias("line"), F.lit("kept").alias("snippet"))
    return X.refreshed_snippets(rows, 1).select("doc_id", "snippet")


CODE = "import os\n# scan-ignore-next-line\neval(x)\nexec(y)\n"


@query("scan_code", "SELECT * FROM (VALUES ('a.py', 4, 'PY001', 'High', 'exec(')) t(file_path, line, rule_id, severity, snippet)")
def scan_code_query(spark, d):
    return scan_code(spark, CODE, "a.py", X.default_rules(spark)).select("file_path", "line", "rule_id", "severity", "snippet")


@query(
    "scan_documents",
    f"""SELECT doc_id, line_no AS line, rule_id, sha256(concat(rule_id, 'doc', doc_id, '.py', sha256(regexp_extract(line, pattern, 0)))) AS fingerprint
    FROM src_lines, {RULES_SQL} WHERE regexp_matches(line, pattern) AND severity <> 'Info'""",
)
def scan_documents(spark, d):
    from .scan import scan

    docs = read(spark, d, "documents").select(F.concat(F.lit("doc"), "doc_id", F.lit(".py")).alias("file_path"), "text")
    found = scan(docs, X.default_rules(spark).where("language is null"))
    return found.select(F.regexp_extract("file_path", r"(\d+)", 1).cast("long").alias("doc_id"), "line", "rule_id", "fingerprint")


# -- text windows and names --------------------------------------------------------------------------


@query(
    "str1_snippet_window",
    r"""SELECT doc_id, CASE WHEN len(ls) >= 3 THEN array_to_string(list_transform(list_slice(ls, 1, 5), lambda x: left(x, 100)), chr(10)) ELSE '' END AS snippet
    FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM documents)""",
)
def str1(spark, d):
    return read(spark, d, "documents").select("doc_id", D.snippet_window("text", F.lit(3), 2).alias("snippet"))


@query(
    "str2_annotated_window",
    r"""SELECT doc_id, CASE WHEN len(ls) >= 2 THEN array_to_string(list_transform(list_slice(ls, 1, 3), lambda x, i: concat(lpad(CAST(i AS VARCHAR), 4, ' '), CASE WHEN i = 2 THEN ' >> ' ELSE '    ' END, x)), chr(10)) ELSE '' END AS snippet
    FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM documents)""",
)
def str2(spark, d):
    return read(spark, d, "documents").select("doc_id", D.annotated_window("text", F.lit(2), 1).alias("snippet"))


_PART_PATH = """CASE p_partkey % 10 WHEN 0 THEN concat('services/', p_brand, '/src/a.py') WHEN 1 THEN concat('./apps/Web', p_size, '/x.js') WHEN 2 THEN concat('api', p_size, '/handler.go')
    WHEN 3 THEN concat('Main', p_size, '.py') WHEN 4 THEN concat('src/packages/UI', p_size, '/a.ts') WHEN 5 THEN 'src/auth/mod.rs' WHEN 6 THEN concat('modules/Pay', p_size, '/x.py')
    WHEN 7 THEN concat('src/lib/cmd/', p_size, '.test.js') WHEN 8 THEN concat('lib/v1.2/Core', p_size, '/m.py') ELSE 'internal/services' END"""


@query(
    "str3_service_name",
    f"""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN lower(p_brand) WHEN 1 THEN concat('web', p_size) WHEN 2 THEN concat('api', p_size) WHEN 3 THEN concat('main', p_size)
    WHEN 4 THEN concat('ui', p_size) WHEN 5 THEN 'auth' WHEN 6 THEN concat('pay', p_size) WHEN 7 THEN concat(p_size, '.test') WHEN 8 THEN concat('core', p_size) ELSE 'services' END AS service FROM part""",
)
def str3(spark, d):
    return read(spark, d, "part").select("p_partkey", D.service_name(F.expr(" ".join(_PART_PATH.split()))).alias("service"))


@query(
    "str7_comment_body",
    r"""SELECT doc_id, line_no, trim(regexp_replace(regexp_extract(line, '(?://|#)(.*)$', 1), '^[/#!\s]+', '')) AS body FROM src_lines WHERE regexp_matches(line, '//|#')""",
)
def str7(spark, d):
    return src_lines(spark, d).where(F.col("line").rlike("//|#")).select("doc_id", "line_no", D.comment_body("line").alias("body"))


@query(
    "str8_owasp_alias",
    """SELECT * FROM (VALUES ('A03', 'A03'), ('a03:2021', 'A03'), ('Injection', 'A03'), ('A03_Injection', 'A03'), ('security misconfiguration', 'A05'), ('other', NULL)) t(text, code)""",
)
def str8(spark, d):
    rows = [(x,) for x in ("A03", "a03:2021", "Injection", "A03_Injection", "security misconfiguration", "other")]
    return spark.createDataFrame(rows, "text string").select("text", D.owasp_code("text").alias("code"))


@query("str10_trace_step", "SELECT event_id, concat(printf('%.3f', value), 's: ', event_type) AS step FROM events")
def str10(spark, d):
    return read(spark, d, "events").select("event_id", D.trace_step("value", "event_type").alias("step"))


@query("str11_lines", "SELECT doc_id, line_no, line FROM src_lines")
def str11(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(D.lines_of("text")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


@query(
    "snk4_display_snippet",
    """SELECT doc_id, array_to_string(list_concat(list_transform(list_slice(ls, 1, 2), lambda x: CASE WHEN length(x) > 40 THEN concat(left(x, 40), '…') ELSE x END),
    CASE WHEN len(ls) > 2 THEN [concat('… (', len(ls) - 2, ' more lines)')] ELSE [] END), chr(10)) AS shown FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""",
)
def snk4(spark, d):
    return read(spark, d, "documents").select("doc_id", D.display_snippet("text", 2, 40).alias("shown"))


# -- scores ------------------------------------------------------------------------------------------

_FLAGS = ["has_path", "user_controlled", "predicates", "api", "framework", "sanitized", "validated", "in_test", "dead"]


@query(
    "sco1_confidence",
    """SELECT k, least(greatest(0.4 * (CASE WHEN p AND u THEN 1.0 WHEN p THEN 0.8 ELSE 0.2 END)
      + 0.3 * least(0.3 + 0.1 * least(k % 9, 5) + (CASE WHEN k % 2 = 0 THEN 0.1 ELSE 0 END) + (CASE WHEN k % 3 = 0 THEN 0.15 ELSE 0 END) + (CASE WHEN k % 5 = 0 THEN 0.1 ELSE 0 END), 1)
      + 0.3 * greatest(1 - (CASE WHEN k % 7 = 0 THEN 0.4 ELSE 0 END) - (CASE WHEN k % 11 = 0 THEN 0.3 ELSE 0 END) - (CASE WHEN k % 13 = 0 THEN 0.3 ELSE 0 END) - (CASE WHEN k % 17 = 0 THEN 0.5 ELSE 0 END), 0), 0), 1)::DOUBLE AS score
    FROM (SELECT p_partkey AS k, p_partkey % 4 = 0 AS p, p_partkey % 8 = 0 AS u FROM part)""",
)
def sco1(spark, d):
    k = F.col("k")
    mods = dict(zip(_FLAGS, (4, 8, 2, 3, 5, 7, 11, 13, 17)))
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("k"))
    rows = rows.select("k", (k % 9).alias("nodes"), *[(k % m == 0).alias(f) for f, m in mods.items()])
    return S.scored(rows).select("k", F.col("confidence_score").alias("score"))


@query("sco5_goldens", "SELECT * FROM (VALUES ('generic', '50%'), ('taint', '96%')) t(name, shown)")
def sco5(spark, d):
    cols = "name string, nodes int, " + ", ".join(f"{f} boolean" for f in _FLAGS)
    rows = [("generic", 1, *[False] * 9), ("taint", 3, True, True, True, True, False, *[False] * 4)]
    return S.scored(spark.createDataFrame(rows, cols)).select("name", S.percent(F.round("confidence_score", 9)).alias("shown"))


@query(
    "sco6_exposed_severity",
    """SELECT finding_id, CASE WHEN line % 3 = 0 THEN 'Critical' WHEN line % 3 = 1 THEN CASE severity WHEN 'Critical' THEN 'High' WHEN 'High' THEN 'Medium' WHEN 'Medium' THEN 'Low' ELSE 'Info' END ELSE severity END AS severity FROM stored_findings""",
)
def sco6(spark, d):
    from .standins import stored_findings

    public = F.when(F.col("line") % 3 == 0, True).when(F.col("line") % 3 == 1, False)
    return stored_findings(spark, d).select("finding_id", S.exposed_severity("severity", public).alias("severity"))


@query("sco7_k8s_public", "SELECT * FROM (VALUES ('a', true), ('b', false), ('c', true), ('d', true), ('e', false)) t(name, public)")
def sco7(spark, d):
    rows = [("a", "ClusterIP", True), ("b", "ClusterIP", False), ("c", "LoadBalancer", None), ("d", "NodePort", False), ("e", None, None)]
    return spark.createDataFrame(rows, "name string, kind string, ingress boolean").select("name", S.k8s_public("kind", "ingress").alias("public"))


_RULE_IDS = ["py-sql-injection", "go-SQLi", "use-sql-parameter", "js-xss", "cross-site-x", "command-string-inject", "cmd-inject", "path-traversal", "path-join", "ssrf-x", "unsafe-yaml", "pickle-x", "hard-coded-key", "secret-in-source", "open-redirect", "xxe", "weak-md5"]
_RULE_CLASS = ["sql_injection", "unknown", "unknown", "xss", "xss", "command_injection", "command_injection", "path_traversal", "unknown", "ssrf", "insecure_deserialization", "insecure_deserialization", "hardcoded_credentials", "hardcoded_credentials", "open_redirect", "xxe", "unknown"]
_CWES = {"CWE-89": "sql_injection", "cwe-79": "xss", "78": "command_injection", "CWE-22 ": "path_traversal", "CWE-918": "ssrf", "CWE-502": "insecure_deserialization", "CWE-798": "hardcoded_credentials", "CWE-601": "open_redirect", "CWE-611": "xxe", "CWE-327": None, "CWE-80": None}


def _values(xs):
    return ", ".join("({}, {})".format(k, "NULL" if x is None else f"'{x}'") for k, x in enumerate(xs))


@query(
    "sco9_vulnerability_class",
    f"""SELECT p_partkey, coalesce(c.class, r.class) AS class FROM part JOIN (VALUES {_values(_RULE_CLASS)}) r(k, class) ON r.k = p_partkey % {len(_RULE_IDS)}
    LEFT JOIN (VALUES {_values(_CWES.values())}) c(k, class) ON c.k = p_partkey % 29""",
)
def sco9(spark, d):
    """By CWE where it names a class (also in other spellings), else by the rule id."""
    k = F.col("p_partkey")
    pick = lambda xs, n: F.try_element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    rule = F.replace(pick(_RULE_IDS, len(_RULE_IDS)), F.lit("go-SQLi"), F.lit("go-SQL-x"))
    return read(spark, d, "part").select("p_partkey", S.vulnerability_class(pick(list(_CWES), 29), rule).alias("class"))


@query(
    "rem1_patched_line",
    """SELECT * FROM (VALUES (1, '  h = hashlib.sha256(x)'), (2, 'el.textContent = y'), (3, NULL), (4, 'get(u, verify=True)')) t(k, patched)""",
)
def rem1(spark, d):
    rows = [(1, "  h = hashlib.md5(x)", "strong-hash"), (2, "el.innerHTML = y", "text-content"), (3, "x = 1", "safe-yaml"), (4, "get(u, verify=False)", "verify-tls")]
    return spark.createDataFrame(rows, "k int, line string, template string").select("k", S.patched_line("line", "template").alias("patched"))
