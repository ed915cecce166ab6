"""Tables of the code-security domain derived from the star-schema test tables, in Spark and in SQL.

Each stand-in is a Spark builder here and a CTE of the same name in ``CTES``, so that a query and its
oracle start from the same rows. ``with_ctes`` prefixes a SQL text with the CTEs that it names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of stand-ins that were written before, by (table folder, name): a bench then times operators alone.
PREPARED: dict[tuple[str, str], str] = {}


def stored_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with triage state, one per (order, line number); ties fall to the smallest row."""
    if (sf_dir, "stored_findings") in PREPARED:
        return spark.read.parquet(PREPARED[sf_dir, "stored_findings"])
    return dressed(finding_facts(spark, sf_dir))


def project_of() -> Column:
    return F.concat(F.lit("p-"), F.col("o_custkey") % 40).alias("project_id")


#: What findings are made of; their texts are many times as long.
FACTS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "o_custkey", "o_orderpriority", "o_orderdate"]


def finding_facts(spark: SparkSession, sf_dir: str, part: tuple[int, int] | None = None) -> DataFrame:
    """Lines with their orders, one per (order, line number); of all orders, or of a part (number, of how many)."""
    # in the order of ties; what comes after the last one that is used decides nothing
    keys = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    # laid out by order once, for the lines and for the join
    own = lambda key: F.lit(True) if part is None else F.pmod(key, F.lit(part[1])) == part[0]
    lines = (
        read(spark, sf_dir, "lineitem").where(own("l_orderkey")).select("l_orderkey", "l_linenumber", *keys).repartition("l_orderkey")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min(F.struct(*keys)).alias("v"))
        .select("l_orderkey", "l_linenumber", "v.*")
    )
    o = read(spark, sf_dir, "orders").where(own("o_orderkey")).select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def dressed(facts: DataFrame) -> DataFrame:
    """The findings that facts stand for."""
    flag = F.concat("l_returnflag", "l_linestatus")
    state = (
        F.when(flag == "AF", "Fixed")
        .when(flag == "AO", "AutoFixed")
        .when(flag == "NF", "Ignored")
        .when(flag == "NO", "Open")
        .when(flag == "RF", "AutoIgnored")
        .when(F.col("l_linenumber") % 2 == 0, "Reviewing")
        .otherwise("ToFix")
    )
    severity = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Critical")
        .when(F.col("o_orderpriority") == "2-HIGH", "High")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Medium")
        .when(F.col("o_orderpriority") == "5-LOW", "Low")
        .otherwise("Info")
    )
    key = F.col("l_partkey")
    return facts.select(
        F.concat(F.lit("f-"), "l_orderkey", F.lit("-"), "l_linenumber").alias("finding_id"),
        F.concat(F.lit("s-"), "l_orderkey").alias("scan_id"),
        project_of(),
        F.concat(F.lit("o-"), F.col("o_custkey") % 4).alias("org_id"),
        F.concat(F.lit("rule-"), key % 40).alias("rule_id"),
        F.concat(F.lit("src/mod"), F.col("l_suppkey") % 25, F.lit("/file"), key % 60, F.lit(".py")).alias("file_path"),
        F.floor("l_quantity").cast("int").alias("line"),
        F.col("l_linenumber").alias("column_num"),
        F.concat(F.lit("call_"), key, F.lit("(x)")).alias("snippet"),
        severity.alias("severity"),
        ((key % 101).cast("double") / 100.0).alias("confidence_score"),
        (key % 3 == 0).alias("reachable"),
        F.when(key % 11 != 0, F.concat(F.lit("A"), F.lpad((key % 10 + 1).cast("string"), 2, "0"))).alias("owasp_category"),
        state.alias("triage_state"),
        F.col("o_orderdate").alias("created_at"),
        F.expr("timestampadd(HOUR, cast(l_partkey % 720 as int), o_orderdate)").alias("updated_at"),
        (key % 720).alias("open_hours"),
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with duration, files and a list of languages."""
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("s-"), key).alias("scan_id"),
        F.concat(F.lit("p-"), F.col("o_custkey") % 40).alias("project_id"),
        F.concat(F.lit("o-"), F.col("o_custkey") % 4).alias("org_id"),
        F.concat(F.lit("repo-"), F.col("o_custkey") % 40).alias("repository"),
        F.when(key % 3 == 0, "main").otherwise("dev").alias("branch"),
        F.col("o_orderdate").alias("ts"),
        F.floor("o_totalprice").cast("long").alias("duration_ms"),
        (key % 500 + 1).alias("files_scanned"),
        F.filter(
            F.array(F.lit("py"), F.when(key % 2 == 0, "js"), F.when(key % 3 == 0, "go")), lambda x: x.isNotNull()
        ).alias("languages"),
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty projects, of which every seventh is absent so that fallbacks are exercised."""
    return (
        spark.range(40)
        .where("id % 7 <> 6")
        .select(
            F.concat(F.lit("p-"), "id").alias("project_id"),
            F.concat(F.lit("o-"), F.col("id") % 4).alias("org_id"),
            F.concat(F.lit("Project "), "id").alias("name"),
            F.concat(F.lit("https://git.example.com/r"), "id").alias("repository_url"),
            F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") % 2 == 0).alias("sca_enabled"),
            F.concat(F.lit("t-"), F.col("id") % 6).alias("team_id"),
            F.when(F.col("id") % 4 == 0, "pending").otherwise("active").alias("provisioning"),
            (F.col("id") * 37 % 100).alias("created_seq"),
        )
    )


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency triples."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("dep_id"),
        F.when(key % 3 == 0, "npm").when(key % 3 == 1, "PyPI").otherwise("crates.io").alias("ecosystem"),
        F.col("p_brand").alias("package_name"),
        F.concat(F.col("p_size") % 5, F.lit("."), "p_size", F.lit("."), key % 10).alias("version"),
    )


def src_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source lines: (doc_id, source, line_no, line)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.select(
        "doc_id", "source", F.posexplode(F.split(F.regexp_replace("text", "\n$", ""), "\n")).alias("pos", "line")
    ).select("doc_id", "source", (F.col("pos") + 1).alias("line_no"), "line")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call graph edges between functions 0..n-1."""
    n = read(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    return (
        read(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n))
        .select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") % F.col("n")).alias("dst"))
        .where("src <> dst")
        .distinct()
    )


#: Lines with and without directives; @ stands for a rule.
FORMS = [
    "x = 1  # scan-ignore", "eval(x)", "# scan-ignore-next-line: anything", "// scan-ignore:@", "#scan-ignore: @ ", "eval(r) // not a scan-ignored line",
    "// scan-ignore legacy reason", "<!-- scan-ignore -->", "/* scan-ignore-next-line */", "<!-- scan-ignore:@ -->", "call(y)  // scan-ignore:@",
    "scan-ignore", "# scan-ignore-secret", "token = 1  # scan-ignore-secret: known", "s = 'scan-ignore-secret'", "/* scan-ignore:@", "# see scan-ignore:@", "",
]
_FORM_ROWS = ", ".join("({}, '{}')".format(k, x.replace("'", "''")) for k, x in enumerate(FORMS))
#: Python files; @ stands for the file's number.
CODE = [
    "import os\n\ndef run@(request):\n    os.system('ls ' + request.path)\n", "def f@(x):\n    return eval(x)\n", "# eval(x)\ntext = 'os.system(y)'\n",
    "import hashlib\nfor a in b:\n    c(hashlib.md5(a), hashlib.md5(b))\n", "def broken@(:\n    eval(x)\n", "try:\n    open('/a/%s' % name)\nexcept:\n    pass\n",
    "def safe@(db, k):\n    db.execute('SELECT %s', (k,))\n", "def bad@(db, k):\n    db.execute(f'SELECT {k}')  # scan-ignore\n    db.execute(f'DELETE {k}')\n",
]
#: Files of languages of brackets: extension and text; @ stands for the file's number.
MIXED = [
    ("js", "const db = require('./db');\nfunction run@(req, res) {\n  db.query(`SELECT ${req.query.id}`);\n  res.redirect(req.query.next);\n}\n"),
    ("ts", "export const apiKey: string = load@();\nlet token: string = 'hunter2hunter';\nbox.innerHTML = body;\n"),
    ("go", 'package a\n\nimport (\n\t"fmt"\n\t"math/rand"\n)\n\nfunc Get@(db DB, name string) {\n\tdb.Query(fmt.Sprintf("SELECT %s", name))\n}\n'),
    ("java", "class A@ {\n  void run(String cmd) {\n    Runtime.getRuntime().exec(cmd);\n    // Runtime.getRuntime().exec(cmd);\n  }\n}\n"),
    ("rs", 'fn run@(cmd: &str) {\n    Command::new("sh").arg("-c").arg(cmd);\n}\n'),
    ("rb", "eval(x)\n"),
    ("js", "const s = 'eval(x)'; // eval(x)\nconst r = /eval(x)/;\nfunction eval(x) {\n  return x@;\n}\n"),
]


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, line_no, line) with directives of all forms."""
    k = F.col("p_partkey")
    form = F.element_at(F.array(*map(F.lit, FORMS)), (k % len(FORMS) + 1).cast("int"))
    line = F.replace(form, F.lit("@"), F.concat(F.lit("rule-"), k % 7))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("src/f"), k % 40, F.lit(".py")).alias("file_path"), F.expr("cast(p_partkey div 40 + 1 as int)").alias("line_no"), line.alias("line"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, text, k) of small Python files."""
    k = F.col("p_partkey")
    text = F.replace(F.element_at(F.array(*map(F.lit, CODE)), (k % len(CODE) + 1).cast("int")), F.lit("@"), k.cast("string"))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("src/svc"), k % 9, F.lit("/f"), k, F.lit(".py")).alias("file_path"), text.alias("text"), k.alias("k"))


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, text) of small files of several languages."""
    k = F.col("p_partkey")
    form = F.element_at(F.array(*[F.struct(F.lit(e).alias("ext"), F.lit(t).alias("text")) for e, t in MIXED]), (k % len(MIXED) + 1).cast("int"))
    return read(spark, sf_dir, "part").select(F.concat(F.lit("src/f"), k, F.lit("."), form["ext"]).alias("file_path"), F.replace(form["text"], F.lit("@"), k.cast("string")).alias("text"))


CTES = {
    "stored_findings": """
  SELECT concat('f-', l_orderkey, '-', l_linenumber) AS finding_id, concat('s-', l_orderkey) AS scan_id,
    concat('p-', o_custkey % 40) AS project_id, concat('o-', o_custkey % 4) AS org_id, concat('rule-', l_partkey % 40) AS rule_id,
    concat('src/mod', l_suppkey % 25, '/file', l_partkey % 60, '.py') AS file_path,
    CAST(floor(l_quantity) AS INT) AS line, l_linenumber AS column_num, concat('call_', l_partkey, '(x)') AS snippet,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
      WHEN '5-LOW' THEN 'Low' ELSE 'Info' END AS severity,
    CAST(l_partkey % 101 AS DOUBLE) / 100.0 AS confidence_score, l_partkey % 3 = 0 AS reachable,
    CASE WHEN l_partkey % 11 <> 0 THEN concat('A', lpad(CAST(l_partkey % 10 + 1 AS VARCHAR), 2, '0')) END AS owasp_category,
    CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'Fixed' WHEN 'AO' THEN 'AutoFixed' WHEN 'NF' THEN 'Ignored'
      WHEN 'NO' THEN 'Open' WHEN 'RF' THEN 'AutoIgnored' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'Reviewing' ELSE 'ToFix' END END AS triage_state,
    o_orderdate AS created_at, o_orderdate + to_hours(CAST(l_partkey % 720 AS INT)) AS updated_at, l_partkey % 720 AS open_hours
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity,
          l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey WHERE rn = 1""",
    "scans": """
  SELECT concat('s-', o_orderkey) AS scan_id, concat('p-', o_custkey % 40) AS project_id, concat('o-', o_custkey % 4) AS org_id,
    concat('repo-', o_custkey % 40) AS repository, CASE WHEN o_orderkey % 3 = 0 THEN 'main' ELSE 'dev' END AS branch,
    o_orderdate AS ts, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms, o_orderkey % 500 + 1 AS files_scanned,
    list_filter(['py', CASE WHEN o_orderkey % 2 = 0 THEN 'js' END, CASE WHEN o_orderkey % 3 = 0 THEN 'go' END], lambda x: x IS NOT NULL) AS languages
  FROM orders""",
    "projects": """
  SELECT concat('p-', id) AS project_id, concat('o-', id % 4) AS org_id, concat('Project ', id) AS name,
    concat('https://git.example.com/r', id) AS repository_url, CASE WHEN id % 5 <> 0 THEN id % 2 = 0 END AS sca_enabled,
    concat('t-', id % 6) AS team_id, CASE WHEN id % 4 = 0 THEN 'pending' ELSE 'active' END AS provisioning, id * 37 % 100 AS created_seq
  FROM (SELECT unnest(range(40)) AS id) WHERE id % 7 <> 6""",
    "deps": """
  SELECT p_partkey AS dep_id, CASE p_partkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' ELSE 'crates.io' END AS ecosystem,
    p_brand AS package_name, concat(p_size % 5, '.', p_size, '.', p_partkey % 10) AS version FROM part""",
    "src_lines": """
  SELECT doc_id, source, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line
  FROM (SELECT doc_id, source, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents)""",
    "call_edges": """
  SELECT DISTINCT l_partkey AS src, l_orderkey % (SELECT count(*) FROM part) AS dst FROM lineitem
  WHERE l_partkey <> l_orderkey % (SELECT count(*) FROM part)""",
    "marked_lines": f"""
  SELECT concat('src/f', p_partkey % 40, '.py') AS file_path, CAST(p_partkey // 40 + 1 AS INT) AS line_no, replace(form, '@', concat('rule-', p_partkey % 7)) AS line
  FROM part JOIN (VALUES {_FORM_ROWS}) t(k, form) ON k = p_partkey % {len(FORMS)}""",
    "code_files": f"""
  SELECT concat('src/svc', p_partkey % 9, '/f', p_partkey, '.py') AS file_path, p_partkey % {len(CODE)} AS form, p_partkey AS k FROM part""",
    "mixed_files": f"""
  SELECT concat('src/f', p_partkey, '.', ext) AS file_path, k AS form
  FROM part JOIN (VALUES {", ".join(f"({k}, '{e}')" for k, (e, _) in enumerate(MIXED))}) t(k, ext) ON k = p_partkey % {len(MIXED)}""",
}


#: SQL of a finding's number and fingerprint, and of the upsert of a scan into stored findings.
NUM = "CAST(regexp_extract(finding_id, 'f-(\\d+)-', 1) AS BIGINT)"
FP = "sha256(concat(rule_id, file_path, sha256(snippet)))"
def upserts(*payloads: str) -> str:
    """CTEs st0, st1, ..: stored findings, and after each payload (a condition on rows_) came in, one after another."""
    out = f"""rows_ AS (SELECT *, {FP} AS fingerprint, {NUM} AS num FROM stored_findings),
  st0 AS (SELECT finding_id, project_id, fingerprint, line, severity, triage_state, rule_id, file_path, created_at, updated_at FROM rows_ WHERE num % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY finding_id) = 1)"""
    for k, payload in enumerate(payloads):
        out += f""",
  inc{k} AS (SELECT *, min(finding_id) OVER (PARTITION BY project_id, fingerprint) AS first_id FROM rows_ WHERE {payload}
    QUALIFY row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY finding_id DESC) = 1),
  sc{k} AS (SELECT DISTINCT project_id, true AS was FROM inc{k}),
  st{k + 1} AS (SELECT coalesce(s.finding_id, i.first_id) AS finding_id, coalesce(s.project_id, i.project_id) AS project_id, coalesce(s.fingerprint, i.fingerprint) AS fingerprint,
    CASE WHEN i.finding_id IS NOT NULL THEN i.line ELSE s.line END AS line, CASE WHEN i.finding_id IS NOT NULL THEN i.severity ELSE s.severity END AS severity,
    CASE WHEN s.finding_id IS NULL THEN 'Open' WHEN i.finding_id IS NOT NULL AND s.triage_state = 'AutoFixed' THEN 'Open'
      WHEN i.finding_id IS NULL AND coalesce(was, false) AND s.triage_state NOT IN ('Fixed','AutoFixed','Ignored','AutoIgnored') THEN 'AutoFixed' ELSE s.triage_state END AS triage_state,
    coalesce(s.rule_id, i.rule_id) AS rule_id, coalesce(s.file_path, i.file_path) AS file_path, CASE WHEN s.finding_id IS NULL THEN TIMESTAMP '1999-01-01' ELSE s.created_at END AS created_at,
    CASE WHEN i.finding_id IS NOT NULL OR (coalesce(was, false) AND s.triage_state NOT IN ('Fixed','AutoFixed','Ignored','AutoIgnored')) THEN TIMESTAMP '1999-01-01' ELSE s.updated_at END AS updated_at
    FROM st{k} s FULL JOIN inc{k} i ON s.project_id = i.project_id AND s.fingerprint = i.fingerprint LEFT JOIN sc{k} ON sc{k}.project_id = coalesce(s.project_id, i.project_id))"""
    return out


STATE = "finding_id, project_id, fingerprint, line, severity, triage_state"
UPSERT = f"""WITH {upserts("num % 3 <> 1 AND project_id < 'p-3'")} SELECT {STATE} FROM st1"""
#: Three payloads, one after another.
PAYLOADS = ["num % 3 <> 1 AND project_id < 'p-3'", "num % 5 <> 2 AND project_id < 'p-2'", "num % 7 < 4 AND project_id >= 'p-15'"]


def with_ctes(sql: str, recursive: bool = False) -> str:
    """sql with the stand-ins that it names as CTEs before it."""
    used = [name for name in CTES if re.search(rf"\b{name}\b", sql)]
    body = ",\n".join(f"{name} AS ({CTES[name]}\n)" for name in used)
    sql = sql.strip()
    if not used:
        return sql
    lead = "WITH RECURSIVE" if recursive else "WITH"
    if sql.upper().startswith("WITH "):
        rest = re.sub(r"(?i)^WITH\s+(RECURSIVE\s+)?", "", sql)
        return f"{lead} {body},\n{rest}"
    return f"{lead} {body}\n{sql}"
