"""Operators on small inputs of their own: edges that the registered queries do not reach."""

from pyspark.sql import functions as F

from sievework.functions import domain as D
from sievework.functions import versions as V
from sievework.operators import cache, filters, graph, mutations, scoring
from sievework.plans import scan as P
from sievework.sources import files as S
from sievework.sources import sinks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_identities(spark):
    assert one(spark, D.dedup_fingerprint("p", "r", "f"), p="p", r="r", f="f") == "dedup:183a2981"
    assert one(spark, D.memory_key("s"), s="  a \n\t b ") == "a b"
    assert one(spark, D.context_hash("c", "s"), c="k", s="A b") == one(spark, D.context_hash("c", "s"), c="k", s="a\nB")


def test_lines_and_windows(spark):
    assert one(spark, D.lines_of("t"), t="a\r\nb\n") == ["a", "b"]
    assert one(spark, D.lines_of("t"), t="") == []
    assert one(spark, D.snippet_window("t", F.lit(9)), t="a\nb") == ""
    assert one(spark, D.snippet_window("t", F.lit(1), 99), t="\n".join("abcdefghijklmnop")) == "\n".join("abcdefghijk")


def test_severity_order(spark):
    rows = spark.createDataFrame([(s,) for s in ("Low", "Critical", "Info", "odd")], "severity string")
    assert {r.severity for r in filters.min_severity(rows, "Low").collect()} == {"Low", "Critical"}


def test_globs():
    import re

    cases = {("**/a.py", "a.py"): True, ("**/a.py", "x/y/a.py"): True, ("a/*.py", "a/b/c.py"): False, ("a/**", "a/b/c"): True, ("?.js", "ab.js"): False, ("[!x]*.c", "xa.c"): False}
    assert all(bool(re.match(filters.glob_to_regex(g), p)) == want for (g, p), want in cases.items())


def test_empty_scan_resolves_nothing(spark):
    from sievework.plans import history

    stored = history._stored(spark, "/root/testdata/sf0.001")
    incoming = history._incoming(spark, "/root/testdata/sf0.001").where("false")
    out = mutations.upsert_scan(stored, incoming, history.now())
    same = out.join(stored.select("finding_id", F.col("triage_state").alias("s")), "finding_id").where("triage_state <> s").count()
    assert same == 0 and out.count() == stored.count()


def test_upsert_is_idempotent(spark):
    from sievework.plans import history

    stored, incoming = history._stored(spark, "/root/testdata/sf0.001"), history._incoming(spark, "/root/testdata/sf0.001")
    once = mutations.upsert_scan(stored, incoming, history.now())
    twice = mutations.upsert_scan(once, incoming, history.now())
    cols = ["finding_id", "triage_state", "line", "severity"]
    assert sorted(map(tuple, once.select(*cols).collect())) == sorted(map(tuple, twice.select(*cols).collect()))


def test_versions(spark):
    for text, want in {"v1.2.3-rc+5": (1, 2, 3), "1.2": None, "a.b.c": None, " 1.0.0 ": (1, 0, 0)}.items():
        got = one(spark, V.parse_version("v"), v=text)
        assert (tuple(got) if got else None) == want


def test_scan_options(spark):
    files = spark.createDataFrame([("a.py", "eval(1)\nexec(2)\n"), ("b.py", "eval(3)"), ("tests/c.py", "eval(4)"), ("d.js", "eval(5); x.innerHTML = 1")], "file_path string, text string")
    rules = S.default_rules(spark)
    found = lambda **o: sorted((r.file_path, r.line, r.rule_id) for r in P.scan(files, rules, P.ScanOptions(**o)).collect())
    assert found() == [("a.py", 1, "PY001"), ("a.py", 2, "PY001"), ("b.py", 1, "PY001"), ("d.js", 1, "JS001")]
    assert found(include=["a*"]) == [("a.py", 1, "PY001"), ("a.py", 2, "PY001")]
    assert found(exclude_rules=["PY001"]) == [("d.js", 1, "JS001")]
    assert found(min_severity="Critical") == []
    changed = spark.createDataFrame([("a.py", 2)], "file_path string, line int")
    assert found(changed=changed) == [("a.py", 2, "PY001")]
    assert found(staged=changed.select("file_path")) == [("a.py", 1, "PY001"), ("a.py", 2, "PY001")]


def test_read_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("eval(1)\n")
    (tmp_path / "src/node_modules").mkdir()
    (tmp_path / "src/node_modules/b.js").write_text("x")
    files = S.collect(S.read_tree(spark, str(tmp_path / "src")))
    assert [r.text for r in files.collect()] == ["eval(1)\n"]


def test_cache_tables(spark):
    entries = spark.createDataFrame([("h1", "r1", "py"), ("h2", "r1", "js")], "file_hash string, rule_set_hash string, language string")
    new = spark.createDataFrame([("h2", "r1", "ts"), ("h3", "r1", "py")], entries.schema)
    assert sorted(tuple(r) for r in cache.put(entries, new).collect()) == [("h1", "r1", "py"), ("h2", "r1", "ts"), ("h3", "r1", "py")]
    files = spark.createDataFrame([("h1",), ("h9",)], "file_hash string")
    assert [r.file_hash for r in cache.misses(files, entries, "r1").collect()] == ["h9"]
    at = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-02 12:00:00")], "k string, t string").withColumn("cached_at", F.col("t").cast("timestamp"))
    assert [r.k for r in cache.stale(at, F.lit("2024-01-02 13:00:00")).collect()] == ["a"]


def test_graph_cycle_and_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (5, 6)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert sorted(r.node for r in graph.reachable(edges, seeds).collect()) == [1, 2, 3]
    assert {r.node: r.path for r in graph.shortest_paths(edges, seeds).collect()} == {1: [1], 2: [1, 2], 3: [1, 3]}


def test_goldens(spark):
    low = scoring.confidence(scoring.reach_score(F.lit(False), F.lit(False)), scoring.pattern_score(F.lit(1), F.lit(False), F.lit(False), F.lit(False)), scoring.context_score(*[F.lit(False)] * 4))
    high = scoring.confidence(scoring.reach_score(F.lit(True), F.lit(True)), scoring.pattern_score(F.lit(3), F.lit(True), F.lit(True), F.lit(False)), scoring.context_score(*[F.lit(False)] * 4))
    assert abs(one(spark, low) - 0.5) < 1e-9 and abs(one(spark, high) - 0.955) < 1e-9


def test_sarif_document_and_csv(spark, tmp_path):
    import json

    rows = [("f1", "R2", "b.py", 2, 1, "x,\"y\"", "High"), ("f2", "R1", "a.py", 1, 1, None, "Info")]
    df = spark.createDataFrame(rows, "finding_id string, rule_id string, file_path string, line int, column_num int, snippet string, severity string")
    log = json.loads(sinks.sarif_log(df).first().json)
    assert [r["id"] for r in log["runs"][0]["tool"]["driver"]["rules"]] == ["R1", "R2"] and log["version"] == "2.1.0"
    assert [(r["ruleId"], r["ruleIndex"], r["level"]) for r in log["runs"][0]["results"]] == [("R2", 1, "error"), ("R1", 0, "note")]
    sinks.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert len(back.columns) == 22 and {r.snippet for r in back.collect()} == {'x,"y"', None}


def test_markdown_report(spark):
    from sievework.operators import analytics

    df = spark.createDataFrame([("A03", "High")], "owasp_category string, severity string")
    text = sinks.owasp_markdown(analytics.owasp_report(df))
    assert text.count("\n") == 12 and "| A03 | Injection | 1 | 0 | 1 |" in text


def test_entry_imports_without_the_corpus_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "sievework", tmp_path / "sievework", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_directives(spark):
    cases = {
        "x = 1  # scan-ignore": "*", "// scan-ignore legacy reason": "*", "<!-- scan-ignore -->": "*", "/* scan-ignore-next-line */": "*", "# scan-ignore:R1": "R1", "<!-- scan-ignore: R 2 -->": "R 2",
        "# scan-ignore-secret": None, "scan-ignore": None, "# see scan-ignore:R1": None, "f()  // scan-ignore:R1": "R1", "# scan-ignore:": None, "  #scan-ignore-next-line: R1": "*",
    }
    rows = spark.createDataFrame([(x,) for x in cases], "line string")
    assert {r.line: r.ignores for r in filters.with_directive(rows).collect()} == cases


def test_positions_and_neighbours_of_one_hot_group(spark):
    from sievework.operators import ordering

    rows = spark.range(5000).selectExpr("id", "'g' as g", "(id * 7919) % 5000 as k").repartition(7)
    got = {r.id: r.position for r in ordering.positions(rows, ["g"], [F.col("k")]).collect()}
    assert all(got[i] == (i * 7919) % 5000 + 1 for i in range(5000))


def test_changes_of_records(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id int, name string, team string")
    changes = spark.createDataFrame([(1, 1, "upsert", "A"), (2, 2, "delete", None), (3, 3, "delete", None), (3, 4, "upsert", "C"), (4, 5, "upsert", "D"), (5, 6, "delete", None)], "id int, seq int, op string, name string")
    assert sorted(tuple(r) for r in mutations.apply_changes(table, changes, ["id"]).collect()) == [(1, "A", "x"), (3, "C", "z"), (4, "D", None)]


def test_tree_patterns_report_once_a_line(spark):
    import json

    from sievework.sources import trees

    find = lambda p, code: [x[1:] for x in trees.Patterns([("R", json.dumps(p))]).find(code)]
    assert find({"node": "call", "eq": {"callee": "a.b"}}, "a.b(1); a.b(2)\nc.a.b(3)\n\nif x:\n  a.b(\n 4)") == [(1, 1, "a.b(1)"), (5, 3, "a.b(\n 4)")]
    assert find({"node": "call", "eq": {"callee": "f"}, "kind": {"arg0": ["fstring"]}}, "f(f'{x}')\nf(f'x')\nf('x')") == [(1, 1, "f(f'{x}')")]
    assert find({"node": "import", "match": {"module": "^os$"}}, "import os, sys\nfrom os import path") == [(1, 1, "import os, sys"), (2, 1, "from os import path")]
    assert find({"node": "call", "eq": {"callee": "f"}}, "f(") == []


def test_expressions_of_bracket_languages():
    from sievework.sources import brackets

    def read(language, text, node="call"):
        return [({k: got[k] for k in got}, line, column, snippet()) for kind, got, line, column, snippet in brackets.nodes(language, text) if kind == node]

    ((got, line, column, snippet),) = read("JavaScript", "// f(x)\n  a?.b['k'].c(x + 1, `v${y}`, { 'p': false }) /* g(x) */")
    assert (line, column, snippet) == (2, 3, "a?.b['k'].c(x + 1, `v${y}`, { 'p': false })")
    assert got == {
        "callee": ("name", "a.b[].c"), "attr": ("name", "c"), "arg0": ("concat", "x + 1"), "arg1": ("fstring", "v${y}"),
        "arg2": ("dict", "{ 'p': false }"), "kw.p": ("constant", "false"),
    }
    callees = lambda *a: [x[0]["callee"][1] for x in read(*a)]
    assert callees("Rust", "fn f<'a>(x: &'a str) { g::h(x)?.k(); vec![q(1)]; }") == ["g.h", "g.h().k", "vec!", "q"]
    assert callees("Java", "int f(int x) { return g(new H(x)); } void k() throws E { m(); }") == ["g", "H", "m"]
    assert callees("Go", "func (r T) f(x int) { if g(x) { h() } }") == ["g", "h"]
    assert callees("TypeScript", "class A { f(x) { g(/h(x)/, 'i(x)') } }") == ["g"]
    assert [x[0]["target"][1] for x in read("JavaScript", "a.b = c = 1; if (d == e) { f = {g: 'x', h} }", "assign")] == ["a.b", "c", "f", "g"]
    assert [x[0]["module"][1] for x in read("Java", "import static a.b.C;\nimport d.*;", "import")] == ["a.b.C", "d"]
    assert [x[0]["kw.K"] for x in read("Go", "x := &t.C{K: true}", "literal")] == [("constant", "true")]
    for language in brackets.LANGUAGES:
        for text in ("", "f(", ")", "a.", "'", "x = ", "f(" * 20_000, "a" + ".b()" * 20_000, "import (" * 20_000, "{a: " * 20_000, "a = " * 20_000):
            list(brackets.nodes(language, text))


def test_patches_of_every_class(spark):
    lines = {
        "bound-parameter": ("cur.execute(f'SELECT {k}')", "cur.execute('SELECT %s', (k,))"), "argument-list": ("os.system(cmd)", "subprocess.run(shlex.split(cmd), check=True)"),
        "no-shell": ("run(a, shell=True)", "run(a, shell=False)"), "base-name": ("open(name, 'r')", "open(os.path.basename(name), 'r')"), "checked-url": ("requests.get(u)", "requests.get(allowed_url(u))"),
        "json-loads": ("pickle.loads(b)", "json.loads(b)"), "from-environment": ("  token = 'abc'", '  token = os.environ["token"]'), "local-redirect": ("redirect(to)", "redirect(local_path(to))"),
        "no-entities": ("P(resolve_entities=True)", "P(resolve_entities=False)"), "text-content": ("x.innerHTML = y", "x.textContent = y"),
    }
    for name, (before, after) in lines.items():
        assert one(spark, scoring.patched_line("line", "template"), line=before, template=name) == after
