"""Diffs, fix rounds, metrics from deltas, watch state, patterns' literals, layouts and visibility, on small inputs."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sievework.functions.patterns import any_of, required_literals
from sievework.operators import diff, filters, fixes, metrics, snapshots
from sievework.plans import scan as P
from sievework.plans import sql as Q
from sievework.plans import state
from sievework.sources import files as S
from sievework.sources import layout
from sievework.streaming import ingest, watch

DIR = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(row[j], above[j + 1])
    return row[-1]


def lines_of(spark, texts):
    return spark.createDataFrame([(k, i, x) for k, t in texts.items() for i, x in enumerate(t)], "pair int, pos int, line string")


def test_diffs_against_longest_common_lines(spark):
    rng = random.Random(5)
    old, new = {}, {}
    for k in range(40):
        old[k] = [rng.choice("abcdefgh{}" if k % 2 else "abcdefghijklmnopqrstuvwxyz{}") for _ in range(rng.randrange(30))]
        new[k] = [x for x in old[k] if rng.random() > 0.2]
        for _ in range(rng.randrange(4)):
            new[k].insert(rng.randrange(len(new[k]) + 1), rng.choice("abXYZ"))
    old[50], new[50] = list("abc"), list("abc")
    old[51], new[51] = list("abc"), []
    old[52], new[52] = [], list("abc")
    old[53], new[53] = ["x"] * 50, ["x"] * 48
    old[54], new[54] = list("abcde"), list("edcba")
    a, b = lines_of(spark, old), lines_of(spark, new)
    steps = diff.script(a, b)
    rows = {}
    for r in steps.orderBy("pair", "at").collect():
        rows.setdefault(r.pair, []).append(r)
    kept = best = 0
    for k in old:
        mine = rows.get(k, [])
        assert [r.line for r in mine if r.kind in " -"] == old[k] and [r.line for r in mine if r.kind in " +"] == new[k]
        n, most = sum(r.kind == " " for r in mine), lcs(old[k], new[k])
        assert n <= most
        kept, best = kept + n, best + most
    assert kept > 0.93 * best
    assert all(r.kind == " " for r in rows[50]) and sum(r.kind == " " for r in rows[53]) == 48
    made = {r.pair: r.text for r in diff.apply_hunks(a, diff.hunks(steps)).collect()}
    assert all(made.get(k, "") == "\n".join(new[k]) for k in new)


def test_unified_text(spark):
    old, new = {1: [f"l{k}" for k in range(20)]}, {1: [f"l{k}" for k in range(20)]}
    new[1][3] = "changed"
    new[1].insert(15, "more")
    (row,) = diff.unified(diff.hunks(diff.script(lines_of(spark, old), lines_of(spark, new)))).collect()
    want = "@@ -1,7 +1,7 @@\n l0\n l1\n l2\n-l3\n+changed\n l4\n l5\n l6\n@@ -13,6 +13,7 @@\n l12\n l13\n l14\n+more\n l15\n l16\n l17"
    assert row.diff == want


def test_longest_run():
    assert diff.longest_run([(0, 3), (1, 0), (2, 1), (3, 4), (4, 2)]) == [(1, 0), (2, 1), (4, 2)]
    assert diff.longest_run([]) == []


def test_fix_rounds(spark):
    rules = [("A", "bad"), ("B", "worse"), ("C", "never"), ("D", "ugly")]
    templates = [("A", 1, "bad", "bad2"), ("A", 2, "bad", "ugly"), ("A", 3, "bad", "good"), ("B", 1, "worse(.*)never", "fine"), ("D", 1, "ugly", "ugly!")]
    rows = spark.createDataFrame([(1, "bad"), (2, "worse never"), (3, "never"), (4, "clean"), (5, None), (6, "ugly bad"), (7, "bad bad")], "k int, line string")
    got = {r.k: (r.fixed, [tuple(o) for o in r.outcomes]) for r in fixes.fix_lines(rows, rules, templates, 3).collect()}
    assert got == {
        1: ("good", [("A", "Applied", 3)]),  # the second attempt is refused, as it makes another finding
        2: ("fine", [("B", "Applied", 1), ("C", "Resolved", 1)]),
        3: ("never", [("C", "Skipped", 1)]),
        6: ("ugly ugly", [("A", "Applied", 2), ("D", "Reverted", 3)]),
        7: ("good good", [("A", "Applied", 3)]),
    }
    short = {r.k: [tuple(o) for o in r.outcomes] for r in fixes.fix_lines(rows, rules, templates, 2).collect()}
    assert short[1] == [("A", "Reverted", 2)] and fixes.fix_lines(rows.where("k = 4"), rules, templates).count() == 0


def test_metrics_follow_deltas(spark, tmp_path):
    store = state.new_store(spark, DIR)
    own = snapshots.Store(spark, str(tmp_path / "m"), metrics.LAYOUTS)
    metrics.refresh(store, own)
    updates = store.read("findings").where("project_id = 'p-3'").select("project_id", "fingerprint", F.lit("Fixed").alias("new_state"))
    store.commit({"findings": snapshots.triage_findings(store, updates, F.lit("1999-01-01").cast("timestamp_ntz"))})
    store.commit({"findings": snapshots.purge_projects(store, spark.createDataFrame([("p-5",)], "project_id string"))})
    version = metrics.refresh(store, own)
    assert metrics.refresh(store, own) == version, "nothing has changed since"
    plain = metrics.daily_counts(store.read("findings"))
    rows = lambda df: sorted(map(tuple, df.select("project_id", "day", "severity", *metrics.SUMS).collect()))
    assert rows(own.read("daily_counts")) == rows(plain)
    exact = {r.project_id: r.n for r in store.read("findings").groupBy("project_id").agg(F.countDistinct("file_path").alias("n")).collect()}
    got = {r.project_id: r.files for r in metrics.distinct_counts(own).collect()}
    assert got.keys() == exact.keys() and "p-5" not in got
    assert all(abs(got[p] - n) <= max(1, 0.05 * n) for p, n in exact.items())


def test_sketch_error(spark):
    rows = spark.range(60_000).selectExpr("'p' project_id", "timestamp_ntz '2024-01-01' created_at", "concat('r', id) rule_id", "concat('f', id % 20000) file_path")
    r = metrics.daily_sketches(rows).select(F.hll_sketch_estimate("rules").alias("a"), F.hll_sketch_estimate("files").alias("b")).first()
    assert abs(r.a - 60_000) < 0.05 * 60_000 and abs(r.b - 20_000) < 0.05 * 20_000


def test_watch_state_of_a_deleted_file_is_gone(spark, tmp_path):
    one = [("r1", 1, "High"), ("r2", 2, "Low")]
    rows = [("a.py", 0, 1, False, one), ("b.py", 0, 1, False, one), ("a.py", 5000, 2, True, None), ("b.py", 5000, 2, False, one[:1]), ("b.py", 5050, 3, False, one), ("z", 90_000, 9, False, None)]
    df = spark.createDataFrame(rows, f"file_path string, ms long, seq long, deleted boolean, findings {watch.FOUND}")
    df = df.select("file_path", F.timestamp_millis(F.col("ms") + 1_700_000_000_000).alias("ts"), "seq", "deleted", "findings")
    source, check, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    df.write.parquet(source)
    run = watch.watch(spark.readStream.schema(df.schema).parquet(source)).writeStream.foreachBatch(lambda b, k: b.write.mode("append").parquet(out))
    run.option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.parquet(out)
    assert sorted((r.file_path, r.change, r.rule_id, r.seq) for r in changes.collect()) == [
        ("a.py", "new", "r1", 1), ("a.py", "new", "r2", 1), ("a.py", "resolved", "r1", 2), ("a.py", "resolved", "r2", 2), ("b.py", "new", "r1", 1), ("b.py", "new", "r2", 1)
    ]
    assert {r.severity: r.held for r in watch.running_totals(changes).collect()} == {"High": 1, "Low": 1}
    held = spark.read.format("statestore").option("stateVarName", "held").load(check)
    assert {r.key.file_path for r in held.select("key").collect()} == {"b.py"}


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "s"), ingest.LAYOUTS)
    rows = state._payloads(spark, DIR).where("batch = 0").drop("batch").limit(50).cache()
    projects = state.projects(spark, DIR)
    take = ingest.ingest_batch(store, projects, projects.select("org_id").distinct().withColumn("most_findings", F.lit(10_000)))
    take(rows, 0)
    once = store.versions()
    take(rows, 0)
    assert store.versions() == once
    take(rows, 1)
    assert {r.status for r in store.read("payload_log", store.versions()[-1]).collect()} >= {200, 400, 409}
    assert store.read("scans").count() == store.read("scans").select("scan_id").distinct().count()
    rows.unpersist()


PATTERNS = [r"abc+d", "x|yz", "(foo|bar)baz", "(?:foo)?qux", "[abc]def", r"a\.b\.c", "(?i)abc", r"\d{3}key", "end$", "(one|two)three|four", "ab{0,2}cde", "(abc){2}", "a.c.e", r"tok\w+en="]


def test_every_match_holds_a_required_literal():
    rng = random.Random(1)
    for p in PATTERNS:
        need = required_literals(p)
        for _ in range(3000):
            text = "".join(rng.choice(["abc", "abd", "def", "foo", "bar", "baz", "qux", "x", "yz", "one", "three", "four", "key", "123", "a.b.c", "end", "cde", "c", "token=", " "]) for _ in range(4))
            if need and re.search(p, text):
                assert any(x in text for x in need), (p, text)
    assert required_literals("(foo|bar)baz") == ["bar", "foo"] or required_literals("(foo|bar)baz") == ["baz"]
    assert required_literals("(?i)abc") is None and required_literals("[0-9]{16}") is None and required_literals("(?:foo)?qux") == ["qux"]
    found = re.findall(f"(?=({any_of(['ab', 'abc', 'bcd', 'x.y', 'x'])}))", "zabcdx.yab")
    assert found == ["abc", "bcd", "x.y", "ab"]


def many_rules(spark, n):
    rng = random.Random(n)
    words = ["".join(rng.choice("bcdfghjklmnpqrstvwz") for _ in range(9)) for _ in range(n)]
    rows = [(f"R{k:04}", "x", "Low", None, rf"{w}\s*=\s*[0-9]+" if k % 3 else rf"\b({w}|{w[::-1]})\(", None, None, [], 0, k) for k, w in enumerate(words)]
    return spark.createDataFrame(rows, S.RULE), words


def test_many_rules_equal_each_alone_and_cost_little(spark):
    rules, words = many_rules(spark, 500)
    rng = random.Random(9)
    body = [(f"f{k % 7}", k, " ".join(rng.choice([*words[:40], "plain", "text", "= 5", "= 7", "("]) for _ in range(8))) for k in range(300)]
    lines = spark.createDataFrame(body, "file_path string, line_no int, line string").withColumn("language", F.lit(None).cast("string"))
    got = sorted((r.line_no, r.rule_id, r.snippet) for r in P.match_rules(lines, rules).collect())
    want = sorted((n, r.rule_id, m[0]) for _, n, x in body for r in rules.collect() for m in [re.search(r.pattern, x)] if m)
    assert got == want and got
    long = spark.range(60_000).select(F.lit("f").alias("file_path"), F.col("id").cast("int").alias("line_no"), F.lit("a line of plain words that holds nothing of what is looked for " * 2).alias("line"), F.lit(None).cast("string").alias("language"))
    took = {}
    for n in (5, 500):
        few = P.match_rules(long, rules.where(F.col("rule_id") < f"R{n:04}"))
        times = []
        for _ in range(3):
            began = time.time()
            few.write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[n] = min(times)
    assert took[500] < 3 * took[5] + 0.3, took


def test_layout_reads_one_bucket(spark):
    rows = spark.range(5000).selectExpr("concat('f-', id) finding_id", "concat('o-', id % 3) org_id", "id")
    table = layout.write_findings(rows, buckets=8)
    one = layout.by_ids(table, ["f-77"])
    assert one.first().id == 77
    # buckets are passed over in any case, but plans say so only where they keep them
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(name, "false")
    try:
        plan = layout.by_ids(table, ["f-77"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(name)
    assert "SelectedBucketsCount: 1 out of 8" in plan
    mine = table.where("org_id = 'o-1' and finding_id = 'f-77'")
    assert mine.count() == 0 and "PartitionFilters: [isnotnull(org_id" in mine._jdf.queryExecution().executedPlan().toString()


def test_visibility(spark):
    members = spark.createDataFrame([("a", "o1", "admin", []), ("b", "o1", "developer", ["t1", "t2"]), ("c", "o1", "manager", []), ("a", "o2", "developer", ["t9"])], "user_id string, org_id string, role string, team_ids array<string>")
    rows = spark.createDataFrame([(1, "o1", "t1"), (2, "o1", None), (3, "o2", "t9"), (4, "o2", "t1")], "k int, org_id string, team_id string")
    assert sorted((r.user_id, r.k) for r in filters.visible_to_each(rows, members).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    for user in "abc":
        own = sorted(r.k for r in filters.visible_rows(rows, members, user).collect())
        assert own == sorted(r.k for r in filters.visible_to_each(rows, members).where(F.col("user_id") == user).collect())


@pytest.mark.parametrize("version,low,high,want", [("1.2.3", "1.2.3", "2.0.0", True), ("v2.0.0-rc", "1.0.0", "2.0.0", False), ("1.10.0", "1.9.0", None, True), ("odd", "1.0.0", "2.0.0", True)])
def test_sql_functions(spark, version, low, high, want):
    Q.register(spark, DIR, ["part"])
    assert spark.sql("SELECT version_between(:v, :low, :high) x", args={"v": version, "low": low, "high": high}).first().x is want


def test_sql_metrics_equal_their_frames(spark):
    from sievework.functions.domain import is_open, severity_rank
    from sievework.plans.standins import stored_findings

    Q.register(spark, DIR)
    rows = stored_findings(spark, DIR)
    by_sql = spark.sql("SELECT severity_rank(severity) AS r, count(*) AS n, count_if(is_open(triage_state)) AS o FROM stored_findings GROUP BY 1 ORDER BY 1").collect()
    frame = rows.groupBy(severity_rank("severity").alias("r")).agg(F.count("*").alias("n"), F.count_if(is_open("triage_state")).alias("o")).orderBy("r").collect()
    assert by_sql == frame
    prints = spark.sql("SELECT count(*) n FROM stored_findings WHERE fingerprint(rule_id, file_path, snippet) IS NULL").first().n
    assert prints == 0
