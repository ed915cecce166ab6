"""As-of and interval joins on hot keys, versions of a store, and scans that use their cache."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import versions as V
from sievework.operators import asof, cache, joins, snapshots
from sievework.plans import scan as P
from sievework.plans.dependencies import RANGES
from sievework.sources import files as S


def test_last_mark_of_one_hot_file(spark):
    rng = random.Random(3)
    marks = sorted({rng.randrange(3000) for _ in range(40)})
    rows = [(i, "hot", rng.randrange(3000)) for i in range(3000)] + [(9000 + i, "hot", 1500) for i in range(2000)] + [(20_000, "cold", 5), (20_001, None, 5), (20_002, "hot", None), (20_003, "none", 1)]
    r = spark.createDataFrame(rows, "finding_id int, file_path string, line int").repartition(6)
    m = spark.createDataFrame([("hot", f"f{x}", x) for x in marks] + [("cold", "g", 5), ("cold", "h", 6), (None, "x", 1)], "file_path string, name string, def_line int")
    want = {}
    for i, path, line in rows:
        k = bisect.bisect_right(marks, line) if path == "hot" and line is not None else 0
        want[i] = f"f{marks[k - 1]}" if k else "g" if path == "cold" else None
    assert {x.finding_id: x.name for x in joins.enclosing_function(r, m).collect()} == want


def test_hot_file_is_spread(spark):
    r = spark.range(40_000).select(F.col("id").alias("finding_id"), F.lit("hot").alias("file_path"), (F.col("id") % 700).alias("line"))
    m = spark.range(30).select(F.lit("hot").alias("file_path"), F.col("id").cast("string").alias("name"), (F.col("id") * 20).alias("def_line"))
    laid = asof.last_mark(r, m, ["file_path"], "line", "def_line")
    sizes = [x.n for x in laid.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == 40_000 and (len(sizes) == 1 or max(sizes) < 2.5 * 40_000 / n)
    assert laid.where("mark.def_line > line or line - mark.def_line >= 20 and line < 600").count() == 0


@pytest.mark.parametrize("bin_rows", [2, 7, 4096])
def test_intervals_of_one_hot_key(spark, bin_rows):
    rng = random.Random(bin_rows)
    points = [(i, "hot", rng.randrange(400)) for i in range(500)] + [(1000 + i, "hot", 77) for i in range(300)] + [(2000, "cold", 3), (2001, "hot", None), (2002, None, 3), (2003, "lone", 3)]
    spans = [(f"a{i}", "hot", x := rng.randrange(400), x + rng.randrange(30)) for i in range(120)] + [("all", "hot", 0, 1000), ("cold", "cold", 3, 4), ("empty", "cold", 3, 3)]
    p = spark.createDataFrame(points, "id int, k string, at int").repartition(5)
    s = spark.createDataFrame(spans, "span string, k string, lo int, hi int")
    got = sorted((r.id, r.span) for r in asof.interval_join(p, s, ["k"], "at", bin_rows).collect())
    assert got == sorted((i, n) for i, k, at in points for n, kk, lo, hi in spans if k == kk and k and at is not None and lo <= at < hi)


def test_intervals_say_what_ranges_say(spark):
    ranges = spark.createDataFrame([(r,) for r in RANGES], "r string").select("r", V.parse_ranges(F.array("r")).alias("p"))
    numbers = [0, 1, 2, 3, 4, 5, 20, 21, 22, 23, 44]
    versions = spark.createDataFrame([(f"{a}.{b}.{c}",) for a in range(6) for b in numbers for c in (0, 2, 3, 4, 5, 6, 44)], "v string").select("v", V.parse_version("v").alias("x"))
    both = versions.crossJoin(F.broadcast(ranges)).select(
        "v", "r", V.in_ranges(F.col("x"), F.col("p")).alias("a"),
        F.exists(asof.disjoint(V.range_intervals(F.col("p"))), lambda i: (i["lo"] <= V.version_key(F.col("x"))) & (V.version_key(F.col("x")) < i["hi"])).alias("b"),
    )
    assert both.where("a <> b").collect() == []


def test_disjoint(spark):
    row = spark.sql("select array(struct(5 lo, 9 hi), struct(1 lo, 3 hi), struct(3 lo, 4 hi), struct(7 lo, 7 hi), struct(6 lo, 12 hi)) x, cast(array() as array<struct<lo:int,hi:int>>) y")
    got = row.select(asof.disjoint(F.col("x")).alias("x"), asof.disjoint(F.col("y")).alias("y")).first()
    assert [tuple(i) for i in got.x] == [(1, 4), (5, 12)] and got.y == []


@pytest.fixture
def store(spark, tmp_path):
    rows = spark.range(400).selectExpr("concat('p', id % 20) project_id", "concat('f', id) fingerprint", "id v")
    out = snapshots.Store(spark, str(tmp_path / "store"), {"t": snapshots.FINDINGS})
    out.commit({"t": snapshots.Change(rows)})
    return out


def folders(store, version=None):
    return {f for _, f in store.manifest(version)["tables"]["t"]["folders"]}


def test_untouched_buckets_keep_their_files(spark, store):
    touched = store.layouts["t"].all_of(spark.createDataFrame([("p3",)], "project_id string"))
    assert len(touched) == 4
    store.commit({"t": store.change("t", touched, lambda df: df.withColumn("v", F.when(F.col("project_id") == "p3", -1).otherwise(F.col("v"))))})
    one, two = folders(store, 1), folders(store)
    assert len(one - two) <= 4 and len(one & two) >= len(one) - 4
    assert store.read("t", 1).where("v < 0").count() == 0
    assert store.read("t").where("v < 0").count() == 20 and store.read("t").count() == 400
    assert store.vacuum(1) == len(one - two) and store.versions() == [2] and store.read("t").count() == 400


def test_a_killed_write_leaves_the_old_version(spark, store):
    boom = F.udf(lambda v: 1 // 0, "int")
    with pytest.raises(Exception):
        store.commit({"t": store.change("t", list(range(32)), lambda df: df.withColumn("v", boom("v").cast("long")))})
    assert store.versions() == [1] and store.read("t").count() == 400
    store._publish = lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        store.commit({"t": store.change("t", list(range(32)), lambda df: df.where("false"))})
    assert store.versions() == [1] and store.read("t").count() == 400


def test_two_writers_of_one_version(spark, store):
    other = snapshots.Store(spark, store.path, store.layouts)
    old = other.manifest()
    store.commit({"t": snapshots.Change(store.read("t").limit(0))})
    other.manifest = lambda version=None: old
    with pytest.raises(RuntimeError):
        other.commit({"t": snapshots.Change(store.read("t").limit(0))})


def test_rows_outside_the_named_buckets_are_refused(spark, store):
    with pytest.raises(ValueError):
        store.commit({"t": snapshots.Change(store.read("t"), [0])})
    assert store.versions() == [1]


def test_find_reads_the_buckets_of_its_keys(spark, store):
    found = store.find("t", [("p3", "f23"), ("p4", "none")])
    assert [r.v for r in found.collect()] == [23]
    assert len({f.rsplit("/", 1)[0] for f in found.inputFiles()}) <= 2


def test_cached_scan_equals_a_full_one(spark, tmp_path, monkeypatch):
    text = "eval(1)\nx = 1\n# scan-ignore-next-line\nexec(2)\n"
    files = spark.createDataFrame([("a.py", text), ("b.py", text), ("c.js", "eval(5); x.innerHTML = 1"), ("d.py", "x"), ("e.py", None), ("f.py", "")], "file_path string, text string")
    rules, c = S.default_rules(spark), cache.open_cache(spark, str(tmp_path / "cache"))
    plain = lambda df: sorted(map(tuple, df.drop("fingerprint").collect()), key=str)
    want = plain(P.scan(files, rules))
    assert plain(P.scan(files, rules, P.ScanOptions(cache=c))) == want
    assert c.read(cache.TABLE).count() == 4
    scanned = []
    monkeypatch.setattr(P, "raw_matches", lambda f, r, whole=P.raw_matches: (scanned.append(f.count()), whole(f, r))[1])
    more = files.where("file_path <> 'd.py'").union(spark.createDataFrame([("g.py", "exec(3)")], files.schema))
    assert plain(P.scan(more, rules, P.ScanOptions(cache=c))) == plain(P.scan(more, rules)) and scanned[0] == 1
    assert c.read(cache.TABLE).count() == 5
    P.scan(files, rules.where("rule_id <> 'JS001'"), P.ScanOptions(cache=c))
    assert c.read(cache.TABLE).count() == 9, "another rule set has entries of its own"


def test_severity_filter_comes_after_exposure(spark):
    files = spark.createDataFrame([("services/web/src/a.py", "eval(1)\n"), ("services/db/src/a.py", "\n\neval(1)\nlast")], "file_path string, text string")
    exposure = spark.createDataFrame([("web", True), ("db", False)], "service string, public boolean")
    found = lambda least, **o: sorted((r.service, r.severity) for r in P.scan(files, S.default_rules(spark), P.ScanOptions(enrich=True, exposure=exposure, min_severity=least, **o)).collect())
    assert found("Critical") == [("web", "Critical")]
    assert found("High") == [("web", "Critical")]
    assert found("Medium") == [("db", "Medium"), ("web", "Critical")]


def test_windows_of_findings(spark):
    files = spark.createDataFrame([("a.py", "one\neval(1)\n" + "x" * 200), ("b.py", "eval(2)")], "file_path string, text string")
    found = P.scan(files, S.default_rules(spark), P.ScanOptions(context=1)).collect()
    assert {r.file_path: r.snippet for r in found} == {"a.py": "one\neval(1)\n" + "x" * 100, "b.py": "eval(2)"}
