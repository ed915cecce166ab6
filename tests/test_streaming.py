import datetime as dt

from pyspark.sql import functions as F

from sievework.streaming import ingest

FINDINGS = "file_path string, seq long, deleted boolean, findings array<struct<rule_id:string,line:int,severity:string>>"


def run(spark, tmp_path, batches, schema, build, mode="append"):
    """Feed batches as files, one micro-batch each, and collect what the query puts out."""
    src = tmp_path / "in"
    src.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    out = []
    q = build(stream).writeStream.outputMode(mode).foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"b{k}"))
        for p in (tmp_path / f"b{k}").glob("part-*"):
            p.rename(src / f"{k:03d}.json")
        q.processAllAvailable()
    q.stop()
    return out


def test_watch_reports_new_and_resolved(spark, tmp_path):
    batches = [
        [("a.py", 1, False, [("R1", 3, "High"), ("R2", 5, "Low")]), ("b.py", 2, False, [])],
        [("a.py", 3, False, [("R1", 3, "Low"), ("R3", 9, "Low")])],
        [("a.py", 4, True, None)],
        [("a.py", 5, False, [("R1", 3, "High")])],
    ]
    got = {(r.seq, r.change, r.rule_id, r.line) for r in run(spark, tmp_path, batches, FINDINGS, ingest.watch_changes)}
    assert got == {
        (1, "new", "R1", 3), (1, "new", "R2", 5), (3, "new", "R3", 9), (3, "resolved", "R2", 5),
        (4, "resolved", "R1", 3), (4, "resolved", "R3", 9), (5, "new", "R1", 3),
    }


def test_watch_filter(spark):
    rows = spark.createDataFrame([("a.py",), ("tests/a.py",), ("a.md",), ("x/node_modules/b.js",)], "file_path string")
    assert [r.file_path for r in ingest.scannable(rows).collect()] == ["a.py"]


def t(s):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(seconds=s)


def test_debounce_with_late_edits(spark, tmp_path):
    schema = "doc string, ts timestamp, saved boolean, version long"
    batches = [[("d", t(0.0), False, 1), ("d", t(0.4), False, 3), ("d", t(0.2), False, 2)], [("d", t(5), True, 4)], [("d", t(60), False, 5)], [("e", t(90), False, 1)]]
    got = {(r.doc, r.version, r.saved) for r in run(spark, tmp_path, batches, schema, ingest.debounced)}
    assert {("d", 3, False), ("d", 4, True)} <= got


def test_scan_ids_come_once(spark, tmp_path):
    schema = "scan_id string, ts timestamp"
    batches = [[("s1", t(0)), ("s1", t(1)), ("s2", t(2))], [("s2", t(3)), ("s3", t(4))]]
    got = sorted(r.scan_id for r in run(spark, tmp_path, batches, schema, ingest.distinct_scans))
    assert got == ["s1", "s2", "s3"]


def test_event_rates_drop_what_is_too_late(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    batches = [[(t(10), "a", 1.0), (t(3700), "a", 2.0)], [(t(20000), "a", 1.0)], [(t(30), "a", 9.0)], [(t(40000), "b", 1.0)]]
    got = {(r.begins.hour, r.n, r.total) for r in run(spark, tmp_path, batches, schema, ingest.event_rates)}
    assert {(0, 1, 1.0), (1, 1, 2.0)} <= got and all(n == 1 for _, n, _ in got)


def test_upsert_each_batch(spark):
    from sievework.operators import mutations
    from sievework.plans import history, state
    from sievework.plans.standins import PAYLOADS

    folder = "/root/testdata/sf0.001"
    store = state.new_store(spark, folder)
    payloads = [history._payload(spark, folder, p) for p in PAYLOADS[:2]]
    ingest.replay_batches(payloads, lambda s: ingest.upsert_each(s, store, history.now()))
    assert store.versions() == [1, 2, 3] and store.mark("upsert") == 1
    want = history._stored(spark, folder)
    for p in payloads:
        want = mutations.upsert_scan(want, p, history.now())
    rows = lambda df: sorted(map(tuple, df.select(*state.COLUMNS).collect()))
    assert rows(store.read("findings")) == rows(want)
    # a stream that has lost its checkpoint hands the first batch over again
    ingest.replay_batches(payloads[:1], lambda s: ingest.upsert_each(s, store, history.now()))
    assert store.versions() == [1, 2, 3]


def test_rulesets_never_go_back(spark, tmp_path):
    schema = "version long, rule_id string"
    seen = []
    src = tmp_path / "in"
    src.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    for restart, versions in enumerate([(3, 2, 4), (1, 4, 5)]):  # a restarted writer knows what was seen before
        q = ingest.latest_ruleset(stream, lambda b: seen.append(b.first().version), str(tmp_path / "version")).option("checkpointLocation", str(tmp_path / "ck")).start()
        for k, v in enumerate(versions):
            spark.createDataFrame([(v, "R")], schema).coalesce(1).write.json(str(tmp_path / f"b{restart}{k}"))
            for p in (tmp_path / f"b{restart}{k}").glob("part-*"):
                p.rename(src / f"{restart}{k}.json")
            q.processAllAvailable()
        q.stop()
    assert seen == [3, 4, 5]


def test_a_save_passes_at_once_and_ends_the_wait(spark, tmp_path):
    schema = "doc string, ts timestamp, saved boolean, version long"
    batches = [[("d", t(0.0), False, 1), ("d", t(0.2), True, 2)], [("e", t(1), False, 7)], [("f", t(90), False, 1)], [("f", t(200), False, 2)]]
    out = run(spark, tmp_path, batches, schema, ingest.debounced)
    got = [(r.doc, r.version, r.saved) for r in out]
    assert got[0] == ("d", 2, True) and ("d", 1, False) not in got and ("e", 7, False) in got and got.count(("d", 2, True)) == 1
