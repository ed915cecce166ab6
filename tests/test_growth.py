"""What steps move and keep: shuffles, versions of stores, sizes of sketches, broadcasts of diffs, passes over vectors, tasks of parsing."""

import numpy as np
from pyspark.sql import functions as F

from sievework.llm import embedding_dedup
from sievework.operators import diff, graph, metrics, mutations, snapshots
from sievework.plans import dependencies, history, standins, state
from sievework.sources import files, trees
from sievework.streaming import ingest

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_laid_out_once_for_lines_and_join(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert plan(standins.stored_findings(spark, SMALL)).count("Exchange hashpartitioning") == 2
        assert plan(history._stored(spark, SMALL)).count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_upsert_moves_only_what_stored_findings_have(spark):
    out = mutations.upsert_scan(history._stored(spark, SMALL).select(*history._NARROW), history._incoming(spark, SMALL), history.now())
    assert "snippet" not in out.columns and not any(f"{c}#" in line for line in plan(out).splitlines() if "Aggregate" in line for c in ("confidence_score", "owasp_category"))


def test_marked_delta_has_null_keys_and_duplicates(spark):
    rows = spark.createDataFrame(
        [(1, "a", True, True), (2, "a", True, False), (3, "b", True, False), (4, "c", False, True), (5, "c", False, True), (6, None, True, True), (7, "a", False, True)],
        "id int, fingerprint string, cur boolean, base boolean",
    )
    got = sorted(map(tuple, mutations.marked_delta(rows, "cur", "base").select("id", "change").collect()))
    assert got == [(1, "unchanged"), (2, "unchanged"), (3, "new"), (4, "resolved"), (5, "resolved"), (6, "new"), (6, "resolved")]
    two = mutations.baseline_delta(rows.where("cur").drop("cur", "base"), rows.where("base").drop("cur", "base"))
    assert sorted(map(tuple, two.select("id", "change").collect())) == got


def test_upserts_of_a_stream_keep_as_many_versions_as_asked(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "store"), {"findings": snapshots.FINDINGS})
    rows = history._stored(spark, SMALL).select("finding_id", "project_id", "fingerprint", "rule_id", "file_path", "scan_id", "line", "column_num", "snippet", "severity", "triage_state", "created_at", "updated_at")
    store.commit({"findings": snapshots.Change(rows)})
    ingest.replay_batches([history._payload(spark, SMALL, p) for p in standins.PAYLOADS[:2]], lambda s: ingest.upsert_each(s, store, history.now(), keep=1))
    assert store.versions() == [3]
    files = [f.name for f in (tmp_path / "store" / "data").rglob("*.parquet")]
    assert files and all(".zstd." in f for f in files)


def test_rows_and_not_sketches_are_shuffled(spark):
    rows = history._stored(spark, SMALL)
    assert "REPARTITION_BY_COL" in plan(metrics.daily_sketches(rows).select("rules")).split("hll_sketch_agg")[-1]


def test_diffs_broadcast_nothing(spark):
    rows = [(p, k, f"{p} {k}") for p in range(3) for k in range(20)]
    old = spark.createDataFrame(rows, "pair int, pos int, line string")
    new = spark.createDataFrame([r for r in rows if r[1] % 5], "pair int, pos int, line string")
    steps = diff.script(old, new)
    assert "BroadcastHashJoin" not in plan(steps) and "BroadcastHashJoin" not in plan(diff.apply_hunks(old, diff.hunks(steps)))


def test_a_line_moved_far_is_still_found_in_later_rounds(spark):
    old = ["x", "a", "x", "b", "x", "c", "y", "y", "z"]
    new = ["x", "b", "x", "a", "x", "c", "y", "w", "y", "z"]
    sides = [spark.createDataFrame([(1, k, v) for k, v in enumerate(s)], "pair int, pos int, line string") for s in (old, new)]
    got = diff.apply_hunks(sides[0], diff.hunks(diff.script(*sides))).first().text
    assert got == "\n".join(new)


def test_alike_advisories_are_matched_once(spark, monkeypatch):
    seen, match = [], dependencies.A.match
    monkeypatch.setattr(dependencies.A, "match", lambda deps, advisories, *more: seen.append(advisories.count()) or match(deps, advisories, *more))
    dependencies.joi4_many(spark, "/root/testdata/sf0.01")
    assert seen and seen[0] <= 1800


def test_passes_go_in_blocks_and_floats_stay_floats(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 3)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 0)
    seen, keyed = [], embedding_dedup.keyed
    monkeypatch.setattr(embedding_dedup, "keyed", lambda rows, bits, *more: seen.append((more, rows.schema["e"].dataType.simpleString())) or keyed(rows, bits, *more))
    x = np.random.default_rng(2).normal(size=(150, 8)).astype(np.float32)
    x[100:] = x[:50] * 2
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, window=8, passes=7, cosine=0.999).collect()}
    assert len(seen) > 2 and seen[0] == ((0, 3), "array<float>") and seen[1][0] == (3, 6)
    assert all(got[i] == (1, i) and got[100 + i] == (1, i) for i in range(50)) and all(got[i] == (0, i) for i in range(50, 100))


def test_files_of_one_partition_are_parsed_by_many_tasks(spark):
    mixed = standins.mixed_files(spark, SMALL).coalesce(1)
    tasks = lambda df: df.select(F.spark_partition_id()).distinct().count()
    assert tasks(trees.match_trees(mixed, trees.default_tree_rules(spark))) > 1
    assert tasks(graph.source_functions(mixed.withColumn("language", files.language_of("file_path")))) > 1


def test_rules_are_asked_once_for_a_name(monkeypatch):
    import json

    seen, fits = [], trees.Patterns.fits
    monkeypatch.setattr(trees.Patterns, "fits", staticmethod(lambda p, got: seen.append(p) or fits(p, got)))
    rules = [(x, json.dumps({"node": "call", "match": {"callee": x + "$"}, "kind": {"arg0": ["name"]}})) for x in "abcdefgh"]
    long = "x" * 1000 + "a"
    found = trees.Patterns(rules).find("a(1);\n" + "a(y);\n" * 50 + "z(y);\n" * 50 + f"{long}(y);\n{long}(1);\n", "Go")
    assert [(rule[0], line) for rule, line, _, _ in found] == [("a", k) for k in range(2, 52)] + [("a", 102)]
    # 8 rules for two short names and twice for the long one, then what they ask of the arguments of 53 calls
    assert len(seen) <= 8 * 4 + 53


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_versions_are_written_in_parts(spark, monkeypatch):
    want = rows_of(state.mut1_versions(spark, SMALL))
    seen, write = [], snapshots.Store.commit
    monkeypatch.setattr(snapshots, "PART_BYTES", 0)
    monkeypatch.setattr(state, "LAYOUT", snapshots.Layout(state.LAYOUT.keys, groups=5, parts=2))
    monkeypatch.setattr(snapshots.Store, "commit", lambda store, changes, *more: seen.append([len(c.parts) for c in changes.values()]) or write(store, changes, *more))
    assert rows_of(state.mut1_versions(spark, SMALL)) == want
    # the facts, then a part for every group of projects
    assert seen == [[1], [5], [5], [5]]


def test_a_scan_given_as_rows_is_upserted_in_parts(spark, monkeypatch):
    new = history._payload(spark, SMALL)
    want = mutations.upsert_scan(history._stored(spark, SMALL).select(*state.STATE), new, history.now()).select(*state.STATE)
    monkeypatch.setattr(state, "LAYOUT", snapshots.Layout(state.LAYOUT.keys, groups=5, parts=2))
    store = state.new_store(spark, SMALL)
    monkeypatch.setattr(snapshots, "PART_BYTES", 0)
    change = snapshots.upsert_findings(store, new, history.now())
    assert len(change.parts) == 5
    store.commit({"findings": change})
    assert rows_of(store.read("findings").select(*state.STATE)) == rows_of(want)
    none = snapshots.upsert_findings(store, new.where("false"), history.now())
    assert [p.count() for p in none.parts] == [0] and none.replace == []
    store.commit({"findings": none})
    assert store.read("findings").count() == want.count()


def test_a_scan_of_one_project_rewrites_few_others(spark):
    store = state.new_store(spark, SMALL)
    touched = store.layouts["findings"].all_of(spark.createDataFrame([("p-3",)], "project_id string"))
    assert store.read("findings", buckets=touched).select("project_id").distinct().count() <= 3
    assert store.read("findings", buckets=touched).where("project_id = 'p-3'").count() == store.read("findings").where("project_id = 'p-3'").count() > 0


def test_facts_laid_out_in_parts_are_all_findings(spark, monkeypatch):
    monkeypatch.setattr(state, "LINES_BYTES", 30_000)
    found = state.Findings(spark, SMALL)
    folders = found.store.manifest()["tables"]["facts"]["folders"]
    assert len({f.split("/")[2] for _, f in folders}) > 1
    assert rows_of(found.read()) == rows_of(standins.stored_findings(spark, SMALL))
    one = found.read([b for b, _ in folders][:1])
    assert 0 < one.select("project_id").distinct().count() <= 4


def test_sketches_are_made_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "LAYOUT", snapshots.Layout(state.LAYOUT.keys, groups=5, parts=2))
    given = state.Findings(spark, SMALL)
    store = state.new_store(spark, SMALL, given)
    counts = lambda df: {r[0]: r[1:] for r in df.groupBy("project_id").agg(F.countDistinct("rule_id"), F.countDistinct("file_path")).collect()}
    monkeypatch.setattr(snapshots, "PART_BYTES", 0)
    seen, sketch = [], metrics.daily_sketches
    monkeypatch.setattr(metrics, "daily_sketches", lambda rows: seen.append({r[0] for r in rows.select("project_id").distinct().collect()}) or sketch(rows))
    own = snapshots.Store(spark, str(tmp_path / "m"), metrics.LAYOUTS)
    for step in range(2):
        if step:
            store.commit({"findings": snapshots.upsert_findings(store, given.payload("num % 5 <> 2 AND project_id < 'p-2'"), history.now())})
            assert metrics.refresh(store, own) == 2 and len(seen) > 1
        else:
            assert metrics.refresh(store, own) == 1 and len(seen) == 5
        assert sum(map(len, seen)) == len(set().union(*seen)), "a project is in one part"
        seen.clear()
        want = counts(store.read("findings"))
        got = {r[0]: r[1:] for r in metrics.distinct_counts(own).collect()}
        assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) <= max(2, want[p][1] * 0.05) for p in want)
