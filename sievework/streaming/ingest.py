"""Structured Streaming: watch mode, debouncing, telemetry ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.domain import fingerprint
from ..operators.mutations import upsert_scan
from ..operators.snapshots import FINDINGS, Change, Layout, Store, upsert_findings
from ..scratch import checkpointed, discard, free_shuffles, scratch_path
from ..sources.files import is_excluded, language_of

CHANGES = "file_path string, change string, rule_id string, line int, severity string, seq long"
STATE = "rows array<struct<rule_id:string,line:int,severity:string>>"


def scannable(events: DataFrame) -> DataFrame:
    """Change events of files that a scan would read."""
    return events.where(language_of("file_path").isNotNull() & ~is_excluded("file_path"))


def watch_changes(snapshots: DataFrame) -> DataFrame:
    """New and resolved findings per file, from a stream of whole scan results.

    snapshots: (file_path, seq, deleted, findings array<struct<rule_id,line,severity>>), one row per re-scan.
    A finding is its rule and line. Deleting a file resolves all that it had. The state is one file's
    findings, and a deleted file's state is removed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(r, n): s for r, n, s in state.get[0]} if state.exists else {}
        out = []
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for seq, deleted, found in zip(rows["seq"], rows["deleted"], rows["findings"]):
            now = {} if deleted else {(f["rule_id"], int(f["line"])): f["severity"] for f in (found if found is not None else [])}
            out += [(key[0], "new", r, n, s, seq) for (r, n), s in sorted(now.items()) if (r, n) not in held]
            out += [(key[0], "resolved", r, n, s, seq) for (r, n), s in sorted(held.items()) if (r, n) not in now]
            held = now
        if held:
            state.update(([(r, n, s) for (r, n), s in sorted(held.items())],))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["file_path", "change", "rule_id", "line", "severity", "seq"])

    return snapshots.groupBy("file_path").applyInPandasWithState(step, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def debounced(edits: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """What to scan of each document: saves at once, and of each burst of edits the last, unless a save came after it.

    edits: (doc, ts timestamp, saved boolean, version long); edits closer than the gap make one burst, which ends
    when the watermark has passed it. A save takes part in its burst as well, and there stands for the edits before it.
    """
    now = edits.where("saved").select("doc", "version", "saved", F.col("ts").alias("begins"), F.col("ts").alias("ends"))
    marked = edits.withWatermark("ts", late)
    bursts = marked.groupBy(F.session_window("ts", gap).alias("w"), "doc").agg(F.max(F.struct("ts", "version", "saved")).alias("last"))
    rest = bursts.where("not last.saved").select("doc", "last.version", "last.saved", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"))
    return now.unionByName(rest)


def distinct_scans(payloads: DataFrame, late: str = "1 hour") -> DataFrame:
    """Payloads whose scan_id has not come before; state is kept for as long as the watermark allows."""
    return payloads.withWatermark("ts", late).dropDuplicatesWithinWatermark(["scan_id"])


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("begins"), "event_type", "n", "total")
    )


def upsert_each(payloads: DataFrame, store: Store, now: Column | None = None, stream: str = "upsert", keep: int | None = None):
    """A writer that merges every micro-batch into the findings of a store, each into what the one before left.

    The commit carries the batch's number, so a batch that is handed over again does nothing. ``keep`` says how many
    versions stay; all do by default.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        done = store.mark(stream)
        if done is None or batch_id > done:
            at = F.current_timestamp().cast("timestamp_ntz") if now is None else now
            store.commit({"findings": upsert_findings(store, batch, at)}, {stream: batch_id})
            if keep is not None:
                store.vacuum(keep)

    return payloads.writeStream.foreachBatch(merge)


REQUIRED = ["project_id", "repository_url", "commit_sha", "scan_id", "findings"]
#: Severities that a payload may carry, and how many findings.
ACCEPTED, MOST = ["Low", "Medium", "High", "Critical"], 5000
LAYOUTS = {
    "findings": FINDINGS,
    "scans": Layout(("scan_id",), groups=8),
    "usage": Layout(("org_id", "month"), groups=4, parts=4),
    "payload_log": Layout(("scan_id",), groups=8),
}
STORED = (
    "finding_id string, project_id string, fingerprint string, rule_id string, file_path string, scan_id string, line int, column_num int, "
    "snippet string, severity string, triage_state string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
SCANS = "scan_id string, project_id string, org_id string, commit_sha string, submitted_at timestamp_ntz, findings long"
USAGE = "org_id string, month string, findings long, scans long"
LOG = "scan_id string, seq long, org_id string, project_id string, findings long, status int"


def judge_payloads(payloads: DataFrame, scans: DataFrame, projects: DataFrame, usage: DataFrame, limits: DataFrame) -> DataFrame:
    """payloads with n (findings), month and status: 200, or the first of the checks that they fail.

    400 for a missing field, too many findings or a severity that is not accepted; 409 for a scan_id that is stored
    or that an earlier payload of these passes the checks up to 404 with; 404 for a project that the organisation does
    not have; 402 where the findings would go over the organisation's limit of the month. Payloads count in order of seq,
    and one that is refused counts for nothing. limits (org_id, most_findings); without one there is none.
    """
    n = F.coalesce(F.size("findings"), F.lit(0)).cast("long")
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    bad = missing | (F.size("findings") > MOST) | F.exists("findings", lambda f: ~F.coalesce(f["severity"], F.lit("")).isin(ACCEPTED))
    rows = payloads.withColumns({"n": n, "month": F.date_format("submitted_at", "yyyy-MM")})
    stored = scans.select("scan_id").distinct().withColumn("__sw_stored", F.lit(True))
    known = projects.select("org_id", "project_id").distinct().withColumn("__sw_known", F.lit(True))
    rows = rows.join(stored, "scan_id", "left").join(known, ["org_id", "project_id"], "left")
    early = F.when(F.coalesce(bad, F.lit(True)), 400).when(F.col("__sw_stored"), 409).when(F.col("__sw_known").isNull(), 404)
    rows = rows.withColumn("__sw_early", early)
    first = rows.where("__sw_early is null").groupBy("scan_id").agg(F.min("seq").alias("__sw_first"))
    rows = rows.join(first, "scan_id", "left")
    rows = rows.withColumn("__sw_early", F.when(F.col("__sw_early").isNull() & (F.col("seq") > F.col("__sw_first")), 409).otherwise(F.col("__sw_early")))
    used = usage.select("org_id", "month", F.col("findings").alias("used")).join(limits.select("org_id", "most_findings"), "org_id", "right")
    queue = rows.where("__sw_early is null").select("org_id", "month", "scan_id", "seq", "n").join(limits.select("org_id", "most_findings"), "org_id")
    queue = queue.join(used.select("org_id", "month", "used"), ["org_id", "month"], "left")

    def fold(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("seq")
        total, most, over = int(batch["used"].fillna(0).iloc[0]), int(batch["most_findings"].iloc[0]), []
        for size in batch["n"]:
            over.append(total + size > most)
            total += 0 if over[-1] else size
        return batch[["scan_id", "seq"]].assign(over=over)

    # numbers of one organisation's payloads of one micro-batch, which the stream bounds
    over = queue.groupBy("org_id", "month").applyInPandas(fold, "scan_id string, seq long, over boolean").where("over")
    rows = rows.join(over, ["scan_id", "seq"], "left")
    status = F.coalesce("__sw_early", F.when(F.col("over"), 402), F.lit(200))
    return rows.select(*payloads.columns, "n", "month", status.alias("status"))


def ingest_batch(store: Store, projects: DataFrame, limits: DataFrame, now: Column | None = None, stream: str = "ingest") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that takes payloads into findings, scans, usage and a log of all outcomes, exactly once.

    payloads (seq, scan_id, project_id, org_id, repository_url, commit_sha, submitted_at, findings array of structs with
    finding_id, rule_id, file_path, line, column_num, snippet, severity). All tables change in one commit, which carries the
    batch's number: a batch that is handed over again finds it and does nothing, and one that was killed has changed nothing.
    """

    def tables() -> dict[str, DataFrame]:
        made = {"findings": STORED, "scans": SCANS, "usage": USAGE, "payload_log": LOG}
        return {t: store.read(t) if store.has(t) else store.spark.createDataFrame([], schema) for t, schema in made.items()}

    def take(batch: DataFrame, batch_id: int) -> None:
        done = store.mark(stream)
        if done is not None and batch_id <= done:
            return
        held = tables()
        judged = checkpointed(judge_payloads(batch, held["scans"], projects, held["usage"], limits), "judged")
        taken = judged.where("status = 200")
        rows = taken.select("scan_id", "project_id", "seq", F.explode("findings").alias("f")).select("scan_id", "project_id", "seq", "f.*")
        rows = rows.withColumn("snippet", F.substring("snippet", 1, 100))
        rows = checkpointed(rows.withColumns({"fingerprint": fingerprint("rule_id", "file_path", "snippet"), "pos": F.struct("seq", "finding_id")}), "ingested")
        layout, at = store.layouts["findings"], F.current_timestamp().cast("timestamp_ntz") if now is None else now
        touched = layout.all_of(taken)
        before = store.read("findings", buckets=touched) if store.has("findings") else held["findings"]
        after = upsert_scan(before, rows, at).select(*held["findings"].columns)
        added = taken.groupBy("org_id", "month").agg(F.sum("n").alias("findings"), F.count("*").alias("scans"))
        months = store.layouts["usage"].of(added)
        was = store.read("usage", buckets=months) if store.has("usage") else held["usage"]
        usage = was.unionByName(added).groupBy("org_id", "month").agg(F.sum("findings").alias("findings"), F.sum("scans").alias("scans"))
        store.commit(
            {
                "findings": Change(after, touched),
                "scans": Change(taken.select("scan_id", "project_id", "org_id", "commit_sha", "submitted_at", F.col("n").alias("findings"))),
                "usage": Change(usage, months),
                "payload_log": Change(judged.select("scan_id", "seq", "org_id", "project_id", F.col("n").alias("findings"), F.col("status").cast("int").alias("status"))),
            },
            {stream: batch_id},
        )
        discard(judged, rows)

    return take


def latest_ruleset(updates: DataFrame, apply: Callable[[DataFrame], None], state: str):
    """A writer that hands on the rules of the newest version in each batch, and none that is older than one seen.

    The newest version is kept in a table at ``state``, in a store that outlives the driver, so a restart goes on
    from it. It is written after apply(): a version whose hand-over failed is handed over again.
    """

    def push(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
        there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        seen = spark.read.schema("version long").parquet(state).agg(F.max("version")).first()[0] if there else None
        top = batch.agg(F.max("version")).first()[0]
        if top is not None and (seen is None or top > seen):
            apply(batch.where(F.col("version") == top))
            spark.range(1).select(F.lit(top).cast("long").alias("version")).write.mode("append").parquet(state)

    return updates.writeStream.foreachBatch(push)


def replay(rows: DataFrame, build: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What a streaming query puts out over a table: the table is written as files, and all of them are processed."""
    spark = rows.sparkSession
    source, sink = scratch_path(spark, "replay-in"), scratch_path(spark, "replay-out")
    rows.write.parquet(source)
    out = build(spark.readStream.schema(rows.schema).parquet(source))
    run = out.writeStream.outputMode(mode).foreachBatch(lambda batch, k: batch.write.mode("append").parquet(sink))
    run.option("checkpointLocation", scratch_path(spark, "replay-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def replay_into(rows: DataFrame, build: Callable[[DataFrame], object]) -> None:
    """Run a writer that build() makes, to its end over a table."""
    spark = rows.sparkSession
    source = scratch_path(spark, "replay-in")
    rows.write.parquet(source)
    writer = build(spark.readStream.schema(rows.schema).parquet(source))
    writer.option("checkpointLocation", scratch_path(spark, "replay-state")).trigger(availableNow=True).start().awaitTermination()


def replay_batches(batches: list[DataFrame], build: Callable[[DataFrame], object]) -> None:
    """Run a writer over tables that arrive one after another, each as one micro-batch of one stream."""
    spark = batches[0].sparkSession
    source, state = scratch_path(spark, "replay-in"), scratch_path(spark, "replay-state")
    for rows in batches:
        rows.write.mode("append").option("compression", "zstd").parquet(source)
        free_shuffles(spark)
        writer = build(spark.readStream.schema(batches[0].schema).parquet(source))
        writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
