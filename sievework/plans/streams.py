"""Streaming operators over whole tables: each replays a table as a stream and returns all that it puts out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.mutations import KEEP
from ..registry import query
from ..scratch import scratch_path
from ..streaming import ingest as I
from ..streaming import watch as W
from .standins import PAYLOADS, STATE, read, stored_findings, upserts


@query(
    "stm1_watch_changes",
    """WITH b AS (SELECT file_path, rule_id, line FROM stored_findings WHERE column_num % 2 = 0 GROUP BY ALL), a AS (SELECT file_path, rule_id, line FROM stored_findings WHERE column_num % 3 = 0 GROUP BY ALL)
    SELECT file_path, 'new' AS change, rule_id, line, 1 AS seq FROM b UNION ALL SELECT *, 2 FROM (SELECT file_path, 'new', rule_id, line FROM (FROM a EXCEPT FROM b))
    UNION ALL SELECT *, 2 FROM (SELECT file_path, 'resolved', rule_id, line FROM (FROM b EXCEPT FROM a))""",
)
def stm1(spark, d):
    """Two scans of every file; what the second changes. A file without findings in the second was deleted."""
    rows = stored_findings(spark, d).groupBy("file_path", "rule_id", "line").agg(
        F.bool_or(F.col("column_num") % 2 == 0).alias("one"), F.bool_or(F.col("column_num") % 3 == 0).alias("two")
    )
    found = F.struct("rule_id", "line", F.lit("High").alias("severity"))
    files = rows.groupBy("file_path").agg(F.collect_list(F.when(F.col("one"), found)).alias("one"), F.collect_list(F.when(F.col("two"), found)).alias("two"))
    scans = F.array(
        F.struct(F.lit(1).cast("long").alias("seq"), F.lit(False).alias("deleted"), F.col("one").alias("findings")),
        F.struct(F.lit(2).cast("long").alias("seq"), (F.size("two") == 0).alias("deleted"), F.col("two").alias("findings")),
    )
    snapshots = files.select("file_path", F.explode(scans).alias("s")).select("file_path", "s.*")
    return I.replay(snapshots, I.watch_changes).select("file_path", "change", "rule_id", "line", "seq")


_SCANS = """b AS (SELECT file_path, rule_id, line, min(severity) AS severity FROM stored_findings WHERE column_num % 2 = 0 GROUP BY ALL), a AS (SELECT file_path, rule_id, line, min(severity) AS severity FROM stored_findings WHERE column_num % 3 = 0 GROUP BY ALL),
    ch AS (SELECT file_path, 'new' AS change, rule_id, line, severity, 1 AS seq FROM b UNION ALL SELECT file_path, 'new', rule_id, line, severity, 3 FROM a WHERE (file_path, rule_id, line) NOT IN (SELECT file_path, rule_id, line FROM b)
      UNION ALL SELECT file_path, 'resolved', rule_id, line, severity, 3 FROM b WHERE (file_path, rule_id, line) NOT IN (SELECT file_path, rule_id, line FROM a))"""


def _rescans(spark, d):
    """Three re-scans of every file: the second comes 40 ms before the third and is never looked at. A last file closes all bursts."""
    rows = stored_findings(spark, d).groupBy("file_path", "rule_id", "line").agg(
        F.min(F.when(F.col("column_num") % 2 == 0, F.col("severity"))).alias("one"), F.min(F.when(F.col("column_num") % 3 == 0, F.col("severity"))).alias("two")
    )
    of = lambda s: F.collect_list(F.when(F.col(s).isNotNull(), F.struct("rule_id", "line", F.col(s).alias("severity"))))
    files = rows.groupBy("file_path").agg(of("one").alias("one"), of("two").alias("two"))
    none = F.array().cast(W.FOUND)
    at = lambda ms: F.timestamp_millis(F.lit(1_700_000_000_000 + ms))
    scan = lambda ms, seq, gone, found: F.struct(at(ms).alias("ts"), F.lit(seq).cast("long").alias("seq"), gone.alias("deleted"), found.alias("findings"))
    scans = F.array(scan(0, 1, F.lit(False), F.col("one")), scan(60_000, 2, F.lit(False), none), scan(60_040, 3, F.size("two") == 0, F.col("two")))
    out = files.select("file_path", F.explode(scans).alias("s")).select("file_path", "s.*")
    return out.unionByName(spark.range(1).select(F.lit("close").alias("file_path"), at(3_600_000).alias("ts"), F.lit(9).cast("long").alias("seq"), F.lit(False).alias("deleted"), none.alias("findings")))


@query("stm1_watch_debounced", f"WITH {_SCANS} SELECT file_path, change, rule_id, line, seq FROM ch")
def stm1_debounced(spark, d):
    return I.replay(_rescans(spark, d), W.watch).select("file_path", "change", "rule_id", "line", "seq")


@query("stm1_watch_totals", f"WITH {_SCANS} SELECT severity, CAST(sum(CASE WHEN change = 'new' THEN 1 ELSE -1 END) AS BIGINT) AS held FROM ch GROUP BY 1")
def stm1_totals(spark, d):
    return W.running_totals(I.replay(_rescans(spark, d), W.watch))


@query("stm2_watch_filter", "SELECT page_id, concat('src/p', page_id, CASE page_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.md' ELSE '.test.js' END) AS file_path FROM pages WHERE page_id % 3 = 0")
def stm2(spark, d):
    k = F.col("page_id")
    name = F.when(k % 3 == 0, ".py").when(k % 3 == 1, ".md").otherwise(".test.js")
    return I.replay(read(spark, d, "pages").select("page_id", F.concat(F.lit("src/p"), k, name).alias("file_path")), I.scannable)


@query(
    "stm3_debounced",
    """WITH e AS (SELECT concat('d', user_id % 20) AS doc, ts, event_type = 'click' AS saved, event_id AS version FROM events),
    m AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY ts, version) AS burst FROM
      (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY doc ORDER BY ts, version) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e))
    SELECT doc, version, true AS saved FROM e WHERE saved UNION ALL
    SELECT doc, version, saved FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc, burst ORDER BY ts DESC, version DESC, saved DESC) = 1) WHERE NOT saved""",
)
def stm3(spark, d):
    """Bursts of half an hour, as the events are far apart, as a stream; a last edit of another document, far behind, ends them all."""
    edits = read(spark, d, "events").select(
        F.concat(F.lit("d"), F.col("user_id") % 20).alias("doc"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "click").alias("saved"), F.col("event_id").alias("version")
    )
    close = edits.agg(F.lit("close").alias("doc"), (F.max("ts") + F.expr("interval 30 days")).alias("ts"), F.lit(False).alias("saved"), F.lit(0).cast("long").alias("version"))
    out = I.replay(edits.unionByName(close), lambda s: I.debounced(s, "30 minutes", "1 hour"))
    return out.where("doc <> 'close'").select("doc", "version", "saved")


@query("stm4_distinct_scans", "SELECT DISTINCT concat('s-', user_id) AS scan_id FROM events")
def stm4(spark, d):
    payloads = read(spark, d, "events").select(F.concat(F.lit("s-"), "user_id").alias("scan_id"), F.col("ts").cast("timestamp").alias("ts"))
    return I.replay(payloads, lambda s: I.distinct_scans(s, "3650 days")).select("scan_id")


@query("stm4_event_rates", "SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS begins, event_type, count(*) AS n FROM events GROUP BY ALL")
def stm4b(spark, d):
    events = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = I.replay(events, I.event_rates, "update").groupBy("begins", "event_type").agg(F.max("n").alias("n"))
    return out.select(F.unix_seconds("begins").alias("begins"), "event_type", "n")


@query("stm5_upsert_per_scan", f"WITH {upserts(*PAYLOADS)} SELECT {STATE} FROM st3")
def stm5(spark, d):
    """Three payloads as one stream, each merged into what the one before left."""
    from . import history as H
    from .state import COLUMNS, new_store

    store = new_store(spark, d)
    used = ["project_id", "fingerprint", "finding_id", "pos", "rule_id", "file_path", *KEEP]
    I.replay_batches([H._payload(spark, d, p).select(*used) for p in PAYLOADS], lambda s: I.upsert_each(s, store, H.now(), keep=1))
    return store.read("findings").select(*COLUMNS)


@query("stm6_latest_ruleset", "SELECT event_id AS rule_id, user_id AS version FROM events WHERE user_id = (SELECT max(user_id) FROM events)")
def stm6(spark, d):
    target, state = scratch_path(spark, "rules"), scratch_path(spark, "ruleset-version")
    updates = read(spark, d, "events").select(F.col("event_id").alias("rule_id"), F.col("user_id").alias("version"))
    I.replay_into(updates, lambda s: I.latest_ruleset(s, lambda rules: rules.write.mode("overwrite").parquet(target), state))
    return spark.read.schema(updates.schema).parquet(target)
