"""Queries over stored state: versions of tables, scans that use their cache, ingest of several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cache as C
from ..operators import snapshots as S
from ..registry import query
from ..scratch import checkpointed, delete, scratch_path, stored_bytes
from ..sources import files as X
from ..streaming import ingest as I
from . import history as H
from .scanning import RULES_SQL
from .standins import FACTS, FP, NUM, PAYLOADS, PREPARED, dressed, finding_facts, project_of, projects, read, stored_findings, upserts
from .standins import STATE as _STATE

COLUMNS = ["finding_id", "project_id", "fingerprint", "line", "severity", "triage_state"]
STATE = ["finding_id", "project_id", "fingerprint", "rule_id", "file_path", "scan_id", "line", "column_num", "snippet", "severity", "triage_state", "created_at", "updated_at"]


#: Findings in groups of about a project each, so that a scan touches little else and parts of a change can be small.
LAYOUT = S.Layout(("project_id", "fingerprint"), groups=64, parts=2)
#: Bytes of lineitem whose lines are laid out by order at a time.
LINES_BYTES = 1 << 30


class Findings:
    """All findings as facts, laid out once in the groups of LAYOUT, which can be read apart."""

    def __init__(self, spark, d):
        self.store = S.Store(spark, scratch_path(spark, "facts"), {"facts": S.Layout(LAYOUT.keys[:1], groups=LAYOUT.groups)})
        if (d, "stored_findings") in PREPARED:
            parts = [stored_findings(spark, d)]
        else:
            n = -(-stored_bytes(spark, f"{d}/lineitem.parquet") // LINES_BYTES)
            parts = [finding_facts(spark, d, (k, n) if n > 1 else None).select(*FACTS, project_of()) for k in range(n)]
        self.store.commit({"facts": S.Change(parts)})

    def read(self, groups=None):
        """The findings of some groups, or all."""
        rows = self.store.read("facts", buckets=groups)
        return rows if "finding_id" in rows.columns else dressed(rows)

    def slices(self):
        """Groups whose findings a part of the store may hold, in lists; a finding's facts take a quarter of it."""
        return self.store.slices("facts", size=S.PART_BYTES // 4)

    def payload(self, condition):
        """A scan's findings by groups."""
        return lambda groups: H.payload_of(self.read(groups), condition)


def new_store(spark, d, findings: Findings | None = None) -> S.Store:
    """A store whose first version holds the stored findings."""
    given, store = findings or Findings(spark, d), S.Store(spark, scratch_path(spark, "store"), {"findings": LAYOUT})
    store.commit({"findings": S.Change([H.known_of(given.read(own)).select(*STATE) for own in given.slices()])})
    if findings is None:
        delete(spark, given.store.path)
    return store


@query(
    "mut1_snapshot_versions",
    f"WITH {upserts(*PAYLOADS[:2])} " + " UNION ALL ".join(f"SELECT {k + 1} AS version, {_STATE} FROM st{k}" for k in range(3)),
)
def mut1_versions(spark, d):
    """Two upserts into a store; all three versions are read in the end."""
    findings = Findings(spark, d)
    store = new_store(spark, d, findings)
    for payload in PAYLOADS[:2]:
        store.commit({"findings": S.upsert_findings(store, findings.payload(payload), H.now())})
    delete(spark, findings.store.path)
    parts = [store.read("findings", v).select(F.lit(v).alias("version"), *COLUMNS) for v in store.versions()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "mut4_snapshot_triage",
    f"""WITH {upserts()} SELECT finding_id, CASE WHEN line = 3 THEN 'Ignored' ELSE triage_state END AS triage_state FROM st0 WHERE project_id NOT IN ('p-1', 'p-2')""",
)
def mut4_store(spark, d):
    """A triage, then a purge of two projects, each of which writes the buckets that it touches."""
    store = new_store(spark, d)
    updates = store.read("findings").where("line = 3").select("project_id", "fingerprint", F.lit("Ignored").alias("new_state"))
    store.commit({"findings": S.triage_findings(store, updates, H.now())})
    store.vacuum(1)
    gone = projects(spark, d).where("project_id in ('p-1', 'p-2')")
    store.commit({"findings": S.purge_projects(store, gone)})
    store.vacuum(1)
    return store.read("findings").select("finding_id", "triage_state")


@query(
    "fil16_by_key",
    f"""WITH {upserts()}, one AS (SELECT project_id, min(fingerprint) AS fingerprint FROM st0 WHERE project_id IN ('p-3', 'p-8') GROUP BY 1)
    SELECT finding_id, triage_state FROM st0 JOIN one USING (project_id, fingerprint)""",
)
def fil16_key(spark, d):
    """Two findings by their whole keys: only the buckets of those keys are read."""
    store = new_store(spark, d)
    rows = store.read("findings").where("project_id in ('p-3', 'p-8')").groupBy("project_id").agg(F.min("fingerprint").alias("fingerprint"))
    keys = [tuple(r) for r in rows.select("project_id", "fingerprint").collect()]
    return store.find("findings", keys).select("finding_id", "triage_state")


def _trees(spark, d):
    """The documents as files, and as files of which a tenth has changed."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    path = F.concat(F.lit("doc"), "doc_id", F.lit(".py")).alias("file_path")
    changed = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("\nfirst line of more at a@b.example.com"))).otherwise(F.col("text"))
    return docs.select(path, "text"), docs.select(path, changed.alias("text"))


@query(
    "joi14_incremental_scan",
    f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN concat(text, chr(10), 'first line of more at a@b.example.com') ELSE text END AS text FROM documents),
    l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS body FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM t))
    SELECT concat('doc', doc_id, '.py') AS file_path, line, rule_id, severity, instr(body, regexp_extract(body, pattern, 0)) AS column_num, regexp_extract(body, pattern, 0) AS snippet
    FROM l, {RULES_SQL} WHERE regexp_matches(body, pattern) AND severity <> 'Info'""",
)
def joi14_scan(spark, d):
    """The second scan of the documents: contents that the first has seen come from the cache."""
    from .scan import ScanOptions, scan

    before, after = _trees(spark, d)
    rules = X.default_rules(spark).where("language is null")
    cache = C.open_cache(spark, scratch_path(spark, "scan-cache"))
    scan(before, rules, ScanOptions(cache=cache))
    found = scan(after, rules, ScanOptions(cache=cache, write_cache=False))
    return found.select("file_path", "line", "rule_id", "severity", "column_num", "snippet")


@query(
    "joi14_scanned_again",
    """WITH t AS (SELECT DISTINCT sha256(text) AS h, length(text) AS n FROM documents),
    c AS (SELECT DISTINCT sha256(x) AS h, length(x) AS n FROM (SELECT concat(text, chr(10), 'first line of more at a@b.example.com') AS x FROM documents WHERE doc_id % 10 = 3))
    SELECT n AS chars, count(*) AS entries FROM (SELECT * FROM c WHERE h NOT IN (SELECT h FROM t)) GROUP BY 1""",
)
def joi14_again(spark, d):
    """What the second of two scans scanned: contents by length."""
    from .scan import ScanOptions, scan

    before, after = _trees(spark, d)
    rules = X.default_rules(spark).where("language is null")
    cache = C.open_cache(spark, scratch_path(spark, "scan-cache"))
    scan(before, rules, ScanOptions(cache=cache))
    first = cache.versions()[-1]
    scan(after, rules, ScanOptions(cache=cache))
    old = cache.read(C.TABLE, first).select("file_hash")
    return cache.read(C.TABLE).join(old, "file_hash", "left_anti").groupBy("chars").agg(F.count("*").alias("entries"))


@query(
    "snk10_cache_life",
    """WITH e AS (SELECT doc_id, sha256(text) AS file_hash, source AS language, length(text) AS chars, doc_id % 3 AS day FROM documents WHERE text IS NOT NULL)
    SELECT step, count(*) AS entries, CAST(sum(chars) AS BIGINT) AS chars FROM (
      SELECT 'put' AS step, * FROM e UNION ALL SELECT 'invalidated', * FROM e WHERE language <> 'src0' UNION ALL SELECT 'stale', * FROM e WHERE language <> 'src0' AND day = 0
      UNION ALL SELECT 'kept', * FROM e WHERE language <> 'src0' AND day > 0) GROUP BY step UNION ALL SELECT 'cleared', 0, NULL""",
)
def snk10_life(spark, d):
    """A stored cache that is filled, loses a language and its stale entries, and is cleared, with what it holds after each step."""
    at = F.expr("timestampadd(DAY, cast(doc_id % 3 as int), timestamp '2024-01-01 00:00:00')")
    rows = read(spark, d, "documents").where("text is not null").select(
        F.sha2("text", 256).alias("file_hash"), F.lit("r1").alias("rule_set_hash"), F.col("source").alias("language"), F.char_length("text").cast("long").alias("chars"), at.alias("cached_at"), F.array().cast(C.FOUND).alias("findings")
    )
    cache, now = C.open_cache(spark, scratch_path(spark, "cache")), F.lit("2024-01-02 12:00:00")
    C.store(cache, rows)
    C.replace_entries(cache, C.invalidate(C.entries(cache), "src0"))
    old = C.stale(C.entries(cache), now)
    C.replace_entries(cache, C.entries(cache).join(old.select("file_hash", "cached_at").distinct(), ["file_hash", "cached_at"], "left_anti"))
    C.clear(cache)
    held = [("put", cache.read(C.TABLE, 1)), ("invalidated", cache.read(C.TABLE, 2)), ("stale", C.stale(cache.read(C.TABLE, 2), now)), ("kept", cache.read(C.TABLE, 3)), ("cleared", cache.read(C.TABLE, 4))]
    parts = [C.stats(rows).select(F.lit(step).alias("step"), "entries", "chars") for step, rows in held]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


LIMIT = 12
_PAYLOAD_SQL = f"""f AS (SELECT *, {NUM} AS num FROM stored_findings),
  per AS (SELECT scan_id, project_id, org_id, num, min(created_at) AS made, count(*) AS n, bool_or(severity = 'Info') AS bad FROM f GROUP BY ALL),
  p AS (SELECT *, num AS seq, CASE WHEN num % 13 = 0 THEN NULL ELSE 'c' END AS sha, num % 3 AS batch FROM per
    UNION ALL SELECT *, num + 1000000000, 'c', 2 FROM per WHERE num % 10 = 0),
  checked AS (SELECT *, CASE WHEN sha IS NULL OR bad THEN 400 WHEN project_id NOT IN (SELECT project_id FROM projects) THEN 404 END AS early FROM p),
  firsts AS (SELECT *, row_number() OVER w AS nth, lag(batch) OVER w AS earlier FROM checked WINDOW w AS (PARTITION BY scan_id ORDER BY early IS NOT NULL, batch, seq)),
  queued AS (SELECT *, strftime(made, '%Y-%m') AS month, row_number() OVER (PARTITION BY org_id, strftime(made, '%Y-%m') ORDER BY batch, seq) AS rn FROM firsts WHERE early IS NULL AND (nth = 1 OR earlier < batch)),
  fold AS (SELECT org_id, month, CAST(0 AS BIGINT) AS rn, '' AS scan_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS used, 0 AS status, CAST([] AS VARCHAR[]) AS ids FROM queued WHERE rn = 1
    UNION ALL SELECT org_id, month, rn, scan_id, seq, CASE WHEN s = 200 THEN used + n ELSE used END, s, CASE WHEN s = 200 THEN list_append(ids, scan_id) ELSE ids END FROM (
      SELECT q.org_id, q.month, q.rn, q.scan_id, q.seq, q.n, fold.used, fold.ids, CASE WHEN list_contains(fold.ids, q.scan_id) THEN 409 WHEN fold.used + q.n <= {LIMIT} THEN 200 ELSE 402 END AS s
      FROM fold JOIN queued q ON q.org_id = fold.org_id AND q.month = fold.month AND q.rn = fold.rn + 1)),
  taken AS (SELECT f.org_id, f.month, f.scan_id, f.seq, q.n, q.batch FROM fold f JOIN queued q USING (scan_id, seq) WHERE f.status = 200)"""


def _payloads(spark, d):
    """(batch, payload): a payload a scan, some without a commit, and some that come again in the last batch."""
    num = F.regexp_extract("scan_id", r"(\d+)", 1).cast("long")
    found = F.struct("finding_id", "rule_id", "file_path", "line", "column_num", "snippet", "severity")
    per = stored_findings(spark, d).groupBy("scan_id", "project_id", "org_id").agg(F.min("created_at").alias("submitted_at"), F.sort_array(F.collect_list(found)).alias("findings"))
    per = per.withColumn("num", num)
    one = per.select("*", F.col("num").alias("seq"), F.when(F.col("num") % 13 != 0, "c").alias("commit_sha"), (F.col("num") % 3).alias("batch"))
    again = per.where("num % 10 = 0").select("*", (F.col("num") + 1_000_000_000).alias("seq"), F.lit("c").alias("commit_sha"), F.lit(2).cast("long").alias("batch"))
    rows = one.unionByName(again).withColumn("repository_url", F.lit("https://git.example.com/r"))
    return rows.select("batch", "seq", "scan_id", "project_id", "org_id", "repository_url", "commit_sha", "submitted_at", "findings")


#: Stores that were filled before, by application and folder: queries look at one replay together.
_FILLED: dict[tuple, S.Store] = {}


def _ingested(spark, d):
    """A store after three batches of payloads, the second of which was handed over twice."""
    known = (spark.sparkContext.applicationId, d)
    if known in _FILLED:
        return _FILLED[known]
    rows = checkpointed(_payloads(spark, d), "payloads")
    store = S.Store(spark, scratch_path(spark, "ingest"), I.LAYOUTS)
    limits = projects(spark, d).select("org_id").distinct().withColumn("most_findings", F.lit(LIMIT))
    take = I.ingest_batch(store, projects(spark, d), limits)

    def twice(batch, k):
        take(batch, k)
        if k == 1:
            take(batch, k)

    I.replay_batches([rows.where(F.col("batch") == k).drop("batch") for k in range(3)], lambda s: s.writeStream.foreachBatch(twice))
    _FILLED[known] = store
    return store


@query(
    "stm5_ingest_outcomes",
    f"""WITH {_PAYLOAD_SQL} SELECT f.scan_id, f.seq, CAST(coalesce(early, fold.status, 409) AS INT) AS status FROM firsts f LEFT JOIN fold ON fold.scan_id = f.scan_id AND fold.seq = f.seq""",
    recursive=True,
)
def stm5_outcomes(spark, d):
    return _ingested(spark, d).read("payload_log").select("scan_id", "seq", "status")


@query(
    "stm5_ingest_usage",
    f"""WITH {_PAYLOAD_SQL} SELECT org_id, month, CAST(sum(n) AS BIGINT) AS findings, count(*) AS scans FROM taken GROUP BY 1, 2""",
    recursive=True,
)
def stm5_usage(spark, d):
    return _ingested(spark, d).read("usage").select("org_id", "month", "findings", "scans")


@query(
    "stm5_ingest_findings",
    f"""WITH {_PAYLOAD_SQL}, rows_ AS (SELECT f.*, {FP} AS fingerprint, batch, seq FROM stored_findings f JOIN taken USING (scan_id)),
    best AS (SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY batch DESC, seq DESC, finding_id DESC) = 1),
    firsts_ AS (SELECT project_id, fingerprint, arg_min(finding_id, (batch, seq, finding_id)) AS first_id FROM rows_ GROUP BY ALL),
    seen AS (SELECT project_id, max(batch) AS last_batch FROM rows_ GROUP BY 1)
    SELECT first_id AS finding_id, b.project_id, b.fingerprint, b.line, b.severity, CASE WHEN b.batch < last_batch THEN 'AutoFixed' ELSE 'Open' END AS triage_state
    FROM best b JOIN firsts_ USING (project_id, fingerprint) JOIN seen ON seen.project_id = b.project_id""",
    recursive=True,
)
def stm5_findings(spark, d):
    return _ingested(spark, d).read("findings").select("finding_id", "project_id", "fingerprint", "line", "severity", "triage_state")


def _metrics(spark, d):
    """A store and its metrics after three payloads, the metrics brought up to date after each."""
    from ..operators import metrics as R

    known = (spark.sparkContext.applicationId, d, "metrics")
    if known in _FILLED:
        return _FILLED[known]
    findings = Findings(spark, d)
    store, metrics = new_store(spark, d, findings), S.Store(spark, scratch_path(spark, "metrics"), R.LAYOUTS)
    R.refresh(store, metrics)
    for payload in PAYLOADS:
        store.commit({"findings": S.upsert_findings(store, findings.payload(payload), H.now())})
        R.refresh(store, metrics)
        # the metrics have taken the difference, and nothing reads older versions
        store.vacuum(1)
        metrics.vacuum(1)
    delete(spark, findings.store.path)
    _FILLED[known] = metrics
    return metrics


@query(
    "agg1_incremental",
    f"""WITH {upserts(*PAYLOADS)} SELECT project_id, severity, count(*) AS findings, count(*) FILTER (WHERE triage_state NOT IN ('Fixed','AutoFixed','Ignored','AutoIgnored')) AS open,
    count(*) FILTER (WHERE triage_state IN ('Fixed','AutoFixed')) AS resolved, CAST(coalesce(sum(CASE WHEN triage_state IN ('Fixed','AutoFixed') THEN trunc(epoch(updated_at - created_at) / 3600) END), 0) AS BIGINT) AS hours FROM st3 GROUP BY 1, 2""",
)
def agg1_incremental(spark, d):
    from ..operators import metrics as R

    return R.overview(_metrics(spark, d))


@query("agg29_incremental_distinct", f"WITH {upserts(*PAYLOADS)} SELECT project_id, count(DISTINCT rule_id) AS rules FROM st3 GROUP BY 1")
def agg29_incremental(spark, d):
    """Distinct rules by merged sketches, which are exact for as few values as there are rules."""
    from ..operators import metrics as R

    return R.distinct_counts(_metrics(spark, d)).select("project_id", "rules")
