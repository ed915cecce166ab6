"""State changes of stored findings and their neighbours, each as a new snapshot of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import is_open, severity_rank

KEEP = ["scan_id", "line", "column_num", "snippet", "severity"]


def collapse_payload(incoming: DataFrame, key: list[str]) -> DataFrame:
    """One row per key from a payload in order ``pos``: the id of the first row, everything else of the last."""
    rest = [c for c in incoming.columns if c not in (*key, "finding_id", "pos")]
    return incoming.groupBy(*key).agg(
        F.min_by("finding_id", "pos").alias("finding_id"),
        F.max_by(F.struct(*rest), "pos").alias("v"),
    ).select(*key, "finding_id", "v.*")


def upsert_scan(stored: DataFrame, incoming: DataFrame, now: Column, scanned: DataFrame | None = None) -> DataFrame:
    """Stored findings after a scan's findings (with ``pos``) came in, keyed by (project_id, fingerprint).

    Known findings take the scan's place and text and keep their state, but AutoFixed reopens; new ones are
    Open; open ones of a scanned project that the scan lacks become AutoFixed, except synthetic paths and
    empty fingerprints, and except where the scan found nothing at all. Of place and text only what stored has is
    taken, and nothing else of the scan is moved. ``scanned`` (project_id) may name the scan's projects, once each.
    """
    key, keep = ["project_id", "fingerprint"], [c for c in KEEP if c in stored.columns]
    used = ["rule_id", "file_path", *keep]
    new = collapse_payload(incoming.select(*key, "finding_id", "pos", *used), key).select(*key, *[F.col(c).alias(f"n_{c}") for c in ("finding_id", *used)])
    scanned = (incoming.select("project_id").distinct() if scanned is None else scanned).withColumn("was_scanned", F.lit(True))
    both = stored.join(new, key, "full_outer").join(scanned, "project_id", "left")
    known, seen = F.col("finding_id").isNotNull(), F.col("n_finding_id").isNotNull()
    gone = (
        known & ~seen & F.coalesce("was_scanned", F.lit(False)) & is_open("triage_state")
        & ~F.startswith("file_path", F.lit("<")) & (F.coalesce("fingerprint", F.lit("")) != "")
    )
    state = (
        F.when(~known, "Open")
        .when(seen & (F.col("triage_state") == "AutoFixed"), "Open")
        .when(gone, "AutoFixed")
        .otherwise(F.col("triage_state"))
    )
    return both.select(
        F.coalesce("finding_id", "n_finding_id").alias("finding_id"),
        *key,
        F.coalesce("rule_id", "n_rule_id").alias("rule_id"),
        F.coalesce("file_path", "n_file_path").alias("file_path"),
        *[F.when(seen, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in keep],
        state.alias("triage_state"),
        F.when(known, F.col("created_at")).otherwise(now).alias("created_at"),
        F.when(seen | gone, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def triage(findings: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Findings with the state and, where it is not empty, the note of (finding_id, new_state, note) updates."""
    out = findings.join(updates, "finding_id", "left")
    hit = F.col("new_state").isNotNull()
    return out.select(
        *[F.col(c) for c in findings.columns if c not in ("triage_state", "triage_note", "updated_at")],
        F.coalesce("new_state", "triage_state").alias("triage_state"),
        F.when(hit & (F.coalesce("note", F.lit("")) != ""), F.col("note")).otherwise(F.col("triage_note")).alias("triage_note"),
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def suppress_minor(findings: DataFrame, batch: int = 500) -> DataFrame:
    """(finding_id): the next ``batch`` findings of Low, then Info, that are neither ignored nor Fixed."""
    rows = findings.where(F.col("severity").isin("Low", "Info") & ~F.col("triage_state").isin("AutoIgnored", "Ignored", "Fixed"))
    return rows.orderBy(F.desc(severity_rank("severity")), "finding_id").limit(batch).select("finding_id")


def resolve_duplicates(findings: DataFrame) -> DataFrame:
    """Findings where all but the newest open one of a rule and file are AutoFixed."""
    open_rows = is_open("triage_state")
    best = findings.where(open_rows).groupBy("rule_id", "file_path").agg(F.max(F.struct("updated_at", "finding_id")).alias("b"))
    out = findings.join(best, ["rule_id", "file_path"], "left")
    late = open_rows & (F.col("b.finding_id") != F.col("finding_id"))
    return out.withColumn("triage_state", F.when(late, "AutoFixed").otherwise(F.col("triage_state"))).drop("b").select(*findings.columns)


def baseline_delta(current: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows of both sides with ``change``: new, resolved or unchanged; duplicates are kept."""
    sides = current.withColumns({"__sw_cur": F.lit(True), "__sw_base": F.lit(False)}), baseline.withColumns({"__sw_cur": F.lit(False), "__sw_base": F.lit(True)})
    return marked_delta(sides[0].unionByName(sides[1].select(*sides[0].columns)), "__sw_cur", "__sw_base", key)


def marked_delta(rows: DataFrame, current: str, baseline: str, key: str = "fingerprint") -> DataFrame:
    """baseline_delta of rows that say by two booleans on which sides they are, on both perhaps.

    Every key is told once which sides have it, by combinable maxima, and its rows meet that once. A null key has no equal.
    """
    sides = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(current).alias("__sw_in_cur"), F.max(baseline).alias("__sw_in_base"))
    both = rows.join(sides, key, "left")
    mine = F.when(F.col(current), F.when(F.col("__sw_in_base"), "unchanged").otherwise("new"))
    gone = F.when(F.col(baseline) & ~F.coalesce("__sw_in_cur", F.lit(False)), "resolved")
    kept = [c for c in rows.columns if c not in (current, baseline)]
    return both.select(*kept, F.explode(F.array_compact(F.array(mine, gone))).alias("change"))


def verify_fixes(fixes: DataFrame, after: DataFrame) -> DataFrame:
    """(fix_id, outcome) of fixes (fix_id, file_path, rule_id, line) against the findings of the new scan.

    StillPresent if the same rule is still found there, else NewFindings if the file has others, else Resolved.
    Both joins are with one row a key, so a file of many findings costs no more than its rows.
    """
    place = ["file_path", "rule_id", "line"]
    same = after.select(*place).distinct().withColumn("__sw_same", F.lit(True))
    some = after.select("file_path").distinct().withColumn("__sw_some", F.lit(True))
    found = fixes.join(same, place, "left").join(some, "file_path", "left")
    return found.groupBy("fix_id").agg(F.max("__sw_same").alias("same"), F.max("__sw_some").alias("some")).select(
        "fix_id", F.when(F.col("same"), "StillPresent").when(F.col("some"), "NewFindings").otherwise("Resolved").alias("outcome")
    )


def upsert_latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row with the largest order columns of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("v")).select(*key, "v.*")


def insert_absent(rows: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Rows, one per key, whose key no open or pending existing row has."""
    first = rows.groupBy(*key).agg(F.min(F.struct(*[c for c in rows.columns if c not in key])).alias("v")).select(*key, "v.*")
    return first.join(existing.where("status in ('open', 'pending')").select(*key).distinct(), key, "left_anti")


def purge_project(table: DataFrame, projects: DataFrame) -> DataFrame:
    """Table without the rows of the given projects."""
    return table.join(projects.select("project_id"), "project_id", "left_anti")


def publish_release(releases: DataFrame) -> DataFrame:
    """Releases with ``active``: the latest published one of each platform, by a combinable maximum joined back."""
    best = releases.groupBy("platform").agg(F.max(F.struct("published_at", "version")).alias("__sw_best"))
    out = releases.join(best, "platform")
    return out.withColumn("active", F.struct("published_at", "version") == F.col("__sw_best")).drop("__sw_best")


def apply_changes(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """A table of records after changes (key, seq, op, and columns to set): the newest change of each key counts.

    ``upsert`` sets the columns that the change has and that are not null, in the record of the key or in a new
    one; ``delete`` takes the record away. The table has one record a key; keys are not null.
    """
    rest = [x for x in changes.columns if x not in (*key, "seq", "op")]
    last = changes.groupBy(*key).agg(F.max_by(F.struct("op", *rest), "seq").alias("__sw_new"))
    both = table.withColumn("__sw_had", F.lit(True)).join(last, key, "full_outer")
    kept = both.where("(__sw_had or __sw_new.op = 'upsert') and coalesce(__sw_new.op <> 'delete', true)")
    value = lambda x: F.coalesce(F.col("__sw_new")[x], F.col(x)).alias(x) if x in rest else F.col(x)
    return kept.select(*[value(x) for x in table.columns])


def update_ruleset(existing: DataFrame, update: DataFrame) -> DataFrame:
    """Rules by id after an update: its rules replace those of the same id; an empty one keeps all."""
    return existing.join(update.select("rule_id"), "rule_id", "left_anti").unionByName(update)


def activate(projects: DataFrame, scans: DataFrame) -> DataFrame:
    """Pending projects that have a scan become active."""
    seen = scans.select("project_id").distinct().withColumn("__sw_seen", F.lit(True))
    out = projects.join(seen, "project_id", "left")
    done = (F.col("provisioning") == "pending") & F.coalesce("__sw_seen", F.lit(False))
    return out.withColumn("provisioning", F.when(done, "active").otherwise(F.col("provisioning"))).drop("__sw_seen")


def learn_suppressions(events: DataFrame) -> DataFrame:
    """(rule_id, ctx_hash, match_count, first_seen, last_seen, snippet) of recorded suppressions."""
    return events.groupBy("rule_id", "ctx_hash").agg(
        F.count("*").alias("match_count"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
        F.min(F.struct("seen_at", "snippet")).alias("s"),
    ).withColumn("snippet", F.col("s.snippet")).drop("s")
