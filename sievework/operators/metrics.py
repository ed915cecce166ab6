"""Dashboard metrics kept up to date from what changed between two versions of the findings.

``daily_counts`` holds sums that can be added and taken away (findings, open ones, resolved ones and their hours) by
project, day and severity: rows of buckets that were written anew count once with each sign, and those that did not
change cancel out. ``daily_sketches`` holds HyperLogLog sketches of rules and files by project and day. Sketches can be merged but
not taken from, so those of the projects whose buckets changed are made anew from the buckets of these projects. Both are tables
of a store, which remembers up to which version of the findings they reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domain import FIXED_STATES, is_open
from ..scratch import checkpointed, discard
from .snapshots import Change, Layout, Store

#: Bits of a sketch's registers: 2^12 of them, a standard error of 1.6 %, and exact for some dozens of values.
PRECISION = 12
SALTS = 4
LAYOUTS = {"daily_counts": Layout(("project_id", "day", "severity"), groups=8), "daily_sketches": Layout(("project_id", "day"), groups=8)}
MARK = "metrics_of"
SUMS = ["findings", "open", "resolved", "hours"]


def daily_counts(findings: DataFrame, sign: int = 1) -> DataFrame:
    """(project_id, day, severity, findings, open, resolved, hours) of findings, with a sign."""
    fixed = F.col("triage_state").isin(*FIXED_STATES)
    hours = F.timestamp_diff("HOUR", F.col("created_at"), F.col("updated_at"))
    return findings.groupBy("project_id", F.to_date("created_at").alias("day"), "severity").agg(
        (F.count("*") * sign).alias("findings"), (F.count_if(is_open("triage_state")) * sign).alias("open"), (F.count_if(fixed) * sign).alias("resolved"),
        (F.coalesce(F.sum(F.when(fixed, hours)), F.lit(0)) * sign).alias("hours"),
    )


def daily_sketches(findings: DataFrame) -> DataFrame:
    """(project_id, day, rules, files): mergeable sketches of distinct rules and files.

    A sketch that is begun takes kilobytes, many times its rows, so the rows and not the sketches of every task are
    shuffled; a day's rows go to SALTS tasks at most, whose sketches then are merged.
    """
    rows = findings.select("project_id", F.to_date("created_at").alias("day"), "rule_id", "file_path")
    rows = rows.repartition("project_id", "day", F.pmod(F.xxhash64("rule_id", "file_path"), F.lit(SALTS)))
    return rows.groupBy("project_id", "day").agg(
        F.hll_sketch_agg("rule_id", PRECISION).alias("rules"), F.hll_sketch_agg("file_path", PRECISION).alias("files")
    )


def delta(store: Store, table: str, before: int, after: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """(rows of folders that only the one version has, of those that only the other has, buckets of both)."""
    one, two = ({(b, f) for b, f in store.manifest(v)["tables"][table]["folders"]} for v in (before, after))
    rows = lambda folders: store.spark.read.schema(schema).parquet(*[f"{store.path}/{f}" for _, f in sorted(folders)]) if folders else store.spark.createDataFrame([], schema)
    schema = store.read(table, after).schema
    return rows(one - two), rows(two - one), sorted({b for b, _ in one ^ two})


def refresh(store: Store, metrics: Store, table: str = "findings") -> int:
    """Bring the metrics to the newest version of the findings; only what changed since is read. The metrics' new version."""
    now, seen = store.versions()[-1], metrics.mark(MARK)
    if seen == now:
        return metrics.versions()[-1]
    if seen is None:
        fresh = [daily_sketches(store.read(table, now, own)) for own in store.slices(table)]
        return metrics.commit({"daily_counts": Change(daily_counts(store.read(table))), "daily_sketches": Change(fresh)}, {MARK: now})
    gone, new, buckets = delta(store, table, seen, now)
    changed = daily_counts(gone, -1).unionByName(daily_counts(new))
    changed = changed.groupBy("project_id", "day", "severity").agg(*[F.sum(c).alias(c) for c in SUMS]).where(" or ".join(f"{c} <> 0" for c in SUMS))
    changed = checkpointed(changed, "changed")
    touched = metrics.layouts["daily_counts"].of(changed)
    counts = metrics.read("daily_counts", buckets=touched).unionByName(changed)
    counts = counts.groupBy("project_id", "day", "severity").agg(*[F.sum(c).alias(c) for c in SUMS]).where("findings > 0")
    projects = checkpointed(gone.select("project_id").unionByName(new.select("project_id")).distinct(), "projects")
    layout, sketches = store.layouts[table], metrics.layouts["daily_sketches"]
    fresh = [daily_sketches(store.read(table, now, own).join(projects, "project_id", "left_semi")) for own in store.slices(table, layout.all_of(projects))]
    places = sketches.all_of(projects)
    kept = metrics.read("daily_sketches", buckets=places).join(projects, "project_id", "left_anti")
    version = metrics.commit({"daily_counts": Change(counts, touched), "daily_sketches": Change([kept, *fresh], places)}, {MARK: now})
    discard(changed, projects)
    return version


def overview(metrics: Store) -> DataFrame:
    """(project_id, severity, findings, open, resolved, hours) of all days."""
    return metrics.read("daily_counts").groupBy("project_id", "severity").agg(*[F.sum(c).alias(c) for c in SUMS])


def distinct_counts(metrics: Store) -> DataFrame:
    """(project_id, rules, files): estimates from the days' sketches."""
    merged = metrics.read("daily_sketches").groupBy("project_id").agg(F.hll_union_agg("rules").alias("r"), F.hll_union_agg("files").alias("f"))
    return merged.select("project_id", F.hll_sketch_estimate("r").alias("rules"), F.hll_sketch_estimate("f").alias("files"))
