"""Orders, latest rows and timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domain import is_open, severity_rank
from ..scratch import checkpointed


def by_severity() -> list[Column]:
    return [F.desc(severity_rank("severity")), F.col("file_path"), F.col("line"), F.col("rule_id"), F.col("finding_id")]


def search_order(key: str = "severity", ascending: bool = False) -> list[Column]:
    """Order of a search result by severity, confidence, path, updated or created, made total by the id."""
    column = {
        "severity": severity_rank("severity"),
        "confidence": F.col("confidence_score"),
        "path": F.col("file_path"),
        "updated": F.col("updated_at"),
        "created": F.col("created_at"),
    }[key]
    return [column.asc() if ascending else column.desc(), F.col("finding_id")]


def snapshot_of(snapshots: DataFrame, wanted: str) -> DataFrame:
    """The snapshot that a name means: the oldest of that tag, else the newest whose time starts so."""
    found = snapshots.agg(
        F.min(F.when(F.col("tag") == wanted, F.struct("snapshot_at", "snapshot_id"))).alias("by_tag"),
        F.max(F.when(F.startswith("snapshot_at", F.lit(wanted)), F.struct("snapshot_at", "snapshot_id"))).alias("by_time"),
    )
    return found.select(F.coalesce("by_tag.snapshot_id", "by_time.snapshot_id").alias("snapshot_id"))


def newest_open_duplicates(findings: DataFrame) -> DataFrame:
    """Among open findings of one rule and file: (finding_id, kept), the newest is kept.

    The newest is found by a combinable maximum and joined back, so no task gathers a file's findings.
    """
    rows = findings.where(is_open("triage_state"))
    best = rows.groupBy("rule_id", "file_path").agg(F.max(F.struct("updated_at", "finding_id")).alias("b"))
    return rows.join(best, ["rule_id", "file_path"]).select("finding_id", (F.col("finding_id") == F.col("b.finding_id")).alias("kept"))


def timeline(findings: DataFrame) -> DataFrame:
    """(finding_id, event, at): detection, and the last change where it is later."""
    changed = F.when(
        F.col("updated_at") > F.col("created_at"), F.struct(F.col("triage_state").alias("event"), F.col("updated_at").alias("at"))
    )
    events = F.filter(F.array(F.struct(F.lit("detected").alias("event"), F.col("created_at").alias("at")), changed), lambda e: e.isNotNull())
    return findings.select("finding_id", F.explode(events).alias("e")).select("finding_id", "e.*")


def capped_trace(trace: Column, steps: int = 20, chars: int = 250) -> Column:
    """The first steps of a trace (array of strings), long ones cut and marked."""
    return F.transform(
        F.slice(trace, 1, steps),
        lambda s: F.when(F.char_length(s) > chars, F.concat(F.substring(s, 1, chars), F.lit("…"))).otherwise(s),
    )


def newest_first(rows: DataFrame, created: str, key: str, n: int | None = None) -> DataFrame:
    out = rows.orderBy(F.desc(created), key)
    return out if n is None else out.limit(n)


def ranked_by(rows: DataFrame, keys: Sequence[Column], n: int | None = None) -> DataFrame:
    """The rows in a total order; the first n by a bounded heap per partition."""
    out = rows.orderBy(*keys)
    return out if n is None else out.limit(n)


def positions(rows: DataFrame, group: list[str], order: Sequence[Column]) -> DataFrame:
    """rows plus position, from 1, of each row in a total order of its group, of whatever size.

    Rows are numbered in ranges of the order; a range's first number is how many rows of the group come before it.
    The ranges are written before both uses, which must see the same ones.
    """
    ranged = checkpointed(rows.repartitionByRange(*group, *order).withColumn("__sw_part", F.spark_partition_id()))
    own = ranged.withColumn("__sw_rn", F.row_number().over(Window.partitionBy("__sw_part", *group).orderBy(*order)))
    before = Window.partitionBy(*group).orderBy("__sw_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__sw_part", *group).agg(F.count("*").alias("__sw_n"))
    sizes = sizes.withColumn("__sw_before", F.coalesce(F.sum("__sw_n").over(before), F.lit(0)))
    out = own.join(sizes, ["__sw_part", *group])
    return out.select(*rows.columns, (F.col("__sw_rn") + F.col("__sw_before")).alias("position"))
