"""Scan results cached by file content and rule set, as a keyed table and as a stored one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import Change, Layout, Store

#: What a stored entry holds of a file's findings.
FOUND = "array<struct<rule_id:string,severity:string,owasp_category:string,cwe_id:string,line:int,column_num:int,snippet:string>>"
ENTRY = f"file_hash string, rule_set_hash string, language string, chars long, cached_at timestamp, findings {FOUND}"
TABLE = "scan_results"


def lookup(files: DataFrame, cache: DataFrame, rule_set_hash: str) -> DataFrame:
    """Files with ``hit``: is there a cached result for their content under this rule set?"""
    known = cache.where(F.col("rule_set_hash") == rule_set_hash).select("file_hash").distinct().withColumn("hit", F.lit(True))
    return files.join(known, "file_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(files: DataFrame, cache: DataFrame, rule_set_hash: str) -> DataFrame:
    return files.join(cache.where(F.col("rule_set_hash") == rule_set_hash), "file_hash", "left_anti")


def put(cache: DataFrame, results: DataFrame) -> DataFrame:
    """Cache after new results came in: they replace entries of the same key."""
    return cache.join(results, ["file_hash", "rule_set_hash"], "left_anti").unionByName(results)


def invalidate(cache: DataFrame, language: str) -> DataFrame:
    return cache.where(F.coalesce(F.col("language"), F.lit("")) != language)


def stale(cache: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Entries that are at least so many hours old."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("cached_at").cast("timestamp"))
    return cache.where(age >= hours * 3_600_000_000)


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.sum("chars").alias("chars"), F.min("cached_at").alias("oldest"))


def open_cache(spark: SparkSession, path: str, buckets: int = 16) -> Store:
    """A stored cache: entries (file_hash, rule_set_hash, language, chars, cached_at, findings) in buckets of file_hash."""
    return Store(spark, path, {TABLE: Layout(("file_hash",), groups=buckets)})


def rule_set_hash(rules: DataFrame) -> str:
    """Digest of a rule set, whatever the order of its rules and their place in their files."""
    plain = [F.col(x) for x in sorted(rules.columns) if x not in ("priority", "load_order", "position")]
    rows = rules.select(F.to_json(F.struct(*plain)).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return rows.select(F.sha2(F.array_join("rs", "\n"), 256).alias("h")).first().h


def entries(cache: Store) -> DataFrame:
    if cache.has(TABLE):
        return cache.read(TABLE)
    return cache.spark.createDataFrame([], ENTRY)


def results(cache: Store, digest: str) -> DataFrame:
    """The newest entry of each content under a rule set."""
    mine = entries(cache).where(F.col("rule_set_hash") == digest)
    return mine.groupBy("file_hash", "language").agg(F.max_by("findings", "cached_at").alias("findings"))


def store(cache: Store, results: DataFrame) -> int:
    """Put entries beside those that are there; nothing is written anew, and the newest of a key counts."""
    return cache.commit({TABLE: Change(results)})


def replace_entries(cache: Store, kept: DataFrame) -> int:
    """Make ``kept`` all that the cache holds: after invalidate() or without the stale() ones; old folders go with vacuum."""
    layout = cache.layouts[TABLE]
    return cache.commit({TABLE: Change(kept, list(range(layout.groups * layout.parts)))})


def clear(cache: Store) -> int:
    return replace_entries(cache, cache.spark.createDataFrame([], ENTRY))
