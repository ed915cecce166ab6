"""Shared helpers of the text-corpus operators: scratch tables, row hygiene, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\x0c\r"
BATCH_ROWS = 512
HOT = 256


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Only a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    context = spark.sparkContext
    own = f"{shared_dir(spark).rstrip('/')}/sievework/{context.applicationId}"
    folder = context._jvm.org.apache.hadoop.fs.Path(own)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sw_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    context = df.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(df._sw_path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are done, which Spark deletes only when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS rows: whole texts make large ones, on both sides of the pipe."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def others(columns: list[str], *outs: str) -> list[str]:
    """The columns that no output replaces; as with withColumn, an output takes the place of its name, case ignored."""
    taken = {o.lower() for o in outs}
    return [c for c in columns if c.lower() not in taken]


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """(key) values that hold more rows than one in HOT, or than a task's mean where there are more tasks than HOT.

    There are fewer of them than tasks or HOT, so they are safe to broadcast.
    """
    n, parts = df.count(), max(HOT, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * parts > n).select(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take lower(), which is much cheaper than translate()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower())
    )


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of df has, case ignored."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def keyed_join(rows: DataFrame, key: str, values: DataFrame, found: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with values, one for each ``found``, where key = found; keys in hot (hot) meet theirs by broadcast."""
    hot = F.broadcast(hot)
    cold = rows.join(hot, F.col(key) == F.col("hot"), "left_anti").join(values, F.col(key) == F.col(found), how)
    near = F.broadcast(values.join(hot, F.col(found) == F.col("hot"), "left_semi"))
    warm = rows.join(hot, F.col(key) == F.col("hot"), "left_semi").join(near, F.col(key) == F.col(found), how)
    return cold.unionByName(warm)


def connected_components(nodes: DataFrame | None, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, component) for every id in edges (a long, b long): component is the smallest id reachable.

    Min-label hooking with pointer jumping. Neighbours' labels are combinable minima. A hub's edges, and the
    members that hang from one root, find its label by broadcast (hot_keys bounds how many there are), so
    no key gathers in a task; members whose root has settled take no part in the jump. Labels are written
    to the shared folder each round, and those before them deleted. The number of rounds is logarithmic in
    practice. ``nodes`` (id) adds isolated ids.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    both = both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "cc-edges")
    labels = materialize(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")),
        "cc-labels",
    )
    hubs = materialize(hot_keys(both, "b").toDF("hot"), "cc-hubs")
    for _ in range(max_rounds):
        found = keyed_join(both, "b", labels, "id", hubs).select("a", "component")
        hook = found.groupBy("a").agg(F.min("component").alias("m"))
        # the neighbours' smallest label, for the node and for the root that it hangs from
        seen = labels.join(hook, F.col("id") == F.col("a")).select("id", "component", "m")
        roots = seen.where("m < component").groupBy("component").agg(F.min("m").alias("r"))
        roots = roots.select(F.col("component").alias("root"), "r")
        stepped = seen.join(roots, F.col("id") == F.col("root"), "left").select(
            "id", F.least("component", "m", F.coalesce("r", "component")).alias("up"), F.col("component").alias("was")
        )
        stepped = materialize(stepped, "cc-steps")
        discard(labels)
        # only roots that hang from another themselves pass that on
        moved = stepped.select("up").distinct().join(stepped.where("up < id").select("id", F.col("up").alias("to")), F.col("up") == F.col("id"))
        moved = materialize(moved.select(F.col("id").alias("root"), "to"), "cc-moved")
        if moved.isEmpty():
            labels = stepped.select("id", F.col("up").alias("component"))
            labels._sw_path = stepped._sw_path
            if stepped.where("up <> was").isEmpty():
                break
            continue
        hot = materialize(hot_keys(stepped, "up").toDF("hot"), "cc-hot")
        jumped = keyed_join(stepped, "up", moved, "root", hot, "left").select("id", F.coalesce("to", "up").alias("component"))
        labels = materialize(jumped, "cc-labels")
        discard(stepped)
    else:
        raise RuntimeError("components did not settle")
    if nodes is not None:
        labels = nodes.select("id").distinct().join(labels, "id", "left").select(
            "id", F.coalesce("component", "id").alias("component")
        )
    return labels
