"""Line diffs of pairs of texts: patience diff as joins, hunks with context, and their application.

Anchors are lines that stand once on both sides of a gap, and the equal lines at its beginning and end; of the
anchors the longest run that increases on both sides is kept, and cuts the gap again. It ends when no gap has a new
anchor; what is left is deleted on one side and added on the other. Every step is a join or window by pair, so the work
of one task is a pair of texts at most; only the choice of the longest run looks at arrays of positions in Python.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import checkpointed, discard, free_shuffles

CONTEXT = 3


def longest_run(pairs: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of their first numbers the longest choice whose second numbers increase as well."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, b) in enumerate(pairs):
        n = bisect.bisect_left(tails, b)
        before.append(at[n - 1] if n else -1)
        tails[n : n + 1] = [b]
        at[n : n + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _longest_runs(candidates: DataFrame) -> DataFrame:
    """(pair, gap, a, b) of the anchors that are kept; candidates are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, gaps, out = [], [], []
            for pair, gap, found in zip(*(batch.column(k).to_pylist() for k in range(3))):
                kept = longest_run([(x["a"], x["b"]) for x in found])
                names += [pair] * len(kept)
                gaps += [gap] * len(kept)
                out += kept
            columns = [pa.array(names, batch.schema.field(0).type), pa.array(gaps, pa.int32()), *(pa.array([x[k] for x in out], pa.int32()) for k in range(2))]
            yield pa.RecordBatch.from_arrays(columns, names=["pair", "gap", "a", "b"])

    grouped = candidates.distinct().groupBy("pair", "gap").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("found"))
    return grouped.select("pair", "gap", "found").mapInArrow(run, candidates.select("pair", "gap", "a", "b").schema)


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that never broadcasts: files of positions are small, but as rows in the driver's memory they are many times larger."""
    return left.join(right.hint("merge"), on, how)


def _ends(rows: DataFrame) -> DataFrame:
    """(pair, gap, pos, h, lo, hi): lines with the first and last position of their gap."""
    w = Window.partitionBy("pair", "gap")
    return rows.select("pair", "gap", "pos", "h", F.min("pos").over(w).alias("lo"), F.max("pos").over(w).alias("hi"))


def _gaps(lines: DataFrame, fresh: DataFrame) -> DataFrame:
    """The lines of the gaps that fresh anchors (pair, gap, pos, at) cut, in their new gaps, without those lines.

    A gap has the old side's position of the matched line before it. One that has no new anchor never gets any.
    """
    rows = _joined(lines, fresh.select("pair", "gap").distinct(), ["pair", "gap"], "left_semi")
    rows = _joined(rows.select("pair", "gap", "pos", "h"), fresh, ["pair", "gap", "pos"], "left")
    upto = Window.partitionBy("pair", "gap").orderBy("pos")
    rows = rows.withColumn("next", F.coalesce(F.last("at", ignorenulls=True).over(upto), "gap")).where("at is null")
    return _ends(rows.select("pair", F.col("next").alias("gap"), "pos", "h"))


def matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pair, a, b): the lines of old (pair, pos, line) and new that stand for each other, increasing on both sides."""
    sides = [checkpointed(x.select("pair", F.col("pos").cast("int").alias("pos"), F.xxhash64("line", F.lit(1)).alias("h")), "diff-side") for x in (old, new)]
    a, b = (checkpointed(_ends(x.withColumn("gap", F.lit(-1))), "diff-gaps") for x in sides)
    discard(*sides)
    found: list[DataFrame] = []
    while True:
        once = lambda x, name: x.groupBy("pair", "gap", "h").agg(F.count("*").alias("n"), F.min("pos").alias(name)).where("n = 1").drop("n")
        unique = _joined(once(a, "a"), once(b, "b"), ["pair", "gap", "h"]).select("pair", "gap", "a", "b")
        ends = []
        for off in (F.col("pos") - F.col("lo"), F.col("hi") - F.col("pos")):
            x, y = (s.select("pair", "gap", off.alias("off"), F.col("pos").alias(n), F.col("h").alias(f"h{n}"), (F.col("hi") - F.col("lo") + 1).alias(f"n{n}")) for s, n in ((a, "a"), (b, "b")))
            both = _joined(x, y, ["pair", "gap", "off"]).withColumn("same", F.col("ha") == F.col("hb"))
            # those before the first that differs
            so_far = F.min(F.col("same").cast("int")).over(Window.partitionBy("pair", "gap").orderBy("off"))
            ends.append(both.withColumn("run", so_far).where("run = 1"))
        first, last = ends
        # what the beginning has taken the end does not take
        taken = first.groupBy("pair", "gap").agg(F.count("*").alias("taken"))
        last = _joined(last, taken, ["pair", "gap"], "left").where(F.col("off") < F.least("na", "nb") - F.coalesce("taken", F.lit(0)))
        fresh = checkpointed(_longest_runs(unique.unionByName(first.select("pair", "gap", "a", "b")).unionByName(last.select("pair", "gap", "a", "b"))), "diff-anchors")
        if fresh.isEmpty():
            discard(fresh, a, b)
            spark = old.sparkSession
            known = fresh.select("pair", "a", "b").schema
            return spark.read.schema(known).parquet(*[x._sw_path for x in found]) if found else spark.createDataFrame([], known)
        found.append(fresh)
        # what no new anchor cuts is done, so every round looks at fewer lines
        cut = [checkpointed(_gaps(x, fresh.select("pair", "gap", F.col(pos).alias("pos"), F.col("a").alias("at"))), "diff-gaps") for x, pos in ((a, "a"), (b, "b"))]
        discard(a, b)
        free_shuffles(old.sparkSession)
        a, b = cut


def script(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pair, at, kind, a, b, line): the lines of both sides in order; kind is ' ', '-' or '+'.

    ``a`` counts the old lines before the line and ``b`` the new ones, from 0; deletions come before additions.
    """
    both = matches(old, new)
    left = old.select("pair", F.col("pos").cast("int").alias("a"), "line")
    left = _joined(left, both, ["pair", "a"], "left")
    right = new.select("pair", F.col("pos").cast("int").alias("b"), "line")
    right = _joined(right, both.select("pair", "b"), ["pair", "b"], "left_anti")
    rows = left.select("pair", F.when(F.col("b").isNull(), "-").otherwise(" ").alias("kind"), "a", "b", "line").unionByName(
        right.select("pair", F.lit("+").alias("kind"), F.lit(None).cast("int").alias("a"), "b", "line")
    )
    # a line's gap follows the last matched line before it on its own side
    by_a, by_b = (Window.partitionBy("pair", F.col(c).isNull()).orderBy(c).rowsBetween(Window.unboundedPreceding, 0) for c in ("a", "b"))
    match_a = F.when(F.col("kind") == " ", F.col("a"))
    rows = rows.withColumn("gap_a", F.max(match_a).over(by_a)).withColumn("gap_b", F.max(match_a).over(by_b))
    gap = F.coalesce(F.when(F.col("kind") == "+", F.col("gap_b")).otherwise(F.col("gap_a")), F.lit(-1))
    rank = F.when(F.col("kind") == " ", 0).when(F.col("kind") == "-", 1).otherwise(2)
    order = Window.partitionBy("pair").orderBy("gap", "rank", F.coalesce("b", "a"), "a")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"gap": gap, "rank": rank})
    count = lambda kinds: F.coalesce(F.count_if(F.col("kind").isin(*kinds)).over(before), F.lit(0)).cast("int")
    return rows.select("pair", F.row_number().over(order).alias("at"), "kind", count((" ", "-")).alias("a"), count((" ", "+")).alias("b"), "line")


def hunks(steps: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(pair, hunk, at, kind, a, b, line): the changed lines of a script and those up to ``context`` around them."""
    w = Window.partitionBy("pair").orderBy("at")
    changed = F.when(F.col("kind") != " ", F.col("at"))
    near = steps.withColumns({"prev": F.max(changed).over(w), "next": F.min(changed).over(w.rowsBetween(0, Window.unboundedFollowing))})
    near = near.where((F.col("at") - F.col("prev") <= context) | (F.col("next") - F.col("at") <= context))
    starts = F.when(F.col("at") - F.lag("at", 1, -1).over(w) > 1, 1).otherwise(0)
    return near.withColumn("starts", starts).withColumn("hunk", F.sum("starts").over(w).cast("int")).select("pair", "hunk", "at", "kind", "a", "b", "line")


def unified(found: DataFrame) -> DataFrame:
    """(pair, diff): the hunks as unified diff text."""
    of_kind = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    per = found.groupBy("pair", "hunk").agg(
        F.min("a").alias("a"), F.min("b").alias("b"), of_kind(" ", "-").alias("n"), of_kind(" ", "+").alias("m"),
        F.array_sort(F.collect_list(F.struct("at", F.concat("kind", "line").alias("text")))).alias("body"),
    )
    start = lambda at, n: F.concat(F.when(F.col(n) > 0, F.col(at) + 1).otherwise(F.col(at)), F.lit(","), n)
    head = F.concat(F.lit("@@ -"), start("a", "n"), F.lit(" +"), start("b", "m"), F.lit(" @@"))
    text = per.select("pair", "hunk", F.concat_ws("\n", head, F.array_join(F.col("body.text"), "\n")).alias("text"))
    return text.groupBy("pair").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk", "text"))), lambda x: x["text"]), "\n").alias("diff"))


def apply_hunks(old: DataFrame, found: DataFrame) -> DataFrame:
    """(pair, text): the old lines (pair, pos, line) with the hunks' deletions left out and additions put in, joined by newlines."""
    gone = found.where("kind = '-'").select("pair", F.col("a").alias("pos"))
    kept = old.select("pair", F.col("pos").cast("int").alias("pos"), "line")
    kept = _joined(kept, gone, ["pair", "pos"], "left_anti")
    added = found.where("kind = '+'").select("pair", F.col("a").alias("pos"), F.lit(0).alias("side"), F.col("b").alias("turn"), "line")
    rows = added.unionByName(kept.select("pair", "pos", F.lit(1).alias("side"), F.lit(0).alias("turn"), "line"))
    pieces = F.array_sort(F.collect_list(F.struct("pos", "side", "turn", "line")))
    return rows.groupBy("pair").agg(pieces.alias("p")).select("pair", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("text"))
