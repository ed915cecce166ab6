"""As-of joins and interval joins that cut hot keys by position.

Both lay their rows out in ranges of (key, position) instead of groups by key, so a key that holds half of all
rows is spread over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import checkpointed

_AT, _KIND, _ROW, _MARK, _RANGE, _TIE = "__sw_at", "__sw_kind", "__sw_row", "__sw_mark", "__sw_range", "__sw_tie"


def last_mark(rows: DataFrame, marks: DataFrame, by: Sequence[str], at: str, mark_at: str) -> DataFrame:
    """rows with ``mark``: the struct of the last row of marks with equal ``by`` and mark_at <= at, else null.

    marks has one row for each (by, mark_at). A two-level scan: rows and marks are range-partitioned by (by, position)
    together, each range hands on the last mark it has seen, and what a range cannot see at its beginning
    comes from the ranges before it. Only keys that cross a border of ranges hand anything on, so that at most twice
    as many rows as there are ranges are broadcast. Many rows of one position may lie in several ranges. Rows with
    a null in ``by`` or ``at`` get null.
    """
    by = list(by)
    given = [c for c in marks.columns if c not in by]
    own = [c for c in rows.columns if c not in by]
    no_mark, no_row = (F.lit(None).cast(df.select(F.struct(*cols)).schema[0].dataType) for df, cols in ((marks, given), (rows, own)))
    usable = " and ".join(f"`{c}` is not null" for c in by)
    both = marks.where(f"{usable} and `{mark_at}` is not null").select(
        *by, F.col(mark_at).alias(_AT), F.lit(0).alias(_KIND), F.lit(0).cast("long").alias(_TIE), F.struct(*given).alias(_MARK), no_row.alias(_ROW)
    ).unionByName(
        rows.select(*by, F.col(at).alias(_AT), F.lit(1).alias(_KIND), F.xxhash64(*own).alias(_TIE), no_mark.alias(_MARK), F.struct(*own).alias(_ROW))
    )
    order = [_AT, _KIND, _TIE]
    laid = both.repartitionByRange(*by, *order).withColumn(_RANGE, F.spark_partition_id())
    laid = checkpointed(laid, "asof")
    upto = Window.partitionBy(_RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = laid.withColumn("mark", F.last(_MARK, ignorenulls=True).over(upto)).where(f"{_KIND} = 1")
    # the last mark of each range of a key that has several
    ends = laid.where(usable).groupBy(*by, _RANGE).agg(F.max_by(_MARK, F.when(F.col(_KIND) == 0, F.struct(*order))).alias("m"))
    wide = ends.groupBy(*by).agg(F.count("*").alias("n"), F.collect_list(F.struct(F.col(_RANGE).alias("r"), "m")).alias("all")).where("n > 1")
    before = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = wide.select(*by, F.explode("all").alias("e")).select(*by, F.col("e.r").alias(_RANGE), F.col("e.m").alias("m"))
    carried = carried.withColumn("carried", F.last("m", ignorenulls=True).over(before)).where("carried is not null").drop("m")
    found = seen.join(F.broadcast(carried), [*by, _RANGE], "left")
    known = F.lit(True)
    for c in (*by, _AT):
        known = known & F.col(c).isNotNull()
    return found.select(*by, f"{_ROW}.*", F.when(known, F.coalesce("mark", "carried")).alias("mark")).select(*rows.columns, "mark")


def disjoint(intervals: Column) -> Column:
    """Sorted, disjoint half-open intervals that cover the same as array<struct<lo,hi>>; empty ones are left out."""
    whole = F.array_sort(F.filter(intervals, lambda x: x["lo"] < x["hi"]))
    last = lambda out: F.element_at(out, -1)

    def add(out: Column, x: Column) -> Column:
        joined = F.struct(last(out)["lo"].alias("lo"), F.greatest(last(out)["hi"], x["hi"]).alias("hi"))
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))
        return F.when((F.size(out) > 0) & (x["lo"] <= F.try_element_at(out, F.lit(-1))["hi"]), grown).otherwise(F.array_append(out, x))

    return F.aggregate(whole, F.filter(whole, lambda x: F.lit(False)), add)


def interval_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, bin_rows: int = 4096) -> DataFrame:
    """points joined with intervals (by, lo, hi, ..) where by is equal and lo <= at < hi.

    Positions and both ends of the intervals of a key are numbered in one order, and every ``bin_rows`` of them are
    a bin. An interval goes to the bins that it touches, where it meets their points: those that reach across
    a whole bin pair with each of its points, and there are at most bin_rows others. A bin whose points repeat one
    position many times is salted by their number. Equal rows of intervals count once. Columns of the two sides other than ``by`` have different names.
    Intervals of a key should be disjoint for each thing they stand for (see ``disjoint``), as every hit is one row.
    """
    by = list(by)
    spots = points.select(*by, F.col(at).alias(_AT), F.lit(1).alias("n"))
    for end in ("lo", "hi"):
        spots = spots.unionByName(intervals.select(*by, F.col(end).alias(_AT), F.lit(0).alias("n")))
    spots = spots.where(" and ".join(f"`{c}` is not null" for c in (*by, _AT))).groupBy(*by, _AT).agg(F.sum("n").alias("n"))
    laid = checkpointed(spots.repartitionByRange(*by, _AT).withColumn(_RANGE, F.spark_partition_id()), "interval-spots")
    k = F.row_number().over(Window.partitionBy(_RANGE, *by).orderBy(_AT)) - 1
    part = F.struct(F.col(_RANGE), F.floor(k / bin_rows).alias("k"))
    bins = laid.withColumn("part", part).groupBy(*by, "part").agg(F.min(_AT).alias("begins"), F.sum("n").alias("n"))
    # bins of a key count up by position
    bins = bins.select(
        *by, "begins", F.row_number().over(Window.partitionBy(*by).orderBy("part")).alias("bin"), F.ceil((F.col("n") + 1) / (4 * bin_rows)).cast("int").alias("salts")
    )
    bins = checkpointed(bins, "interval-bins")
    # points and both ends of the intervals find their bins together
    point, span = F.struct(*points.columns), F.struct(*intervals.columns)
    no_point, no_span = (F.lit(None).cast(df.select(x).schema[0].dataType) for df, x in ((points, point), (intervals, span)))
    rows = points.select(*by, F.col(at).alias(_AT), point.alias("p"), no_span.alias("s"))
    for end in ("lo", "hi"):
        rows = rows.unionByName(intervals.where("lo < hi").select(*by, F.col(end).alias(_AT), no_point.alias("p"), span.alias("s")))
    placed = last_mark(rows.withColumnRenamed(_AT, "at"), bins, by, "at", "begins").where("mark is not null")
    a = placed.where("p is not null").select(*by, "p", F.col("mark.bin").alias("bin"), F.pmod(F.xxhash64("p"), F.col("mark.salts")).cast("int").alias("salt"))
    b = placed.where("s is not null").groupBy(*by, "s").agg(F.min("mark.bin").alias("first"), F.max("mark.bin").alias("last"))
    b = b.select(*by, "s", F.explode(F.sequence("first", "last")).alias("bin")).join(bins.select(*by, "bin", "salts"), [*by, "bin"])
    b = b.select(*by, "s", "bin", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hits = a.join(b, [*by, "bin", "salt"]).where((F.col("s.lo") <= F.col(f"p.{at}")) & (F.col(f"p.{at}") < F.col("s.hi")))
    return hits.select("p.*", *[f"s.{c}" for c in intervals.columns if c not in (*by, "lo", "hi")])
