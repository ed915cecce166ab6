"""Lenient versions and version ranges as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .domain import c

_N = r"(?:0|[1-9]\d{0,8})"
_ANY = r"^ *[*xX] *$"
#: operator, major, minor, patch, pre-release; a wildcard ends the numbers.
_COMPARATOR = rf"^ *(>=|<=|>|<|=|\^|~)? *({_N})(?:\.(?:({_N})(?:\.(?:({_N})(-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?|[*xX]))?|[*xX](?:\.[*xX])?))? *$"
_KIND = "array<struct<op:string,major:int,minor:int,patch:int,pre:boolean>>"


def parse_version(v: Column | str) -> Column:
    """struct<major,minor,patch> of x.y.z, after a leading v and before - or +; null for anything else."""
    core = F.regexp_extract(F.trim(c(v)), r"^v*([^-+]*)", 1)
    part = lambda i: F.regexp_extract(core, rf"^({_N})\.({_N})\.({_N})$", i).cast("int")
    ok = core.rlike(rf"^{_N}\.{_N}\.{_N}$")
    return F.when(ok, F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def parse_ranges(ranges: Column | str) -> Column:
    """array<array<struct<op,major,minor,patch,pre>>>: ranges are OR-ed, their comma-separated comparators AND-ed.

    A comparator is an operator (none: ^, or = before a wildcard) and one to three numbers, of which missing or
    wildcard ones are null. ``*`` alone is a range without comparators. Ranges of another form are left out.
    """

    def comparator(s: Column) -> Column:
        part = lambda i: F.regexp_extract(s, _COMPARATOR, i)
        number = lambda i: F.when(part(i) != "", part(i).cast("int"))
        bare = F.when(s.rlike("[*xX]"), "=").otherwise("^")
        return F.struct(
            F.when(part(1) == "", bare).otherwise(part(1)).alias("op"),
            number(2).alias("major"),
            number(3).alias("minor"),
            number(4).alias("patch"),
            (part(5) != "").alias("pre"),
        )

    def one(r: Column) -> Column:
        parts = F.split(r, ",", -1)
        valid = F.forall(parts, lambda s: s.rlike(_COMPARATOR))
        return F.when(r.rlike(_ANY), F.array().cast(_KIND)).when(valid, F.transform(parts, comparator))

    return F.filter(F.transform(c(ranges), one), lambda r: r.isNotNull())


def satisfies(v: Column, k: Column) -> Column:
    """Does a parsed version satisfy a comparator? A number that the comparator lacks is not compared."""
    op, pre = k["op"], k["pre"]
    # the first number that differs decides; -1, 0 or 1 as far as the comparator goes
    sign = F.lit(0)
    for name in ("patch", "minor", "major"):
        sign = F.when(k[name].isNull() | (v[name] == k[name]), sign).when(v[name] > k[name], 1).otherwise(-1)
    whole = k["patch"].isNotNull()
    # a version without a pre-release comes after all pre-releases of the same numbers
    sign = F.when((sign == 0) & pre, 1).otherwise(sign)
    minor = k["minor"].isNull() | (v["minor"] == k["minor"])
    patch = k["patch"].isNull() | (v["patch"] >= k["patch"])
    same = v["major"] == k["major"]
    caret = same & (
        F.when(k["minor"].isNull(), True)
        .when(k["major"] > 0, sign >= 0)
        .when((k["minor"] > 0) | ~whole, minor & patch)
        .otherwise(minor & (v["patch"] == k["patch"]))
    )
    return F.coalesce(
        F.when(op == ">=", sign >= 0)
        .when(op == "<=", sign <= 0)
        .when(op == ">", sign > 0)
        .when(op == "<", sign < 0)
        .when(op == "=", sign == 0)
        .when(op == "~", same & minor & patch)
        .when(op == "^", caret),
        F.lit(False),
    )


def in_ranges(v: Column, parsed: Column) -> Column:
    """Does a parsed version fall into any of the parsed ranges? A version that does not parse falls into all."""
    hit = F.exists(parsed, lambda r: F.forall(r, lambda k: satisfies(v, k)))
    return F.when(v.isNull(), F.lit(True)).otherwise(hit)


_PART = 10**9
_TOP = "9" * 28


def version_key(v: Column) -> Column:
    """One sortable decimal(28,0) of a parsed version; null stays null."""
    wide = lambda x: v[x].cast("decimal(28,0)")
    high = (wide("major") * F.lit(_PART).cast("decimal(10,0)") + wide("minor")).cast("decimal(19,0)")
    return (high * F.lit(_PART).cast("decimal(10,0)") + wide("patch")).cast("decimal(28,0)")


def _interval(k: Column) -> Column:
    """struct<lo,hi> of the keys of the versions that satisfy a comparator, half open."""
    zero = lambda x: F.coalesce(x, F.lit(0))
    key = lambda a, b, c: version_key(F.struct(a.alias("major"), b.alias("minor"), c.alias("patch")))
    op, major, minor, patch, nothing, top = k["op"], k["major"], k["minor"], k["patch"], F.lit(0), F.lit(_TOP).cast("decimal(28,0)")
    begin = key(major, zero(minor), zero(patch))
    after_major, after_minor = key(major + 1, nothing, nothing), key(major, minor + 1, nothing)
    # the versions that a comparator names when what it lacks may be anything; none if it names a pre-release
    end = F.when(minor.isNull(), after_major).when(patch.isNull(), after_minor).when(k["pre"], begin).otherwise(begin + 1).cast("decimal(28,0)")
    caret = F.when(minor.isNull() | (major > 0), after_major).when((minor > 0) | patch.isNull(), after_minor).otherwise((begin + 1).cast("decimal(28,0)"))
    tilde = F.when(minor.isNull(), after_major).otherwise(after_minor)
    low = F.when(op.isin("<", "<="), F.lit(0).cast("decimal(28,0)")).when(op == ">", end).otherwise(begin)
    high = F.when(op == "<", begin).when(op.isin("<=", "="), end).when(op == "~", tilde).when(op == "^", caret).otherwise(top)
    return F.struct(low.alias("lo"), high.alias("hi"))


def range_intervals(parsed: Column) -> Column:
    """Parsed ranges as array<struct<lo,hi>> of version keys, one for each range, half open; some may be empty."""
    whole = F.struct(F.lit(0).cast("decimal(28,0)").alias("lo"), F.lit(_TOP).cast("decimal(28,0)").alias("hi"))

    def one(comparators: Column) -> Column:
        each = F.array_append(F.transform(comparators, _interval), whole)
        return F.struct(F.array_max(F.transform(each, lambda x: x["lo"])).alias("lo"), F.array_min(F.transform(each, lambda x: x["hi"])).alias("hi"))

    return F.transform(parsed, one)
