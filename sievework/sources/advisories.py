"""Vulnerability advisories from public feeds, and their match with dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import c
from ..functions.versions import parse_ranges, parse_version, range_intervals, version_key
from ..operators.asof import disjoint, interval_join
from ..scratch import checkpointed

OSV = (
    "id string, aliases array<string>, modified string, summary string, severity array<struct<type:string,score:string>>, "
    "affected array<struct<package:struct<ecosystem:string,name:string>,"
    "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"
)


def cvss_severity(score: Column | str) -> Column:
    """Severity of a base score, cut to an integer; Medium where it is no number."""
    n = F.floor(c(score).try_cast("double"))
    return F.when(n.isNull(), "Medium").when(n >= 9, "Critical").when(n >= 7, "High").when(n >= 4, "Medium").when(n >= 1, "Low").otherwise("Info")


def range_strings(ranges: Column) -> Column:
    """Ranges of one affected package as text: last_affected ones as they come, then introduced and fixed."""
    usable = F.filter(ranges, lambda r: r["type"].isin("SEMVER", "ECOSYSTEM"))

    def of_range(r: Column) -> Column:
        step = F.aggregate(
            r["events"],
            F.struct(F.lit(None).cast("string").alias("intro"), F.lit(None).cast("string").alias("fix"), F.array().cast("array<string>").alias("out")),
            lambda s, e: F.struct(
                F.when(e["introduced"].isNotNull() & (e["introduced"] != "0"), e["introduced"]).otherwise(s["intro"]).alias("intro"),
                F.coalesce(e["fixed"], s["fix"]).alias("fix"),
                F.when(
                    e["last_affected"].isNotNull(),
                    F.concat(
                        s["out"],
                        F.array(
                            F.concat(
                                F.coalesce(
                                    F.concat(F.lit(">="), F.when(e["introduced"].isNotNull() & (e["introduced"] != "0"), e["introduced"]).otherwise(s["intro"]), F.lit(", ")),
                                    F.lit(""),
                                ),
                                F.lit("<="),
                                e["last_affected"],
                            )
                        ),
                    ),
                ).otherwise(s["out"]).alias("out"),
            ),
        )
        return F.transform(
            F.array(step),
            lambda s: F.array_compact(
                F.array_append(
                    s["out"],
                    F.when(s["intro"].isNotNull() & s["fix"].isNotNull(), F.concat(F.lit(">="), s["intro"], F.lit(", <"), s["fix"]))
                    .when(s["intro"].isNotNull(), F.concat(F.lit(">="), s["intro"]))
                    .when(s["fix"].isNotNull(), F.concat(F.lit("<"), s["fix"])),
                )
            ),
        )[0]

    return F.array_distinct(F.flatten(F.transform(usable, of_range)))


def import_osv(records: DataFrame) -> DataFrame:
    """Advisories of OSV records (json): one per affected package."""
    r = records.select(F.from_json("json", OSV).alias("r")).select("r.*").where("id is not null")
    alias = lambda p: F.get(F.filter("names", lambda a: a.startswith(p)), 0)
    r = r.withColumn("names", F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = r.select("*", F.explode("affected").alias("a"))
    rows = rows.select(
        alias("CVE-").alias("cve_id"),
        alias("GHSA-").alias("ghsa_id"),
        F.col("a.package.ecosystem").alias("ecosystem"),
        F.col("a.package.name").alias("package_name"),
        range_strings(F.coalesce(F.col("a.ranges"), F.array().cast("array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>"))).alias("vulnerable_versions"),
        "modified",
        "summary",
        F.col("severity")[0]["score"].alias("score"),
    )
    return rows.withColumn("severity", cvss_severity("score")).drop("score")


#: Ecosystem names of the two feeds.
ECOSYSTEMS = {"NPM": "npm", "PYPI": "PyPI", "RUST": "crates.io", "CRATES_IO": "crates.io", "MAVEN": "Maven", "GO": "Go", "RUBYGEMS": "RubyGems", "NUGET": "NuGet"}


def ghsa_severity(s: Column | str) -> Column:
    return F.when(c(s) == "CRITICAL", "Critical").when(c(s) == "HIGH", "High").when(c(s) == "LOW", "Low").otherwise("Medium")


def ghsa_ecosystem(e: Column | str) -> Column:
    out = c(e)
    for name, ours in ECOSYSTEMS.items():
        out = F.when(F.upper(c(e)) == name, ours).otherwise(out)
    return out


def import_ghsa(nodes: DataFrame) -> DataFrame:
    """Advisories of (ghsa_id, severity, ecosystem, package_name, range) nodes."""
    r = F.trim("range")
    return nodes.select(
        "ghsa_id",
        ghsa_ecosystem("ecosystem").alias("ecosystem"),
        "package_name",
        F.when(r != "", F.array(r)).otherwise(F.array().cast("array<string>")).alias("vulnerable_versions"),
        ghsa_severity("severity").alias("severity"),
    )


def advisory_key(rows: DataFrame) -> DataFrame:
    """Adds advisory_id: CVE, else GHSA, else ecosystem:package:first range, within its ecosystem and package."""
    first = F.coalesce(F.get("vulnerable_versions", 0), F.lit(""))
    key = F.coalesce("cve_id", "ghsa_id", F.concat_ws(":", "ecosystem", "package_name", first))
    return rows.withColumn("advisory_id", key)


def match(deps: DataFrame, advisories: DataFrame, bin_rows: int = 4096) -> DataFrame:
    """Dependencies with the advisories that their version falls under (all of the package if it does not parse).

    Every distinct list of ranges becomes disjoint intervals of one version key, and every distinct version a
    position on it, so a package with many advisories is cut by version; rows then meet theirs again by equal keys.
    """
    place = ["ecosystem", "package_name"]
    deps, name = deps.withColumn("__sw_v", parse_version("version")), [x for x in advisories.columns if x not in ("ecosystem", "package_name")]
    versions = checkpointed(deps.select(*deps.columns[:-1], version_key(F.col("__sw_v")).alias("__sw_key")), "advisory-versions")
    lists = advisories.select("vulnerable_versions").distinct()
    parsed = lists.select("vulnerable_versions", disjoint(range_intervals(parse_ranges("vulnerable_versions"))).alias("__sw_cover"))
    rows = checkpointed(advisories.join(parsed, "vulnerable_versions").select(*advisories.columns, "__sw_cover"), "advisory-ranges")
    spans = rows.select(*advisories.columns, F.explode("__sw_cover").alias("i")).select(*advisories.columns, "i.lo", "i.hi")
    hits = interval_join(versions.where("__sw_key is not null"), spans, place, "__sw_key", bin_rows)
    loose = versions.where("__sw_key is null").join(advisories, place)
    return hits.select(*versions.columns, *name).unionByName(loose.select(*versions.columns, *name)).drop("__sw_key")


def stale(sources: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Feeds whose last sync is at least so many hours ago."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_synced_at").cast("timestamp"))
    return sources.where(age >= hours * 3_600_000_000)
