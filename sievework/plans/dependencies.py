"""Queries over manifests, advisories and cloud inventories."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import versions as V
from ..operators import joins as J
from ..registry import query
from ..sources import advisories as A
from ..sources import cloud as K
from ..sources import manifests as M
from .standins import deps, read


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "file_path string, text string")


def values(*rows) -> str:
    lit = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


PKG = json.dumps({"dependencies": {"left": "^1.2.3", "b": ">= 2.0.0"}, "devDependencies": {"c": "~3.1.0"}})
LOCK2 = json.dumps({"lockfileVersion": 2, "packages": {"": {"version": "1.0.0"}, "node_modules/a": {"version": "1.1.1"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0"}, "node_modules/n": {}}})
LOCK1 = json.dumps({"dependencies": {"a": {"version": "9.9.9"}}})
REQ = "# comment\nrequests[security]==2.28.0\nflask >= 1.0, < 2\nnumpy\n-r other.txt\ndjango~=4.2  # web\nx!=1.0\n\n"
TOML = '[package]\nname = "p"\n[dependencies]\nserde = "1.0.1"\ntokio = { version = "^1.2" }\nw = { workspace = true }\n[dev-dependencies]\nr = "=0.3.0"\n'
CLOCK = '[[package]]\nname = "own"\nversion = "0.1.0"\n[[package]]\nname = "serde"\nversion = "1.0.5"\nsource = "registry"\n'
COLS = "t(file_path, ecosystem, package_name, version)"


@query("src8_package_json", f"SELECT * FROM {values(('package.json', 'npm', 'left', '1.2.3'), ('package.json', 'npm', 'b', '2.0.0'), ('package.json', 'npm', 'c', '3.1.0'))} {COLS}")
def src8(spark, d):
    return M.package_json(files(spark, ("package.json", PKG)))


@query("src9_package_lock", f"SELECT * FROM {values(('2.json', 'npm', 'a', '1.1.1'), ('2.json', 'npm', '@s/b', '2.0.0'), ('1.json', 'npm', 'a', '9.9.9'))} {COLS}")
def src9(spark, d):
    return M.package_lock(files(spark, ("2.json", LOCK2), ("1.json", LOCK1)))


@query("src10_cargo_toml", f"SELECT * FROM {values(('Cargo.toml', 'crates.io', 'serde', '1.0.1'), ('Cargo.toml', 'crates.io', 'tokio', '1.2'), ('Cargo.toml', 'crates.io', 'r', '0.3.0'))} {COLS}")
def src10(spark, d):
    return M.cargo_toml(files(spark, ("Cargo.toml", TOML), ("bad", "[")))


@query("src11_cargo_lock", f"SELECT * FROM {values(('Cargo.lock', 'crates.io', 'serde', '1.0.5'))} {COLS}")
def src11(spark, d):
    return M.cargo_lock(files(spark, ("Cargo.lock", CLOCK)))


@query(
    "src12_requirements",
    f"SELECT * FROM {values(*[('r.txt', 'PyPI', n, v) for n, v in (('requests', ''), ('flask', '1.0'), ('numpy', ''), ('django', '4.2'), ('x', '1.0'))])} {COLS}",
)
def src12(spark, d):
    """Extras are cut off before the operator is sought, so a pinned extra has no version."""
    return M.requirements(files(spark, ("r.txt", REQ)))


@query(
    "src13_manifest_walk",
    f"SELECT * FROM {values(('a/package-lock.json', 'npm', 'a', '9.9.9'), ('b/package.json', 'npm', 'left', '1.2.3'), ('b/package.json', 'npm', 'b', '2.0.0'), ('b/package.json', 'npm', 'c', '3.1.0'), ('c/requirements.txt', 'PyPI', 'numpy', ''), ('Cargo.lock', 'crates.io', 'serde', '1.0.5'))} {COLS}",
)
def src13(spark, d):
    rows = [("a/package.json", PKG), ("a/package-lock.json", LOCK1), ("b/package.json", PKG), ("c/requirements.txt", "numpy\n"), ("Cargo.toml", TOML), ("Cargo.lock", CLOCK)]
    return M.dependencies(files(spark, *rows))


OSV = [
    {"id": "GHSA-1", "aliases": ["CVE-2020-1"], "modified": "2020", "severity": [{"type": "CVSS_V3", "score": "9.8"}],
     "affected": [{"package": {"ecosystem": "npm", "name": "a"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.2.0"}]}]},
                  {"package": {"ecosystem": "npm", "name": "b"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "1.0.0"}, {"last_affected": "1.5.0"}]}, {"type": "GIT", "events": [{"introduced": "0"}]}]}]},
    {"id": "PYSEC-2", "modified": "2021", "severity": [{"type": "CVSS_V3", "score": "CVSS:3.1/AV:N"}], "affected": [{"package": {"ecosystem": "PyPI", "name": "c"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "2.0.0"}]}]}]},
]


@query(
    "src14_osv",
    "SELECT * FROM "
    + values(("CVE-2020-1", "GHSA-1", "npm", "a", "<1.2.0", "Critical"), ("CVE-2020-1", "GHSA-1", "npm", "b", ">=1.0.0, <=1.5.0|>=1.0.0", "Critical"), (None, None, "PyPI", "c", ">=2.0.0", "Medium"))
    + " t(cve_id, ghsa_id, ecosystem, package_name, ranges, severity)",
)
def src14(spark, d):
    out = A.import_osv(spark.createDataFrame([(json.dumps(x),) for x in OSV], "json string"))
    return out.select("cve_id", "ghsa_id", "ecosystem", "package_name", F.array_join("vulnerable_versions", "|").alias("ranges"), "severity")


@query("src16_ghsa", f"SELECT * FROM {values(('g1', 'PyPI', 'Medium', '>= 1, < 2'), ('g2', 'crates.io', 'High', ''), ('g3', 'Hex', 'Medium', '< 3'))} t(ghsa_id, ecosystem, severity, ranges)")
def src16(spark, d):
    rows = [("g1", "MODERATE", "PIP", "a", " >= 1, < 2 "), ("g2", "HIGH", "RUST", "b", ""), ("g3", None, "Hex", "c", "< 3")]
    rows = [(g, s, "pypi" if e == "PIP" else e, p, r) for g, s, e, p, r in rows]
    out = A.import_ghsa(spark.createDataFrame(rows, "ghsa_id string, severity string, ecosystem string, package_name string, range string"))
    return out.select("ghsa_id", "ecosystem", "severity", F.array_join("vulnerable_versions", "|").alias("ranges"))


@query("src17_kubernetes", f"SELECT * FROM {values(('k.yaml', 'Service', 'prod', 'web', 'LoadBalancer', True), ('k.yaml', 'Service', 'default', 'db', None, False))} t(file_path, kind, namespace, name, service_type, public)")
def src17(spark, d):
    text = "kind: Service\nmetadata: {name: web, namespace: prod}\nspec: {type: LoadBalancer}\n---\nkind: Service\nmetadata: {name: db}\n---\nkind: ConfigMap\nmetadata: {name: c}\n---\n: ["
    return K.kubernetes(files(spark, ("k.yaml", text))).select("file_path", "kind", "namespace", "name", "service_type", "public")


@query("src18_cspm", f"SELECT * FROM {values(('r1', 'web', True), ('r3', 'r3', False))} t(resource_id, name, public)")
def src18(spark, d):
    rows = [{"resource_id": "r1", "resource_name": "web", "internet_facing": True}, {"resource_name": "x"}, {"resource_id": "r3"}]
    return K.cspm(spark.createDataFrame([(json.dumps(rows),)], "json string")).select("resource_id", "name", "public")


@query("agg23_exposure_map", f"SELECT * FROM {values(('web', True), ('db', False), ('r3', False))} t(service, public)")
def agg23(spark, d):
    k8s = spark.createDataFrame([("Web", False), ("db", False)], "name string, public boolean")
    cloud = spark.createDataFrame([("web", True), ("r3", False)], "name string, public boolean")
    return J.exposure_map(k8s, cloud)


ADVISORIES = [
    ("CVE-1", None, "npm", "Brand#11", [">=1.0.0, <3.0.0"]),
    ("CVE-2", None, "PyPI", "Brand#12", ["<2.5.0", "4.1.0"]),
    (None, "GHSA-3", "npm", "Brand#11", ["^2.1.0"]),
    (None, None, "crates.io", "Brand#13", ["~3.3.0", ">4.9.9"]),
    ("CVE-5", None, "npm", "Brand#2", [">= 1, < 2", "3.*"]),
    ("CVE-6", None, "PyPI", "Brand#3", ["^1.2", "~4"]),
    ("CVE-7", None, "npm", "Brand#4", ["*"]),
    ("CVE-8", None, "PyPI", "Brand#5", ["one", "<=2", ">3"]),
]
_V = "list_transform(string_split(version, '.'), lambda x: CAST(x AS INT))"


@query(
    "joi4_advisory_match",
    f"""WITH v AS (SELECT *, v[1] * 1000000 + v[2] * 1000 + v[3] AS n, v[1] AS major, v[2] AS minor FROM (SELECT *, {_V} AS v FROM deps))
    SELECT dep_id, 'CVE-1' AS advisory_id FROM v WHERE ecosystem = 'npm' AND package_name = 'Brand#11' AND n >= 1000000 AND n < 3000000
    UNION ALL SELECT dep_id, 'CVE-2' FROM v WHERE ecosystem = 'PyPI' AND package_name = 'Brand#12' AND (n < 2005000 OR (n >= 4001000 AND n < 5000000))
    UNION ALL SELECT dep_id, 'GHSA-3' FROM v WHERE ecosystem = 'npm' AND package_name = 'Brand#11' AND n >= 2001000 AND n < 3000000
    UNION ALL SELECT dep_id, 'crates.io:Brand#13:~3.3.0' FROM v WHERE ecosystem = 'crates.io' AND package_name = 'Brand#13' AND ((n >= 3003000 AND n < 3004000) OR n > 4009009)
    UNION ALL SELECT dep_id, 'CVE-5' FROM v WHERE ecosystem = 'npm' AND package_name = 'Brand#2' AND major IN (1, 3)
    UNION ALL SELECT dep_id, 'CVE-6' FROM v WHERE ecosystem = 'PyPI' AND package_name = 'Brand#3' AND ((major = 1 AND minor >= 2) OR major = 4)
    UNION ALL SELECT dep_id, 'CVE-7' FROM v WHERE ecosystem = 'npm' AND package_name = 'Brand#4'
    UNION ALL SELECT dep_id, 'CVE-8' FROM v WHERE ecosystem = 'PyPI' AND package_name = 'Brand#5' AND (major <= 2 OR major > 3)""",
)
def joi4(spark, d):
    adv = spark.createDataFrame(ADVISORIES, "cve_id string, ghsa_id string, ecosystem string, package_name string, vulnerable_versions array<string>")
    return A.match(deps(spark, d), A.advisory_key(adv)).select("dep_id", "advisory_id")


def _many_ranges(spark, d):
    """Advisories made of parts, all of a few packages, of which one has half; and the versions that lines of orders use."""
    k = F.col("p_partkey")
    low = F.concat(k % 50, F.lit("."), k * 7 % 40, F.lit("."), k * 11 % 30)
    high = F.concat(k % 50 + k % 3, F.lit("."), k * 7 % 40 + 1, F.lit("."), k * 13 % 30)
    form = F.when(k % 4 == 0, F.array(F.concat(F.lit(">="), low, F.lit(", <"), high))).when(k % 4 == 1, F.array(F.concat(F.lit("="), low), F.concat(F.lit("~"), high)))
    form = form.when(k % 4 == 2, F.array(F.concat(F.lit("^"), low), F.concat(F.lit(">"), low, F.lit(", <="), high))).otherwise(F.array(F.concat(F.lit("<"), k % 3, F.lit(".5"))))
    package = F.when(k % 2 == 0, "hot").otherwise(F.concat(F.lit("pkg"), k % 9))
    advisories = read(spark, d, "part").select(F.concat(F.lit("ADV-"), k).alias("advisory_id"), F.lit("npm").alias("ecosystem"), package.alias("package_name"), form.alias("vulnerable_versions"))
    o, n = F.col("l_orderkey"), F.col("l_suppkey")
    used = F.when(o % 3 == 0, "hot").otherwise(F.concat(F.lit("pkg"), n % 9))
    # a version that many use, and some that do not parse
    version = F.when(o % 5 == 0, "3.7.11").when(o % 101 == 0, "latest").otherwise(F.concat(o % 53, F.lit("."), n % 41, F.lit("."), F.col("l_linenumber")))
    deps = read(spark, d, "lineitem").select(F.lit("npm").alias("ecosystem"), used.alias("package_name"), version.alias("version")).distinct()
    return deps, advisories


@query(
    "joi4_many_ranges",
    """WITH a AS (SELECT concat('ADV-', k) AS advisory_id, CASE WHEN k % 2 = 0 THEN 'hot' ELSE concat('pkg', k % 9) END AS package_name, k % 4 AS form,
      (k % 50) * 1000000 + (k * 7 % 40) * 1000 + k * 11 % 30 AS low, k % 50 AS low_major, k * 7 % 40 AS low_minor, (k % 50 + k % 3) * 1000000 + (k * 7 % 40 + 1) * 1000 + k * 13 % 30 AS high,
      (k % 50 + k % 3) * 1000000 + (k * 7 % 40 + 2) * 1000 AS high_tilde, k % 3 * 1000000 + 5000 AS less FROM (SELECT p_partkey AS k FROM part)),
    v AS (SELECT DISTINCT CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE concat('pkg', l_suppkey % 9) END AS package_name,
      CASE WHEN l_orderkey % 5 = 0 THEN '3.7.11' WHEN l_orderkey % 101 = 0 THEN 'latest' ELSE concat(l_orderkey % 53, '.', l_suppkey % 41, '.', l_linenumber) END AS version,
      CASE WHEN l_orderkey % 5 = 0 THEN 3007011 WHEN l_orderkey % 101 = 0 THEN NULL ELSE (l_orderkey % 53) * 1000000 + (l_suppkey % 41) * 1000 + l_linenumber END AS n FROM lineitem),
    spans AS (SELECT advisory_id, package_name, low AS lo, high AS hi FROM a WHERE form IN (0) UNION ALL SELECT advisory_id, package_name, low, low + 1 FROM a WHERE form = 1
      UNION ALL SELECT advisory_id, package_name, high, high_tilde FROM a WHERE form = 1
      UNION ALL SELECT advisory_id, package_name, low, CASE WHEN low_major > 0 THEN (low_major + 1) * 1000000 WHEN low_minor > 0 THEN (low_minor + 1) * 1000 ELSE low + 1 END FROM a WHERE form = 2
      UNION ALL SELECT advisory_id, package_name, low + 1, high + 1 FROM a WHERE form = 2 UNION ALL SELECT advisory_id, package_name, 0, less FROM a WHERE form = 3)
    SELECT package_name, version, count(DISTINCT advisory_id) AS hits, min(advisory_id) AS first_id, max(advisory_id) AS last_id
    FROM (SELECT v.package_name, version, advisory_id FROM v JOIN spans s ON s.package_name = v.package_name AND n BETWEEN lo AND hi - 1
      UNION ALL SELECT v.package_name, version, advisory_id FROM v JOIN a ON a.package_name = v.package_name WHERE n IS NULL) GROUP BY 1, 2""",
)
def joi4_many(spark, d):
    """Advisories of one package and list of ranges hit the same versions, so they are summed up before they are matched."""
    deps, advisories = _many_ranges(spark, d)
    lists = advisories.groupBy("ecosystem", "package_name", "vulnerable_versions").agg(
        F.count_distinct("advisory_id").alias("n"), F.min("advisory_id").alias("lowest"), F.max("advisory_id").alias("highest")
    )
    found = A.match(deps, lists)
    return found.groupBy("package_name", "version").agg(F.sum("n").alias("hits"), F.min("lowest").alias("first_id"), F.max("highest").alias("last_id"))


@query("str4_parse_version", f"SELECT dep_id, v[1] AS major, v[2] AS minor, v[3] AS patch FROM (SELECT dep_id, {_V} AS v FROM deps)")
def str4(spark, d):
    v = V.parse_version(F.concat(F.lit("v"), "version", F.lit("-rc.1")))
    return deps(spark, d).select("dep_id", v.alias("v")).select("dep_id", "v.*")


#: Ranges of all forms, and what they mean for a version of major, minor and patch.
RANGES = {
    "<2": "major < 2", "<= 2": "major <= 2", ">2": "major > 2", ">=2": "major >= 2", "=2": "major = 2", "2": "major = 2", "^0": "major = 0", "~3": "major = 3",
    "<2.20": "n < 2020000", "<=2.20": "n < 2021000", ">2.20": "n >= 2021000", ">=2.20": "n >= 2020000", "=2.20": "major = 2 AND minor = 20", "^2.20": "major = 2 AND minor >= 20",
    "^0.20": "major = 0 AND minor = 20", "^0.0": "major = 0 AND minor = 0", "~2.20": "major = 2 AND minor = 20", "2.20": "major = 2 AND minor >= 20",
    "<2.22.5": "n < 2022005", "<=2.22.5": "n <= 2022005", ">2.22.5": "n > 2022005", ">=2.22.5": "n >= 2022005", "=2.22.5": "n = 2022005", "^2.22.5": "major = 2 AND n >= 2022005",
    "^0.20.5": "major = 0 AND minor = 20 AND patch >= 5", "^0.0.3": "n = 3", "~2.22.5": "major = 2 AND minor = 22 AND patch >= 5", "*": "true", " x ": "true", "3.*": "major = 3", "3.x.X": "major = 3",
    "3.23.*": "major = 3 AND minor = 23", ">= 1, < 2": "major = 1", ">=1.0.0,<3": "major IN (1, 2)", ">1, <=3, >= 2": "major IN (2, 3)", "v1.0": "false", "1 2": "false", "": "false", "1,": "false", "*, 1": "false",
    "01": "false", ">=4-rc": "false", ">=4.4.4-rc.1": "n >= 4004004", "<=4.4.4-rc.1": "n < 4004004", ">4.44.4-rc.1": "n >= 4044004", "=4.4.4-rc": "false", ">=4.4.4+build": "n >= 4004004",
}


@query(
    "str5_ranges",
    f"""SELECT dep_id, k, hit FROM (SELECT dep_id, v[1] AS major, v[2] AS minor, v[3] AS patch, v[1] * 1000000 + v[2] * 1000 + v[3] AS n FROM (SELECT dep_id, {_V} AS v FROM deps)) d,
    LATERAL (SELECT * FROM (VALUES {", ".join(f"({k}, {sql})" for k, sql in enumerate(RANGES.values()))}) t(k, hit)) x""",
)
def str5(spark, d):
    """Every version against every form of a range."""
    ranges = spark.createDataFrame([(k, [r]) for k, r in enumerate(RANGES)], "k int, r array<string>").select("k", V.parse_ranges("r").alias("r"))
    versions = deps(spark, d).select("dep_id", V.parse_version("version").alias("v"))
    return versions.crossJoin(F.broadcast(ranges)).select("dep_id", "k", V.in_ranges(F.col("v"), F.col("r")).alias("hit"))


@query(
    "sco8_cvss",
    """SELECT dep_id, CASE WHEN x >= 90 THEN 'Critical' WHEN x >= 70 THEN 'High' WHEN x >= 40 THEN 'Medium' WHEN x >= 10 THEN 'Low' ELSE 'Info' END AS severity FROM (SELECT dep_id, dep_id % 100 AS x FROM deps)""",
)
def sco8(spark, d):
    return deps(spark, d).select("dep_id", A.cvss_severity(((F.col("dep_id") % 100) / 10.0).cast("string")).alias("severity"))
