"""Dependency manifests as (directory, ecosystem, package_name, version, is_lock) rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPS = "file_path string, ecosystem string, package_name string, version string"


def _out(rows: DataFrame, ecosystem: str) -> DataFrame:
    return rows.select("file_path", F.lit(ecosystem).alias("ecosystem"), "package_name", "version")


def package_json(files: DataFrame) -> DataFrame:
    """dependencies and devDependencies; version operators are stripped."""
    maps = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    rows = files.withColumn("j", maps).select("file_path", F.explode(F.array("j.dependencies", "j.devDependencies")).alias("m"))
    rows = rows.select("file_path", F.explode("m").alias("package_name", "v"))
    return _out(rows.withColumn("version", F.trim(F.ltrim("v", F.lit("^~><= ")))), "npm")


def package_lock(files: DataFrame) -> DataFrame:
    """packages of lock format 2 and up (the name follows the last node_modules/), else dependencies."""
    entry = "map<string,struct<version:string>>"
    j = F.from_json("text", f"packages {entry}, dependencies {entry}")
    rows = files.withColumn("j", j).select("file_path", F.explode(F.when(F.size("j.packages") > 0, F.col("j.packages")).otherwise(F.col("j.dependencies"))).alias("k", "v"))
    name = F.element_at(F.split("k", "node_modules/"), -1)
    return _out(rows.where("k <> '' and v.version is not null").select("file_path", name.alias("package_name"), F.col("v.version").alias("version")), "npm")


def requirements(files: DataFrame) -> DataFrame:
    """One line each: comments, options and extras go; the first operator of a fixed order splits name and version."""
    lines = files.select("file_path", F.explode(F.split("text", r"\r?\n")).alias("line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", r"\s*#.*$", ""))).where("line <> '' and not line like '-%'")
    base = F.element_at(F.split("line", r"\["), 1)
    cut = F.lit(None).cast("int")
    for op in ("==", "~=", ">=", "<=", "!=", ">", "<"):
        at = F.locate(op, base)
        cut = F.coalesce(cut, F.when((at > 1) & (F.trim(F.substring(base, F.lit(1), at - 1)) != ""), at))
    rows = lines.select("file_path", base.alias("b"), cut.alias("cut"))
    version = F.trim(F.element_at(F.split(F.ltrim(F.expr("substring(b, cut)"), F.lit("=~><! ")), ","), 1))
    name = F.trim(F.when(F.col("cut").isNull(), F.col("b")).otherwise(F.expr("substring(b, 1, cut - 1)")))
    return _out(rows.select("file_path", name.alias("package_name"), F.coalesce(version, F.lit("")).alias("version")).where("package_name <> ''"), "PyPI")


def _toml(files: DataFrame, lock: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tomllib

        for b in batches:
            rows = []
            for path, text in zip(b["file_path"], b["text"]):
                try:
                    t = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    continue
                if lock:
                    rows += [(path, "crates.io", p.get("name"), p.get("version")) for p in t.get("package", []) if p.get("source")]
                    continue
                for table in ("dependencies", "dev-dependencies", "build-dependencies"):
                    for name, spec in t.get(table, {}).items():
                        if isinstance(spec, dict):
                            if spec.get("workspace"):
                                continue
                            spec = spec.get("version")
                        if isinstance(spec, str):
                            rows.append((path, "crates.io", name, spec.lstrip("^~>=< ")))
            yield pd.DataFrame(rows, columns=["file_path", "ecosystem", "package_name", "version"])

    return files.select("file_path", "text").mapInPandas(run, DEPS)


def cargo_toml(files: DataFrame) -> DataFrame:
    return _toml(files, False)


def cargo_lock(files: DataFrame) -> DataFrame:
    return _toml(files, True)


#: manifest file, its lock file, and the readers.
KINDS = [
    ("package.json", "package-lock.json", package_json, package_lock),
    ("Cargo.toml", "Cargo.lock", cargo_toml, cargo_lock),
    ("requirements.txt", None, requirements, None),
]


def directory_of(path: str = "file_path"):
    return F.regexp_replace(F.col(path), "/?[^/]*$", "")


def dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of all manifests; where a directory has a lock file its manifest is not read."""
    named = files.withColumn("__sw_dir", directory_of()).withColumn("__sw_name", F.regexp_extract("file_path", "([^/]*)$", 1))
    out = None
    for manifest, lock, read, read_lock in KINDS:
        own = named.where(F.col("__sw_name") == manifest)
        if lock:
            locked = named.where(F.col("__sw_name") == lock)
            own = own.join(locked.select("__sw_dir").distinct(), "__sw_dir", "left_anti")
            found = read(own).unionByName(read_lock(locked))
        else:
            found = read(own)
        out = found if out is None else out.unionByName(found)
    return out
