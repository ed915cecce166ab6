"""Tables with versions: files in buckets, a manifest for each version, and changes that write touched buckets only.

A store is a folder with ``data`` and ``versions``. A version's manifest lists the folders that make up each bucket
of each table; committing writes data first and then renames a finished manifest to the next number, so a write
that is killed leaves folders that no manifest names, and the old version. One commit may change several tables, and may
carry a mark, such as a stream's batch number, which later versions keep. One writer at a time; a second one that
commits the same number fails. Manifests are as long as buckets x tables (x appended folders) and are read by the driver.

Data is written with ``DataFrame.write`` and read with ``spark.read``; old versions stay readable until ``vacuum``.
A change of many rows comes in parts of whole groups of buckets: they are written one after another, and the shuffle files of
one are let go before the next, so that disk holds the shuffles of a part and not those of the table.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import checkpointed, free_shuffles

BUCKET = "__sw_bucket"
#: Stored bytes that a part of a change covers, or one group if that has more; the shuffles of an upsert take some times as much.
PART_BYTES = 1 << 30


@dataclass
class Change:
    """New rows of a table: instead of all that its touched buckets hold (``replace``, a list of buckets), or beside it (None).

    Rows may be a list of DataFrames, the parts of the change.
    """

    rows: DataFrame | list[DataFrame]
    replace: list[int] | None = None

    @property
    def parts(self) -> list[DataFrame]:
        return self.rows if isinstance(self.rows, list) else [self.rows]


@dataclass(frozen=True)
class Layout:
    """Where the rows of a table lie: ``groups`` buckets by the first key times ``parts`` by the others.

    A task writes a bucket, so their number follows the size of the table, and parts that of the largest first key.
    """

    keys: tuple[str, ...]
    groups: int = 8
    parts: int = 1

    def bucket(self, columns: Iterable[str] | None = None) -> Column:
        """The bucket of a row."""
        first, *rest = columns or self.keys
        inner = F.pmod(F.xxhash64(*rest), F.lit(self.parts)) if rest and self.parts > 1 else F.lit(0)
        return (F.pmod(F.xxhash64(first), F.lit(self.groups)) * self.parts + inner).cast("int")

    def all_of(self, rows: DataFrame) -> list[int]:
        """All buckets of the first keys that rows have: what a change of whole groups touches."""
        found = rows.select(F.pmod(F.xxhash64(self.keys[0]), F.lit(self.groups)).alias("g")).distinct().collect()
        return sorted(r.g * self.parts + k for r in found for k in range(self.parts))

    def groups_of(self, buckets: Iterable[int]) -> list[int]:
        return sorted({b // self.parts for b in buckets})

    def in_groups(self, groups: list[int]) -> Column:
        """Whether a row's first key is of some groups."""
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.groups)).isin(groups)

    def of(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows themselves."""
        return sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())


class Store:
    def __init__(self, spark: SparkSession, path: str, layouts: dict[str, Layout]):
        self.spark, self.path, self.layouts = spark, path.rstrip("/"), layouts

    def _at(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        files, folder = self._files(), self._at(*parts)
        return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for m in (re.fullmatch(r"v(\d+)", n) for n in self._names("versions")) if m)

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "marks", "tables": {name: {"schema", "folders": [[bucket, folder], ..]}}}; of no version an empty one."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "marks": {}, "tables": {}}
        if version is not None and version not in known:
            raise ValueError(f"no version {version}")
        at = known[-1] if version is None else version
        text = self.spark.read.text(f"{self.path}/versions/v{at:010d}", wholetext=True).first().value
        return json.loads(text)

    def mark(self, name: str) -> int | None:
        return self.manifest()["marks"].get(name)

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table in a version (the newest), of some buckets or all; None's table is not known yet."""
        held = self.manifest(version)["tables"].get(table)
        if held is None:
            raise ValueError(f"no table {table}")
        schema = StructType.fromJson(held["schema"])
        wanted = None if buckets is None else set(buckets)
        folders = [f"{self.path}/{f}" for b, f in held["folders"] if wanted is None or b in wanted]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def has(self, table: str) -> bool:
        return table in self.manifest()["tables"]

    def find(self, table: str, keys: list[tuple], version: int | None = None) -> DataFrame:
        """Rows of some whole keys; only their buckets are read."""
        names = self.layouts[table].keys
        wanted = self.spark.createDataFrame(keys, self.read(table, version).select(*names).schema)
        return self.read(table, version, self.layouts[table].of(wanted)).join(F.broadcast(wanted), list(names), "left_semi")

    def commit(self, changes: dict[str, Change], marks: dict[str, int] | None = None) -> int:
        """Write the changes and make them the next version."""
        before = self.manifest()
        tables, commit = dict(before["tables"]), uuid.uuid4().hex
        for name, change in changes.items():
            layout, new = self.layouts[name], []
            for k, rows in enumerate(change.parts):
                folder = f"data/{name}/{commit}-{k}"
                placed = rows.withColumn(BUCKET, layout.bucket())
                # fingerprints are half as long in zstd
                placed.repartition(BUCKET).write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{self.path}/{folder}")
                new += [[int(n.split("=")[1]), f"{folder}/{n}"] for n in self._names(folder) if n.startswith(f"{BUCKET}=")]
                free_shuffles(self.spark)
            gone = set(change.replace or ())
            if change.replace is not None and (stray := sorted({b for b, _ in new} - gone)):
                raise ValueError(f"rows of {name} lie in buckets {stray} that were not named")
            held = tables.get(name, {}).get("folders", [])
            tables[name] = {"schema": change.parts[0].schema.jsonValue(), "folders": sorted([x for x in held if x[0] not in gone] + new)}
        version = before["version"] + 1
        self._publish(version, {"version": version, "marks": {**before["marks"], **(marks or {})}, "tables": tables})
        return version

    def _publish(self, version: int, manifest: dict) -> None:
        files, draft = self._files(), self._at("versions", f".draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._at("versions", f"v{version:010d}")
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise RuntimeError(f"version {version} was committed by another writer")

    def change(self, table: str, touched: list[int], step: Callable[[DataFrame], DataFrame]) -> Change:
        """The change that step() makes to the rows of the touched buckets."""
        return Change(step(self.read(table, buckets=touched)), touched)

    def slices(self, table: str, buckets: list[int] | None = None, size: int | None = None) -> list[list[int]]:
        """Buckets (all that have rows, or those named) in lists of whole groups, each of which holds about ``size`` bytes; one list at least."""
        files, parts, most = self._files(), self.layouts[table].parts, PART_BYTES if size is None else size
        held = self.manifest()["tables"][table]["folders"]
        groups: dict[int, list] = {}
        for b in sorted({b for b, _ in held}) if buckets is None else sorted(buckets):
            groups.setdefault(b // parts, [0, []])[1].append(b)
        for b, folder in held:
            if b // parts in groups:
                groups[b // parts][0] += files.getContentSummary(self._at(folder)).getLength()
        out, room = [[]], most
        for n, own in groups.values():
            if out[-1] and n > room:
                out.append([])
                room = most
            out[-1] += own
            room -= n
        return out

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest versions and delete the folders that none of those names; how many it deleted."""
        known, files = self.versions(), self._files()
        kept = {f for v in known[-keep:] for t in self.manifest(v)["tables"].values() for _, f in t["folders"]}
        for v in known[:-keep]:
            files.delete(self._at("versions", f"v{v:010d}"), False)
        n = 0
        for table in self._names("data"):
            for commit in self._names("data", table):
                own = [f"data/{table}/{commit}/{b}" for b in self._names("data", table, commit) if b.startswith(BUCKET)]
                for folder in own:
                    if folder not in kept:
                        n += files.delete(self._at(folder), True)
                if not any(f in kept for f in own):
                    files.delete(self._at("data", table, commit), True)
        return n


#: Findings by project and fingerprint: a scan touches the parts of its projects, a triage the parts of its findings.
FINDINGS = Layout(("project_id", "fingerprint"), groups=8, parts=4)


def upsert_findings(store: Store, incoming: DataFrame | Callable[[list[int] | None], DataFrame], now: Column, table: str = "findings") -> Change:
    """The change that a scan's findings make: buckets of the scanned projects are written anew, others keep their files.

    A large change comes in parts, each of which looks at the scan's findings of its groups. ``incoming`` may be a function that
    reads them: of some groups of the table's layout, or all (None).
    """
    from .mutations import upsert_scan

    if not store.has(table):
        raise ValueError("create the table with a commit of all rows first")
    layout, given = store.layouts[table], incoming if callable(incoming) else None
    scanned = checkpointed((given(None) if given else incoming).select("project_id").distinct(), "scanned")
    touched = layout.all_of(scanned)
    slices, parts = store.slices(table, touched), []
    for own in slices:
        stored, groups = store.read(table, buckets=own), layout.groups_of(own)
        new = given(groups) if given else incoming if len(slices) == 1 else incoming.where(layout.in_groups(groups))
        parts.append(upsert_scan(stored, new, now, scanned).select(*stored.columns))
    return Change(parts, touched)


def triage_findings(store: Store, updates: DataFrame, now: Column, table: str = "findings") -> Change:
    """The change that (project_id, fingerprint, new_state, note) updates make, in the buckets of those findings."""
    touched = store.layouts[table].of(updates)
    stored = store.read(table, buckets=touched)
    out = stored.join(updates.select("project_id", "fingerprint", "new_state"), ["project_id", "fingerprint"], "left")
    hit = F.col("new_state").isNotNull()
    out = out.withColumn("triage_state", F.coalesce("new_state", "triage_state")).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
    return Change(out.select(*stored.columns), touched)


def purge_projects(store: Store, projects: DataFrame, table: str = "findings") -> Change:
    """The change that takes the rows of some projects away."""
    touched = store.layouts[table].all_of(projects)
    return Change(store.read(table, buckets=touched).join(projects.select("project_id").distinct(), "project_id", "left_anti"), touched)
