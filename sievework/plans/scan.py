"""The scan: files x rules to findings, enriched, filtered and ordered.

Planning a scan runs small jobs: rules go to the driver, and what several steps read is written once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domain import fingerprint, severity_rank
from ..functions.patterns import any_of, required_literals
from ..operators import cache as C
from ..operators import filters as L
from ..operators.snapshots import Store
from ..scratch import checkpointed
from ..sources import files as S
from ..sources import trees as T


@dataclass
class ScanOptions:
    """What a scan takes in and adds: ``enrich`` adds names, reachability, confidence and, with ``exposure`` (service,
    public), exposed severities; ``advisories`` adds findings of the dependencies that the manifests name. With a
    ``cache`` only contents that it does not know are scanned, and ``write_cache`` puts what they gave into it.
    ``context`` takes the snippets anew, as the lines around the finding."""

    min_severity: str = "Low"
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    exclude_rules: Sequence[str] = ()
    ignore_globs: Sequence[str] = ()
    changed: DataFrame | None = None
    staged: DataFrame | None = None
    learned: DataFrame | None = None
    suppress: bool = True
    enrich: bool = False
    exposure: DataFrame | None = None
    advisories: DataFrame | None = None
    cache: Store | None = None
    write_cache: bool = True
    context: int | None = None


_FACTS = "array<struct<rule_id:string,severity:string,owasp_category:string,cwe_id:string,language:string,pattern:string>>"


def match_rules(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Every match of line rules: (.., rule_id, severity, line, column_num, snippet), one per rule and line.

    The rules are few and go to the driver when the plan is made. Those whose pattern needs a literal are named by one
    pattern that looks for all of the literals at once, and only those named are then run on the line, so a line that holds
    none costs the same whatever the number of rules. The others are constants that every line is tested with. ``lines``
    has language (null: rules of every language), line_no and line.
    """
    every = sorted(rules.collect(), key=lambda r: r.rule_id)
    if not every:
        raise ValueError("no rules")
    needs = [required_literals(r.pattern) for r in every]
    fields = ("rule_id", "severity", "owasp_category", "cwe_id", "language", "pattern")
    facts = F.from_json(F.lit(json.dumps([{x: r[x] for x in fields} for r in every])), _FACTS)
    tests = [F.when(F.col("line").rlike(r.pattern), F.lit(k)) for k, (r, n) in enumerate(zip(every, needs)) if n is None]
    named = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<int>")
    by_literal: dict[str, set[int]] = {}
    for k, n in enumerate(needs):
        for x in n or ():
            by_literal.setdefault(x, set()).add(k)
    if by_literal:
        # the longest literal of a place is found, and stands for those that it begins with
        table = {x: sorted(set().union(*(ks for y, ks in by_literal.items() if x.startswith(y)))) for x in by_literal}
        of_literal = F.from_json(F.lit(json.dumps(table)), "map<string,array<int>>")
        found = F.array_distinct(F.regexp_extract_all("line", F.lit(f"(?=({any_of(list(table))}))"), F.lit(1)))
        named = F.concat(named, F.flatten(F.transform(found, lambda x: F.element_at(of_literal, x))))
    keep = [c for c in lines.columns if c not in ("line", "language")]
    rows = lines.select(*keep, "line", "language", F.explode(F.transform(F.array_distinct(named), lambda k: F.get(facts, k))).alias("r"))
    fits = F.col("r.language").isNull() | (F.col("r.language") == F.col("language"))
    rows = rows.where(fits & F.regexp("line", F.col("r.pattern")))
    whole = F.regexp_extract_all("line", F.concat(F.lit("("), F.col("r.pattern"), F.lit(")")), F.lit(1))[0]
    rows = rows.withColumn("__sw_whole", whole)
    return rows.select(
        *keep, *[F.col(f"r.{x}").alias(x) for x in fields[:4]], F.instr(F.col("line"), F.col("__sw_whole")).cast("int").alias("column_num"), F.col("__sw_whole").alias("snippet")
    )


FOUND = ["file_path", "rule_id", "severity", "owasp_category", "cwe_id", "line", "column_num", "snippet"]


def dependency_findings(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings of the dependencies of (file_path, text) manifests that advisories (advisory_id, ..) match."""
    from ..sources import advisories as A
    from ..sources import manifests as M

    hit = A.match(M.dependencies(files.select("file_path", "text")).drop("file_path").distinct(), advisories)
    return hit.select(
        F.concat(F.lit("<"), "ecosystem", F.lit("/"), "package_name", F.lit(">")).alias("file_path"),
        F.concat(F.lit("sca/"), "advisory_id").alias("rule_id"),
        "severity",
        F.lit("A06").alias("owasp_category"),
        F.lit(None).cast("string").alias("cwe_id"),
        F.lit(0).alias("line"),
        F.lit(0).alias("column_num"),
        F.concat_ws(" ", F.concat_ws("@", "package_name", "version"), F.lit("-"), "summary").alias("snippet"),
    )


def enriched(found: DataFrame, files: DataFrame, rules: DataFrame, exposure: DataFrame | None = None) -> DataFrame:
    """Findings with rule_name, service, reachable, confidence_score and, by exposure, their severity and cloud_exposed.

    A finding is reachable when its function is, from one that uses a taint source, or when it lies in none. The
    score takes reachability, the taint of the own function, whether the snippet is a call of an imported module,
    and whether it stands in a test or after what looks like escaping or checking.
    """
    from ..functions.domain import service_name
    from ..operators import graph as G
    from ..operators import joins as J
    from ..operators import scoring as W

    # both are read several times, and each reading would parse the files again
    found, nodes = checkpointed(found), checkpointed(G.source_functions(files))
    name = lambda path, fn: F.concat_ws(":", path, fn)
    tainted = G.tainted_functions(nodes).select(name("file_path", "name").alias("node"))
    edges = G.call_graph(nodes).select(name("src_path", "src").alias("src"), name("dst_path", "dst").alias("dst"))
    rows = found.withColumn("finding_id", F.sha2(F.concat_ws("|", "rule_id", "file_path", "line", "column_num"), 256))
    inside = J.enclosing_function(rows, G.function_definitions(nodes)).where("name is not null")
    inside = inside.select("finding_id", name("file_path", "name").alias("node")).distinct()
    rows = G.is_reachable(rows.join(inside, "finding_id", "left"), G.reachable(edges, tainted))
    own = tainted.distinct().withColumn("__sw_own", F.lit(True))
    rows = rows.join(own, "node", "left").withColumn("user_controlled", F.coalesce("__sw_own", F.lit(False)))
    score = W.confidence(
        W.reach_score("reachable", "user_controlled"),
        W.pattern_score(F.lit(1), F.lit(True), F.col("snippet").rlike(r"\w\.\w+\("), F.lit(False)),
        W.context_score(F.col("snippet").rlike(r"(?i)escap|saniti[sz]|quote"), F.col("snippet").rlike(r"(?i)valid|check"), F.col("file_path").rlike(r"(^|/)tests?/|_test\."), F.lit(False)),
    )
    rows = rows.withColumn("confidence_score", score)
    path = F.when(~F.startswith("file_path", F.lit("<")), service_name("file_path"))
    rows = J.with_rule_names(rows.withColumn("service", path), rules.select("rule_id", "name").distinct())
    if exposure is not None:
        rows = J.with_exposure(rows, exposure).withColumn("severity", W.exposed_severity("severity", "public")).withColumnRenamed("public", "cloud_exposed")
    return rows.drop("node", "__sw_own", "finding_id")


def raw_matches(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches of the line and tree rules in (file_path, language, text) files, before any filter."""
    found = None
    if not rules.where("pattern is not null").isEmpty():
        body = F.split(F.regexp_replace("text", "\r?\n$", ""), "\r?\n")
        lines = files.select("file_path", "language", F.posexplode(body).alias("p", "line")).select("file_path", "language", (F.col("p") + 1).alias("line_no"), "line")
        found = match_rules(lines, rules.where("pattern is not null")).withColumnRenamed("line_no", "line").select(*FOUND)
    if "tree" in rules.columns and not rules.where("tree is not null").isEmpty():
        trees = T.match_trees(files, rules).select(*FOUND)
        found = trees if found is None else found.unionByName(trees)
    if found is None:
        raise ValueError("no rules")
    return found


def cached_matches(files: DataFrame, rules: DataFrame, cache: Store, write: bool = True) -> DataFrame:
    """raw_matches(files, rules), of which only contents that the cache does not hold are scanned.

    Contents are known by digest and language, under the digest of the rules. Each new one is scanned once,
    however many files have it, and put into the cache, with an empty list where it has no match.
    """
    digest = C.rule_set_hash(rules)
    keyed = files.withColumn("file_hash", F.sha2("text", 256)).where("text is not null")
    known = C.results(cache, digest)
    new = keyed.join(known.select("file_hash", "language"), ["file_hash", "language"], "left_anti")
    new = checkpointed(new.dropDuplicates(["file_hash", "language"]).select(F.concat_ws(" ", "file_hash", "language").alias("file_path"), "language", "text", "file_hash"), "cache-misses")
    one = F.struct(*[c for c in FOUND if c != "file_path"])
    per = raw_matches(new, rules).groupBy("file_path").agg(F.collect_list(one).alias("found"))
    fresh = new.join(per, "file_path", "left").select(
        "file_hash", F.lit(digest).alias("rule_set_hash"), "language", F.char_length("text").cast("long").alias("chars"), F.current_timestamp().alias("cached_at"),
        F.coalesce("found", F.array().cast(C.FOUND)).alias("findings"),
    )
    fresh = checkpointed(fresh, "cache-fresh")
    if write and not fresh.isEmpty():
        C.store(cache, fresh)
    every = known.select("file_hash", "language", "findings").unionByName(fresh.select("file_hash", "language", "findings")).where("size(findings) > 0")
    hits = keyed.select("file_path", "file_hash", "language").join(every, ["file_hash", "language"])
    return hits.select("file_path", F.explode("findings").alias("f")).select("file_path", "f.*").select(*FOUND)


def scan(files: DataFrame, rules: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """Findings of (file_path, text) files: collect, match, suppress, enrich, add dependencies, filter by severity, take snippets.

    Tree rules are those of ``rules`` with a ``tree``. The severity filter comes after exposure has changed severities; a
    dependency's severity stays as its advisory has it. Order the result with ``ordered``.
    """
    o = options or ScanOptions()
    kept = L.by_paths(S.collect(files, o.ignore_globs), o.include, o.exclude)
    rules = S.last_rules(rules)
    found = raw_matches(kept, rules) if o.cache is None else cached_matches(kept, rules, o.cache, o.write_cache)
    if o.suppress:
        found = L.suppress_inline(lines_with(kept, "scan-ignore"), found)
    found = L.without_rules(found, list(o.exclude_rules))
    if o.changed is not None:
        found = L.on_changed_lines(found, o.changed)
    if o.staged is not None:
        found = L.in_files(found, o.staged)
    if o.learned is not None:
        found = L.without_learned(found, o.learned)
    if o.enrich:
        found = enriched(found, kept, rules, o.exposure)
    if o.advisories is not None:
        named = L.without_rules(dependency_findings(L.by_paths(files, o.include, o.exclude), o.advisories), list(o.exclude_rules))
        if o.changed is not None:
            named = L.on_changed_lines(named, o.changed)
        if o.staged is not None:
            named = L.in_files(named, o.staged)
        if o.enrich:
            named = named.withColumns({"rule_name": F.col("rule_id"), "reachable": F.lit(True)})
        found = found.unionByName(named, allowMissingColumns=True)
    found = L.min_severity(found, o.min_severity)
    found = found.withColumn("fingerprint", fingerprint("rule_id", "file_path", "snippet"))
    return found if o.context is None else S.with_windows(found, kept, o.context)


def lines_with(files: DataFrame, word: str) -> DataFrame:
    """(file_path, line_no, line) of the lines that hold a word; other files are not split."""
    body = F.split(F.regexp_replace("text", "\r?\n$", ""), "\r?\n")
    lines = files.where(F.contains("text", F.lit(word))).select("file_path", F.posexplode(body).alias("p", "line"))
    return lines.where(F.contains("line", F.lit(word))).select("file_path", (F.col("p") + 1).alias("line_no"), "line")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc(severity_rank("severity")), "file_path", "line", "rule_id")


def scan_code(spark, text: str, file_path: str, rules: DataFrame, options: ScanOptions | None = None) -> DataFrame:
    """The scan of one text."""
    return scan(spark.createDataFrame([(file_path, text)], "file_path string, text string"), rules, options)
