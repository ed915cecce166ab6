"""Selections over findings, scans and their neighbours."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domain import c, severity_rank
from ..scratch import checkpointed


def min_severity(findings: DataFrame, severity: str = "Low") -> DataFrame:
    """Findings of at least a severity."""
    return findings.where(severity_rank("severity") >= severity_rank(F.lit(severity)))


def glob_to_regex(glob: str) -> str:
    """Path glob to an anchored regular expression: ** crosses directories, * and ? stay inside one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i:]:
            j = glob.index("]", i)
            out, i = out + glob[i : j + 1].replace("[!", "[^"), j + 1
        else:
            out, i = out + ("\\" if glob[i] in ".^$+{}()|\\" else "") + glob[i], i + 1
    return f"^{out}$"


def any_glob(path: Column | str, globs: Sequence[str]) -> Column:
    return c(path).rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs)) if globs else F.lit(False)


def by_paths(rows: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), path: str = "file_path") -> DataFrame:
    """Rows whose path an include glob matches (all if none is given) and no exclude glob does."""
    if include:
        rows = rows.where(any_glob(path, include))
    return rows.where(~any_glob(path, exclude)) if exclude else rows


def without_rules(findings: DataFrame, rules: Sequence[str]) -> DataFrame:
    return findings.where(~F.col("rule_id").isin(list(rules))) if rules else findings


def on_changed_lines(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings on changed (file_path, line)."""
    return findings.join(changed.select("file_path", "line").distinct(), ["file_path", "line"], "left_semi")


def in_files(findings: DataFrame, paths: DataFrame, root: str = "") -> DataFrame:
    """Findings in the listed files; both sides may be relative or below root."""
    own = F.regexp_replace("file_path", f"^(?:\\./|{root.rstrip('/')}/)" if root else r"^\./", "")
    names = paths.select(
        F.regexp_replace("file_path", f"^(?:\\./|{root.rstrip('/')}/)" if root else r"^\./", "").alias("__sw_path")
    ).distinct()
    return findings.join(names, own == F.col("__sw_path"), "left_semi")


_COMMENT = r"//|#|^\s*(<!--|/\*)"
#: What a line says after the comment marker that it starts with, else after the first // or the first #.
_BODY = r"(?s)^\s*(?://\s*(.*?)|#\s*(.*?)|<!--\s*(.*?)\s*(?:-->)?|/\*\s*(.*?)\s*(?:\*/)?|.*?//\s*(.*?)|[^#]*#\s*(.*?))\s*$"


def in_comment(line: Column | str) -> Column:
    """Does a line start as a comment, or hold the marker of a line comment anywhere?"""
    return c(line).rlike(_COMMENT)


def with_directive(lines: DataFrame, directive: str = "scan-ignore") -> DataFrame:
    """lines plus ``ignores``: what a line tells to ignore on the next one, '*' for all, a rule id, or null.

    ``<directive>:rule`` at the start of a comment names a rule; ``<directive>-next-line`` anywhere in it, or the
    directive before white space or its end, means all.
    """
    word, body = re.escape(directive), F.col("__sw_body")
    rows = lines.withColumn("__sw_body", F.when(in_comment("line"), F.regexp_replace("line", _BODY, "$1$2$3$4$5$6")))
    rows = rows.withColumn("__sw_rule", F.regexp_extract(body, rf"(?s)^{word}:\s*(.+)$", 1))
    every = body.rlike(rf"(?s){word}-next-line|^(?:(?!{word}).)*{word}(?:\s|$)")
    return rows.withColumn("ignores", F.when(F.col("__sw_rule") != "", F.col("__sw_rule")).when(every, "*")).drop("__sw_body", "__sw_rule")


def suppress_inline(lines: DataFrame, findings: DataFrame, directive: str = "scan-ignore") -> DataFrame:
    """Findings whose preceding line holds no directive for them; lines (file_path, line_no, line).

    Only the lines that hold a directive reach the join.
    """
    marks = with_directive(lines.where(F.contains("line", F.lit(directive))).select("file_path", "line_no", "line"), directive).select(
        F.col("file_path").alias("__sw_path"), (F.col("line_no") + 1).alias("__sw_line"), F.col("ignores").alias("__sw_rule")
    )
    hit = (
        (F.col("file_path") == F.col("__sw_path"))
        & (F.col("line") == F.col("__sw_line"))
        & ((F.col("__sw_rule") == "*") | (F.col("__sw_rule") == F.col("rule_id")))
    )
    return findings.join(marks.where("__sw_rule is not null"), hit, "left_anti")


def suppress_secrets(lines: DataFrame, findings: DataFrame, directive: str = "scan-ignore-secret") -> DataFrame:
    """Findings whose preceding line does not hold the secret directive in a comment, whatever their rule."""
    marks = lines.where(F.contains("line", F.lit(directive)) & in_comment("line"))
    marks = marks.select("file_path", (F.col("line_no") + 1).alias("line")).distinct()
    return findings.join(marks, ["file_path", "line"], "left_anti")


def count_directives(lines: DataFrame, directive: str = "scan-ignore") -> DataFrame:
    """(file_path, directives) of every file."""
    return with_directive(lines, directive).groupBy("file_path").agg(F.count("ignores").alias("directives"))


def predicate_captures(captures: DataFrame, equals: dict[str, str] | None = None, matches: dict[str, str] | None = None) -> DataFrame:
    """Captures (.., name, text) that pass their predicates: text equal to one, or found by a pattern."""
    ok = F.lit(True)
    for name, value in (equals or {}).items():
        ok = ok & ((F.col("name") != name) | (F.col("text") == value))
    for name, pattern in (matches or {}).items():
        ok = ok & ((F.col("name") != name) | F.col("text").rlike(pattern))
    return captures.where(ok)


def without_learned(findings: DataFrame, learned: DataFrame, least: int = 3) -> DataFrame:
    """Findings whose (rule_id, ctx_hash) was not recorded as suppressed ``least`` times or more."""
    known = learned.where(F.col("match_count") >= least).select("rule_id", "ctx_hash")
    return findings.join(known, ["rule_id", "ctx_hash"], "left_anti")


def without_approved(findings: DataFrame, memory: DataFrame) -> DataFrame:
    """Findings whose (rule_id, memory_key) carries no approval in the triage memory."""
    known = memory.where("decision = 'approved'").select("rule_id", "memory_key").distinct()
    return findings.join(known, ["rule_id", "memory_key"], "left_anti")


def list_findings(
    findings: DataFrame,
    severity: str | None = None,
    state: str | None = None,
    confidence_min: float | None = None,
    scan_id: str | None = None,
) -> DataFrame:
    for column, value in (("severity", severity), ("triage_state", state), ("scan_id", scan_id)):
        if value is not None:
            findings = findings.where(F.col(column) == value)
    return findings if confidence_min is None else findings.where(F.col("confidence_score") >= confidence_min)


def search(
    findings: DataFrame,
    severities: Sequence[str] = (),
    states: Sequence[str] = (),
    confidence_min: float | None = None,
    confidence_max: float | None = None,
    reachable: bool | None = None,
    scan_id: str | None = None,
    owasp: str | None = None,
    project_id: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """All given conditions; text is sought in rule, path and snippet, case ignored."""
    out = findings
    if severities:
        out = out.where(F.col("severity").isin(list(severities)))
    if states:
        out = out.where(F.col("triage_state").isin(list(states)))
    if confidence_min is not None:
        out = out.where(F.col("confidence_score") >= confidence_min)
    if confidence_max is not None:
        out = out.where(F.col("confidence_score") <= confidence_max)
    if reachable is not None:
        out = out.where(F.col("reachable") == reachable)
    for column, value in (("scan_id", scan_id), ("owasp_category", owasp), ("project_id", project_id)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if text:
        found = [F.contains(F.lower(F.col(x)), F.lit(text.lower())) for x in ("rule_id", "file_path", "snippet")]
        out = out.where(found[0] | found[1] | found[2])
    return out


def list_scans(
    scans: DataFrame,
    repository: str | None = None,
    branch: str | None = None,
    since: str | None = None,
    until: str | None = None,
) -> DataFrame:
    """Scans of a repository and branch, between inclusive ISO bounds that compare as text."""
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    if repository is not None:
        scans = scans.where(F.col("repository") == repository)
    if branch is not None:
        scans = scans.where(F.col("branch") == branch)
    if since is not None:
        scans = scans.where(day >= since)
    return scans if until is None else scans.where(day <= until)


def visible_rows(rows: DataFrame, members: DataFrame, user: str) -> DataFrame:
    """Rows of an organisation that a user sees: all for admins, else those of the user's teams.

    rows (org_id, team_id), members (user_id, org_id, role, team_ids).
    """
    own = members.where(F.col("user_id") == user).select(
        F.col("org_id").alias("__sw_org"), F.col("role").alias("__sw_role"), F.col("team_ids").alias("__sw_teams")
    )
    seen = (F.col("org_id") == F.col("__sw_org")) & (
        (F.col("__sw_role") == "admin") | F.array_contains("__sw_teams", F.col("team_id"))
    )
    return rows.join(own, seen, "left_semi")


def visible_to_each(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, and the columns of rows): what each member sees, by the rule of visible_rows; one join for all users.

    Admins meet the rows of their organisation, others those of each of their teams, so both joins are by equal keys.
    """
    admins = members.where("role = 'admin'").select("user_id", "org_id").distinct()
    teams = members.where("role <> 'admin'").select("user_id", "org_id", F.explode("team_ids").alias("team_id")).distinct()
    return rows.join(admins, "org_id").select("user_id", *rows.columns).unionByName(rows.join(teams, ["org_id", "team_id"]).select("user_id", *rows.columns))


def group_captures(lines: DataFrame, pattern: str, names: Sequence[str]) -> DataFrame:
    """(the columns of lines but line, match, name, text): what each group of a pattern captured, for each of its matches in a line.

    ``names`` are those of the groups, from the first; match counts the matches of a line.
    """
    wholes = [F.regexp_extract_all("line", F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in range(1, len(names) + 1)]
    keep = [x for x in lines.columns if x != "line"]
    hit = lines.where(F.col("line").rlike(pattern)).select(*keep, F.arrays_zip(*wholes).alias("z"))
    each = hit.select(*keep, F.posexplode("z").alias("match", "m"))
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"m.g{k}").alias("text")) for k, n in enumerate(names, 1)])
    return each.select(*keep, "match", F.explode(pairs).alias("c")).select(*keep, "match", "c.*")


def matches_passing(captures: DataFrame, keys: Sequence[str], equals: dict[str, str] | None = None, matches: dict[str, str] | None = None) -> DataFrame:
    """The captures of those matches (keys and match) of which every capture passes its predicate."""
    ok = predicate_captures(captures, equals, matches).groupBy(*keys, "match").agg(F.count("*").alias("__sw_n"))
    every = captures.groupBy(*keys, "match").agg(F.count("*").alias("__sw_n"))
    return captures.join(ok.join(every, [*keys, "match", "__sw_n"]).drop("__sw_n"), [*keys, "match"], "left_semi")


#: Roles from least to most powerful.
ROLES = ["developer", "manager", "admin"]


def role_level(role: Column | str) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), c(role)), F.lit(0))


def memberships_since(members: DataFrame, dismissals: DataFrame, orgs: DataFrame) -> DataFrame:
    """Memberships that began after their user last dismissed the notice, or that were never dismissed, with org_name."""
    last = dismissals.groupBy("user_id").agg(F.max("dismissed_at").alias("__sw_last"))
    rows = members.join(last, "user_id", "left").where("__sw_last is null or created_at > __sw_last").drop("__sw_last")
    named = rows.join(orgs.select("org_id", F.col("name").alias("org_name")), "org_id", "left")
    return named.withColumn("org_name", F.coalesce("org_name", F.lit("Unknown Organization")))


def payload_violations(findings: DataFrame, most: int = 5000) -> DataFrame:
    """(scan_id, problem, n): scans with too many findings, and findings of a severity that is not accepted."""
    accepted = ["Low", "Medium", "High", "Critical"]
    per = findings.groupBy("scan_id").agg(
        F.count("*").alias("total"), F.count_if(~F.coalesce("severity", F.lit("")).isin(accepted)).alias("bad")
    )
    rows = F.array(
        F.struct(F.lit("too_many_findings").alias("problem"), F.when(F.col("total") > most, F.col("total")).alias("n")),
        F.struct(F.lit("bad_severity").alias("problem"), F.when(F.col("bad") > 0, F.col("bad")).alias("n")),
    )
    return per.select("scan_id", F.explode(rows).alias("v")).select("scan_id", "v.*").where("n is not null")


def normalized_payload(findings: DataFrame) -> DataFrame:
    """Ingested findings in the stored form: defaults for what a payload does not carry, text cut short."""
    return findings.select(
        "scan_id",
        "rule_id",
        F.col("rule_id").alias("rule_name"),
        "file_path",
        "line",
        F.lit(0).alias("column_num"),
        F.substring("snippet", 1, 100).alias("snippet"),
        "severity",
        F.lit(0.0).alias("confidence_score"),
        F.lit(False).alias("reachable"),
    )


def exit_code(findings: DataFrame, severity: str = "High", confidence: float = 0.0) -> DataFrame:
    """One row: 1 if an unsuppressed finding reaches both thresholds, else 0."""
    hit = (
        ~F.coalesce(F.col("suppressed"), F.lit(False))
        & (severity_rank("severity") >= severity_rank(F.lit(severity)))
        & (F.col("confidence_score") >= confidence)
    )
    return findings.agg(F.when(F.coalesce(F.bool_or(hit), F.lit(False)), 1).otherwise(0).alias("exit_code"))


def page(rows: DataFrame, order: Sequence[Column], size: int, offset: int = 0) -> DataFrame:
    """One page of an order that is total, with the total and the next offset (null on the last page)."""
    total = rows.agg(F.count("*").alias("total"))
    one = rows.orderBy(*order).offset(offset).limit(size)
    following = F.when(F.col("total") > offset + size, F.lit(offset + size).cast("long"))
    return one.crossJoin(F.broadcast(total)).withColumn("next_cursor", following)


def neighbours(rows: DataFrame, order: Sequence[Column], key: str = "finding_id") -> DataFrame:
    """(key, previous, next) in a total order of the filtered rows.

    Ranges of the order are sorted in parallel; only each range's ends meet in one place, so no task sees
    the whole input. The ranges are written before both uses, which must see the same ones.
    """
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("__sw_part", F.spark_partition_id()))
    ranged = ranged.sortWithinPartitions("__sw_part", *order)
    inner = Window.partitionBy("__sw_part").orderBy(*order)
    own = ranged.withColumn("__sw_prev", F.lag(key).over(inner)).withColumn("__sw_next", F.lead(key).over(inner))
    ends = own.groupBy("__sw_part").agg(
        F.max(F.when(F.col("__sw_prev").isNull(), F.col(key))).alias("first"),
        F.max(F.when(F.col("__sw_next").isNull(), F.col(key))).alias("last"),
    )
    # as many rows as partitions
    across = Window.orderBy("__sw_part")
    ends = ends.select(
        "__sw_part", F.lag("last").over(across).alias("__sw_before"), F.lead("first").over(across).alias("__sw_after")
    )
    return own.join(F.broadcast(ends), "__sw_part").select(
        key,
        F.coalesce("__sw_prev", "__sw_before").alias("previous_id"),
        F.coalesce("__sw_next", "__sw_after").alias("next_id"),
    )
