"""Fixes of findings in lines: rounds of one patch a line, each matched again and taken back where that refuses it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import checkpointed, discard

LIMIT = 3
_OUT = "array<struct<rule_id:string,outcome:string,round:int>>"


def matching(line: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ids of the rules (rule_id, pattern) that a line matches, in their order."""
    return F.array_compact(F.array(*[F.when(line.rlike(p), F.lit(i)) for i, p in rules]))


def fix_lines(lines: DataFrame, rules: Sequence[tuple[str, str]], templates: Sequence[tuple[str, int, str, str]], limit: int = LIMIT) -> DataFrame:
    """lines (.., line) that rules match, with ``fixed``, ``outcomes`` array of (rule_id, outcome, round) and ``rounds``.

    rules (rule_id, pattern) and templates (rule_id, attempt from 1, pattern, replacement) are few and become constants.
    In each round a line takes one patch: that of the first rule in their order that still matches and has not been
    stopped, by its next attempt. The patched line is matched again. The patch is refused, and the line stays, if the rule still
    matches or one does that did not before; then the rule's next attempt follows, until ``limit`` attempts have
    failed (Reverted) or it has no further template (Skipped where it never had one). Otherwise the rule is Applied, and
    others that no longer match are Resolved. Lines depend on themselves alone, so a round is one projection of the rows that still have
    work, and it ends when none has: each round uses up an attempt.
    """
    most = {i: max((t[1] for t in templates if t[0] == i), default=0) for i, _ in rules}
    none = F.array().cast("array<string>")
    line, tried, stopped = F.col("__sw_line"), F.col("__sw_tried"), F.col("__sw_stopped")
    rows = lines.where(F.col("line").isNotNull()).withColumns(
        {"__sw_line": F.col("line"), "__sw_tried": F.create_map().cast("map<string,int>"), "__sw_stopped": none, "outcomes": F.array().cast(_OUT), "rounds": F.lit(0)}
    )
    rows = rows.withColumn("__sw_hits", matching(line, rules)).where("size(__sw_hits) > 0")
    done, k = [], 0
    rows = checkpointed(rows, "fix-rows")
    while True:
        k += 1
        todo = rows.withColumn("__sw_rule", F.get(F.array_except("__sw_hits", stopped), 0))
        done.append(todo.where("__sw_rule is null").drop("__sw_rule"))
        active = todo.where("__sw_rule is not null")
        active = active.withColumn("__sw_try", F.coalesce(F.try_element_at(tried, F.col("__sw_rule")), F.lit(0)) + 1)
        patch = F.lit(None).cast("string")
        for rule, attempt, pattern, replacement in templates:
            patch = F.when((F.col("__sw_rule") == rule) & (F.col("__sw_try") == attempt), F.regexp_replace(line, pattern, replacement)).otherwise(patch)
        last = F.element_at(F.create_map(*[F.lit(x) for item in most.items() for x in item]), F.col("__sw_rule"))
        active = active.withColumn("__sw_patch", patch).withColumn("__sw_after", F.when(F.col("__sw_patch").isNotNull(), matching(F.col("__sw_patch"), rules)))
        rule = F.col("__sw_rule")
        refused = F.array_contains("__sw_after", rule) | (F.size(F.array_except("__sw_after", "__sw_hits")) > 0)
        active = active.withColumn("__sw_ok", F.coalesce(~refused, F.lit(False)))
        ended = F.when(last == 0, "Skipped").when((F.col("__sw_try") >= F.least(F.lit(limit), last)), "Reverted")
        event = lambda r, o: F.struct(r.alias("rule_id"), o.alias("outcome"), F.lit(k).alias("round"))
        gone = F.array_except(F.array_except("__sw_hits", "__sw_after"), F.array(rule))
        fresh = F.when(F.col("__sw_ok"), F.concat(F.array(event(rule, F.lit("Applied"))), F.transform(gone, lambda r: event(r, F.lit("Resolved"))))).when(
            ended.isNotNull(), F.array(event(rule, ended))
        )
        step = active.select(
            *lines.columns,
            F.when(F.col("__sw_ok"), F.col("__sw_patch")).otherwise(line).alias("__sw_line"),
            F.map_concat(F.map_filter(tried, lambda r, _: r != rule), F.map_from_arrays(F.array(rule), F.array("__sw_try"))).alias("__sw_tried"),
            F.when(~F.col("__sw_ok") & ended.isNotNull(), F.array_append(stopped, rule)).otherwise(stopped).alias("__sw_stopped"),
            F.concat("outcomes", F.coalesce(fresh, F.array().cast(_OUT))).alias("outcomes"),
            F.lit(k).alias("rounds"),
            F.when(F.col("__sw_ok"), F.col("__sw_after")).otherwise(F.col("__sw_hits")).alias("__sw_hits"),
        )
        rows = checkpointed(step, "fix-rows")
        if rows.isEmpty():
            discard(rows)
            break
    return reduce(DataFrame.unionByName, done).select(*lines.columns, F.col("__sw_line").alias("fixed"), "outcomes", "rounds")
