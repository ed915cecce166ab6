"""Queries over changes of text: diffs of documents and fixes of their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as P
from ..operators import fixes as X
from ..registry import query
from ..scratch import checkpointed
from .scanning import LINE_RULES
from .standins import read, src_lines

_TEXTS = "t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_PAIRS = f"{_TEXTS}, firsts AS (SELECT substr(text, 1, 24) AS k, min(doc_id) AS id FROM t GROUP BY 1)"


def _lines(texts, key):
    """(pair, pos, line) of (key, text)."""
    return texts.select(F.col(key).alias("pair"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def _near(spark, d):
    """Lines of the first document that begins alike, and of the document itself, for every document that has another one."""
    docs = read(spark, d, "documents").where("text is not null").select("doc_id", "text", F.substring("text", 1, 24).alias("k"))
    first = docs.groupBy("k").agg(F.min("doc_id").alias("id"))
    pairs = docs.join(first, "k").where("id <> doc_id")
    before = pairs.select(F.col("doc_id").alias("pair"), F.col("id").alias("doc_id")).join(docs.select("doc_id", "text"), "doc_id")
    return checkpointed(_lines(before.select("pair", "text"), "pair"), "diff-old"), checkpointed(_lines(pairs, "doc_id"), "diff-new")


@query("rem2_near_copies", f"WITH {_PAIRS} SELECT doc_id, sha256(text) AS sha FROM t JOIN firsts ON k = substr(text, 1, 24) WHERE doc_id <> id")
def rem2_near(spark, d):
    """The first document of those that begin alike, patched to each of the others by the hunks of their diff."""
    old, new = _near(spark, d)
    found = P.hunks(P.script(old, new))
    return P.apply_hunks(old, found).select(F.col("pair").alias("doc_id"), F.sha2("text", 256).alias("sha"))


_EDITED = """l AS (SELECT doc_id, i, line, line_no FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
  parts AS (SELECT doc_id, i, 0 AS k, CASE WHEN i % 11 = 3 THEN concat('changed ', line) ELSE line END AS line FROM l WHERE i % 7 <> 5
    UNION ALL SELECT doc_id, i, 1, concat('after ', i) FROM l WHERE i % 9 = 4),
  edited AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i, k) AS text FROM parts GROUP BY 1)"""


def _edited(spark, d):
    """Lines of the documents, and of the same with every seventh line gone, every eleventh changed, and new ones after every ninth."""
    old = checkpointed(_lines(read(spark, d, "documents").where("text is not null"), "doc_id"), "diff-old")
    i = F.col("pos")
    kept = old.where("pos % 7 <> 5").select("pair", i.alias("i"), F.lit(0).alias("k"), F.when(i % 11 == 3, F.concat(F.lit("changed "), "line")).otherwise(F.col("line")).alias("line"))
    rows = kept.unionByName(old.where("pos % 9 = 4").select("pair", i.alias("i"), F.lit(1).alias("k"), F.concat(F.lit("after "), i).alias("line")))
    lines = rows.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("i", "k", "line"))).alias("ls"))
    return old, checkpointed(lines.select("pair", F.posexplode("ls.line").alias("pos", "line")), "diff-new")


@query(
    "rem2_edited",
    f"""WITH {_EDITED}, one AS (SELECT doc_id, line FROM l UNION ALL SELECT doc_id, line FROM parts), n AS (SELECT doc_id, count(*) AS before FROM l GROUP BY 1), m AS (SELECT doc_id, count(*) AS after FROM parts GROUP BY 1)
    SELECT doc_id, sha256(text) AS sha, after - before AS grown FROM edited JOIN n USING (doc_id) JOIN m USING (doc_id)""",
)
def rem2_edited(spark, d):
    """Documents patched to their edited forms, and by how many lines the hunks make them grow."""
    old, new = _edited(spark, d)
    found = checkpointed(P.hunks(P.script(old, new)), "diff-hunks")
    grown = found.groupBy("pair").agg((F.count_if(F.col("kind") == "+") - F.count_if(F.col("kind") == "-")).alias("grown"))
    made = P.apply_hunks(old, found).join(grown.hint("merge"), "pair", "left")
    return made.select(F.col("pair").alias("doc_id"), F.sha2("text", 256).alias("sha"), F.coalesce("grown", F.lit(0)).alias("grown"))


RULES = [(r[0], r[4]) for r in LINE_RULES]
#: (rule, attempt, pattern, replacement): a first try that fails, ones that always fail, and ones that help; none for licences.
TEMPLATES = [
    ("SEC001", 1, "token = ", "token =  "), ("SEC001", 2, 'token = "', 'token = "0'),
    ("PII001", 1, "@[a-z0-9]+[.]example[.]com", "@masked.example.com"), ("PII001", 2, "@([a-z0-9]+)[.]example[.]com", " at $1"),
    ("PII002", 1, "[.]([0-9]{1,3})[.]", ".0."), ("PII002", 2, "([0-9]{1,3})[.]([0-9]{1,3})", "$1.9"),
    ("PII003", 1, "[0-9]{16}", "1.2.3.4"), ("PII003", 2, "[0-9]{16}", "0000111122223333"), ("PII003", 3, "[0-9]{12}([0-9]{4})", "x$1"),
]
LIMIT = 2


def _sql_hits(line):
    cases = ", ".join(f"CASE WHEN regexp_matches({line}, '{p}') THEN '{i}' END" for i, p in RULES)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def _sql_patch():
    cases = " ".join(f"WHEN rule = '{r}' AND try = {k} THEN regexp_replace(line, '{p}', '{to.replace('$', chr(92))}', 'g')" for r, k, p, to in TEMPLATES)
    return f"CASE {cases} END"


_MOST = "CASE rule " + " ".join(f"WHEN '{i}' THEN {max((t[1] for t in TEMPLATES if t[0] == i), default=0)}" for i, _ in RULES) + " END"


@query(
    "rem3_fix_rounds",
    f"""WITH start AS (SELECT doc_id, line_no, line, {_sql_hits("line")} AS hits FROM src_lines),
    s AS (SELECT doc_id, line_no, line, hits, CAST([] AS VARCHAR[]) AS stopped, CAST([] AS VARCHAR[]) AS tried, '' AS log, 0 AS k, false AS done FROM start WHERE len(hits) > 0
      UNION ALL SELECT doc_id, line_no, CASE WHEN ok THEN patch ELSE line END, CASE WHEN ok THEN after ELSE hits END,
        CASE WHEN rule IS NOT NULL AND NOT ok AND ended IS NOT NULL THEN list_append(stopped, rule) ELSE stopped END, CASE WHEN rule IS NULL THEN tried ELSE list_append(tried, rule) END,
        concat(log, CASE WHEN rule IS NULL THEN '' WHEN ok THEN concat(';', rule, '=Applied@', k + 1, array_to_string(list_transform(list_filter(hits, lambda x: NOT list_contains(after, x) AND x <> rule), lambda x: concat(';', x, '=Resolved@', k + 1)), ''))
          WHEN ended IS NOT NULL THEN concat(';', rule, '=', ended, '@', k + 1) ELSE '' END),
        CASE WHEN rule IS NULL THEN k ELSE k + 1 END, rule IS NULL
      FROM (SELECT *, coalesce(patch IS NOT NULL AND NOT list_contains(after, rule) AND len(list_filter(after, lambda x: NOT list_contains(hits, x))) = 0, false) AS ok,
          CASE WHEN {_MOST} = 0 THEN 'Skipped' WHEN try >= least({LIMIT}, {_MOST}) THEN 'Reverted' END AS ended
        FROM (SELECT *, {_sql_hits("patch")} AS after FROM (SELECT *, {_sql_patch()} AS patch FROM (SELECT *, len(list_filter(tried, lambda x: x = rule)) + 1 AS try
          FROM (SELECT *, list_filter(hits, lambda x: NOT list_contains(stopped, x))[1] AS rule FROM s WHERE NOT done))))))
    SELECT doc_id, line_no, line AS fixed, log AS outcomes, k AS rounds FROM s WHERE done""",
    recursive=True,
)
def rem3(spark, d):
    """All lines of the documents that a line rule matches, fixed in rounds."""
    rows = X.fix_lines(src_lines(spark, d).select("doc_id", "line_no", "line"), RULES, TEMPLATES, LIMIT)
    log = F.array_join(F.transform("outcomes", lambda o: F.concat(F.lit(";"), o["rule_id"], F.lit("="), o["outcome"], F.lit("@"), o["round"])), "")
    return rows.select("doc_id", "line_no", "fixed", log.alias("outcomes"), "rounds")
