r"""Interaction of quality filters: what each filter removes in every order, and what it alone would have removed.

``flag_texts`` marks the failures of five filters on whole texts, ``prefix_counts`` counts them, ``order_report``
spreads the counts over all orders. Counting uses a packed bitmap index: every Arrow batch of a partition becomes
NumPy bitsets, one for each filter and each label, in which every part owns a segment of whole bytes (the part's
bitset marks the bits that are rows of it). For each subset of the filters that can stand before a filter,
AND-NOT gives the rows that pass it, AND the rows that the filter then removes, and a popcount for each
segment the numbers. A task adds up its batches; Spark adds up the tasks. Any order of the filters is a chain of
such subsets, so 2^n subsets stand for n! orders, and no row is looked at more than once.

Only (part, failure bits) reaches Python. A row's copies elsewhere are found by its text's digest: the smallest
doc_id of a digest is a combinable minimum, and a row asks for (digest, own doc_id), a key that copies do not share.

Row rules: null text is empty, null part is the empty string. Rows with a null doc_id have no label and are no
copies, and make no other row a copy. Rows that repeat count each; those that share the smallest doc_id of their text
are all first. Labels that repeat a doc_id: one that is 1 is enough. Texts may have any length. Empty tables give
no rows, without labels nothing is good or toxic. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, materialize

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
ODD_SIGNS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
#: Parts whose sums a task holds before it gives them out.
HELD_PARTS = 4096


def text_failures(text: Column) -> dict[str, Column]:
    """Failure of each filter that looks at a text alone: A too short, B repetitive, C upper-case, D odd signs."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {
        "A": n < MIN_WORDS,
        "B": distinct.cast("long") * 100 < n.cast("long") * DISTINCT_PERCENT,
        "C": upper.cast("long") * 100 > F.char_length(text).cast("long") * UPPER_PERCENT,
        "D": text.rlike(ODD_SIGNS),
    }


def flag_texts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of every row of docs; E: a smaller doc_id has the same text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        *[c.alias(name) for name, c in text_failures(text).items()],
    )
    rows = materialize(rows, "audit-flags")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    known = rows.where("doc_id is not null").join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left")
    known = known.join(marks, "doc_id", "left").select(
        "part", "A", "B", "C", "D", F.col("first").isNull().alias("E"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    )
    no = F.lit(False)
    unknown = rows.where("doc_id is null").select("part", "A", "B", "C", "D", no.alias("E"), no.alias("good"), no.alias("toxic"))
    return known.unionByName(unknown)


def segment_counts(codes: np.ndarray, bits: np.ndarray, n_filters: int, n_labels: int) -> np.ndarray:
    """Counts of each part over the rows of one batch: [part, subset, filter, (passed, removed, each label removed)].

    codes: part of each row, 0 to the number of parts; bits: failures and labels of each row, the filters lowest.
    """
    n_parts = int(codes.max()) + 1
    per = np.bincount(codes, minlength=n_parts)
    room = (per + 7) // 8
    starts = np.concatenate([[0], np.cumsum(room)[:-1]])
    order = np.argsort(codes, kind="stable")
    # each part's rows follow one another from the first bit of its first byte
    slot = np.empty(len(codes), np.int64)
    slot[order] = np.arange(len(codes)) + np.repeat(starts * 8 - np.concatenate([[0], np.cumsum(per)[:-1]]), per)

    def packed(of_row: np.ndarray) -> np.ndarray:
        spread = np.zeros(int(room.sum()) * 8, bool)
        spread[slot] = of_row
        return np.packbits(spread)

    def count(bitset: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(bitset).astype(np.int64), starts)

    present = packed(np.ones(len(codes), bool))
    fails = [packed((bits >> k) & 1 != 0) for k in range(n_filters)]
    marked = [packed((bits >> (n_filters + k)) & 1 != 0) for k in range(n_labels)]
    out = np.zeros((n_parts, 1 << n_filters, n_filters, 2 + n_labels), np.int64)
    passes = [present]
    for subset in range(1, 1 << n_filters):
        low = (subset & -subset).bit_length() - 1
        passes.append(passes[subset & (subset - 1)] & ~fails[low])
    for subset, left in enumerate(passes):
        passed = count(left)
        for k in range(n_filters):
            if not subset >> k & 1:
                removed = left & fails[k]
                out[:, subset, k, 0] = passed
                out[:, subset, k, 1] = count(removed)
                for j, of in enumerate(marked):
                    out[:, subset, k, 2 + j] = count(removed & of)
    return out


def prefix_counts(rows: DataFrame, filters: Sequence[str] = tuple(FILTERS), labels: Sequence[str] = ("good", "toxic"), part: str = "part") -> DataFrame:
    """(part, subset, filter, passed, removed, <label>_lost..) for each filter and each subset of the others.

    rows: a boolean column for each filter (true: fails) and label, null for false; filters are at most 8. subset is
    a bit mask over ``filters``; passed counts the rows that no filter of it removes, removed those that the filter
    then removes.
    """
    if len(filters) > 8:
        raise ValueError("at most 8 filters")
    columns = [*filters, *labels]
    bits = sum((F.when(F.col(f"`{c}`"), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(columns)), F.lit(0))
    n_filters, n_labels = len(filters), len(labels)
    pairs = [(s, k) for s in range(1 << n_filters) for k in range(n_filters) if not s >> k & 1]
    at_subset, at_filter = np.array([s for s, _ in pairs]), np.array([k for _, k in pairs])
    lost = [f"{c}_lost" for c in labels]
    schema = "part string, subset int, filter int, passed long, removed long" + "".join(f", `{c}` long" for c in lost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            sums = np.stack([v[at_subset, at_filter] for v in held.values()]).reshape(-1, 2 + n_labels)
            names = pa.array(held, pa.string()).take(pa.array(np.repeat(np.arange(len(held)), len(pairs))))
            which = [np.tile(x, len(held)).astype(np.int32) for x in (at_subset, at_filter)]
            held.clear()
            return pa.RecordBatch.from_arrays([names, *map(pa.array, which), *(pa.array(np.ascontiguousarray(c)) for c in sums.T)], names=["part", "subset", "filter", "passed", "removed", *lost])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            counts = segment_counts(names.indices.to_numpy(), batch.column(1).to_numpy(), n_filters, n_labels)
            for name, c in zip(names.dictionary.to_pylist(), counts):
                held[name] = held[name] + c if name in held else c
            if len(held) > HELD_PARTS:
                yield out()
        if held:
            yield out()

    found = rows.select(F.coalesce(F.col(part), F.lit("")).alias("part"), bits.cast("int").alias("bits")).mapInArrow(run, schema)
    names = F.element_at(F.array(*map(F.lit, filters)), F.col("filter") + 1)
    sums = [F.sum(c).alias(c) for c in ("passed", "removed", *lost)]
    return found.groupBy("part", "subset", "filter").agg(*sums).withColumn("filter", names)


def order_report(counts: DataFrame, filters: Sequence[str] = tuple(FILTERS), labels: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <label>_lost.., shapley) for all orders.

    counts are those of prefix_counts. The steps are a fixed table of n! * n rows, which is broadcast; a part and filter
    have 2^(n-1) subsets, so the windows are of fixed size.
    """
    spark, n = counts.sparkSession, len(filters)
    lost = [f"{c}_lost" for c in labels]
    steps = []
    for order in itertools.permutations(range(n)):
        name, before = "".join(filters[k] for k in order), 0
        for step, k in enumerate(order, 1):
            steps.append((name, step, before, filters[k]))
            before |= 1 << k
    orders = spark.createDataFrame(steps, "filter_order string, step int, subset int, filter string")
    of_filter = Window.partitionBy("part", "filter")
    own = F.element_at(F.create_map(*[F.lit(x) for k, f in enumerate(filters) for x in (f, 1 << k)]), F.col("filter"))
    # so many orders have just these filters before the filter
    weights = [math.factorial(s) * math.factorial(n - 1 - s) for s in range(n)]
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.bit_count("subset") + 1)
    rows = counts.select(
        "part", "subset", "filter", "passed", "removed", *lost,
        F.max(F.when(F.col("subset") == 0, F.col("removed"))).over(of_filter).alias("fails"),
        F.max(F.when(F.col("subset") == (1 << n) - 1 - own, F.col("removed"))).over(of_filter).alias("unique_fails"),
        F.sum(weight * F.col("removed")).over(of_filter).alias("shapley"),
    )
    return rows.join(F.broadcast(orders), ["subset", "filter"]).select(
        "part", "filter_order", "step", (F.col("passed") - F.col("removed")).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley",
    )


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of the five filters over documents, in parts by source."""
    return order_report(prefix_counts(flag_texts(docs, labels)))


SQL = """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
  first AS (SELECT text, min(doc_id) AS id FROM t GROUP BY text),
  marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
  flags AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
      + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN t.doc_id > first.id THEN 16 ELSE 0 END AS mask
    FROM t JOIN first USING (text) LEFT JOIN marks ON marks.doc_id = t.doc_id),
  groups AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, mask),
  letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) l(c, b)),
  orders AS (SELECT concat(p.c, q.c, r.c, s.c, u.c) AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits FROM letters p, letters q, letters r, letters s, letters u
    WHERE p.b + q.b + r.b + s.b + u.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, u.b])) = 5),
  steps AS (SELECT filter_order, step, CAST(bits[step] AS INT) AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
    FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
  rows_ AS (SELECT part, filter_order, step, bit,
      sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
      sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
      sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM groups, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM rows_"""
