"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows.

Every window of ``window`` consecutive words of a benchmark item (the whole item where it is shorter)
becomes a pattern of word numbers, each spelt in DIGITS symbols; a document is normalised to its words' numbers,
those of words that no item has being 0, and scanned once. Matches are mapped through word starts to code points of the
original text. Only the benchmark is broadcast, and its size is checked: an automaton takes about NODE_BYTES a
symbol, and where that comes to more than ``max_pattern_bytes`` the windows are cut into slices with an automaton
each. Slices then run over the documents one after another, each written before the next is read from the
benchmark, so neither the driver nor a worker ever holds more than one, and nothing is skipped.

Row rules: null or empty text has no words, no hits. Texts may have any length. Items with null or empty text
have no window. Rows that repeat are treated one by one; items that repeat an id with other texts pool their
windows; null item ids are left out. Of several items with a window all are named, so there are no ties. Empty
tables give empty results, or no hits. Extra columns of documents pass through; one that has the name of the
output is replaced, as by withColumn.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, others, small_batches
from .words import WORD_TABLE, slices, tidy, words

WINDOW = 10
#: Of an automaton, measured at 46 bytes a symbol.
MAX_PATTERN_BYTES, NODE_BYTES = 96 << 20, 48
#: A word's number is spelt in so many symbols of this base: the automaton looks for a node's child one by one.
DIGITS, BASE = 3, 64
NONE = "\0" * DIGITS

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("count", T.LongType())]))),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class Patterns:
    """Windows as strings of word numbers, each with the places of its items."""

    def __init__(self):
        self.numbers: dict[bytes, str] = {}
        self.windows: dict[str, set[int]] = {}
        self.items: list[str] = []

    def spelt(self, word: bytes) -> str:
        """The number of a word; first digits are no others' digits, so that no match begins inside a word."""
        if word not in self.numbers:
            n = len(self.numbers)
            self.numbers[word] = "".join(chr(1 + BASE * (k == 0) + n // BASE**k % BASE) for k in range(DIGITS))
        return self.numbers[word]

    def add(self, item: str, window: list[bytes]) -> None:
        if not self.items or self.items[-1] != item:
            self.items.append(item)
        self.windows.setdefault("".join(map(self.spelt, window)), set()).add(len(self.items) - 1)

    def full(self, window: int, max_bytes: int) -> bool:
        return len(self.windows) * window * DIGITS * NODE_BYTES >= max_bytes or len(self.numbers) + window > BASE**DIGITS

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for own, items in self.windows.items():
            a.add_word(own, (len(own) // DIGITS, items))
        a.make_automaton()
        return a


def scan(a, patterns: Patterns, text: str | None) -> tuple[int, list, list, list[str]]:
    """(n_words, merged hit word runs, their spans in code points, item ids) of one document."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    flat = raw.translate(WORD_TABLE)
    w = flat.split()
    if not w or not len(a):
        return len(w), [], [], []
    found = list(a.iter("".join(map(patterns.numbers.get, w, itertools.repeat(NONE)))))
    if not found:
        return len(w), [], [], []
    size = np.array([n for _, (n, _) in found])
    stop = (np.array([end for end, _ in found]) + 1) // DIGITS
    change = np.zeros(len(w) + 1, np.int64)
    np.add.at(change, stop - size, 1)
    np.add.at(change, stop, -1)
    runs = _runs(np.cumsum(change[:-1]) > 0)
    at, to = _runs(np.frombuffer(flat, np.uint8) != 32).T  # bytes of each word in the original
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points up to each byte
    spans = [(int(chars[at[s]]) - 1, int(chars[to[e - 1] - 1])) for s, e in runs]
    items = sorted({patterns.items[i] for i in set().union(*(ids for _, (_, ids) in found))})
    return len(w), [(int(s), int(e - s)) for s, e in runs], spans, items


def _runs(mask: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge.reshape(-1, 2)


def pattern_slices(benchmark: DataFrame, item_id: str, text: str, window: int, max_bytes: int) -> Iterator[Patterns]:
    """Patterns of the items, in slices whose automata take about max_bytes at most; an item may lie in several."""
    rows = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string"), F.col(text))
    found = Patterns()
    for i, t in rows.toLocalIterator():
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else []:
            if found.windows and found.full(window, max_bytes):
                yield found
                found = Patterns()
            found.add(i, w[k : k + window])
    yield found


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    out: str = "hits",
    keep: list[str] | None = None,
    max_pattern_bytes: int = MAX_PATTERN_BYTES,
) -> DataFrame:
    """docs (or its columns ``keep``) plus the struct ``out``: n_words, hit_words, hit_spans, items."""
    small_batches(docs.sparkSession)
    keep = others(docs.columns if keep is None else keep, out)
    own = free_name(docs, "__sw_text")
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias(own))
    parts = pattern_slices(benchmark, item_id, item_text, window, max_pattern_bytes)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _scan_with(df, first, own, out).drop(own)
    row, more = free_name(df, "__sw_row"), free_name(df, "__sw_more")
    df = materialize(df.withColumn(row, F.monotonically_increasing_id()), "leak-docs")
    late = None
    for part in itertools.chain([second], parts):
        found = _scan_with(df.select(row, own), part, own, more).where(F.size(f"{more}.hit_words") > 0).drop(own)
        found = materialize(found, "leak-hits")
        late = found if late is None else late.unionByName(found)
    late = late.groupBy(row).agg(F.collect_list(more).alias(more))
    df = _scan_with(df, first, own, out).drop(own).join(late, row, "left")
    return df.withColumn(out, F.when(F.col(more).isNull(), F.col(out)).otherwise(_pooled(F.col(out), F.col(more)))).select(*keep, out)


def _pooled(first, more):
    """Hits of all slices as one; runs may touch or overlap, as n_hit counts words through a set."""
    return F.struct(
        first["n_words"].alias("n_words"),
        F.concat(first["hit_words"], F.flatten(more["hit_words"])).alias("hit_words"),
        F.concat(first["hit_spans"], F.flatten(more["hit_spans"])).alias("hit_spans"),
        F.array_sort(F.array_union(first["items"], F.flatten(more["items"]))).alias("items"),
    )


def _scan_with(df: DataFrame, patterns: Patterns, text: str, out: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(patterns)
    schema = T.StructType([*df.schema.fields, T.StructField(out, HITS)])
    at = df.columns.index(text)

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(HITS)
        a = shared.value.automaton()
        for part in slices(batches, at):
            hits = [
                {
                    "n_words": n,
                    "hit_words": [{"first": s, "count": c} for s, c in runs],
                    "hit_spans": [{"start": s, "end": e} for s, e in spans],
                    "items": items,
                }
                for n, runs, spans, items in (scan(a, shared.value, t) for t in part.column(at).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, kind)], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def n_hit(hits: str = "hits"):
    """Words under any hit; runs of several slices may overlap, so their union is counted."""
    runs = F.array_sort(F.col(f"{hits}.hit_words"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(
        runs,
        zero,
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0), r["first"] + r["count"] - F.greatest(s["upto"], r["first"]))).alias("n"),
            F.greatest(s["upto"], r["first"] + r["count"]).alias("upto"),
        ),
        lambda s: s["n"],
    )


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    found = found.withColumn("n_hit", n_hit())
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        "n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH b AS (SELECT item_id, {_W} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i + 1, i + least(len(w), 10)), ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(greatest(len(w) - 9, 1))) AS i) t WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM bw),
d AS (SELECT doc_id, {_W} AS w FROM documents),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS win
  FROM (SELECT doc_id, w, n FROM d CROSS JOIN lens WHERE len(w) >= n), LATERAL (SELECT unnest(range(len(w) - n + 1)) AS i) t
), m AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
