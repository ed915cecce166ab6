"""Line deduplication that returns keep bitmaps.

Hashes of normalised lines are range-partitioned and sorted by (hash, document, position), so that the
first occurrence of a line is the first row of its run; later documents' rows become drops. A hash is
split by a document salt first, and only the first document of each (hash, salt) goes to the second
pass, so a line that a third of all documents hold is spread over SALTS groups and meets again as at
most SALTS rows. No text is shuffled until a bitmap is applied.

Row rules: null or empty text is one empty line. Texts and lines may have any length. Rows that share doc_id
are one document, and lose nothing to each other; of a line's documents the smallest doc_id keeps it, so there
are no ties. Rows with a null doc_id lose nothing and make nothing lose. Empty tables give empty results. Extra
columns, whatever their names, pass through ``apply_keep_runs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, free_name, materialize

#: Groups that a hash is spread over at least; more where the session shuffles into more partitions.
SALTS = 64
MIN_CHARS = 10


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, version, n_lines, pos, h1, h2) of every line whose key has min_chars code points or more.

    version tells apart rows that repeat a doc_id with another text.
    """
    base = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("version"),
        _lines(text).alias("lines"),
    )
    exploded = base.select(
        "doc", "version", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line")
    )
    keyed = exploded.select(
        "doc", "version", "n_lines", "pos", ascii_lower(F.btrim("line", F.lit(ASCII_SPACE))).alias("key")
    ).where(F.char_length("key") >= min_chars)
    return keyed.select(
        "doc",
        "version",
        "n_lines",
        "pos",
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(7), "key").alias("h2"),
    )


def dropped_lines(hashes: DataFrame, salts: int = SALTS) -> DataFrame:
    """(doc, version, n_lines, pos) of the lines to drop: those of a hash outside its smallest document."""
    salts = max(salts, int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = hashes.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    runs = salted.repartitionByRange("h1", "h2", "salt")
    first = F.first("doc").over(Window.partitionBy("h1", "h2", "salt").orderBy("doc", "pos"))
    runs = runs.withColumn("first_doc", first)
    late = runs.where("doc <> first_doc").select("doc", "version", "n_lines", "pos")
    meet = runs.where("doc = first_doc").select("h1", "h2", "doc", "version", "n_lines", "pos")
    meet = meet.repartitionByRange("h1", "h2")
    overall = F.first("doc").over(Window.partitionBy("h1", "h2").orderBy("doc", "pos"))
    later = meet.withColumn("first_doc", overall).where("doc <> first_doc")
    return late.union(later.select("doc", "version", "n_lines", "pos"))


def keep_bitmaps(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, salts: int = SALTS
) -> DataFrame:
    """(doc, version, n_lines, keep_runs) for each document that loses lines; the others keep all.

    keep_runs is the run-length-coded bitmap: array<struct<keep,drop>> of alternating run lengths; what
    follows the last run is kept.
    """
    hashes = materialize(line_hashes(docs, doc_id, text, min_chars), "line-hashes")
    per_doc = (
        dropped_lines(hashes, salts)
        .groupBy("doc", "version")
        .agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("pos")).alias("d"))
    )
    # a run starts where the position before it is not dropped
    starts = F.filter(
        F.sequence(F.lit(0), F.size("d") - 1),
        lambda i: (i == 0) | (F.get("d", i) - F.get("d", i - 1) != 1),
    )
    per_doc = per_doc.withColumn("s", starts)
    runs = F.transform(
        F.col("s"),
        lambda i, j: F.struct(
            F.when(i == 0, F.get("d", i)).otherwise(F.get("d", i) - F.get("d", i - 1) - 1).alias("keep"),
            (F.coalesce(F.get("s", j + 1), F.size("d")) - i).alias("drop"),
        ),
    )
    return per_doc.select("doc", "version", "n_lines", runs.alias("keep_runs"))


def kept_text(text: str, runs: Column) -> Column:
    """The text without the lines that the bitmap drops, joined by newlines."""
    mask = F.flatten(
        F.transform(
            runs,
            lambda r: F.concat(
                F.array_repeat(F.lit(True), r["keep"]), F.array_repeat(F.lit(False), r["drop"])
            ),
        )
    )
    zipped = F.arrays_zip(_lines(text).alias("line"), mask.alias("keep"))
    kept = F.filter(zipped, lambda z: F.coalesce(z["keep"], F.lit(True)))
    return F.array_join(F.transform(kept, lambda z: z["line"]), "\n")


def apply_keep_runs(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text replaced by what is kept; the columns stay as they were."""
    runs = free_name(docs, "__sw_runs")
    joined = with_runs(docs, bitmaps, doc_id, text, runs)
    new = F.when(F.col(runs).isNull(), F.col(text)).otherwise(kept_text(text, F.col(runs)))
    return joined.withColumn(text, new).select(*docs.columns)


def with_runs(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "__sw_runs") -> DataFrame:
    """docs plus the keep_runs of each document, null where it keeps all."""
    doc, version, own = (free_name(docs, stem) for stem in ("__sw_doc", "__sw_version", "__sw_own"))
    found = bitmaps.select(F.col("doc").alias(doc), F.col("version").alias(version), F.col("keep_runs").alias(out))
    versioned = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = versioned.join(found, (F.col(doc_id) == F.col(doc)) & (F.col(own) == F.col(version)), "left")
    return joined.drop(doc, version, own)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document of the contract: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = docs.select("doc_id", "text")
    joined = with_runs(docs, keep_bitmaps(docs))
    dropped = F.aggregate("__sw_runs", F.lit(0).cast("long"), lambda a, r: a + r["drop"])
    kept = F.when(F.col("__sw_runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        kept_text("text", F.col("__sw_runs"))
    )
    return joined.select(
        "doc_id",
        F.size(_lines("text")).cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0).cast("long")).alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.*, coalesce(k.doc_id > f.first_doc, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
