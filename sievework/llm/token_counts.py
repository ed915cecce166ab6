"""Token counts of the documents in flat, unindexed token files, by a separator scan.

A token file is nothing but fixed-width little-endian ids, each document ended by the separator id. Files
are cut into blocks that are scanned independently: one vectorised comparison finds the separators of a
block, and a prefix scan over summaries of the blocks (its last separator and the document after it) stitches
the documents that cross block borders. The scan has two levels, ranges of RANGE blocks and then the ranges
of a file, so no task gathers the blocks of a large file, and what the blocks found is never shuffled by file.
Files of up to ``whole_bytes`` come in one read of Spark's; longer ones are read in ranges through pyarrow's
file systems, so memory is bounded whatever a file's size; in a store that pyarrow does not know they come in one
read too, which takes executors that can hold the file.

``write_token_files`` makes such files from documents, through Spark's own writer and so in any store it
reaches. Every document starts with HEADER ids that spell its doc_id in base ``separator``, hence no index
or order is needed to know it again; ``header=0`` counts files that have none.

Row rules: null or empty text has 0 tokens. Texts may have any length. Rows with a null doc_id are left out.
Repeated rows are counted one by one, so there are no ties; an empty table has no counts. A file that does not
end in a separator ends its last document; empty files have none. A vocabulary whose ids do not fit in
``width`` bytes is refused. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import materialize, scratch_path, small_batches
from .words import slices, tidy

HEADER = 5
SEPARATOR = 50_256
WIDTH = 2
BLOCK_IDS = 1 << 20
#: Blocks in a range of the first level of the prefix scan.
RANGE = 1024
WHOLE_BYTES = 64 << 20
#: Documents in a file at most, which bounds what one read brings.
FILE_DOCUMENTS = 4000


def header_of(doc_id: int, base: int) -> list[int]:
    """The id as HEADER digits below the separator; negative ids are folded in by zigzag."""
    z = (doc_id << 1) ^ (doc_id >> 63)
    return [(z // base**k) % base for k in range(HEADER)]


def header_ids(digits: np.ndarray, base: int) -> np.ndarray:
    """Inverse of header_of for rows of digits."""
    z = np.zeros(len(digits), np.uint64)
    for k in range(HEADER):
        z += digits[:, k].astype(np.uint64) * np.uint64(pow(base, k, 1 << 64))
    return ((z >> np.uint64(1)).astype(np.int64)) ^ -((z & np.uint64(1)).astype(np.int64))


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str | None = None, separator: int = SEPARATOR, width: int = WIDTH
) -> None:
    """Encode doc_id and text into token files under path. Separator text in a document is ordinary text."""
    small_batches(docs.sparkSession)
    found = bpe.encoder_tables(bpe.read_spec(vocabulary or bpe.default_vocabulary()))
    if max(len(found["len"]) - 1, separator) >= 1 << 8 * width:
        raise ValueError(f"ids of this vocabulary do not fit in {width} bytes")
    tables = docs.sparkSession.sparkContext.broadcast(found)
    kind = f"<u{width}"

    @tidy(bpe.forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bpe.codec(tables.value)
        for part in slices(batches, 1):
            ids = c.encode_batch([t or "" for t in part.column(1).to_pylist()], special=False)
            heads = (np.array(header_of(d, separator), kind).tobytes() for d in part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([h + x.astype(kind).tobytes() for h, x in zip(heads, ids)], pa.binary())], names=["record"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "record binary")
    # the text writer puts a string's bytes and then the line separator, byte by byte as Latin-1
    end = np.array([separator], kind).tobytes().decode("latin-1")
    (
        rows.select(F.col("record").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", end)
        .option("maxRecordsPerFile", FILE_DOCUMENTS)
        .option("compression", "none")
        .text(path)
    )


BLOCKS = "file string, start long, seps array<long>, ids array<long>, first_id long"


def scan_block(
    ids: np.ndarray, start: int, own: int, file_ids: int, separator: int, header: int
) -> tuple[list[int], list[int | None], int | None]:
    """Separators among the first ``own`` ids of a block, the doc_id that follows each, and the file's first.

    ids may run over the block's end by ``header`` ids; start and file_ids are in ids of the file.
    """
    at = np.flatnonzero(ids[:own] == separator)
    seps = (at + start).tolist()
    begins = np.concatenate(([0], at + 1)) if start == 0 else at + 1
    names: list[int | None]
    if header:
        full = begins + header <= len(ids)
        rows = ids[np.where(full, begins, 0)[:, None] + np.minimum(np.arange(header), max(len(ids) - 1, 0))] if len(ids) else np.zeros((0, header))
        names = [int(n) if f else None for n, f in zip(header_ids(rows, separator), full)] if len(ids) else [None] * len(begins)
    else:
        names = [None] * len(begins)
    first = names.pop(0) if start == 0 else None
    if start + own >= file_ids and file_ids and (not len(ids[:own]) or ids[own - 1] != separator):
        seps.append(file_ids)  # the end of the file ends its last document
        names.append(None)
    return seps, names, first


def known_store(path: str) -> bool:
    """Whether pyarrow can open files of this store."""
    from pyarrow import ArrowInvalid, fs

    scheme = path.partition(":")[0] if ":" in path else "file"
    try:
        fs.FileSystem.from_uri("file:///" if scheme == "file" else path)
    except (ArrowInvalid, OSError):
        return False
    return True


def scan_files(
    spark: SparkSession,
    path: str,
    separator: int = SEPARATOR,
    width: int = WIDTH,
    header: int = HEADER,
    block_ids: int = BLOCK_IDS,
    whole_bytes: int = WHOLE_BYTES,
) -> DataFrame:
    """(file, start, seps, ids, first_id): one row per block of every file under path."""
    kind = f"<u{width}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def blocks(name: str, total: int, read) -> Iterator[tuple]:
        for start in range(0, total, block_ids):
            own = min(block_ids, total - start)
            ids = np.frombuffer(read(start * width, min(own + header, total - start) * width), kind)
            yield name, start, *scan_block(ids, start, own, total, separator, header)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(cols[0], pa.string()),
                pa.array(cols[1], pa.int64()),
                pa.array(cols[2], pa.list_(pa.int64())),
                pa.array(cols[3], pa.list_(pa.int64())),
                pa.array(cols[4], pa.int64()),
            ],
            names=["file", "start", "seps", "ids", "first_id"],
        )

    @tidy()
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, 1) for x in batches for k in range(x.num_rows)):
            for k in range(b.num_rows):
                data = memoryview(b.column(1)[k].as_buffer())
                rows = list(blocks(b.column(0)[k].as_py(), len(data) // width, lambda at, n: data[at : at + n]))
                if rows:
                    yield batch(rows)

    @tidy()
    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name, length, start in zip(*(c.to_pylist() for c in b.columns)):
                store, place = fs.FileSystem.from_uri(name.replace("file:/", "file:///") if name.startswith("file:/") and not name.startswith("file:///") else name)
                total = length // width
                own = min(block_ids, total - start)
                with store.open_input_file(place) as f:
                    ids = np.frombuffer(f.read_at(min(own + header, total - start) * width, start * width), kind)
                yield batch([(name, start, *scan_block(ids, start, own, total, separator, header))])

    if not known_store(path):
        whole_bytes = 1 << 62
    small = files.where(F.col("length") <= whole_bytes).select("path", "content").mapInArrow(whole, BLOCKS)
    large = files.where(F.col("length") > whole_bytes).select("path", "length")
    if large.isEmpty():
        return small
    starts = F.explode(F.sequence(F.lit(0), F.expr(f"(length div {width}) - 1"), F.lit(block_ids))).alias("start")
    large = large.select("path", "length", starts).repartition("path", "start")
    return small.union(large.mapInArrow(ranged, BLOCKS))


def carried(blocks: DataFrame, block_ids: int) -> DataFrame:
    """(file, start, carry): of each block, the last (start, at, id) before it: a separator and the document after it.

    A prefix scan in two levels over one small row a block.
    """
    some = F.size("seps") > 0
    at = F.when(some, F.element_at("seps", -1)).otherwise(F.lit(-1).cast("long"))
    name = F.when(some, F.element_at("ids", -1)).otherwise(F.col("first_id"))
    rows = blocks.select(
        "file",
        "start",
        F.expr(f"start div {block_ids * RANGE}").alias("range"),
        F.when(some | (F.col("start") == 0), F.struct("start", at.alias("at"), name.alias("id"))).alias("last"),
    )
    inside = Window.partitionBy("file", "range").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("file", "range").agg(F.max("last").alias("top")).withColumn("before", F.max("top").over(across))
    near = rows.withColumn("near", F.max("last").over(inside)).select("file", "start", "range", "near")
    return near.join(tops.select("file", "range", "before"), ["file", "range"]).select("file", "start", F.coalesce("near", "before").alias("carry"))


def count_tokens(blocks: DataFrame, header: int = HEADER, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, doc_id, begins_at, n_tokens) of every document, from the scanned blocks."""
    blocks = materialize(blocks, "token-blocks")
    stitched = blocks.join(carried(blocks, block_ids), ["file", "start"]).select(
        "file",
        "seps",
        "ids",
        F.coalesce("carry.at", F.lit(-1).cast("long")).alias("carry_at"),
        "carry",
        "first_id",
    )
    doc = stitched.where(F.size("seps") > 0).select(
        "file",
        F.explode(
            F.arrays_zip(
                F.concat(F.array("carry_at"), F.slice("seps", 1, F.size("seps") - 1)).alias("b"),
                F.col("seps").alias("e"),
                F.concat(
                    F.array(F.when(F.col("carry").isNull(), F.col("first_id")).otherwise(F.col("carry.id"))), F.slice("ids", 1, F.size("ids") - 1)
                ).alias("i"),
            )
        ).alias("d"),
    )
    return doc.select(
        "file",
        F.col("d.i").alias("doc_id"),
        (F.col("d.b") + 1).alias("begins_at"),
        (F.col("d.e") - F.col("d.b") - 1 - header).alias("n_tokens"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens of every document, through token files in the shared folder."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path)
    return count_tokens(scan_files(spark, path)).select("doc_id", "n_tokens")
