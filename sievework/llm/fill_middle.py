r"""Fill-in-the-middle transformation: a text is cut into prefix, middle and suffix at two unit borders and reordered.

Units are found by overlapping chunks: a predicate on two neighbouring bytes says whether a unit begins at the
second, a chunk of a text overlaps the next by one byte so that each pair belongs to one chunk, and the borders of all
chunks of a batch are counted side by side. Prefix sums of these counts give a text's number of units and route both
cut ranks to the chunks that own them; only those chunks are scanned again, for the exact byte. UTF-8 needs no
decoding, as the bytes of the predicates are ASCII. Texts go through Arrow in batches cut to about 1 MB (a longer
text alone), are counted slab by slab and not shuffled.

Where to cut and in which form to write follow from a digest of the seed and doc_id, so a run can be repeated.

Forms: ``plain`` is the text itself, ``psm`` ``<P>``prefix``<S>``suffix``<M>``middle, ``spm``
``<S>``suffix``<P>``prefix``<M>``middle. A text that holds a mark stays plain, so ``restored`` can split
an output at its marks: they cannot overlap with a part's end, as ``<`` and ``>`` differ.

Row rules: null and empty texts are plain with 0 units. A null doc_id is digested as no digits. Rows that repeat are
cut alike. Texts may have any length. Empty tables give empty results. Extra columns pass through; the output columns
take the place of columns of their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, others, small_batches
from .words import slices, tidy

SEED, RATE, SPM_RATE = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
CHUNK, SLAB = 4096, 1 << 20
OUTS = ["n_units", "form", "prefix_chars", "middle_chars", "fim_text"]

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: By unit: does a unit begin at the second of two neighbouring bytes?
BEGINS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "line": lambda a, b: a == 0x0A,
    "word": lambda a, b: _SPACES[a] & ~_SPACES[b],
    "char": lambda a, b: (b & 0xC0) != 0x80,
}


def chunk_counts(data: np.ndarray, ends: np.ndarray, begins: Callable, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(first chunk of each text, borders of each chunk) of the texts data[ends[i]:ends[i + 1]].

    Chunk c of a text owns the pairs whose first byte lies in its bytes c*chunk to (c+1)*chunk; the pair of a
    text's last byte with the next text's first is nobody's.
    """
    per = -(-np.diff(ends) // chunk)
    first = np.concatenate([[0], np.cumsum(per)])
    text = np.repeat(np.arange(len(per)), per)
    starts = ends[text] + (np.arange(first[-1]) - first[text]) * chunk
    counts = np.zeros(first[-1], np.int64)
    if not len(starts):
        return first, counts
    last = np.zeros(ends[-1] - ends[0] + 1, bool)
    last[ends[1:] - 1 - ends[0]] = True
    stops = np.append(starts[1:], ends[-1])
    at = 0
    while at < len(starts):  # whole chunks, a slab at a time
        upto = max(at + 1, int(np.searchsorted(stops, starts[at] + SLAB, "right")))
        lo, hi = starts[at], stops[upto - 1]
        after = min(hi + 1, ends[-1])
        a, b = data[lo : after - 1], data[lo + 1 : after]
        hit = np.zeros(hi - lo, bool)
        hit[: len(a)] = begins(a, b)
        hit &= ~last[lo - ends[0] : hi - ends[0]]
        counts[at:upto] = np.add.reduceat(hit, starts[at:upto] - lo, dtype=np.int64)
        at = upto
    return first, counts


def cut_at(data: np.ndarray, begin: int, end: int, counts: np.ndarray, rank: int, begins: Callable, chunk: int = CHUNK) -> int:
    """Byte of the text data[begin:end] before which ``rank`` of its units end; counts are those of its chunks."""
    if rank == 0:
        return begin
    sums = np.cumsum(counts)
    if rank > sums[-1]:
        return end
    owner = int(np.searchsorted(sums, rank))
    lo, hi = begin + owner * chunk, min(begin + (owner + 1) * chunk + 1, end)
    hits = np.flatnonzero(begins(data[lo : hi - 1], data[lo + 1 : hi]))
    return lo + 1 + int(hits[rank - (int(sums[owner - 1]) if owner else 0) - 1])


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, chunk: int = CHUNK) -> DataFrame:
    """docs with n_units, form, prefix_chars, middle_chars (null if plain) and fim_text.

    ``rate`` percent of the texts are cut, ``spm_rate`` percent of those with the suffix first.
    """
    small_batches(docs.sparkSession)
    text, drawn = free_name(docs, "__sw_text"), free_name(docs, "__sw_draws")
    keep = others(docs.columns, *OUTS)
    rows = docs.withColumns({text: F.coalesce(F.col("text"), F.lit("")), drawn: F.array(*draws(seed, F.col("doc_id")))})
    rows = rows.select(text, drawn, *[f"`{c}`" for c in keep])
    schema = rows.drop(text, drawn).schema
    for name, kind in zip(OUTS, ("long", "string", "long", "long", "string")):
        schema = schema.add(name, kind)
    begins = BEGINS[unit]

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            texts = batch.column(0).cast(pa.large_binary())
            _, offsets, values = texts.buffers()
            ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
            first, counts = chunk_counts(data, ends, begins, chunk)
            h = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            out: list[list] = [[] for _ in OUTS]
            for k in range(len(texts)):
                begin, end = int(ends[k]), int(ends[k + 1])
                own = counts[first[k] : first[k + 1]]
                whole = data[begin:end].tobytes()
                n = int(own.sum()) + 1 if whole else 0
                if not whole or any(m in whole for m in MARKS) or h[k, 2] % 100 >= rate:
                    row = (n, "plain", None, None, whole)
                else:
                    ranks = sorted((int(h[k, 0]) % (n + 1), int(h[k, 1]) % (n + 1)))
                    lo, hi = (cut_at(data, begin, end, own, r, begins, chunk) for r in ranks)
                    spm = h[k, 3] % 100 < spm_rate
                    prefix, middle, suffix = whole[: lo - begin], whole[lo - begin : hi - begin], whole[hi - begin :]
                    head = [SUFFIX, suffix, PREFIX, prefix] if spm else [PREFIX, prefix, SUFFIX, suffix]
                    row = (n, "spm" if spm else "psm", code_points(data[begin:lo]), code_points(data[lo:hi]), b"".join([*head, MIDDLE, middle]))
                for column, value in zip(out, row):
                    column.append(value)
            made = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names=[*keep, *OUTS])

    return rows.mapInArrow(run, schema)


def restored(form: str = "form", out: str = "fim_text") -> Column:
    """The exact text that an output was made of."""
    parts = F.split(F.col(out), "|".join(m.decode() for m in MARKS), -1)
    order = lambda *at: F.concat(*[F.get(parts, F.lit(k)) for k in at])
    return F.when(F.col(form) == "psm", order(1, 3, 2)).when(F.col(form) == "spm", order(2, 3, 1)).otherwise(F.col(out))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of documents."""
    done = transform(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c, 256)
    return done.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", sha(F.col("fim_text")).alias("output_sha256"), sha(restored()).alias("restored_sha256")
    )


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('7:', doc_id)) AS h FROM documents),
  u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
    CAST(concat('0x', h[1:8]) AS BIGINT) AS h1, CAST(concat('0x', h[9:16]) AS BIGINT) AS h2, CAST(concat('0x', h[25:32]) AS BIGINT) AS h4 FROM t),
  c AS (SELECT *, len(lines) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS lo, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS hi FROM u),
  p AS (SELECT doc_id, text, n, form, array_to_string(lines[1:lo], '') AS pre, array_to_string(lines[lo + 1:hi], '') AS mid, array_to_string(lines[hi + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
