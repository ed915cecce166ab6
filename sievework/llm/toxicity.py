"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, their stems, word pairs and pairs with one word
between.
Per-coordinate learning rates suit rare features, and the L1 term leaves most weights at exactly zero, so
the model is a short list of (hash, weight) that is broadcast; its size is bounded by 2**bits.

Learning takes a bounded sample of labelled rows, the documented limit of this classifier: the ids with the
smallest hashes, of each one row, ``max_rows`` of them or as many as have MAX_BYTES of features together. Features are hashed where the texts are, one task learns from them, and the driver receives
the weights. A feature of fewer than MIN_DOCUMENTS sampled documents takes no part. Scoring takes whole texts
and all their features.

Row rules: null or empty text has no feature and scores as the bias says. Texts may have any length. Labels
that are null count as unlabelled; of several labels of one id the largest is taken, and of several rows of one
id the one with the smallest features. Ids of equal hash are taken by id. Without two classes to learn from,
every score is the share of positive labels, 0 without labels. Repeated rows are scored one by one; empty
tables give empty results. Extra columns pass through; one that has the name of the output is replaced, as
by withColumn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialize, others, small_batches
from .words import slices, tidy, words

BITS = 20
MAX_ROWS = 12_000
#: Bytes of features (four each) that the learning task holds at most; a document's features are never cut.
MAX_BYTES = 256 << 20
MIN_DOCUMENTS = 3
EPOCHS = 4
THRESHOLD = 0.7
CACHED_WORDS = 100_000
#: Stems are a word's first so many bytes; they carry word families of which each form is rare.
STEMS = (4, 5, 6, 7)
_ODD = np.uint64(0x9E3779B97F4A7C15)

_INDEX: dict[bytes, int] = {}
_HASHES = [np.zeros((1 << 12, 1 + len(STEMS)), np.uint64)]


def forget() -> None:
    _INDEX.clear()
    _HASHES[0] = np.zeros((1 << 12, 1 + len(STEMS)), np.uint64)


def word_hashes(w: list[bytes]) -> np.ndarray:
    """uint64 hashes of each word and of its stems (0 where it is no longer than a stem), by a bounded cache."""
    if len(_INDEX) > CACHED_WORDS:
        _INDEX.clear()
    new = list(set(w).difference(_INDEX))
    if new:
        while len(_INDEX) + len(new) > len(_HASHES[0]):
            _HASHES[0] = np.concatenate((_HASHES[0], np.zeros_like(_HASHES[0])))
        digest = xxhash.xxh3_64_intdigest
        for k, x in enumerate(new, len(_INDEX)):
            _HASHES[0][k] = [digest(x), *(digest(x[:n], n) if len(x) > n else 0 for n in STEMS)]
            _INDEX[x] = k
    return _HASHES[0][np.fromiter(map(_INDEX.__getitem__, w), np.int64, len(w))]


def feature_hashes(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashes of words, stems, pairs and skip pairs, repeated as they come; 0 is no feature."""
    own = word_hashes(words(text))
    h = own[:, 0]
    parts = [own.ravel()]
    if len(h) > 1:
        parts.append((h[:-1] * _ODD) ^ (h[1:] + _ODD))
    if len(h) > 2:
        parts.append((h[:-2] * _ODD * _ODD) ^ (h[2:] * _ODD))
    return (np.concatenate(parts) * _ODD >> np.uint64(64 - bits)).astype(np.uint32)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct feature hashes of a text, sorted."""
    x = np.unique(feature_hashes(text, bits))
    return x[x > 0]


def train(
    rows: list[tuple[np.ndarray, int]],
    bits: int = BITS,
    epochs: int = EPOCHS,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 3.0,
    l2: float = 0.1,
    min_documents: int = MIN_DOCUMENTS,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes, weights, bias) of the non-zero weights, from (distinct hashes, label) rows.

    Features that too few documents have are taken out of ``rows`` itself.
    """
    none = np.zeros(0, np.uint32), np.zeros(0)
    labels = np.array([y for _, y in rows], float)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return *none, float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    seen = np.zeros(1 << bits, np.int32)
    for x, _ in rows:
        seen[x] += 1
    # a feature takes part once it has been seen in enough documents
    for k, (x, y) in enumerate(rows):
        rows[k] = x[seen[x] >= min_documents], y
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits
    strength = np.full((1 << bits) + 1, l1)
    strength[bias] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = (np.sign(zi) * strength[i] - zi) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= strength[i], 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            i = np.append(x, bias).astype(np.int64)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    every = weights(np.arange((1 << bits) + 1))
    kept = np.flatnonzero(every[:-1])
    return kept.astype(np.uint32), every[kept], float(every[bias])


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, bits: int, max_rows: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, y, x): labels and feature hashes of the max_rows labelled documents with the smallest id hashes, or as many of them as max_bytes hold."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("__sw_id"))
        .agg(F.max(F.col(label).cast("int")).alias("__sw_y"))
        .orderBy(F.xxhash64("__sw_id"), "__sw_id")
        .limit(max_rows)
    )
    df = docs.select(F.col(doc_id).alias("__sw_id"), F.col(text).alias("__sw_text")).join(F.broadcast(known), "__sw_id")

    @tidy(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            x = [features(t, bits).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], names=["id", "y", "x"])

    kind = known.schema["__sw_id"].dataType.simpleString()
    rows = df.select("__sw_id", "__sw_text", "__sw_y").mapInArrow(run, f"id {kind}, y int, x binary")
    rows = rows.groupBy("id").agg(F.min(F.struct("x", "y")).alias("one")).select("id", "one.y", "one.x")
    rows = materialize(rows, "toxicity-rows")
    # one row a document of a bounded number, without its features
    upto = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.select("id", F.octet_length("x").cast("long").alias("size")).withColumn("held", F.sum("size").over(upto))
    return rows.join(F.broadcast(held.where(F.col("held") <= max_bytes).select("id")), "id", "left_semi")


def train_rows(rows: DataFrame, bits: int, options: dict) -> tuple[np.ndarray, np.ndarray, float]:
    """train() in one task over rows of bounded number, in order of id."""

    @tidy(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(str(i), y, np.frombuffer(x, np.uint32)) for b in batches for i, y, x in zip(*(c.to_pylist() for c in b.columns))]
        got.sort(key=lambda r: (r[0], r[2].tobytes()))
        rows = [(x, y) for _, y, x in got]
        del got
        hashes, weights, bias = train(rows, bits, **options)
        yield pa.RecordBatch.from_pydict({"h": [hashes.tobytes()], "w": [weights.tobytes()], "b": [bias]})

    (row,) = rows.repartition(1).mapInArrow(run, "h binary, w binary, b double").collect() or [None]
    if row is None:  # no rows, and so no task
        return train([], bits, **options)
    return np.frombuffer(row.h, np.uint32), np.frombuffer(row.w), row.b


def score(
    docs: DataFrame,
    model: tuple[np.ndarray, np.ndarray, float],
    text: str = "text",
    out: str = "score",
    keep: list[str] | None = None,
    bits: int = BITS,
) -> DataFrame:
    """docs (or its columns ``keep``) plus ``out``, the probability of the positive label."""
    small_batches(docs.sparkSession)
    keep = others(docs.columns if keep is None else keep, out)
    own = free_name(docs, "__sw_text")
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias(own))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema.fields[:-1], T.StructField(out, T.DoubleType())])

    @tidy(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, values, bias = shared.value
        weight = np.zeros(1 << bits, np.float64)
        weight[hashes] = values
        used = weight != 0
        for part in slices(batches, len(keep)):
            sums = [weigh(t, weight, used, bits) + bias for t in part.column(len(keep)).to_pylist()]
            p = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p, pa.float64())], names=[*keep, out])

    return df.mapInArrow(run, schema)


def weigh(text: str | None, weight: np.ndarray, used: np.ndarray, bits: int) -> float:
    """Sum of the weights of the distinct features; only those with a weight are sorted."""
    x = feature_hashes(text, bits)
    return float(weight[np.unique(x[used[x]])].sum())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    bits: int = BITS,
    max_rows: int = MAX_ROWS,
    **options,
) -> tuple[np.ndarray, np.ndarray, float]:
    small_batches(docs.sparkSession)
    return train_rows(training_rows(docs, labels, doc_id, text, label, bits, max_rows), bits, options)


def fold(c: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(c).cast("string").cast("binary")) % n


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract rows: doc_id, held_out, score, predicted; rows of fold 1 of 3 are never learned from."""
    model = fit(docs, labels.where(fold("doc_id", 3) != 1))
    scored = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
