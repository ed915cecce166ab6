"""Near-duplicate embeddings by sorted projection passes.

Equal vectors of a label collapse to their smallest id first. A sample of each label tells how many passes
bring a pair at the threshold together with probability RECALL among the densest tenth of its vectors. In a
pass the vectors of a label are ordered lexicographically by BITS concatenated signs of random projections,
and each is compared with its WINDOW neighbours in that order, across the edges of partitions as well;
verified pairs of all passes are united into components. A label of no more vectors than a window needs one
pass, which then sees all its pairs. A stream gives a spanning forest of its links, never all of them, so a dense
group of n vectors makes fewer than n rows a pass. Links are then counted exactly inside each component, tile
by tile of bounded size, so the window caps nobody's partners; a link can be missed only when no pass brought
its ends together directly or through others. On request (``exact``, ``pairs``) labels are compared whole instead,
tile by tile: those of up to so many vectors, or those whose passes would cost more than that.

Row rules: vectors that are null, empty, zero, hold a null or a non-finite number, or have no label link
with nothing. Vectors of different lengths never link. Repeated rows count once; rows that share an id
with other vectors pool their links. A null id has no links, a null component and is not kept. A component has
the smallest id of its vectors, so there are no ties. An empty table gives an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import connected_components, free_shuffles, materialize, small_batches
from .words import tidy

COSINE = 0.93
PASSES = 8
BITS = 48
WINDOW = 64
TILE = 512
RECALL = 0.99
BLOCK, BLOCK_ROWS = 16, 4_000_000
CELL = 8192
SAMPLE = 2048
SEED = 20_240_501


def projections(dim: int, which: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, which, dim]).normal(size=(dim, bits))


def clean(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, dim, c1, c2, e) of the vectors that can link; c1 and c2 hash the vector."""
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).cast("string").alias("label"),
        # floats stay floats, half as long, until they are compared
        F.col(embedding).cast("array<float>" if vectors.schema[embedding].dataType == ArrayType(FloatType()) else "array<double>").alias("e"),
    ).where("vec_id is not null and label is not null and e is not null and size(e) > 0")
    broken = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~broken & F.exists("e", lambda x: x != 0))
    return rows.select(
        "vec_id",
        "label",
        F.size("e").alias("dim"),
        F.xxhash64("e").alias("c1"),
        F.xxhash64(F.lit(11), "e").alias("c2"),
        "e",
    )


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def needed_passes(x: np.ndarray, n: int, bits: int, window: int, cosine: float, recall: float) -> int:
    """Passes that a label of n vectors, x a sample of them, needs to bring a pair at the threshold together.

    A pair that shares the first k signs lies somewhere in the two halves of the run that shares them; the
    sample tells how long the runs around each vector are.
    """
    x = unit(x)
    same = 1 - np.arccos(np.clip(x @ x.T, -1, 1)) / np.pi
    np.fill_diagonal(same, 0)
    own = 1 - np.arccos(cosine) / np.pi
    hit, power = np.zeros(len(x)), np.ones_like(same)
    for k in range(bits):
        run = 2 + (n - 2) * power.sum(1) / max(1, len(x) - 1) if k else np.full(len(x), float(n))
        t = np.minimum(2, 2 * window / run)
        hit += own**k * (1 - own) * np.where(t < 1, t * t / 2, 1 - (2 - t) ** 2 / 2)
        power *= same
    t = np.minimum(1, window / (2 + (n - 2) * power.sum(1) / max(1, len(x) - 1)))
    hit += own**bits * (1 - (1 - t) ** 2)
    dense = np.sort(hit)[: max(1, len(hit) // 10)]
    lo, hi = 0, 1
    while np.mean((1 - dense) ** hi) > 1 - recall and hi < n:
        lo, hi = hi, 2 * hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if np.mean((1 - dense) ** mid) > 1 - recall else (lo, mid)
    return hi


def plan(reps: DataFrame, passes: int, bits: int, window: int, cosine: float, exact: int, pairs: int, recall: float) -> DataFrame:
    """(label, dim, passes) of each label; 0 passes where it is compared whole."""
    sizes = materialize(reps.groupBy("label", "dim").agg(F.count("*").alias("n")), "emb-sizes")
    # whatever the order, one window holds all of them
    sure = F.when(F.col("n") <= exact, 0).when(F.col("n") <= window + 1, 1)
    large = sizes.where((F.col("n") > window + 1) & (F.col("n") > exact))
    few = F.pmod(F.xxhash64(F.lit(SEED), "rep"), F.col("n")) < SAMPLE

    def run(pdf):
        n = int(pdf["n"].iloc[0])
        k = max(passes, needed_passes(np.stack(pdf["e"].to_list()).astype(np.float64), n, bits, window, cosine, recall))
        return pdf[["label", "dim"]].head(1).assign(needed=0 if n <= pairs * k else k)

    rows = reps.join(large, ["label", "dim"]).where(few).select("label", "dim", "n", "e")
    needed = rows.groupBy("label", "dim").applyInPandas(run, "label string, dim int, needed int")
    return sizes.join(needed, ["label", "dim"], "left").select("label", "dim", F.coalesce(sure, "needed", F.lit(passes)).cast("int").alias("passes"))


def whole_links(rows: DataFrame, cosine: float, cell: int) -> DataFrame:
    """(a, b): a spanning forest of the links in each pair of cells of a label; rows are (label, dim, rep, e)."""
    sizes = rows.groupBy("label", "dim").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts"))
    rows = rows.join(sizes, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "label",
        "dim",
        F.least("part", "other").alias("pi"),
        F.greatest("part", "other").alias("pj"),
        (F.col("part") > F.col("other")).cast("int").alias("side"),
        "rep",
        "e",
    )
    rows = rows.repartition("label", "dim", "pi", "pj").sortWithinPartitions("label", "dim", "pi", "pj")

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = unit(matrix(t.column("e").chunk(0), t.column("dim")[0].as_py()))
            rep, side = t.column("rep").to_numpy(), t.column("side").to_numpy()
            same = t.column("pi")[0] == t.column("pj")[0]
            left, right = (np.arange(len(rep)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            y, short = x[right], x[right].astype(np.float32)
            comp, a, b = np.arange(len(rep)), [], []
            for lo in range(0, len(left), 512):
                own = left[lo : lo + 512]
                # single precision rules out, double precision decides
                maybe = x[own].astype(np.float32) @ short.T >= cosine - 1e-4
                if same:
                    maybe[np.arange(len(own)), own] = False
                for r in np.flatnonzero(maybe.any(1)):
                    at = np.flatnonzero(maybe[r])
                    to = right[at][y[at] @ x[own[r]] >= cosine]
                    to = to[comp[to] != comp[own[r]]]
                    if len(to):
                        roots, first = np.unique(comp[to], return_index=True)
                        a += [rep[own[r]]] * len(first)
                        b += rep[to[first]].tolist()
                        comp[np.isin(comp, roots)] = comp[own[r]]
            a_, b_ = np.array(a, np.int64), np.array(b, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a_, b_)), pa.array(np.maximum(a_, b_))], names=["a", "b"])

        last = None
        for b in batches:
            where = list(zip(*(b.column(k).to_pylist() for k in range(4))))
            cut = [i for i in range(len(where)) if not i or where[i] != where[i - 1]] + [len(where)]
            for s, e in zip(cut, cut[1:]):
                if held and where[s] != last:
                    yield done()
                    held = []
                last = where[s]
                held.append(b.slice(s, e - s))
        if held:
            yield done()

    return rows.mapInArrow(run, "a long, b long")


KEYED = "pass int, label string, dim int, key long, rep long, e array<double>"


def keyed_type(rows: DataFrame) -> str:
    """KEYED with the vectors of rows."""
    return KEYED.replace("array<double>", rows.schema["e"].dataType.simpleString())


def keyed(reps: DataFrame, bits: int, first: int = 0, last: int | None = None) -> DataFrame:
    """(pass, label, dim, key, rep, e): each vector once per pass of its label, of those from first to before last, with its sort key."""

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, passes = b.column(1).to_numpy(), b.column(4).to_numpy()
            for d, most in sorted({*zip(dims.tolist(), passes.tolist())}):
                part = b.filter(pa.array((dims == d) & (passes == most)))
                x = matrix(part.column(3), d)
                for p in range(first, most if last is None else min(most, last)):
                    sign = x @ projections(int(d), p, bits) > 0
                    key = sign @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), p, np.int32)), part.column(0), part.column(1), pa.array(key), part.column(2), part.column(3)],
                        names=["pass", "label", "dim", "key", "rep", "e"],
                    )

    return reps.select("label", "dim", "rep", "e", "passes").mapInArrow(run, keyed_type(reps))


class Forest:
    """Union-find over the rows of a stream, pruned to the rows still in the window."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def window_links(sorted_rows: DataFrame, window: int, cosine: float) -> DataFrame:
    """(a, b, and KEYED): a spanning forest of the links that each partition's windows verify, with null
    columns of KEYED; and each partition's first and last rows, up to window, with null a and b."""
    schema = f"a long, b long, {keyed_type(sorted_rows)}"
    number = pa.float32() if "float" in sorted_rows.schema["e"].dataType.simpleString() else pa.float64()
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(number)]
    names_ = ["a", "b", *(c.split()[0] for c in KEYED.split(", "))]

    def edge(b: pa.RecordBatch) -> pa.RecordBatch:
        columns = [pa.nulls(len(b), t) for t in types[:2]] + [c.cast(t) for c, t in zip(b.columns, types[2:])]
        return pa.RecordBatch.from_arrays(columns, names=names_)

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tail, ids, forest = None, None, None, Forest()
        total, late = 0, []
        for b in batches:
            if total < window and len(b):
                yield edge(b.slice(0, window - total))
            rest = b.slice(max(0, window - total))
            total += len(b)
            if len(rest):
                late.append(rest)
            while len(late) > 1 and sum(map(len, late[1:])) >= window:
                late.pop(0)
            where = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            cut = [i for i in range(len(where)) if not i or where[i] != where[i - 1]] + [len(where)]
            a_out: list[int] = []
            b_out: list[int] = []
            for s, e in zip(cut, cut[1:]):
                if where[s] != group:
                    group, tail, ids, forest = where[s], None, None, Forest()
                for lo in range(s, e, 4 * window):
                    part = b.slice(lo, min(4 * window, e - lo))
                    x, own = unit(matrix(part.column(5), where[s][2])), part.column(4).to_numpy()
                    full = x if tail is None else np.concatenate((tail, x))
                    names = own if ids is None else np.concatenate((ids, own))
                    before = len(full) - len(x)
                    i, j = np.nonzero(full @ x.T >= cosine)
                    gap = (j + before) - i
                    near = (gap > 0) & (gap <= window)
                    for m, n in zip(names[i[near]].tolist(), own[j[near]].tolist()):
                        if forest.join(m, n):
                            a_out.append(min(m, n))
                            b_out.append(max(m, n))
                    tail, ids = full[-window:], names[-window:]
                    if len(forest.up) > 100_000:
                        forest = Forest()
            ends = [pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())]
            yield pa.RecordBatch.from_arrays(ends + [pa.nulls(len(a_out), t) for t in types[2:]], names=names_)
        extra = sum(map(len, late)) - window
        for b in late:
            if len(b) > extra:
                yield edge(b.slice(max(0, extra)))
            extra -= len(b)

    return sorted_rows.mapInArrow(run, schema)


def all_window_links(ordered: DataFrame, window: int, cosine: float) -> DataFrame:
    """(a, b): the links of the partitions' windows, and of those that reach over edges of partitions.

    The ends of partitions in order hold all rows that are within a window of an edge, at the same distances.
    """
    inside = materialize(window_links(ordered, window, cosine), "emb-windows")
    ends = inside.where("rep is not null").drop("a", "b").repartition("pass", "label", "dim")
    over = window_links(ends.sortWithinPartitions("pass", "label", "dim", "key", "rep"), window, cosine)
    return inside.where("a is not null").select("a", "b").union(over.where("a is not null").select("a", "b"))


def count_links(members: DataFrame, cosine: float, tile: int) -> DataFrame:
    """(rep, linked): vectors in other classes of the component that link with the class rep stands for."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("m"))
    # smaller tiles for smaller components, which then spread over tasks; large ones would repeat too many vectors
    side = F.greatest(F.lit(tile // 4), F.least(F.lit(tile), F.col("m") / 64))
    rows = members.join(sizes, "comp").withColumn("parts", F.ceil(F.col("m") / side).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "comp",
        F.least("part", "other").alias("pi"),
        F.greatest("part", "other").alias("pj"),
        (F.col("part") > F.col("other")).cast("int").alias("side"),
        "rep",
        "copies",
        "dim",
        "e",
    )
    rows = rows.repartition("comp", "pi", "pj").sortWithinPartitions("comp", "pi", "pj")

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            dim = t.column("dim")[0].as_py()
            x = unit(matrix(t.column("e").chunk(0), dim))
            rep, copies, side = (t.column(c).to_numpy() for c in ("rep", "copies", "side"))
            if t.column("pi")[0] == t.column("pj")[0]:
                hit = x @ x.T >= cosine
                np.fill_diagonal(hit, False)
                n = hit @ copies
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                hit = x[left] @ x[right].T >= cosine
                n = np.zeros(len(rep), np.int64)
                n[left], n[right] = hit @ copies[right], copies[left] @ hit
            return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n.astype(np.int64))], names=["rep", "linked"])

        last = None
        for b in batches:
            where = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            cut = [i for i in range(len(where)) if not i or where[i] != where[i - 1]] + [len(where)]
            for s, e in zip(cut, cut[1:]):
                if held and where[s] != last:
                    yield done()
                    held = []
                last = where[s]
                held.append(b.slice(s, e - s))
        if held:
            yield done()

    return rows.mapInArrow(run, "rep long, linked long").groupBy("rep").agg(F.sum("linked").alias("linked"))


def near_duplicates(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
    passes: int = PASSES,
    bits: int = BITS,
    window: int = WINDOW,
    tile: int = TILE,
    exact: int = 0,
    pairs: int = 0,
    recall: float = RECALL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of vectors.

    passes is the least number of them in labels that need several. exact and pairs ask for whole comparison, of labels
    of up to exact vectors and of those where it costs less than passes of ``pairs`` vectors each.
    """
    small_batches(vectors.sparkSession)
    good = materialize(clean(vectors, vec_id, embedding, label), "emb-clean")
    key = ["label", "dim", "c1", "c2"]
    reps = (
        good.groupBy(*key, "vec_id").agg(F.first("e").alias("e"))
        .groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("e").alias("e"))
    )
    reps = materialize(reps, "emb-reps")
    planned = materialize(plan(reps, passes, bits, window, cosine, exact, pairs, recall), "emb-plan")
    rows = materialize(reps.join(planned, ["label", "dim"]).select("label", "dim", "rep", "e", "passes"), "emb-planned")
    order = ["pass", "label", "dim", "key", "rep"]
    # passes go block by block, so that what lies on disks at once follows the vectors and not their passes
    block, most, links = max(BLOCK, BLOCK_ROWS // max(1, reps.count())), planned.agg(F.max("passes")).first()[0] or 0, None
    for lo in range(0, max(1, most), block):
        some = rows.where(F.col("passes") > lo)
        ordered = keyed(some, bits, lo, lo + block).repartitionByRange(*order).sortWithinPartitions(*order)
        found = materialize(all_window_links(ordered, window, cosine).distinct(), "emb-block")
        links = found if links is None else links.union(found)
        del ordered
        free_shuffles(rows.sparkSession)
    if exact or pairs:
        links = links.union(whole_links(rows.where("passes = 0").drop("passes"), cosine, CELL))
    links = materialize(links.distinct(), "emb-links")
    labels = connected_components(None, links)

    members = reps.join(labels, reps.rep == labels.id).select(
        F.col("component").alias("comp"), "rep", "copies", "dim", "e"
    )
    counts = count_links(members, cosine, tile)
    classes = reps.select(*key, "rep", "copies").join(
        labels.join(counts, labels.id == counts.rep, "left").select("id", "component", "linked"),
        F.col("rep") == F.col("id"),
        "left",
    )
    found = (
        good.select(*key, "vec_id")
        .distinct()
        .join(classes.select(*key, "rep", "copies", "component", "linked"), key)
        .groupBy("vec_id")
        .agg(
            F.sum(F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.min(F.coalesce("component", "rep")).alias("component_id"),
        )
    )
    ids = vectors.select(F.col(vec_id).cast("long").alias("vec_id"))
    out = ids.join(found, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
    ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
