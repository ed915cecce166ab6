"""Exact Jaccard self-join of documents on word shingles, by partitions of the shingle universe.

Sizes fall into bands such that two sets that can link lie in one band or in neighbouring ones. For the
pairs whose smaller set lies in band b, at most H tokens differ, so when the universe is hashed into
segments that are allowed to differ by v_i - 1 tokens each, and the v_i add up to H + 1 or more, some
segment is hit. Segments with v = 1 are indexed by the hash of the set's subset in them, segments with
v = 2 by that and by the hashes of all its one-deletion neighbours. ``allocate`` chooses how many of
each by cost: keys written plus collisions expected. Slack of k hits lets a set leave out the keys of up
to k empty segments; a set with more writes them all, so nothing is lost.

Each key's group compares its members with its smallest document first, and links are contracted to
components. Groups that still span several components compare all pairs across components, in blocks of
bounded size, by their segment vectors (more than H differing segments cannot link), and only what
passes is verified exactly, on the sets of shingle hashes: each document's set is made once, and a
representative's set is sent once to a group of its candidates, never once a pair. Keys that a bounded sample
shows to be frequent are salted by set, and representatives of many candidates by candidate, so that no group
gathers in one task.

Row rules: null or empty text has no shingle, and links with nothing. Texts may have any length and are taken
whole. Rows that share doc_id are one document: its links are those of all its texts, and each of its rows
is returned. Rows with a null id are returned too; they link with nothing and have a null component. Of
documents that link, the smallest id names the component, so there are no ties. An empty table gives an
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, discard, hot_keys, keyed_join, materialize, small_batches
from .words import slices, tidy

SHINGLE = 4
PERCENT = 85
BLOCK = 1024
#: Groups that a frequent key is spread over at least; more where the session shuffles into more partitions.
SALTS = 32
#: Rows sampled to find frequent keys, and the count in the sample from which a key is salted.
SAMPLE_ROWS = 40_000
SAMPLE_HITS = 40
BITMAP_BITS = 1 << 24
CACHED_WORDS = 100_000
#: Chance that a random set shares a given shingle, and sets to collide with: the cost model's constants.
SHARED, OTHERS = 0.02, 10_000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_S = np.uint64(32)
_WORDS: dict[bytes, int] = {}


def forget() -> None:
    _WORDS.clear()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M3
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> _S)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > CACHED_WORDS:
        _WORDS.clear()
    for x in set(w).difference(_WORDS):
        _WORDS[x] = xxhash.xxh3_64_intdigest(x)
    h = np.fromiter(map(_WORDS.__getitem__, w), np.uint64, len(w))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * _M2 + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def band_starts(percent: int, upto: int) -> list[int]:
    """First sizes of the bands; a set and any larger partner lie in one band or in neighbouring ones."""
    out = [1]
    while out[-1] <= upto:
        out.append(out[-1] * 100 // percent + 1)
    return out


def most_different(a, b, percent: int):
    """Tokens in one of two linked sets of sizes a and b only, at most."""
    return (100 - percent) * (a + b) // (100 + percent)


@functools.cache
def _starts(percent: int) -> np.ndarray:
    return np.array(band_starts(percent, 1 << 40), np.int64)


def band_of(n: int, percent: int) -> int:
    return int(np.searchsorted(_starts(percent), n, "right")) - 1


@functools.cache
def allocate(band: int, percent: int) -> tuple[int, int, int, int]:
    """(H, segments with v=2, segments with v=1, slack k) for pairs whose smaller set is in the band."""
    lo, hi = int(_starts(percent)[band]), int(_starts(percent)[band + 1]) - 1
    h = most_different(hi, hi * 100 // percent, percent)
    best = None
    for twos in sorted({*range(min(h + 1, 8) // 2 + 1), (h + 1) // 2, (h + 2) // 2}):
        k = 0
        for _ in range(20):  # the slack that lets most sets leave out their empty segments
            ones = max(0, h + 1 + k - 2 * twos)
            empty = ones * math.exp(-lo / max(1, ones + twos))
            need = math.ceil(empty + 3 * math.sqrt(empty)) if empty > 1e-3 else 0
            if need <= k:
                break
            k = need
        ones = max(0, h + 1 + k - 2 * twos)
        each = lo / max(1, ones + twos)
        cost = ones + twos * (1 + each)
        cost += OTHERS * (ones * SHARED**each + twos * SHARED ** max(0.0, each - 1))
        if best is None or cost < best[0]:
            best = (cost, twos, ones, k)
    return h, *best[1:]


def segments(tokens: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sums, sizes) of the set's subset in each segment, and the (segment, value) of each token."""
    _, twos, ones, _ = allocate(band, percent)
    m = twos + ones
    value = mix(tokens + _M2)
    seg = ((value >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    seg, value = seg[order], value[order]
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    edge = np.searchsorted(seg, np.arange(m + 1))
    return upto[edge[1:]] - upto[edge[:-1]], np.diff(edge), seg, value


def _key(sums: np.ndarray, seg: np.ndarray, band: int) -> np.ndarray:
    # the lowest bit is kept for salted keys
    place = (seg.astype(np.uint64) + np.uint64(1)) * _M2 ^ np.uint64(band * 0x9E3779B97F4A7C15 % 2**64)
    return mix(sums ^ mix(place)) & ~np.uint64(1)


def schemes(n: int, percent: int) -> list[int]:
    """Bands whose pairs a set of n tokens can be in, where anything but equal sets can link."""
    b = band_of(n, percent)
    return [x for x in (b, b - 1) if x >= 0 and allocate(x, percent)[0] > 0]


def index_keys(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All index keys of a set."""
    out = []
    for band in schemes(len(tokens), percent) if len(tokens) else []:
        _, twos, _, slack = allocate(band, percent)
        sums, sizes, seg, value = segments(tokens, band, percent)
        at = np.arange(len(sums))
        empty = (sizes == 0) & (at >= twos)
        use = ~empty if empty.sum() <= slack else np.ones(len(sums), bool)
        out.append(_key(sums[use], at[use], band))
        if twos:  # one-deletion neighbours of the first segments
            near = seg < twos
            out.append(_key(sums[seg[near]] - value[near], seg[near], band))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def vectors(tokens: np.ndarray, percent: int = PERCENT) -> list[bytes]:
    """Segment vectors for the set's own band and for the one below.

    A vector holds a 32-bit fingerprint of the index key of each segment, then each segment's size (255 at most).
    """
    b = band_of(len(tokens), percent)
    out = []
    for band in (b, b - 1):
        if band < 0 or not allocate(band, percent)[0]:
            out.append(b"")
        else:
            sums, sizes, _, _ = segments(tokens, band, percent)
            marks = (_key(sums, np.arange(len(sums)), band) >> _S).astype(np.uint32)
            out.append(marks.tobytes() + np.minimum(sizes, 255).astype(np.uint8).tobytes())
    return out


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, of sets of distinct tokens that are not empty."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


# -- stages ---------------------------------------------------------------------------------------


def keyed_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc, n, c1, c2, keys): size of the shingle set, its 128-bit hash and its index keys, for each row."""

    @tidy(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            n, c, out = [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, size)
                n.append(len(s))
                c.append(xxhash.xxh3_128_digest(s.tobytes()))
                out.append(index_keys(s, percent).view(np.int64))
            c = np.frombuffer(b"".join(c), np.int64).reshape(-1, 2)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in out])))
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(c[:, 0].copy()),
                    pa.array(c[:, 1].copy()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                names=["doc", "n", "c1", "c2", "keys"],
            )

    return docs.mapInArrow(run, "doc long, n long, c1 long, c2 long, keys array<long>")


def frequent_keys(sets: DataFrame) -> list[int]:
    """Keys that SAMPLE_HITS or more of about SAMPLE_ROWS sampled sets have; at most a bounded number."""
    rows = sets.count()
    if rows < SAMPLE_HITS * 100:
        return []
    share = min(1.0, SAMPLE_ROWS / rows)
    sample = sets.where(F.pmod(F.xxhash64("doc", F.lit(3)), F.lit(1_000_003)) < int(1_000_003 * share))
    got = sample.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") >= SAMPLE_HITS)
    return sorted(r.key for r in got.collect())


def spread(df: DataFrame) -> int:
    return max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def key_table(sets: DataFrame, hot: list[int]) -> DataFrame:
    """(key, doc, base): index keys; a frequent one is salted by its set and names what it was as base.

    Plain keys are even, and only salted ones are odd.
    """
    rows = sets.select(F.explode("keys").alias("key"), "doc", "c1")
    if not hot:
        return rows.select("key", "doc", F.lit(None).cast("long").alias("base"))
    names = sets.sparkSession.createDataFrame([(k,) for k in hot], "base long")
    salted = F.xxhash64("base", F.pmod("c1", F.lit(spread(sets)))).bitwiseOR(F.lit(1))
    return rows.join(F.broadcast(names), rows.key == names.base, "left").select(
        F.when(F.col("base").isNull(), F.col("key")).otherwise(salted).alias("key"), "doc", "base"
    )


def bitmap_of(ids: DataFrame) -> bytes:
    """Fixed-size bitmap over hashes of (doc): what is not in it is not among the ids."""
    bit = F.pmod(F.xxhash64("doc"), F.lit(BITMAP_BITS))
    rows = (
        ids.select(bit.alias("b"))
        .groupBy(F.expr("b div 32768").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(b % 32768)").alias("bits"))
        .collect()
    )
    out = np.zeros(BITMAP_BITS >> 3, np.uint8)
    for r in rows:
        out[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def over_texts(docs: DataFrame, ids: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """make() of the (doc, text) of the given (doc); a bitmap of fixed size keeps most other texts from being read."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids))

    @tidy(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint8)
        for b in batches:
            at = b.column(2).to_numpy()
            hit = (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            for part in slices([b.select([0, 1]).filter(pa.array(hit == 1))], 1):
                yield make(part)

    some = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)).alias("bit"))
    return some.mapInArrow(run, schema).join(ids, "doc", "left_semi")


def hash_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc, tokens) of each text of the given documents: sorted 64-bit shingle hashes."""

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [shingles(t, size).tobytes() for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.binary())], names=["doc", "tokens"])

    return materialize(over_texts(docs, ids, make, "doc long, tokens binary"), "join-hashes")


def verify(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) of pairs that link, as a table.

    The set of a is sent once to the group of its candidates (once a salt where these are many) and sorts
    before them.
    """
    pairs = materialize(pairs, "join-pairs")
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    ids = materialize(ids, "join-ids")
    sets = hash_sets(docs, ids, size)
    many = F.broadcast(hot_keys(pairs, "a").select(F.col("a").alias("many")))
    salt = F.when(F.col("many").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("b"), F.lit(8 * spread(pairs)))).cast("int")
    salted = pairs.join(many, pairs.a == F.col("many"), "left").select("a", salt.alias("salt"), "b")
    heads = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("doc")).select("a", "salt", F.lit(None).cast("long").alias("b"), "tokens")
    tails = salted.join(sets, F.col("b") == F.col("doc")).select("a", "salt", "b", "tokens")
    rows = heads.unionByName(tails).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for part in slices(batches, 3):
            keep = []
            for a, s, b, raw in zip(*(c.to_pylist() for c in part.columns)):
                if at != (a, s):
                    at, own = (a, s), []
                tokens = np.frombuffer(raw, np.uint64)
                if b is None:
                    own.append(tokens)
                keep.append(b is not None and any(links(x, tokens, percent) for x in own))
            yield part.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    found = materialize(rows.select("a", "salt", "b", "tokens").mapInArrow(run, "a long, b long").distinct(), "join-links")
    for done in (pairs, ids, sets):
        discard(done)
    return found


def cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) in different components of one block that their segment vectors do not rule out.

    rows: (key, pi, pj, doc, comp, n, own, below, side), partitioned and sorted by (key, pi, pj); side is
    0 in block pi, 1 in block pj, and blocks with pi = pj compare with themselves.
    """

    def pairs_of(g: dict) -> tuple[np.ndarray, np.ndarray]:
        doc, comp, n, side = g["doc"], g["comp"], g["n"], g["side"]
        here = np.uint32((g["key"] & (2**64 - 1)) >> 32)
        bands = np.array([band_of(int(x), percent) for x in n])
        a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for band in np.unique(bands):
            if not allocate(int(band), percent)[0]:
                continue
            # the scheme of this band holds its own sets and, as larger partners, those of the next
            rows = np.flatnonzero((bands == band) | (bands == band + 1))
            raw = b"".join(g["own"][x] if bands[x] == band else g["below"][x] for x in rows)
            raw = np.frombuffer(raw, np.uint8).reshape(len(rows), -1)
            m = raw.shape[1] // 5
            mark, size = np.ascontiguousarray(raw[:, : 4 * m]).view(np.uint32), raw[:, 4 * m :].astype(np.int16)
            for p in np.flatnonzero(bands[rows] == band):
                i = rows[p]
                ok = comp[rows] != comp[i]
                # a pair of two sets of the band once, and across two blocks only
                ok &= (doc[rows] > doc[i]) | (bands[rows] != band)
                if g["pi"] != g["pj"]:
                    ok &= side[rows] != side[i]
                ok &= 100 * np.minimum(n[rows], n[i]) >= percent * np.maximum(n[rows], n[i])
                q = np.flatnonzero(ok)
                if not len(q):
                    continue
                same = mark[q] == mark[p]
                gap = np.abs(size[q] - size[p])  # 16 bits, as the sum's terms stay
                # different subsets of equal size differ in two tokens at least, unless sizes were cut at 255
                least = np.where(same, 0, np.where(gap > 0, gap, np.where(size[p] == 255, 1, 2)))
                near = least.sum(1) <= most_different(n[rows[q]], n[i], percent)
                q, same = q[near], same[near] & (size[p] > 0)
                # the group of the first equal segment that is not empty speaks for the pair
                first = same.argmax(1)
                own = np.where(same.any(1), mark[p][first] == here, True)
                j = rows[q[own]]
                a_out.append(np.minimum(doc[j], doc[i]))
                b_out.append(np.maximum(doc[j], doc[i]))
        return np.concatenate(a_out), np.concatenate(b_out)

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            cols = list(zip(*held))
            g = {"key": cols[0][0], "pi": cols[1][0], "pj": cols[2][0], "own": cols[6], "below": cols[7]}
            g |= {name: np.array(cols[k], np.int64) for name, k in (("doc", 3), ("comp", 4), ("n", 5), ("side", 8))}
            a, b = pairs_of(g)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    cols = ["key", "pi", "pj", "doc", "comp", "n", "own", "below", "side"]
    return rows.select(*cols).mapInArrow(run, "a long, b long").distinct()


def vector_table(docs: DataFrame, ids: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc, n, own, below): the segment vectors of the given documents."""

    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, size) for t in b.column(1).to_pylist()]
        vecs = [vectors(s, percent) if len(s) else [b"", b""] for s in sets]
        return pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([v[0] for v in vecs], pa.binary()),
                pa.array([v[1] for v in vecs], pa.binary()),
            ],
            names=["doc", "n", "own", "below"],
        )

    return over_texts(docs, ids, make, "doc long, n long, own binary, below binary")


def join_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(sets, components): sets (doc, n, ..) of each row, components (id, component) of linked documents."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    every = materialize(keyed_sets(docs, size, percent), "join-sets")
    docs, sets = docs.where("doc_id is not null"), every.where("doc is not null")
    # equal sets: linked to the smallest document of their class, which stands for them from here on
    whole = sets.where("n > 0").select("doc", F.struct("c1", "c2", "n").alias("same"))
    firsts = whole.groupBy("same").agg(F.min("doc").alias("rep")).toDF("own", "rep")
    placed = keyed_join(whole, "same", firsts, "own", hot_keys(whole, "same").toDF("hot")).select("doc", "rep")
    copies = placed.where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    copies = materialize(copies.distinct(), "join-copies")
    # a repeated id stays in the search while one of its texts stands for a class
    copied = copies.select("b").distinct().join(placed.where("doc = rep"), F.col("b") == F.col("doc"), "left_anti")
    copied = materialize(copied, "join-copied")

    keys = key_table(sets, frequent_keys(sets))
    w = Window.partitionBy("key")
    groups = keys.withColumn("rep", F.min("doc").over(w)).withColumn("last", F.max("doc").over(w))
    groups = groups.where("rep <> last or base is not null")
    groups = materialize(groups.select(F.coalesce("base", "key").alias("key"), "doc", "rep", "base"), "join-groups")
    stars = groups.where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    # salted groups of one key meet through their smallest documents
    salts = groups.where("base is not null").groupBy("base", "rep").count()
    base = salts.groupBy("base").agg(F.min("rep").alias("first"))
    stars = stars.union(salts.join(base, "base").where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")))
    stars = stars.distinct().join(copied, "b", "left_anti").select("a", "b")
    stars = materialize(stars, "join-stars")
    found = verify(docs, stars, size, percent)
    labels = connected_components(None, found)

    # groups of several components: pairs across components that the first pass has not compared
    members = groups.join(copied, groups.doc == copied.b, "left_anti").select("key", "doc").distinct()
    members = members.join(labels, members.doc == labels.id, "left").select(
        "key", "doc", F.coalesce("component", "doc").alias("comp")
    )
    members = materialize(members, "join-members")
    open_keys = (
        members.groupBy("key")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("cnt"))
        .where("lo <> hi and cnt > 2")
        .select("key", F.ceil(F.col("cnt") / block).cast("int").alias("parts"))
    )
    rest = materialize(members.join(open_keys, "key"), "join-open")
    if not rest.isEmpty():
        vecs = vector_table(docs, materialize(rest.select("doc").distinct(), "join-open-ids"), size, percent)
        part = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
        placed = rest.withColumn("own_part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        placed = placed.select(
            "key",
            F.least("own_part", "other").alias("pi"),
            F.greatest("own_part", "other").alias("pj"),
            "doc",
            "comp",
            (F.col("own_part") > F.col("other")).cast("int").alias("side"),
        )
        blocks = placed.join(vecs, "doc").repartition("key", "pi", "pj").sortWithinPartitions("key", "pi", "pj")
        more = cross_pairs(blocks, percent).join(stars, ["a", "b"], "left_anti")
        found = found.union(verify(docs, more, size, percent))
    return every, connected_components(None, found.union(copies))


def digest(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, n_shingles, component_id."""
    sets, components = join_components(docs.select("doc_id", "text"))
    return sets.join(components, sets.doc == components.id, "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id")
    )


_SPLIT = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + least(len(w), 4)), ' ') AS sh
  FROM w, LATERAL (SELECT unnest(range(greatest(len(w) - 3, 1))) AS i) t WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
