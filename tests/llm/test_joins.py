"""Similarity joins, embeddings and chat trees: against brute force, and odd inputs."""

import itertools
import random

import numpy as np
import pytest

from sievework.llm import chat_format, embedding_dedup, ngram_join
from sievework.llm.common import connected_components


def union(pairs, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40, 70)] + [(5, 9), (9, 3), (100, 3), (7, 7), (None, 4)] + [(200, k) for k in range(201, 260)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in connected_components(None, df).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == union(real, {x for e in real for x in e})
    assert connected_components(None, df.limit(0)).count() == 0


def documents():
    r = random.Random(8)
    pool = [f"v{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = r.choices(pool, k=r.choice([3, 5, 9, 12, 20, 60, 150]))
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(pool)
            if r.random() < 0.3 and len(t) > 4:
                del t[r.randrange(len(t))]
            rows.append((len(rows), " ".join(t)))
    passage = " ".join(r.choices(pool, k=40))
    rows += [(len(rows) + k, passage + " " + " ".join(r.choices(pool, k=6))) for k in range(25)]
    k = len(rows)
    return rows + [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "V1 v2"), (k + 4, "v1\tv2 "), (3, rows[3][1])]


@pytest.mark.parametrize(("size", "percent", "block"), [(4, 85, 1024), (5, 80, 3), (2, 60, 1024)])
def test_ngram_join_against_brute_force(spark, size, percent, block):
    rows = documents()
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, key string")
    sets = {i: set(ngram_join.shingles(t, size).tolist()) for i, t in rows}
    pairs = [
        (a, b)
        for a, b in itertools.combinations(sorted(sets), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    table, components = ngram_join.join_components(df, size=size, percent=percent, block=block)
    got = {r.id: r.component for r in components.collect()}
    assert {i: got.get(i, i) for i in sets} == union(pairs, sets)
    assert {r.doc: r.n for r in table.collect()} == {i: len(s) for i, s in sets.items()}


def test_ngram_join_keeps_the_other_texts_of_a_copy(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (1, a), (3, b + " more")]
    got = ngram_join.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 3: 1, 5: 1}


def test_ngram_join_with_salted_keys(spark, monkeypatch):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r.component_id for r in ngram_join.digest(df).collect()}
    few = "select key from (select explode(keys) as key from {s}) group by key having count(*) > 3"
    monkeypatch.setattr(ngram_join, "frequent_keys", lambda s: [r.key for r in spark.sql(few, s=s).collect()])
    assert {r.doc_id: r.component_id for r in ngram_join.digest(df).collect()} == plain


def test_no_link_is_lost_by_the_index():
    r = np.random.default_rng(5)
    for percent in (80, 85, 60):
        for n in (1, 2, 5, 6, 7, 9, 13, 30, 90, 300):
            for _ in range(40):
                a = np.unique(r.integers(0, 2**63, size=n).astype(np.uint64))
                b = a.copy()
                for _ in range(int(r.integers(0, max(1, n // 5) + 1))):
                    b = np.delete(b, r.integers(len(b))) if len(b) > 1 and r.random() < 0.5 else np.unique(np.append(b, np.uint64(r.integers(2**62))))
                if ngram_join.links(a, b, percent) and not (len(a) == len(b) and (a == b).all()):
                    shared = np.intersect1d(ngram_join.index_keys(a, percent), ngram_join.index_keys(b, percent))
                    assert len(shared), (percent, len(a), len(b))


def test_ngram_join_empty(spark):
    assert ngram_join.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- embeddings ---------------------------------------------------------------------------------------


def vectors():
    r = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for g in range(25):
            base = r.normal(size=16)
            for _ in range(int(r.integers(1, 6))):
                rows.append((len(rows), (base + 0.12 * r.normal(size=16)).tolist(), label))
    rows += [(len(rows) + k, (np.ones(16) + 0.05 * r.normal(size=16)).tolist(), 1) for k in range(150)]
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(5)]
    k = len(rows)
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15]
    rows += [(k + j, v, 0) for j, v in enumerate(bad)]
    k = len(rows)
    return rows + [(k, rows[0][1], None), (k + 1, [1.0, 2.0], 0), (k + 2, [2.0, 4.0], 0)]


def test_embeddings_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as rep", "1 as comp")
    good = [
        (i, np.array(v, float), lab)
        for i, v, lab in rows
        if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    pairs = []
    for (i, x, a), (j, y, b) in itertools.combinations(good, 2):
        if a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
            pairs.append((i, j))
    comp = union(pairs, [r[0] for r in rows])
    degree = {r[0]: 0 for r in rows}
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, window=20, tile=40).collect()}
    found = sum(r.n_links for r in got.values()) / 2
    assert found >= 0.98 * len(pairs) and all(got[i].n_links <= degree[i] for i in degree)
    assert np.mean([got[i].component_id == comp[i] for i in comp]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values()) and len(got) == len(rows)


def crowded(n, dim=64, planted=150):
    """n vectors of one label, a fifth of them in a dense cone below the threshold, and pairs just above it."""
    r = np.random.default_rng(12)
    x = r.normal(size=(n, dim))
    x[: n // 5] = r.normal(size=dim) * 1.6 + r.normal(size=(n // 5, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(planted):
        side = r.normal(size=dim)
        side -= (side @ x[k]) * x[k]
        x[n - 1 - k] = 0.931 * x[k] + np.sqrt(1 - 0.931**2) * side / np.linalg.norm(side)
    return x


@pytest.mark.parametrize("more", [{}, {"exact": 0}, {"exact": 0, "pairs": 0}])
def test_embeddings_of_a_crowded_label(spark, more):
    x = crowded(4000)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, window=8, **more).collect()}
    comp = union(zip(a.tolist(), b.tolist()), range(len(x)))
    if "pairs" not in more:
        assert {i: r.component_id for i, r in got.items()} == comp
        assert sum(r.n_links for r in got.values()) == 2 * len(a)
    assert np.mean([got[i].component_id == got[j].component_id for i, j in zip(a, b)]) >= 0.97


def test_passes_follow_size_and_density():
    r = np.random.default_rng(2)
    x = r.normal(size=(1000, 64))
    few, many = (embedding_dedup.needed_passes(x, n, 48, 64, 0.93, 0.99) for n in (10_000, 10_000_000))
    dense = embedding_dedup.needed_passes(x + 1.5 * r.normal(size=64), 10_000, 48, 64, 0.93, 0.99)
    assert few < dense and 2 * few < many


def test_windows_reach_over_partition_edges(spark):
    angles = [(0, "a", 2, k, k, [float(np.cos(0.1 * k)), float(np.sin(0.1 * k))]) for k in range(60)]
    rows = spark.createDataFrame(angles, embedding_dedup.KEYED)
    for parts in (1, 7, 40):
        ordered = rows.repartitionByRange(parts, "key").sortWithinPartitions("key")
        links = embedding_dedup.all_window_links(ordered, 3, 0.93).collect()
        assert len(union([(r.a, r.b) for r in links], range(60))) == 60 and set(union([(r.a, r.b) for r in links], range(60)).values()) == {0}


def test_embeddings_empty(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# -- chat ---------------------------------------------------------------------------------------------

TREE = [
    ("t", 1, None, "user", "root", 0.0),
    ("t", 2, 1, "assistant", "good <|end|>\n\\ answer", 2.0),
    ("t", 3, 1, "assistant", "bad answer", -1.0),
    ("t", 4, 2, "user", None, 0.0),
    ("t", 5, 2, "user", "more", 1.0),
    ("u", 1, 99, "user", "orphan is a root", 0.0),
    ("c", 1, 2, "user", "cycle", 0.0),
    ("c", 2, 1, "user", "cycle", 0.0),
    ("t", 1, None, "user", "root", 0.0),
    (None, 1, None, "user", "no tree", 0.0),
]
NODES = "tree string, node long, parent long, role string, text string, score double"


def test_reply_trees(spark):
    out = chat_format.format_trees(spark.createDataFrame(TREE, NODES)).withColumn("turns", chat_format.parsed_turns())
    rows = {(r.tree, r.leaf): r for r in out.withColumn("loss", chat_format.loss_text()).collect()}
    assert set(rows) == {("t", 3), ("t", 4), ("t", 5), ("u", 1)}
    assert [rows["t", k].rank for k in (5, 4, 3)] == [1, 2, 3]
    assert [(x.role, x.text) for x in rows["t", 5].turns] == [("user", "root"), ("assistant", "good <|end|>\n\\ answer"), ("user", "more")]
    assert rows["t", 5].loss == "good <|end|>\n\\ answer" and rows["u", 1].loss == ""
    best = chat_format.format_trees(spark.createDataFrame(TREE, NODES), keep_rank=1)
    assert {(r.tree, r.leaf) for r in best.collect()} == {("t", 5), ("u", 1)}


def test_long_thread(spark):
    rows = [("t", k, k - 1 if k else None, "user", str(k), 0.0) for k in range(300)]
    row = chat_format.format_trees(spark.createDataFrame(rows, NODES)).select(chat_format.parsed_turns().alias("t")).first()
    assert [x.text for x in row.t] == [str(k) for k in range(300)]


def test_template_is_reversible(spark):
    r = random.Random(1)
    odd = ["\\", "<|", "|>", "<", "|", "<|end|>\n", "<\\|", "\n", "a", "🙂", "### Assistant:", "$1"]
    some = lambda: "".join(r.choices(odd, k=r.randint(0, 9)))
    rows = [(k, 0, "assistant", some()) for k in range(150)] + [(200, 0, "user|>\nx", "hello")] + [(1000 + k, 0, some(), some()) for k in range(150)]
    rows.append((3000, 0, "assistant", "<|end|>\n" * 100_000 + "x" * 1_000_000))
    df = spark.createDataFrame([*rows, (500, 0, None, None), (500, 0, None, None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    out = chat_format.format_trees(chat_format.conversation_nodes(df))
    got = {x.tree: x for x in out.select("tree", chat_format.parsed_turns().alias("t"), chat_format.loss_text().alias("loss")).collect()}
    assert all([(x.role, x.text) for x in got[k].t] == [(role, text)] and got[k].loss == (text if role == "assistant" else "") for k, _, role, text in rows)
    assert len(got[500].t) == 2 and len(got) == len(rows) + 1


def test_chat_digest_has_the_extra_conversation(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    (row,) = chat_format.digest(spark, df).collect()
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-7, 2, 26)
