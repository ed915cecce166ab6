"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from sievework.llm import bpe, chat_format, common, decontaminate, embedding_dedup, language_id, line_dedup, ngram_join, secret_scan, token_counts, toxicity

OUTPUTS = ["score", "lang_pred", "spans", "token_ids", "decoded", "hits", "x", "features", "begin", "stop", "probability", "prediction", "path", "key", "doc", "a", "b", "component", "__sw_text", "__sw_score", "__sw_hits", "__sw_runs", "__sw_own", "kept_0", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in OUTPUTS)
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t"),
    (4, "the same words stand in this text here\nand a second line of it"),
    (4, "the same words stand in this text here\nand a second line of it"),
    (5, "the same words stand in this text here\nand a second line of it"),
    (6, "Ünï 中文 текст   and token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\""),
    (None, "the same words stand in this text here\nand a second line of it"),
    (7, "x" * 1_000_000),
    (8, "word " * 200_000),
]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('rows')}/documents.parquet"
    spark.createDataFrame([(i, t, "en" if i != 6 else None, "src1", *["own"] * len(OUTPUTS)) for i, t in TEXTS], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def per_row(spark):
    items = spark.createDataFrame([(1, "same words stand in this text"), (None, "x"), (2, None)], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (4, 1, 0), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    return {
        "language": (lambda d: language_id.predict(d, language_id.fit(d)), ["lang_pred", "score", "spans"]),
        "toxicity": (lambda d: toxicity.score(d, toxicity.fit(d, labels)), ["score"]),
        "bpe": (lambda d: bpe.decode(bpe.encode(d)), ["token_ids", "decoded"]),
        "decontaminate": (lambda d: decontaminate.find_contamination(d, items), ["hits"]),
        "decontaminate in slices": (lambda d: decontaminate.find_contamination(d, items, max_pattern_bytes=1), ["hits"]),
        "line dedup": (lambda d: line_dedup.apply_keep_runs(d, line_dedup.keep_bitmaps(d)), []),
    }


@pytest.mark.parametrize("name", ["language", "toxicity", "bpe", "decontaminate", "decontaminate in slices", "line dedup"])
def test_operators_return_every_row_and_every_other_column(spark, rows, name):
    run, outs = per_row(spark)[name]
    out = run(rows)
    assert sorted(out.columns) == sorted({*rows.columns, *outs})
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in TEXTS)
    kept = [c for c in OUTPUTS if c not in outs]
    assert all(r[c] == "own" for r in got for c in kept)
    none = run(rows.limit(0))
    assert none.count() == 0 and sorted(none.columns) == sorted(out.columns)


def test_bpe_of_odd_rows_equals_the_library(rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    for r in bpe.decode(bpe.encode(rows)).collect():
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want and r.decoded == (r.text or "")


@pytest.mark.parametrize("size", [257, 300, 5000, 100_000])
def test_bpe_of_long_words_equals_the_library(size):
    from tokenizers import Tokenizer

    lib, r = Tokenizer.from_file(bpe.default_vocabulary()), random.Random(size)
    c = bpe.Codec(bpe.read_spec(bpe.default_vocabulary()))
    texts = ["x" * size, "ab" * (size // 2), "".join(r.choices("etaoinshrdlu", k=size)), "".join(r.choices("éßñaö", k=size)), "-=" * size]
    for t in texts:  # alone in a batch, too
        assert c.encode_batch([t])[0].tolist() == lib.encode(t, add_special_tokens=False).ids
    assert [x.tolist() for x in c.encode_batch(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_secret_scan_keeps_other_columns_and_is_linear(spark, rows):
    model = secret_scan.train(spark.createDataFrame(secret_scan.sample_findings(300), "candidate string, before string, after string, path string, label int"))
    found = secret_scan.scan(rows, model, path="source").collect()
    assert {r.doc_id for r in found} == {6, 7} - {7} and all(r.prediction == "own" and r.x == "own" and 0 <= r.score <= 1 for r in found)
    assert secret_scan.scan(rows.limit(0), model).count() == 0
    import time

    began = time.time()
    assert secret_scan.candidates("a" * 1_000_000) == [] and len(secret_scan.candidates("a1" * 500_000)) == 1
    assert time.time() - began < 1


def test_secret_features_by_brute_force():
    words, pairs = frozenset({"token", "word"}), np.zeros((26, 26))
    got = secret_scan.features("wordAB12", 'my token = "', '" end', "src/tests", words, pairs)
    assert got[0] == 8 and got[1] == pytest.approx(3.0) and got[2] == 1.0
    assert got[3:8] == [0.5, 0.25, 0.25, 0, 0]
    moves = {(0, 0): 3, (0, 1): 1, (1, 1): 1, (1, 2): 1, (2, 2): 1}
    assert got[8:24] == [moves.get((a, b), 0) / 7 for a in range(4) for b in range(4)]
    assert got[24:27] == [0.0, 5 / 8, 0.5]
    left = got[33 : 33 + secret_scan.LEFT_BUCKETS]
    near = got[33 + secret_scan.LEFT_BUCKETS :][: secret_scan.NEAR_BUCKETS]
    assert left == secret_scan.buckets("token", secret_scan.LEFT_BUCKETS) and sum(left) == 1
    assert near == secret_scan.buckets("my token end", secret_scan.NEAR_BUCKETS) and sum(near) == 3
    assert got[-secret_scan.PATH_BUCKETS :] == secret_scan.buckets("src test", secret_scan.PATH_BUCKETS)


def test_secret_forest_on_shapes_it_has_not_seen(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    cols = "candidate string, before string, after string, path string, label int"
    words = secret_scan.dictionary(bpe.default_vocabulary())
    pairs, right = secret_scan.pair_model(words), []
    for held in range(7):
        model = secret_scan.train(spark.createDataFrame(secret_scan.sample_findings(3000, 1, lambda k: k % 7 != held), cols))
        test = [(secret_scan.features(*f[:4], words, pairs), f[4]) for f in secret_scan.sample_findings(400, 2, lambda k: k % 7 == held)]
        df = spark.createDataFrame(test, "x array<double>, y int").withColumn("features", array_to_vector("x"))
        right += [(r.p >= 0.5) == (r.y == 1) for r in model.transform(df).select("y", vector_to_array("probability")[1].alias("p")).collect()]
    assert np.mean(right) > 0.78


def test_ngram_join_returns_every_row(rows):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.digest(rows).collect()]
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in TEXTS}
    n, m = (len({tuple(words[k][i : i + 4]) for i in range(len(words[k]) - 3)}) for k in (4, 6))
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, n, 4), (4, n, 4), (5, n, 4), (6, m, 6), (None, n, None), (7, 1, 7), (8, 1, 8)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ngram_join.digest(rows.limit(0)).count() == 0


def test_token_counts_of_odd_rows(spark, rows):
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts.digest(rows).collect())
    c = bpe.Codec(bpe.read_spec(bpe.default_vocabulary()))
    assert got == sorted((i, len(c.encode_batch([t or ""])[0])) for i, t in TEXTS if i is not None)
    with pytest.raises(ValueError):
        token_counts.write_token_files(rows, "/nowhere", width=1)


@pytest.mark.parametrize("span", [1, 3, 1024])
def test_token_blocks_are_stitched_in_two_levels(spark, tmp_path, monkeypatch, span):
    monkeypatch.setattr(token_counts, "RANGE", span)
    ids = [np.arange(n) % 50_000 for n in (0, 40, 3, 300, 0, 64)]
    for name in "ab":
        (tmp_path / f"{name}.bin").write_bytes(np.concatenate([np.append(x, 50256) for x in ids]).astype("<u2").tobytes())
    blocks = token_counts.scan_files(spark, str(tmp_path), header=0, block_ids=7)
    rows = token_counts.count_tokens(blocks, header=0, block_ids=7).orderBy("file", "begins_at").collect()
    assert [r.n_tokens for r in rows] == [len(x) for x in ids] * 2


def test_a_real_conversation_minus_seven_keeps_its_rows(spark):
    real = [(-7, 0, "user", "own"), (-7, 5, None, None), (1, None, "assistant", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 1, "user", "x")]
    got = {r.conv_id: r for r in chat_format.digest(spark, spark.createDataFrame(real, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {-7, 1} and got[-7].n_turns == 4 and got[1].n_turns == 3 and got[1].loss_chars == 3
    assert [r.n_turns for r in chat_format.digest(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()] == [2]


def brute_links(vectors):
    ids = [i for i, _, _ in vectors]
    x = np.array([v for _, v, _ in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array([l for _, _, l in vectors])
    hit = (x @ x.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(hit, False)
    up = dict(zip(ids, ids))
    for _ in ids:
        new = {i: min([up[i], *(up[ids[j]] for j in np.flatnonzero(hit[k]))]) for k, i in enumerate(ids)}
        if new == up:
            break
        up = new
    return {i: (int(hit[k].sum()), up[i]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("exact, partitions", [(40_000, 4), (10, 4), (10, 61)])
def test_embedding_links_against_brute_force(spark, exact, partitions):
    r = np.random.default_rng(8)
    vectors = []
    for k in range(120):
        centre = r.normal(size=16)
        for _ in range(1 + k % 7):
            vectors.append((len(vectors), (centre + r.normal(size=16) * 0.16).tolist(), f"l{k % 3}"))
    vectors += [(len(vectors) + k, vectors[3][1], vectors[3][2]) for k in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label string")
        got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.near_duplicates(df, exact=exact, passes=24, pairs=1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute_links(vectors)
    assert sum(n for n, _ in want.values()) > 1500
    assert np.mean([got[i] == want[i] for i in want]) == 1 if exact > 1000 else np.mean([got[i] == want[i] for i in want]) > 0.97


def test_components_of_a_hub_and_a_chain(spark):
    hub = spark.range(1, 100_001).selectExpr("id as a", "0L as b")
    chain = spark.range(200_000, 200_300).selectExpr("id as a", "id + 1 as b")
    got = common.connected_components(None, hub.union(chain))
    assert {(r.component, r["count"]) for r in got.groupBy("component").count().collect()} == {(0, 100_001), (200_000, 301)}


def test_ftrl_equals_a_plain_loop():
    rows = [(np.array(x, np.uint32), y) for x, y in [([1, 2], 1), ([2, 3], 0), ([1, 4], 1), ([3, 4], 0), ([1, 3], 1), ([2, 4], 0)]]
    alpha, beta, l1, l2, bits = 2.0, 1.0, 0.05, 0.1, 3
    z, n, bias = [0.0] * 9, [0.0] * 9, 8

    def weight(i):
        strength = 0.0 if i == bias else l1
        return 0.0 if abs(z[i]) <= strength else (np.sign(z[i]) * strength - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for k in order.permutation(len(rows)):
            at = [*map(int, rows[k][0]), bias]
            g = 1 / (1 + np.exp(-sum(map(weight, at)))) - rows[k][1]
            w = [weight(i) for i in at]
            for i, own in zip(at, w):
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * own
                n[i] += g * g
    hashes, weights, b = toxicity.train(list(rows), bits, 3, alpha, beta, l1, l2, 1)
    want = {i: weight(i) for i in range(8) if weight(i)}
    assert dict(zip(hashes.tolist(), weights)) == pytest.approx(want) and b == pytest.approx(weight(bias))


def test_language_spans_in_text_without_spaces(spark):
    r = random.Random(3)
    rows = [(k, "".join(r.choices("漢字仮名交文章", k=20)), "zh") if k % 2 else (k, " ".join(r.choices(["alo", "bera", "cilo"], k=8)), "xx") for k in range(100)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = "漢字仮名交文章漢字仮名" + "bera cilo alo bera cilo" + "交文章漢字仮名交文章"
    spans = language_id.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().spans
    assert [(s.start, s.end, s.lang) for s in spans] == [(0, 11, "zh"), (11, 34, "xx"), (34, 44, "zh")]


def test_pipeline_stages_on_odd_rows(spark, rows, tmp_path):
    docs = rows.withColumn("n_chars", rows.doc_id)
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        kept = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = common.materialize(stage(spark, kept, str(tmp_path)), name)
            assert kept.columns == docs.columns
            assert all(r.score == "own" and r["__sw_score"] == "own" for r in kept.collect())
        coded = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
        assert coded.columns == ["doc_id", "n_tokens", "token_ids"] and coded.count() == kept.count()
        if start is docs:  # the copy 5 loses its lines to 4, and then has nothing to be a copy by
            assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in TEXTS)
