"""Operators that treat each text on its own, and line dedup: against brute force, and odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from sievework.llm import bpe, decontaminate, language_id, line_dedup, secret_scan, token_counts, toxicity
from sievework.llm.words import words

SCHEMA = "doc_id long, text string, source string, line string, doc string"
ODD = [
    (1, None, "a", "x", "y"),
    (2, "", None, None, None),
    (3, "\n", "a", "x", "y"),
    (4, "same line here\nsame line here\n  SAME line HERE\t\nshort", "a", "x", "y"),
    (5, "same line here\nother words stand here\nshort", "a", "x", "y"),
    (5, "same line here\nother words stand here\nshort", "a", "x", "y"),
    (6, "other words stand here\nÄÖ same line here\nlast", None, "x", "y"),
    (None, "same line here\nother words stand here", "a", "x", "y"),
    (7, "word " * 30000 + "\n" + "same line here\n" * 500, "a", "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def strip_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(bpe_upper(), bpe_upper().lower()))


def bpe_upper():
    return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute_line_dedup(rows):
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = strip_key(line)
            if i is not None and len(k) >= 10:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(strip_key(x)) < 10 or first[strip_key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_against_brute_force(spark, odd):
    got = sorted((tuple(r) for r in line_dedup.digest(odd).collect()), key=str)
    assert got == brute_line_dedup([r[:2] for r in ODD])


def test_line_dedup_random_and_hot_line(spark):
    r = random.Random(4)
    pool = [f"line number {k} of the pool" for k in range(30)]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(0, 8)) + ["a very common line"] * (i % 3 == 0))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in line_dedup.digest(df).collect()), key=str) == brute_line_dedup(rows)


def test_line_dedup_bitmap_rebuilds_text_and_keeps_columns(spark, odd):
    out = line_dedup.apply_keep_runs(odd, line_dedup.keep_bitmaps(odd))
    assert out.columns == odd.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[1] is None and text[6] == "ÄÖ same line here\nlast" and text[5] == "other words stand here\nshort"


def test_line_dedup_empty(empty):
    assert line_dedup.digest(empty).count() == 0


# -- BPE ----------------------------------------------------------------------------------------------

PIECES = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "中文", "🙂", "<|endoftext|>", "<|endo", "12", "'s", "...", "\x1c", "　", "=" * 70, "hello", "²", "\r\n", " the", "Ünï", "ab" * 300]


def odd_texts():
    r = random.Random(9)
    return ["".join(r.choices(PIECES, k=r.randint(0, 25))) for _ in range(300)] + ["", " ", "a" * 3000, " " * 500]


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    lib = Tokenizer.from_file(path)
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, path), path).collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got[i].token_ids, "<u4").tolist() == want
        assert got[i].decoded == lib.decode(want, skip_special_tokens=False)


def test_bpe_checks_reject_wrong_cuts():
    c = bpe.Codec(bpe.read_spec(bpe.default_vocabulary()))
    words_ = [w for t in odd_texts() for w in c.split.findall(t)]
    n, flat = c.encode_words(words_)
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [c.merged(w.encode()) for w in words_]


def test_bpe_eviction_keeps_results(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 20)
    c = bpe.Codec(bpe.read_spec(bpe.default_vocabulary()))
    texts = odd_texts()
    small = [x.tolist() for t in texts for x in c.encode_batch([t])]
    monkeypatch.undo()
    whole = bpe.Codec(bpe.read_spec(bpe.default_vocabulary()))
    assert small == [x.tolist() for x in whole.encode_batch(texts)]


def test_bpe_odd_rows(odd, empty):
    assert bpe.digest(empty).count() == 0
    rows = {r.doc_id: r for r in bpe.digest(odd).collect()}
    assert rows[1].n_tokens == 0 and rows[2].n_tokens == 0 and rows[3].n_tokens == 1
    assert bpe.encode(odd).columns == [*odd.columns, "token_ids"]


# -- decontamination ----------------------------------------------------------------------------------


def brute_contamination(docs, items, n=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1)) if w else []:
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit |= set(range(k, k + size))
                    ids |= wins[tuple(w[k : k + size])]
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


@pytest.fixture(scope="module")
def contaminated():
    r = random.Random(2)
    pool = [f"w{k}" for k in range(12)] + ["Größe", "naïve"]
    items = [(k, " ".join(r.choices(pool, k=r.randint(0, 14)))) for k in range(20)] + [(20, None), (21, "..."), (3, "w1 w2")]
    docs = []
    for k in range(120):
        t = r.choices(pool, k=r.randint(0, 40))
        if k % 3 == 0:
            t[5:5] = re.findall(r"\S+", r.choice(items)[1] or "")
        docs.append((k, ", ".join(t).upper() if k % 2 else "  ".join(t)))
    return docs + [(200, None)], items


@pytest.mark.parametrize("limit", [1 << 20, 20_000])
def test_decontamination_against_brute_force(spark, contaminated, limit):
    docs, items = contaminated
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.find_contamination(d, b, max_pattern_bytes=limit).withColumn("n_hit", decontaminate.n_hit())
    want = brute_contamination(docs, items)
    for r in found.collect():
        n, hit, ids, digest, _ = want[r.doc_id]
        assert (r.hits.n_words, r.n_hit, len(r.hits["items"])) == (n, hit, ids)
        assert hashlib.sha256(",".join(r.hits["items"]).encode()).hexdigest() == digest


def test_decontamination_offsets_map_to_the_original(spark):
    item = "one two three four five six seven eight nine ten"
    text = "Größe -- " + item.upper().replace(" ", " - ") + " ende"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(5, item)], "item_id long, text string")
    (span,) = decontaminate.find_contamination(d, b).first().hits.hit_spans
    assert text[span.start : span.end] == item.upper().replace(" ", " - ")


def test_decontamination_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(empty, none).count() == 0
    assert {r.contaminated for r in decontaminate.digest(odd, none).collect()} == {False}


# -- language, toxicity -------------------------------------------------------------------------------

LANGS = {"xx": ["alo", "bera", "cilo", "doro"], "yy": ["skrt", "wrtz", "pfst", "knrz"], "ру": ["мир", "дом", "лес", "река"]}


def language_rows():
    r = random.Random(5)
    return [(k, " ".join(r.choices(LANGS[lang], k=r.randint(3, 30))), lang) for k in range(240) for lang in [list(LANGS)[k % 3]]]


def test_language_held_out(spark):
    rows = language_rows() + [(900, None, "xx"), (901, "123 ...", "yy"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.digest(df).collect()}
    assert len(got) == len(rows)
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _, _ in rows)
    held = [got[k].lang_pred == lang for k, t, lang in rows if got[k].held_out and t and lang and "." not in t]
    assert np.mean(held) > 0.97
    assert {got[k].lang_pred for k in (900, 901, 902)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_spans_of_mixed_text(spark):
    df = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    model = language_id.fit(df)
    left, right = " ".join(["alo", "bera", "cilo"] * 8), " ".join(["мир", "дом"] * 8)
    one = spark.createDataFrame([(1, f"{left}\n {right} ")], "doc_id long, text string")
    a, b = language_id.predict(one, model).first().spans
    assert (a.lang, b.lang) == ("xx", "ру") and (a.start, a.end) == (0, len(left)) and b.end == len(left) + 2 + len(right)


def test_language_without_training(spark, odd, empty):
    docs = odd.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language_id.digest(docs).collect()} == {"und"}
    assert language_id.digest(docs.limit(0)).count() == 0


def test_viterbi_is_optimal(monkeypatch):
    import itertools

    monkeypatch.setattr(language_id, "CHUNK", 3)
    r = np.random.default_rng(1)
    for _ in range(60):
        langs, n, penalty = int(r.integers(1, 4)), r.integers(0, 8, size=4), 2.0
        s = r.normal(size=(int(n.sum()), langs)) * 3
        labels, at = language_id.viterbi(s, n, penalty), 0
        for m in n:
            own, got = s[at : at + m], labels[at : at + m]
            at += m
            value = lambda p: sum(own[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            if m:
                assert value(got) == pytest.approx(max(map(value, itertools.product(range(langs), repeat=int(m)))))


def toxic_rows(n=900):
    r = random.Random(6)
    clean, bad = [f"word{k}" for k in range(300)], ["vilething", "scumbag", "nastyword"]
    rows, labels = [], []
    for k in range(n):
        t = r.choices(clean, k=r.randint(5, 60))
        y = int(r.random() < 0.3)
        if y:
            t.insert(r.randrange(len(t)), r.choice(bad))
        rows.append((k, " ".join(t)))
        labels.append((k, 1, y))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (5000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(docs, lab).collect()}
    held = [got[k].predicted == y for k, _, y in labels if got[k].held_out]
    assert len(got) == len(rows) + 2 and np.mean(held) > 0.97
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())


def test_toxicity_model_is_sparse_and_needs_two_classes():
    rows, labels = toxic_rows()
    x = [(toxicity.features(t), y) for (_, t), (_, _, y) in zip(rows, labels)]
    assert len(toxicity.train(x)[0]) < 1000
    assert len(toxicity.train([(a, 0) for a, _ in x])[0]) == 0 and len(toxicity.train([])[0]) == 0


def test_toxicity_empty(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.digest(empty, none).count() == 0
    assert {r.predicted for r in toxicity.digest(odd, none).collect()} == {0}


# -- token files, secrets -----------------------------------------------------------------------------


def test_token_counts_of_documents(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    lib.encode_special_tokens = True
    rows = list(enumerate(odd_texts(), -3)) + [(2**62, None), (-(2**62), "x"), (None, "left out")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.digest(df).collect()}
    assert got == {i: len(lib.encode(t or "", add_special_tokens=False).ids) for i, t in rows if i is not None}


@pytest.mark.parametrize("whole", [1 << 20, 64])
def test_token_files_blocks_are_stitched(spark, tmp_path, whole):
    r = np.random.default_rng(3)
    ids = [r.integers(0, 50256, size=n) for n in (0, 1, 7, 300, 5, 0, 64)]
    flat = np.concatenate([np.append(x, 50256) for x in ids[:-1]] + [ids[-1]]).astype("<u2")
    (tmp_path / "a.bin").write_bytes(flat.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    for block in (1, 5, 64, 1000):
        blocks = token_counts.scan_files(spark, str(tmp_path), header=0, block_ids=block, whole_bytes=whole)
        rows = token_counts.count_tokens(blocks, header=0).orderBy("begins_at").collect()
        assert [x.n_tokens for x in rows] == [len(x) for x in ids]


def test_secret_scan_finds_and_clears(spark):
    text = 'a token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" b; mail x.92@mail2.example.com, version = "v1.2.3-thanerconver"'
    docs = spark.createDataFrame([(1, text, "src1"), (2, None, None), (3, "", "x")], "doc_id long, text string, source string")
    found = secret_scan.digest(spark, docs).collect()
    assert [text[r.begin : r.stop] for r in found if r.is_secret] == ["9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"]
    assert secret_scan.digest(spark, docs.limit(0)).count() == 0


def test_secret_candidates_in_quotes_and_after_names():
    key, letters = "ghp_" + "aB3dE6gH9" * 4, "QwErTyUiOpAsDfGhJkLzXcVbNmQwErTy"
    for text, value in [
        (f'message = "deploy with key {key} then restart"', key),
        (f'{{"log": "sent {key}"}}', key),
        ("password: Tr0ub4dor-3", "Tr0ub4dor-3"),
        ("db_password=hunter2hunter\n", "hunter2hunter"),
        (f"AWS_SECRET={letters}", letters),
        ("?password=hunter2hunter&user=x", "hunter2hunter"),
        (f"Authorization: Bearer {letters}", letters),
        ('note = "the password: Tr0ub4dor-3, then"', "Tr0ub4dor-3"),
    ]:
        assert value in [text[a:b] for a, b in secret_scan.candidates(text)], text
    assert secret_scan.candidates("password: short and plain words") == []


def test_secret_forest_held_out_accuracy(spark):
    from pyspark.ml.functions import vector_to_array

    cols = "candidate string, before string, after string, path string, label int"
    model = secret_scan.train(spark.createDataFrame(secret_scan.sample_findings(2000, 1), cols))
    words_ = secret_scan.dictionary(bpe.default_vocabulary())
    pairs = secret_scan.pair_model(words_)
    test = [(secret_scan.features(*f[:4], words_, pairs), f[4]) for f in secret_scan.sample_findings(600, 2)]
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame(test, "x array<double>, y int").withColumn("features", array_to_vector("x"))
    rows = model.transform(df).select("y", vector_to_array("probability")[1].alias("p")).collect()
    assert np.mean([(r.p >= 0.5) == (r.y == 1) for r in rows]) > 0.93
