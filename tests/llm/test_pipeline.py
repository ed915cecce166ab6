"""The corpus pipeline: every stage's decisions against brute force on a small fixture."""

import numpy as np

import corpus_pipeline
from sievework.llm import ngram_join, toxicity
from sievework.llm.words import words
from tests.llm.test_text_operators import brute_contamination, toxic_rows


def tables(spark, path):
    rows, labels = toxic_rows(500)
    long = " ".join(f"clean{k}" for k in range(60))
    near = long.replace("clean30", "changed")
    item = " ".join(f"question{k}" for k in range(12))
    rows += [(600, long), (601, near), (602, f"before {item} after"), (603, "a line that repeats itself\nunique tail one"), (604, "a line that repeats itself\nunique tail two")]
    docs = [(i, t, "en", "src0", len(t)) for i, t in rows] + [(700, None, None, None, None), (701, "", "en", "src1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return labels


def test_stages(spark, tmp_path):
    labels = tables(spark, tmp_path)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept, cols = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, d), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == cols or name == "bpe"
    right = [(i in kept["toxicity"]) == (y == 0) for i, _, y in labels]
    assert np.mean(right) > 0.97 and {600, 601, 602, 603, 604, 700, 701} <= set(kept["toxicity"])
    assert kept["line_dedup"][603].text.startswith("a line") and kept["line_dedup"][604].text == "unique tail two"
    assert kept["line_dedup"][604].n_chars == len("unique tail two")
    before = {i: set(ngram_join.shingles(r.text, 5).tolist()) for i, r in kept["line_dedup"].items()}
    gone = set(before) - set(kept["ngram_join"])
    assert 601 in gone and 600 in kept["ngram_join"]
    assert all(any(j < i and 100 * len(before[i] & before[j]) >= 80 * len(before[i] | before[j]) for j in before if before[j]) for i in gone)
    found = brute_contamination([(i, r.text) for i, r in kept["ngram_join"].items()], [(1, " ".join(f"question{k}" for k in range(12)))])
    assert set(kept["decontamination"]) == {i for i, v in found.items() if not v[4]} and 602 not in kept["decontamination"]
    assert set(kept["bpe"]) == set(kept["decontamination"]) and kept["bpe"][701].n_tokens == 0
    assert words("A-b") == [b"a", b"b"] and toxicity.THRESHOLD == 0.7


def test_run_equals_the_stages(spark, tmp_path):
    tables(spark, tmp_path)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, d), name)
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
