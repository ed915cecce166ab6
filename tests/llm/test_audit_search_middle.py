"""Filter audit, exact top-k search and fill-in-middle: against plain loops, and on odd rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import fill_middle, filter_audit, topk_search

ODD_TEXTS = [
    None, "", "\n", "\n\n", "a", "a\n", "\na", "one line\nand another\nä line ü\n", "中文\n文\r\n\x0b", "<P>\nx", "a <S> b\nc", "x<M", "<\n<P\n>",
    "word " * 60, "SHOUT OUT LOUD", "has $ sign", "the quick brown fox " * 15, "x" * 1_000_000, "line of words\n" * 80_000,
]


def audit_by_loops(docs, labels):
    smallest, parts = {}, {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and smallest[t] < i,
        }
        mine = [x for x in labels if x[0] == i and i is not None]
        parts.setdefault(source or "", []).append((fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part, rows in parts.items():
        report, total = {}, dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                total[f] += len(gone)
                every = sum(x[0][f] for x in rows)
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in rows)
                report[order, step, f] = (len(left), len(gone), every - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone))
        out += [(part, order, step, *v, total[f]) for (order, step, f), v in report.items()]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_loops(spark):
    rng = random.Random(4)
    docs = [(k, t, rng.choice(["a", "b", None, ""])) for k, t in enumerate(ODD_TEXTS)]
    docs += [(100 + k, rng.choice(ODD_TEXTS[:17]), "a") for k in range(40)]
    docs += [(None, None, "a"), (None, "has $ sign", None), (100, docs[-1][1], "b"), (101, "has $ sign", "a")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 130, 2)] + [(4, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*r, "x", True) for r in docs], "doc_id long, text string, source string, part string, A boolean").repartition(5)
    found = filter_audit.digest(d, spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, source string"))
    assert sorted(tuple(r) for r in found.select(*AUDIT).collect()) == audit_by_loops(docs, labels)


def test_audit_of_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.digest(docs, labels).count() == 0
    one = filter_audit.digest(spark.createDataFrame([(1, "x", "s")], docs.schema), labels)
    assert one.count() == 600 and one.where("good_lost + toxic_lost > 0").count() == 0


def test_audit_takes_any_filters_and_many_parts(spark):
    rows = spark.range(20_000).selectExpr("cast(id % 9000 as string) part", "id % 2 = 0 p", "id % 3 = 0 q", "id % 5 = 0 bad")
    got = filter_audit.prefix_counts(rows, ["p", "q"], ["bad"])
    sums = {(r.subset, r.filter): (r.a, r.b, r.c) for r in got.groupBy("subset", "filter").agg(*[F.sum(x).alias(y) for x, y in (("passed", "a"), ("removed", "b"), ("bad_lost", "c"))]).collect()}
    ids = range(20_000)
    assert sums[0, "p"] == (20_000, 10_000, 2_000)
    assert sums[1, "q"] == (10_000, sum(i % 2 > 0 and i % 3 == 0 for i in ids), sum(i % 2 > 0 and i % 15 == 0 for i in ids))


def search_by_loops(queries, rows, k):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    scaled = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and ok(v)]
    asked = {}
    for i, v in queries:
        if i is not None and ok(v):
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        mine = [int(np.floor(1024 * float(x))) for x in v]
        scores = [(-max(min(sum(a * b for a, b in zip(mine, w)), 2**63 - 1), 2 - 2**63), i) for i, w in scaled if i != q and len(w) == len(mine)]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k,block,fan", [(10, 1 << 20, 16), (3, 1, 2), (1, 600, 3)])
def test_search_equals_loops(spark, monkeypatch, k, block, fan):
    rng = np.random.default_rng(k)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 5) / 4]) for i in rng.permutation(300)]
    rows += [(400 + i, rows[0][1]) for i in range(60)]  # one group of copies
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [float("nan")] * 5), (503, [float("inf")] * 5), (504, []), (505, []), (None, [1.0] * 5), (507, [1.0, 2.0])]
    rows += [(7, [9.0] * 5), (8, [1e30] * 5), (9, [-1e30] * 5), (10, [1e6, 1.0, 0.0, 0.0, 0.0])]
    d = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, query_id int").repartition(7)
    few = [r for r in rows if r[0] is None or r[0] % 20 == 0 or r[0] >= 500 or r[0] in (7, 8, 9, 10)]
    got = topk_search.top_k(spark.createDataFrame(few, "vec_id long, embedding array<double>"), d, k, block_bytes=block, fan=fan)
    assert sorted(tuple(r) for r in got.collect()) == search_by_loops(few, rows, k)


def test_search_of_small_tiles(spark):
    rng = np.random.default_rng(1)
    ids, rows = np.arange(50), rng.integers(-2, 3, (50, 3)).astype(float)
    got = topk_search.tile_best(ids[:8], rows[:8], ids, rows, 4)
    for q in range(8):
        want = sorted((-int(rows[q] @ rows[i]), i) for i in range(50) if i != q)[:4]
        assert sorted(zip((-got[1][q]).tolist(), got[0][q].tolist())) == want


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")
    assert topk_search.digest(none).count() == topk_search.digest(some).count() == topk_search.top_k(some, none).count() == 0


def middle_by_loops(doc_id, text, pattern):
    text = text or ""
    units = re.findall(pattern, text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h4 % 100 < 50:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "char": r"(?s)."}


@pytest.mark.parametrize("unit,chunk", [("line", 4096), ("line", 1), ("line", 3), ("word", 7), ("char", 2)])
def test_middle_equals_loops(spark, unit, chunk):
    texts = ODD_TEXTS if chunk > 3 else ODD_TEXTS[:17]
    texts = [t for t in texts if unit == "line" or t is None or len(t) < 100_000]
    rows = [(k, t) for k, t in enumerate([*texts, *texts])] + [(None, "a\nb\nc"), (3, "rows\nthat\nrepeat"), (3, "rows\nthat\nrepeat")]
    d = spark.createDataFrame([(i, t, "f", 1.5) for i, t in rows], "doc_id long, text string, form string, other double").repartition(3)
    done = fill_middle.transform(d, unit=unit, chunk=chunk)
    assert sorted(done.columns) == sorted([*d.columns, *[c for c in fill_middle.OUTS if c != "form"]])
    got = done.withColumn("back", fill_middle.restored()).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.fim_text) for r in got), key=key) == sorted(
        ((i, *middle_by_loops(i, t, UNITS[unit])) for i, t in rows), key=key
    )
    assert all(r.back == (r.text or "") and r.other == 1.5 for r in got)


def test_middle_of_no_rows_and_rates(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.transform(none).count() == 0
    some = spark.createDataFrame([(k, "a\nb\n") for k in range(200)], none.schema)
    assert fill_middle.transform(some, rate=0).where("form <> 'plain'").count() == 0
    assert {r.form for r in fill_middle.transform(some, spm_rate=100).collect()} == {"spm"}


def test_counts_cross_slabs(monkeypatch):
    monkeypatch.setattr(fill_middle, "SLAB", 64)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab\n") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 400]))).encode() for _ in range(60)]
    ends = np.concatenate([[3], 3 + np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"\n\n\n" + b"".join(texts) + b"\n", np.uint8)
    first, counts = fill_middle.chunk_counts(data, ends, fill_middle.BEGINS["line"], 16)
    for k, t in enumerate(texts):
        own = counts[first[k] : first[k + 1]]
        assert int(own.sum()) + bool(t) == len(re.findall(rb"[^\n]*\n|[^\n]+", t))
        for rank in range(int(own.sum()) + 1 if t else 0):
            at = fill_middle.cut_at(data, int(ends[k]), int(ends[k + 1]), own, rank, fill_middle.BEGINS["line"], 16)
            assert at - ends[k] == len(b"".join(re.findall(rb"[^\n]*\n|[^\n]+", t)[:rank]))
