"""Every registered query of the engine against its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from sievework import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = Counter(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert name in registry.ORACLES
    want = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({registry.ORACLES[name]})").fetchall()
    assert rows == Counter(tuple(map(plain, r)) for r in want)
