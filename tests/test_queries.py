"""Every query against its SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from columnloom.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9))
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in [*TABLES, "pages", "benchmark", "labels", "conversations"]:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        return
    found = duck.sql(ORACLES[name])
    at = [found.columns.index(c) for c in sorted(found.columns)]
    assert columns == sorted(found.columns)
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("missing", ["tiktoken", "ahocorasick", "tokenizers", "public_tokenizers", "columnloom.llm"])
def test_entry_without(missing):
    """The alignment queries stay where something that only the training-data operators need can't be imported."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(found[0]) >= len(QUERIES) and int(found[1]) >= len(ORACLES)
