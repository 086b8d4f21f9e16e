"""All registered queries of the reference's operators against their SQL in DuckDB, on the smallest tables that give rows."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from cloudgrid.plans import harness

NAMES = sorted(harness.oracle_sql())
#: queries that the smallest tables give no rows for
LARGER = {"density_threshold", "outlier_filter_l5"}


def data(name: str) -> str:
    return f"/root/testdata/sf{'0.01' if name in LARGER else '0.001'}"


@pytest.fixture(scope="module")
def db():
    made = {}
    for d in {data(n) for n in NAMES}:
        con = made[d] = duckdb.connect()
        for t in os.listdir(d):
            con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{d}/{t}'")
    return made


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    d = data(name)
    got, want = rows(entry.queries()[name](spark, d).toPandas()), rows(db[d].execute(entry.oracle_sql()[name]).fetchdf())
    assert len(got)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_entry_and_names(spark):
    found = entry.entry(spark)
    assert found.columns == ["y", "x", "v", "w"] and found.where("w = 1").count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("blocked", ["ahocorasick", "cloudgrid.llm", "corpus_pipeline"])
def test_the_rest_stands_without(blocked):
    """Neither a missing dependency of the training-data operators nor their absence takes other queries away."""
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len([n for n in q if not n.startswith('op') and n != 'pipeline']), 'op13_fill_in_middle' in q, 'pipeline' in q)"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    operators = blocked == "corpus_pipeline" and "op13_fill_in_middle" in entry.queries()
    assert out == [str(len(harness.queries())), str(operators), "False"]
