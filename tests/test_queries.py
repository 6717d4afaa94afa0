"""Every query that has SQL against DuckDB, over one derived log."""

import datetime
import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from logweave.plans import base, registry

SF = "/root/testdata/sf0.001"
SLOW = {"k01_tail", "k03_until_terminal", "k05_live_state"}


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
        return "-"
    if isinstance(x, bool | np.bool_):
        return str(bool(x))
    if isinstance(x, int | np.integer):
        return str(int(x))
    if isinstance(x, float | np.floating):
        return f"{x:.9g}"
    if isinstance(x, decimal.Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, pd.Timestamp | np.datetime64 | datetime.date):
        return pd.Timestamp(x).isoformat()
    if isinstance(x, list | tuple | np.ndarray):
        return "[" + ",".join(map(plain, x)) + "]"
    return str(x)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(zip(*[[plain(v) for v in df[n]] for n in names], strict=True)) if len(df) else []


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.fixture(scope="module")
def one_log(spark, tmp_path_factory):
    """The log written once; queries over it read that."""
    path = str(tmp_path_factory.mktemp("log") / "log")
    real = base.derive
    real(spark, SF).write.parquet(path)
    base.derive = lambda s, d: s.read.parquet(path).repartition("run_id")
    yield
    base.derive = real


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, duck, one_log, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
