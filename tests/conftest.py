from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import get_session

    session = get_session("tests", cpus=4, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of strings, columns by name."""
    def text(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NA:
            return "null"
        if isinstance(x, float):
            return str(int(x)) if abs(x) < 1e15 and x == int(x) else f"{x:.6f}"
        return str(list(x)) if hasattr(x, "__len__") and not isinstance(x, (str, bytes, dict)) else str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def compare(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert canonical(ours) == canonical(theirs)

    return compare
