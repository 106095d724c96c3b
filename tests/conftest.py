import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from chronofold.session import session

    s = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    """A function that runs SQL over the tables of a folder."""
    import os

    import duckdb

    def run(sql, sf_dir=SF):
        c = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            path = f"{sf_dir}/{t}.parquet"
            if os.path.exists(path):
                c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
        return c.execute(sql).df()

    return run


@pytest.fixture(scope="session")
def same():
    """Compares two pandas frames as bags of rows, columns by name."""
    import pandas as pd

    def value(v):
        if v is None or v is pd.NaT or (not hasattr(v, "__len__") and pd.isna(v)):
            return "-"
        if isinstance(v, str | bool) or type(v).__name__ == "bool":
            return str(v)
        try:
            return repr(float(v) + 0.0)
        except (TypeError, ValueError):
            return str(v)

    def check(a, b):
        names = sorted(a.columns)
        assert names == sorted(b.columns)
        rows = [sorted(tuple(map(value, r)) for r in x[names].itertuples(index=False, name=None)) for x in (a, b)]
        assert len(rows[0]) == len(rows[1])
        assert rows[0] == rows[1]

    return check
