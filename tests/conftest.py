import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest tables."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(small).iterdir():
        con.execute(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def same_rows(a, b):
    """Equal as multisets of rows: numbers to five places."""
    import pandas as pd

    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)

    def rows(df):
        def plain(x):
            if x is None or x is pd.NA or x != x:
                return None
            if isinstance(x, float):
                return round(x, 5) + 0.0
            return str(x) if not isinstance(x, (int, bool)) else x

        flat = [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in map(plain, (x.item() if hasattr(x, "item") else x for x in r))) for r in df[cols].itertuples(index=False)]
        return sorted(flat, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))

    x, y = rows(a), rows(b)
    assert len(x) == len(y)
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    assert not bad, bad[:3]
