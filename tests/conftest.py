import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def contests(spark):
    from contestry.sources import sample_tables as st

    return st.contests(spark, SF)


def by_key(df, *keys):
    """Rows as {key: {column: value}}; keys must be unique."""
    out = {}
    for row in df.collect():
        d = row.asDict()
        key = tuple(d[k] for k in keys)
        assert key not in out
        out[key] = d
    return out


def close(a, b, tolerance=1e-9):
    assert a.keys() == b.keys()
    for k in a:
        for c, v in a[k].items():
            w = b[k][c]
            if isinstance(v, float) and w is not None:
                assert abs(v - w) <= tolerance * max(1.0, abs(v)), (k, c, v, w)
            else:
                assert v == w, (k, c, v, w)
