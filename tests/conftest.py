import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="session")
def same_as_sql(spark, sf):
    """Compare a query with its DuckDB SQL over the same tables, floats to nine digits, in any order."""
    import duckdb

    db = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def told(x):
        return round(x, 9) if isinstance(x, float) else x

    def check(query, sql):
        df = query(spark, sf)
        cols = sorted(df.columns)
        got = sorted((tuple(told(r[c]) for c in cols) for r in df.collect()), key=repr)
        cur = db.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = sorted((tuple(told(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
        assert got == want

    return check
