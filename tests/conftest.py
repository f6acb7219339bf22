import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def same_rows(df, sql, folder):
    """Asserts that a Spark result equals what DuckDB makes of the same tables."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    other = con.execute(sql).df()
    mine = df.toPandas()
    assert sorted(mine.columns) == sorted(other.columns)
    columns = sorted(mine.columns)

    def rows(frame):
        blank = frame[columns].astype(object).where(frame[columns].notna(), None)
        return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in blank.itertuples(index=False))

    assert rows(mine) == rows(other)
