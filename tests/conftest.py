import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(small)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v


def same_rows(df, cursor):
    """Whether a Spark result and a DuckDB cursor hold the same rows, columns matched by name."""
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    mine = sorted((tuple(plain(x) for x in r) for r in df.collect()), key=str)
    other = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=str)
    assert mine == other
    return len(mine)
