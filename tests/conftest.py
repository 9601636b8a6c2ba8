import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(rows):
    """Rows as sorted tuples of text, floats rounded, so that two engines compare."""

    def cell(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}"
        if isinstance(v, list):
            return str([cell(x) for x in v])
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


def same_rows(df, duck, sql):
    ours = df.toArrow()
    theirs = duck.execute(sql).to_arrow_table() if hasattr(duck.execute(sql), "to_arrow_table") else duck.execute(sql).fetch_arrow_table()
    names = sorted(theirs.column_names)
    assert set(names) <= set(ours.column_names)
    a, b = (plain(zip(*(t[c].to_pylist() for c in names), strict=True)) for t in (ours, theirs))
    assert a == b
