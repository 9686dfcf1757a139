import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows_of(frame):
    """A pandas frame as sorted rows of plain values, columns by name, numbers to six places."""

    def plain(x):
        if x is None or x != x or repr(x) in ("<NA>", "NaT"):
            return None
        if hasattr(x, "tolist") and not isinstance(x, str):
            x = x.tolist()
        return round(x, 6) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, list) else x

    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(plain, row))) for row in frame.astype(object).itertuples(index=False, name=None))


def same_as_sql(spark, duck, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, SF).toPandas()
    expected = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)
