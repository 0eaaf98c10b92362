import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("FOLIOWEAVE_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    path = DATA / "sf0.001"
    if not path.exists():
        pytest.skip("no test tables here")
    return str(path)


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for p in sorted(Path(small).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(value):
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, bool) or value is None:
        return value
    return float(value) if isinstance(value, (int, float)) else value


@pytest.fixture(scope="session")
def same(spark, small, duck):
    """Holds a query's rows against its SQL's, in any order."""

    def check(query, sql):
        found = query(spark, small)
        names = sorted(found.columns)
        mine = sorted((repr(_plain(tuple(r[n] for n in names))) for r in found.collect()))
        result = duck.execute(sql)
        heads = [d[0] for d in result.description]
        assert sorted(heads) == names
        theirs = sorted(repr(_plain(tuple(r[heads.index(n)] for n in names))) for r in result.fetchall())
        assert mine == theirs

    return check
