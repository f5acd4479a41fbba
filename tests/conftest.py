import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in NAMES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"create view {t} as select * from '{p}/*.parquet'" if os.path.isdir(p) else f"create view {t} as select * from '{p}'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v


def same_rows(df, relation) -> None:
    """Same column names and, without regard to order, the same rows."""
    assert sorted(df.columns) == sorted(relation.columns)
    names = sorted(df.columns)
    a = sorted((tuple(normal(r[n]) for n in names) for r in df.collect()), key=repr)
    at = [relation.columns.index(n) for n in names]
    b = sorted((tuple(normal(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert a == b
