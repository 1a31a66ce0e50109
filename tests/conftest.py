import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same_rows(df, result):
    """Spark rows and a DuckDB result, columns sorted by name, as sorted lists."""
    cols = sorted(df.columns)
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    a = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)
    b = sorted((tuple(tidy(r[i]) for i in at) for r in result.fetchall()), key=repr)
    return a, b
