import glob
import math
import os

import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def canonical(rows):
    """Rows as sorted tuples of text; doubles to six digits."""

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="session")
def against_sql(spark):
    """Compare a query with its SQL twin in DuckDB on the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")

    def check(query, sql):
        df = query(spark, DATA)
        order = sorted(df.columns)
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == order
        want = [tuple(r[names.index(c)] for c in order) for r in found.fetchall()]
        assert canonical([tuple(r[c] for c in order) for r in df.collect()]) == canonical(want)

    return check
