import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir("/root/testdata/sf0.001"):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '/root/testdata/sf0.001/{f}'")
    return con


def rows_of(pdf):
    """Rows as sorted tuples of comparable text, whatever the library's null and number types."""
    import pandas as pd

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return str([cell(x) for x in v])
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        try:
            return f"{float(v):.6f}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    columns = sorted(pdf.columns)
    return sorted(tuple(cell(v) for v in row) for row in zip(*(pdf[c].astype(object) for c in columns))) if len(pdf) else []
