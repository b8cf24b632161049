import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="likeness-tests-"))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cust(spark):
    from likeness.sources import fixtures as fx

    return fx.cust(spark, SF).cache()


@pytest.fixture(scope="session")
def cust_model(cust):
    from likeness.operators.conditionals import fit_context
    from likeness.sources import fixtures as fx

    return fit_context(cust, fx.CUST, fx.CUST_CONTEXTS)


@pytest.fixture(scope="session")
def toy(spark):
    """300 rows, 4 columns: b follows a, c follows (a, b) loosely, d is noise."""
    rows = []
    for i in range(300):
        a = "xyz"[i % 3]
        b = {"x": "p", "y": "q", "z": "r"}[a] if i % 10 else "s"
        c = "u" if (a == "x") != (i % 7 == 0) else ("v" if b == "q" else "w")
        d = str((i * 7919) % 5)
        rows.append((i, a, b, c, d))
    return spark.createDataFrame(rows, "row_id bigint, a string, b string, c string, d string").cache()
