import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark import cloudpickle

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SHARED = tempfile.mkdtemp(prefix="factloom-tests-")
os.environ.setdefault(
    "PYSPARK_SUBMIT_ARGS",
    f"--driver-memory 6g --conf spark.ui.showConsoleProgress=false --conf spark.checkpoint.dir={SHARED} pyspark-shell")

import factloom  # noqa: E402
from factloom.session import build_session  # noqa: E402

cloudpickle.register_pickle_by_value(factloom)


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """values(fn, [inputs]) applies a column function to strings."""
    from pyspark.sql import functions as F

    def run(fn, inputs, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
        return [r.out for r in rows.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]

    return run
