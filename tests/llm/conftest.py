import pytest
from pyspark.sql import functions as F

from tests.llm.samples import CLASHING, FOLDER, ODD_TEXTS, SCHEMA, prose


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, equal rows, equal and null ids, columns whose names the operators use."""
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (5, "another text of the same id", None, "s1", 1), (None, prose(3, 20), "en", "s1", 2), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}), rows


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")
