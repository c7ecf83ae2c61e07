import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wardlens.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as a sorted list of plain tuples."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))

    return collect


@pytest.fixture(scope="session")
def table(spark):
    """DataFrame from python rows; times are given as text."""

    def build(schema, data):
        columns = [c.strip().split(" ", 1) for c in schema.split(",")]
        raw = ", ".join(f"{n} {'string' if k == 'timestamp_ntz' else k}" for n, k in columns)
        df = spark.createDataFrame(data, raw)
        for n, k in columns:
            if k == "timestamp_ntz":
                df = df.withColumn(n, df[n].cast("timestamp_ntz"))
        return df

    return build
