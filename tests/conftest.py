import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from stocktide.session import build_session

    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows from tuples with a schema string; dates may be ISO text."""
    def make(rows, schema):
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        kinds = [f.strip().split(" ")[1] for f in schema.split(",")]
        text = ", ".join(f"{n} {'string' if k == 'date' else k}" for n, k in zip(names, kinds))
        df = spark.createDataFrame(rows, text)
        return df.select(*[df[n].cast(k).alias(n) for n, k in zip(names, kinds)])

    return make
