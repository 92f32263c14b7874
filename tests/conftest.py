import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Python workers import the functions that tests hand over.
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from corpusflow.session import local_session

    session = local_session(
        4, partitions=4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    )
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate a function of a text column for one text."""

    def evaluate(f, text):
        from pyspark.sql import functions as F

        row = spark.createDataFrame([(text,)], "t string")
        return row.select(f(F.col("t")).alias("out")).first()["out"]

    return evaluate
