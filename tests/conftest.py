import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from coverlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("coverlens-tests", memory="6g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Values of one input column after an expression, in input order."""

    def run(values, expression, dtype="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
        return [r[1] for r in df.select("i", expression.alias("y")).orderBy("i").collect()]

    return run


def rows(df):
    return [tuple(r) for r in df.collect()]
