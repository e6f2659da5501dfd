import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from caseledger.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate one expression per case over a single-column frame."""

    def run(expression, cases, kind="string"):
        frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, v {kind}")
        return [r[0] for r in frame.select(expression, "i").orderBy("i").collect()]

    return run
