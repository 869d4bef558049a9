import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs(spark):
    from corpora import frame

    return frame(spark).cache()


@pytest.fixture(scope="session")
def empty(spark):
    from corpora import frame

    return frame(spark, [])
