import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from check import session

    s = session("8", 8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    from check import connect

    return connect(SF)


@pytest.fixture(scope="session")
def starter(spark):
    from inciflow.sources.seeds import starter_dimension

    return starter_dimension(spark).cache()
