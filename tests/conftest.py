import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from memquarry.session import local_session

    session = local_session(cores=4, shuffle_partitions=4, memory="4g", app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA
