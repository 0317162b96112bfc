import pytest

from corvane.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "8")
    yield s
    s.stop()
