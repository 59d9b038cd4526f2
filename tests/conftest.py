import pytest

from sedge.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "8", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
