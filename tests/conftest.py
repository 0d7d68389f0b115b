import pytest

from routeloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tests", "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
