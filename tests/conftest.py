import pytest

from tidemark.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
