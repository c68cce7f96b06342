import pytest

from stratalens.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", "2", 2)
