import pytest

from checks.compare import session


@pytest.fixture(scope="session")
def spark():
    return session("tests")
