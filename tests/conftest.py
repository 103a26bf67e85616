import pytest

from quernstone.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("local[4]", 4)
