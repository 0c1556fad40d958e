import pytest

from dipstick.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("*", "dipstick-tests")
