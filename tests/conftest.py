import pytest

from tracelab.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8", shuffle_partitions=4, app="tests")
