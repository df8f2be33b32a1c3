import pytest

from skarn.plans.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session(master="local[4]", app="skarn-tests", shuffle_partitions=4, memory="4g")
