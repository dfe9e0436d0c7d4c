import pytest

from skein.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark(4, memory="3g")
