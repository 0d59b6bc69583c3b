import pytest

from siftline.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="3g", spark__driver__host="127.0.0.1")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
