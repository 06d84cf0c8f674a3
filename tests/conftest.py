import pytest

from maskwright.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        app_name="tests",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__default__parallelism="4",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
