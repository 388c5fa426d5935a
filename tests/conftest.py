import pytest

from tidemark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tidemark-tests", master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
