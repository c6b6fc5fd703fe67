import pytest

from gridledger.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a frame from tuples and a schema string."""
    return lambda data, schema: spark.createDataFrame(data, schema)
