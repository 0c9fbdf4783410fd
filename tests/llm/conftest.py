import pytest

from training_rows import edge_rows, frame


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(4).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, []).cache()
