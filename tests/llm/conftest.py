import pytest

from retailmart.llm import queries


@pytest.fixture(scope="session", autouse=True)
def code(spark):
    queries.ship(spark)
