import pytest

from tests.conftest import SF
from talkgrain.session import read_table


@pytest.fixture(scope="session")
def messages(spark):
    return read_table(spark, SF, "messages")


@pytest.fixture(scope="session")
def documents(spark):
    return read_table(spark, SF, "documents")
