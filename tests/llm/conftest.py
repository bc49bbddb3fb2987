import pytest

from rejoinder.llm.common import prepared


@pytest.fixture(autouse=True)
def _settings(spark):
    prepared(spark)
