import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def edge(spark):
    import data_llm
    df = data_llm.docs(spark).cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def none(spark):
    import data_llm
    return data_llm.empty(spark)
