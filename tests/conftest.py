import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyspan.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", 4, "tallyspan-tests")


@pytest.fixture
def hot(spark):
    """Treat every entity with more than three rows as hot."""
    spark.conf.set("tallyspan.hotRows", "3")
    yield
    spark.conf.unset("tallyspan.hotRows")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
