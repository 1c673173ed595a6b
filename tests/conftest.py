import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from transferlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__enabled="false"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def transfer_rows(spark, small_folder):
    from transferlens.functions.columns import enrich
    from transferlens.sources.transfers import transfers

    return enrich(transfers(spark, small_folder))
