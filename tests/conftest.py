import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketgrade.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        spark__sql__shuffle__partitions="2",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def ticks(spark):
    def make(rows):
        """Rows of (symbol, ts, price, volume), numbered in the given order."""
        numbered = [(s, ts, i, float(p), float(v)) for i, (s, ts, p, v) in enumerate(rows)]
        return spark.createDataFrame(
            numbered, "symbol string, ts bigint, trade_id bigint, price double, volume double"
        )

    return make
