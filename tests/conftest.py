import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from valueflow.session import build_session
    s = build_session("local[4]", 4, app_name="valueflow-tests")
    yield s
    s.stop()


@pytest.fixture()
def ledger(spark):
    from valueflow.sources.ledger import Ledger
    led = Ledger()
    led.spark = spark
    return led
