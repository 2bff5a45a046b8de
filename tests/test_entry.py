"""Driver contract: entry runs, every query has a callable, oracle keys are a subset."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert "day" in df.columns and "energy_kcal" in df.columns
    assert df.count() > 0


def test_registry_shape():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 100
    assert set(sql) <= set(qs)
    own = [k for k in qs if not k.startswith("op") and k != "pipeline"]
    assert len(own) >= 100
    assert all(k[0] in "psfjawoucvzrt" and k[1:3].isdigit() for k in own)
