"""Driver contract."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["lang", "system", "distinct_1", "distinct_2"]
    assert df.count() > 0


def test_every_query_has_an_oracle_or_is_rows_only():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = {"few_shot_sample_mt19937", "interleave_reference_mt19937", "ballot_build_mt19937"}
    assert {k for k in set(q) - set(o) if not k.startswith("op") and k != "pipeline"} == own
    assert len(q) >= 56
