"""Every query of the library against its SQL."""

from __future__ import annotations

import pytest
from conftest import canonical

from recordsmith.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    rows = [r.asDict() for r in df.collect()]
    assert rows and canonical(rows, df.columns) == oracle(ORACLES[name])


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(5).count() == 5


def test_dataset_statistics_of_whole_conversations(spark, tmp_path):
    """An example is a conversation, not a turn, and all its turns count."""
    rows = [(1, 1, "ab."), (1, 2, "c. d"), (1, 3, None), (2, 1, "e")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["q24_dataset_statistics"](spark, str(tmp_path)).first().asDict()
    assert got == {"examples": 2, "average_length": 4.0, "average_records": 2.0, "average_sentences": 2.0}
