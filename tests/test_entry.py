import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from tandem.plans.oracle import ORACLES
from tandem.plans.registry import QUERIES

# One query per family; `python check.py` compares all of them.
SAMPLE = ["paired_bitext", "encoded_roundtrip", "vocab_growth", "link_states", "rendered_grid", "whole_job",
          "best_link", "top_translations", "metrics_per_sentence", "take_per_partition", "em_20"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).columns == ["e", "f", "log_p", "rank"]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf_dir, name):
    frame = queries()[name](spark, sf_dir)
    with duckdb.connect() as db:
        for table in check.TABLES:
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        result = db.execute(oracle_sql()[name])
        columns = [d[0] for d in result.description]
        want = check.rows_of(columns, result.fetchall())
    assert sorted(columns) == sorted(frame.columns)
    assert check.rows_of(frame.columns, frame.collect()) == want
