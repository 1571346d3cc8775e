"""A few registered queries against their SQL twins; `tools/check_oracles.py` runs all of them."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from docreview.plans.oracles import ORACLES
from docreview.plans.queries import QUERIES
from tools.check_oracles import TABLES, bag

FOLDER = "/root/testdata/sf0.001"
SOME = ["sections", "packages", "reviews", "expert_totals", "audit_uniform", "bind_files", "segment_criteria", "active_time"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_every_query_has_a_twin():
    """Only the optional training-data operators may come without one."""
    assert set(ORACLES) == set(QUERIES)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = queries()[name](spark, FOLDER)
    result = db.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert bag(frame.collect(), frame.columns) == bag(result.fetchall(), names)
