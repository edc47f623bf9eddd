"""Every query with SQL against DuckDB, every other for its rows."""

from __future__ import annotations

import pytest

from paceline.plans.oracles import ORACLE_SQL
from paceline.plans.queries import QUERIES
from tests.compare import connect, rows

SF = "/root/testdata/sf0.001"
#: Tens of millions of draws; test_assembly compares their operators with brute force on small fields.
LARGE = {"outcome_probabilities", "noise_grid_search"}
#: Parts of walk_forward_metrics, and what test_zoo runs; they take long to start many small jobs.
ELSEWHERE = {"lambdarank_scores", "boosted_trees", "forest_walk_forward", "tuned_trees", "qualifying_board"}
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), connect(SF).sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - LARGE - ELSEWHERE))
def test_rows(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(ORACLE_SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns[:3] == ["year", "round", "driver"]


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, check=True)
