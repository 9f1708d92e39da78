"""A quick cross-section of the registered queries against DuckDB; tests/oracle.py runs all of them."""
import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUICK = [
    "domain_stats", "interest_stats", "representative_posts", "chronological_chunks", "gate_verdicts", "tag_observations", "word_lemmas",
    "match_outcomes", "profile_metrics", "masked_identifiers", "scrubbed_posts", "resolved_evidence", "scenario_turns", "scored_turns",
    "condition_means", "scored_assignments", "reconciled_results", "recovered_json",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    message, _ = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert message == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
