"""Every named query against its SQL, most of them on the smallest tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF_DIR, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# On the smallest tables a balanced sample has four rows, so that features take two values there and are tested by
# Fisher's exact test, which has no SQL. What follows from the choice of features is compared on the next tables.
CHOSEN = {
    "select_topk", "feature_frequency", "distinct_calculators", "train_stumps", "train_vote", "train_consensus",
    "balanced_accuracy", "nb_vote", "knn_vote",
}
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    sf_dir = LARGER if name in CHOSEN else SF_DIR
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert difference(got, connect(sf_dir).sql(ORACLES[name]).df()) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
