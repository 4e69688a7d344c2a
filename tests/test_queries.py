import pytest
from conftest import SF_DIR
from oracle import compare, connect

from logsluice.plans.oracles import all_oracles
from logsluice.plans.queries import all_queries
from logsluice.session import settings


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, con, name):
    frame = all_queries()[name](spark, SF_DIR)
    assert compare(frame, con, all_oracles()[name]) is None
    if name not in ("preview",):
        assert frame.count() > 0


@pytest.mark.parametrize("name", ["failure_runs_stream", "alarm_5min_stream", "k_of_n_health", "audit_two_days"])
def test_results_do_not_depend_on_the_session_zone(spark, con, name):
    with settings(spark, spark__sql__session__timeZone="America/New_York"):
        frame = all_queries()[name](spark, SF_DIR)
        assert compare(frame, con, all_oracles()[name]) is None
