"""Queries of events see rows beyond the small table's end."""

import duckdb
import pytest

from quern import queries

FOLDER = "/root/testdata/sf0.001"
OF_EVENTS = ["change_feed", "live_query_delta", "pitr_replay", "feed_caught_up", "write_conflicts", "delete_versions", "subscription_filter", "backup_restored", "committed_log", "store_compacted", "update_versions"]


@pytest.fixture(scope="module")
def longer(tmp_path_factory):
    """Events eight times over, each time with other users: longer than any fixed piece."""
    folder, c = tmp_path_factory.mktemp("longer"), duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (event_id + k * 1000 AS event_id, user_id + k * 100 AS user_id) FROM '{FOLDER}/events.parquet', range(8) AS t(k)) TO '{folder}/events.parquet'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", OF_EVENTS)
def test_longer_log(spark, longer, name):
    folder, c = longer
    want = c.sql(queries.ORACLE_SQL[name])
    rows = sorted(map(str, want.fetchall()))
    assert sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, folder).select(*want.columns).collect()) == rows
    if name != "write_conflicts":  # each copy has users of its own; a replay to three quarters sees six copies
        at = want.columns.index("id")
        assert max(r[at] for r in want.fetchall()) >= (500 if name == "pitr_replay" else 700)
