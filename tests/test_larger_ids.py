"""Queries against their SQL where ids are larger than an address or a domain of the smallest tables has room for."""

import duckdb
import pytest

from secflow.plans import catalog
from tests.test_oracles import SF, plain

NAMES = [
    "enr_bulk_lookup",
    "enr_events",
    "enr_internal",
    "enr_merge_verdicts",
    "enr_network",
    "pred_cidr",
    "risk_alert_score",
    "norm_identity",
    "udf_ip_binary",
    "risk_context",
    "risk_modifier",
    "st_enrich",
]


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    folder, c = str(tmp_path_factory.mktemp("wide")), duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    shifts = "(VALUES (0, 0), (1, 300), (2, 70000)) s(i, d)"
    c.execute(f"COPY (SELECT event_id + i * 100000 AS event_id, ts, user_id + d AS user_id, event_type, value, props FROM '{SF}/events.parquet', {shifts}) TO '{folder}/events.parquet'")
    c.execute(f"COPY (SELECT c_custkey + d AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM '{SF}/customer.parquet', {shifts}) TO '{folder}/customer.parquet'")
    for t in ("events", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return folder, c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle_on_larger_ids(spark, wide, name):
    folder, duck = wide
    df = catalog.queries()[name](spark, folder)
    found = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in found.description]
    assert plain(tuple(r) for r in df.select(*names).collect()) == plain(found.fetchall())
