"""Registered queries against their expected SQL (all of them with ALL_QUERIES=1)."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
import verify
from workload import ctes
from workload.registry import QUERIES, oracles

SAMPLE = (
    "src_site_files dom_tokens dom_elements dom_attrs dom_element_text fn_snippet mr_score cc_main_content as_robots_rules as_bot_access "
    "url_validate url_normalize url_mask ip_classify host_ip_verdict redirect_resolve findings_long report_build src_reports_validated "
    "insight_parse job_dedupe_decision metrics_duration_pct report_delete_authorised retention_apply st_inflight_dedupe st_rate_excess "
    "st_job_metrics redact_event"
).split()


@pytest.fixture(scope="module")
def database(sf_dir):
    return verify.database(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query(spark, database, sf_dir, name):
    state, note, _ = verify.check(spark, database, sf_dir, name, entry.queries(), entry.oracle_sql())
    assert state in ("ok", "ROWS"), note


def test_every_query_has_expected_sql():
    assert set(QUERIES) == set(oracles())


_BIND = """
import importlib, sys
importlib.import_module(sys.argv[1])
import verify, workload.registry as registry
database = verify.database(sys.argv[2])
for name in ("report_build", "recs_extract", "url_mask", "st_job_timeout"):
    database.execute("explain " + registry.oracles()[name])
"""


@pytest.mark.parametrize("first", ["workload.q_streams", "workload.q_reports", "workload.q_dimensions"])
def test_expected_sql_binds_whatever_is_imported_first(sf_dir, first):
    subprocess.run([sys.executable, "-c", _BIND, first, sf_dir], cwd=os.path.dirname(entry.__file__), check=True)


def test_blocks_come_after_those_they_read(monkeypatch):
    monkeypatch.setattr(ctes, "CTES", {"top": "select * from middle", "middle": "select 'from other' as x from base", "base": "select 1", "other": "select 2"})
    assert [line.split(" as ")[0] for line in ctes.sql("select 'top' from top").removeprefix("with ").split(",\n")] == ["base", "middle", "top"]
    monkeypatch.setattr(ctes, "CTES", {"a": "select * from b", "b": "select * from a"})
    with pytest.raises(ValueError):
        ctes.sql("select * from a")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
