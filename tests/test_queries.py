"""Every registered query beside its SQL, and what its plan must not hold."""

import pathlib
import re
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as registry  # noqa: E402
from compare import connect, differences  # noqa: E402

from driftshelf.queries import all_queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, con, name):
    text, _ = differences(spark, con, FOLDER, name)
    assert text.startswith("same"), text


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_plan_has_no_pair_joins(spark, name):
    text = plan(registry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["change_status", "null_key_dedupe", "relations_topk", "variants_topk"])
def test_hot_keys_are_cut_before_the_exchange(spark, name):
    text = plan(registry.queries()[name](spark, FOLDER))
    assert re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*WindowGroupLimit[^\n]*Partial", text)


def test_scans_read_only_what_is_used(spark):
    text = plan(registry.queries()["run_counters"](spark, FOLDER))
    assert "o_totalprice" not in text
    assert re.search(r"PushedFilters: \[[^\]]*p_size", plan(registry.queries()["orphan_audit"](spark, FOLDER)))


def test_pages_of_all_styles_are_parsed_once(spark):
    text = plan(registry.queries()["adapter_dispatch"](spark, FOLDER))
    assert text.count("ArrowEvalPython") == text.count("FileScan") == 1
    assert "page_body" not in text  # the body is searched for markers where it is parsed


def test_entry_runs(spark):
    assert registry.entry(spark).limit(1).count() == 1
