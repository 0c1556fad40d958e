"""What the plans look like: exchanges, pushed columns, sums before shuffles, no forced broadcast."""

import re

import pytest

from dipstick.catalog import QUERIES
from dipstick.catalog.base import Inputs
from dipstick.catalog.sources import scored
from dipstick.operators import features, metrics, profile, timeline
from dipstick.session import materialise, materialise_by
from dipstick.sources import tables

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|rangepartitioning|SinglePartition)", plan(df))


@pytest.fixture(scope="module")
def unbucketed(spark):
    return materialise(Inputs.of(spark, FOLDER).ledger, "plain")


def test_all_features_need_one_exchange(unbucketed):
    assert len(exchanges(features.normalise(unbucketed))) == 1
    assert len(exchanges(features.training_features(features.prepare(unbucketed)))) == 1


@pytest.mark.parametrize(
    "name",
    ["w01_rolling_mean", "w06_ewm_weekday", "w09_days_since_refill", "a01_sales_by_weekday", "a11_describe",
     "a24_winsorise", "f07_refill_decision", "m03_split"],
)
def test_stored_ledger_needs_none(spark, name):
    assert exchanges(QUERIES[name](spark, FOLDER)) == []


def test_many_buckets_give_the_same_features_without_exchange(unbucketed):
    stored = materialise_by(unbucketed, "bucketed", "station_id", "Date", buckets=16)
    spread = features.normalise(stored)
    assert "Bucketed: true" in plan(spread) and exchanges(spread) == []
    assert spread.exceptAll(features.normalise(unbucketed)).count() == 0


def test_raw_scan_reads_only_what_it_needs(spark):
    text = plan(tables.daily_quantities(spark, FOLDER))
    scanned = [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)]
    assert {"l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"} in scanned
    assert all(not s & {"l_shipdate", "o_totalprice", "c_acctbal", "p_name"} for s in scanned)


def test_joins_follow_measured_sizes(spark):
    """With broadcasting off the bridge still plans: nothing is forced to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(tables.daily_quantities(spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_orders_lines_are_summed_before_they_are_shuffled(spark):
    text = plan(tables.daily_quantities(spark, FOLDER))
    # Read from the bottom: the scan, a partial sum, then the exchange on the order key.
    exchange = text.index("Exchange hashpartitioning(l_orderkey")
    assert "partial_sum" in text[exchange:].split("\n")[1]


def test_tail_cuts_rows_before_the_shuffle(unbucketed):
    assert "WindowGroupLimit" in plan(timeline.tail(unbucketed, 7))


def test_overall_curve_has_no_single_task(spark):
    """Scores of one overall curve are summed range by range; only range totals meet in one task."""
    inputs = Inputs.of(spark, FOLDER)
    text = plan(metrics.cumulative_counts(scored(inputs), by=()))
    single = text[text.index("SinglePartition"):]
    assert "sum(pos" in single.split("Exchange")[1]


def test_multipliers_aggregate_before_they_window(unbucketed):
    text = plan(profile.monthly_multipliers(unbucketed))
    assert text.index("Window") < text.index("HashAggregate")
