"""The physical plans keep the properties the operators are built for."""

import re
import tempfile

import pytest
from conftest import utc
from pyspark.sql import functions as F

from knownby.operators import pit, screens, series
from knownby.operators.intervals import members_history


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    """A vintage table on disk, large enough for Spark not to fold it away."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/vintages"
    spark.range(2000).select(
        (F.col("id") % 7).cast("string").alias("security_id"), F.lit("f").alias("feature_name"), F.col("id").cast("double").alias("value"),
        F.lit("unused").alias("note"), F.to_date(F.lit("2024-01-01")).alias("session_date"),
        (F.lit(utc(2024, 1, 1)).cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("available_at"),
    ).write.parquet(path)
    return spark.read.parquet(path)


CUTS = ["2024-01-05T00:00:00+00:00", "2024-02-05T00:00:00+00:00"]


def test_cutoff_and_columns_reach_the_scan(stored):
    text = plan(pit.latest_vintage_as_of(stored.select("security_id", "value", "available_at"), as_of=CUTS[0], keys=["security_id"]))
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(available_at", text)
    assert "note" not in text.split("ReadSchema")[1]


def test_vintages_are_reduced_before_the_shuffle(stored):
    text = plan(pit.latest_vintage_as_of(stored, as_of=CUTS[0], keys=["security_id"]))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_max_by" in text.split("Exchange hashpartitioning")[1]


def test_many_cutoffs_need_no_pairwise_join(stored):
    text = plan(pit.latest_vintage_history(stored, cutoffs=CUTS, keys=["security_id"], tie_break=["value"]))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    rows = stored.select("security_id", F.col("available_at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    text = plan(members_history(rows, cutoffs=CUTS))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_series_features_share_one_shuffle_and_sort(stored):
    k, t = ["security_id"], "available_at"
    df = series.simple_returns(stored, keys=k, order=t, value="value", name="r")
    df = series.rolling_zscore(df, keys=k, order=t, value="r", window=20)
    df = series.rolling_volatility(df, keys=k, order=t, value="r", window=20)
    df = series.rolling_beta(df, keys=k, order=t, asset="r", benchmark="value", window=20, minimum=5)
    text = plan(series.abnormal_returns(df, keys=k, order=t, asset="r", factors=["value"], window=20, minimum=5))
    # Moments merged from blocks take sorts of partitions that are there already, never another shuffle or a sliding frame.
    assert text.count("Exchange hashpartitioning") == 1
    frames = set(re.findall(r"covar_pop\(.*?specifiedwindowframe\(RowFrame, ([^,]+),", text))
    assert frames == {"unboundedpreceding$()"}


def test_a_rolling_fit_sorts_its_rows_three_times(stored):
    """By session, by block, and from the latest row back; looking back and fitting again find the last order."""
    k, t = ["security_id"], "available_at"
    df = stored.withColumn("r", F.col("value") * 2)
    text = plan(series.abnormal_returns(df, keys=k, order=t, asset="r", factors=["value"], window=20, minimum=5))
    assert len(re.findall(r"Sort \[", text)) == 3
    assert text.count("Exchange hashpartitioning") == 1


def test_stages_with_methods_that_the_jvm_never_compiles_are_not_fused(spark):
    from knownby.session import prepare

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    assert prepare(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_sections_look_for_headings_once(spark):
    from knownby.operators import filings

    text = plan(spark.createDataFrame([("RISK FACTORS\nx",)], "text string").select(filings.sections("text").alias("s")))
    assert text.split("LocalTableScan")[0].count("(?md)^(?:item") == 1


def test_screen_limit_is_pruned_in_each_task(spark, stored):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
    screen = screens.Screen("s", (screens.Criterion("f", "greater_than", 0.0),), rank=("f", "descending"), limit=5000)
    text = plan(screens.screen_matches(screens.screen_history(stored, screen, cutoffs=CUTS), screen))
    assert "WindowGroupLimit" in text


def test_the_close_workflow_query_leaves_the_cutoff_to_the_operator(spark, monkeypatch):
    from knownby.catalog import QUERIES
    from knownby.plans import workflows

    given = {}

    class Seen(Exception):
        pass

    def seen(**arguments):
        given.update(arguments)
        raise Seen

    monkeypatch.setattr(workflows, "close_workflow", seen)
    with pytest.raises(Seen):
        QUERIES["o7_close_workflow"](spark, "/root/testdata/sf0.001")
    assert not given["bars"].where("effective_at > timestamp '2001-07-01'").isEmpty()


def test_the_daily_run_evaluates_its_features_once(spark):
    """Members that are too short and those that go on come from the same stored rows."""
    from knownby.catalog import research_queries

    run = research_queries.run(spark, "/root/testdata/sf0.001")
    for df in (run.run, run.failures, run.snapshots):
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
