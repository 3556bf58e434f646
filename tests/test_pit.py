from datetime import datetime, timedelta

import pytest
from conftest import utc
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from knownby.operators import estimates, intervals, pit, positioning, screens

CUT = "2024-01-05T00:00:00+00:00"
SCHEMA = "security_id string, metric string, period_end string, value double, available_at timestamp"


def vintages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_latest_vintage(spark):
    df = vintages(spark, [("a", "m", "p", 100.0, utc(2024, 1, 2)), ("a", "m", "p", 110.0, utc(2024, 1, 10))])
    out = pit.latest_vintage_as_of(df, as_of=CUT, keys=["security_id", "metric"]).collect()
    assert [r["value"] for r in out] == [100.0]
    history = pit.latest_vintage_history(df, cutoffs=["2024-01-01T00:00:00+00:00", CUT, "2024-02-01T00:00:00+00:00"], keys=["security_id", "metric"])
    assert [r["value"] for r in history.orderBy("as_of").collect()] == [100.0, 110.0]


def test_cutoff_boundary_is_inclusive_and_several_cutoffs_share_a_day(spark):
    df = vintages(spark, [("a", "m", "p", float(h), utc(2024, 1, 2, h)) for h in (1, 5, 9)])
    cuts = [f"2024-01-02T{h:02d}:00:00+00:00" for h in (0, 1, 4, 5, 12)]
    got = pit.latest_vintage_history(df, cutoffs=cuts, keys=["security_id"]).orderBy("as_of").collect()
    assert [r["value"] for r in got] == [1.0, 1.0, 5.0, 9.0]


def test_naive_or_unordered_cutoffs_are_rejected(spark):
    df = vintages(spark, [])
    with pytest.raises(ValueError):
        pit.latest_vintage_as_of(df, as_of="2024-01-05T00:00:00", keys=["security_id"])
    with pytest.raises(ValueError):
        pit.latest_vintage_history(df, cutoffs=[CUT, CUT], keys=["security_id"])


def test_membership_boundaries(spark):
    rows = [("old", utc(2024, 1, 1), utc(2024, 1, 5)), ("new", utc(2024, 1, 5), None), ("open", utc(2023, 1, 1), None)]
    df = spark.createDataFrame(rows, "security_id string, valid_from timestamp, valid_to timestamp")
    assert {r["security_id"] for r in intervals.members_as_of(df, as_of=CUT).collect()} == {"new", "open"}
    cuts = ["2024-01-04T00:00:00+00:00", CUT, "2024-01-06T00:00:00+00:00"]
    got = {(r["as_of"].day, r["security_id"]) for r in intervals.members_history(df, cutoffs=cuts).collect()}
    assert got == {(4, "old"), (4, "open"), (5, "new"), (5, "open"), (6, "new"), (6, "open")}


def test_look_ahead_rows_fail_the_job(spark):
    rows = [(utc(2024, 1, 2), utc(2024, 1, 2)), (utc(2024, 1, 2), utc(2024, 1, 2, 0, 0, 1))]
    df = spark.createDataFrame(rows, "decision_at timestamp, available_at timestamp")
    assert pit.availability_violations(df).count() == 1
    with pytest.raises(Exception, match="unavailable at decision time"):
        pit.assert_available_by_decision(df).collect()


def test_price_history_by_knowledge_time(spark):
    rows = [("a", "1d", "s", utc(2024, 1, 2), utc(2024, 1, 2, 21), 100.0), ("a", "1d", "s", utc(2024, 1, 2), utc(2024, 1, 4), 105.0)]
    bars = spark.createDataFrame(rows, "security_id string, frequency string, source string, effective_at timestamp, available_at timestamp, close double")
    at = lambda k: pit.price_history_as_of(bars, start="2024-01-01T00:00:00+00:00", end=CUT, knowledge_time=k).collect()[0]["close"]
    assert at("2024-01-03T00:00:00+00:00") == 100.0 and at(CUT) == 105.0


def snapshots(spark, rows):
    names = "security_id string, feature_name string, feature_version string, value double, effective_at timestamp, available_at timestamp, calculated_at timestamp, config_version string"
    return spark.createDataFrame(rows, names)


def test_ambiguous_panel_raises(spark):
    row = ("a", "signal", "v1", 1.0, utc(2024, 1, 2), utc(2024, 1, 2), utc(2024, 1, 2), "c")
    pins = spark.createDataFrame([("signal", "v1")], "feature_name string, feature_version string")
    df = snapshots(spark, [row, ("a", "signal", "v2", 9.0, *row[4:])])
    panel = pit.require_unambiguous(pit.panel_as_of(df, pins=pins, as_of=CUT, config_version="c"))
    assert [r["value"] for r in panel.collect()] == [1.0]
    tied = snapshots(spark, [row, ("a", "signal", "v1", 2.0, *row[4:])])
    with pytest.raises(Exception, match="ambiguous feature snapshots"):
        pit.require_unambiguous(pit.panel_as_of(tied, pins=pins, as_of=CUT, config_version="c")).collect()


def test_resolution_statuses(spark):
    ids = spark.createDataFrame(
        [("s1", "ticker", "AAA", None, "XNYS", utc(2020, 1, 1), utc(2022, 1, 1)), ("s2", "ticker", "AAA", None, "XNYS", utc(2022, 1, 1), None),
         ("s3", "ticker", "BBB", None, "XNYS", utc(2020, 1, 1), None), ("s4", "ticker", "BBB", None, "XLON", utc(2020, 1, 1), None)],
        "security_id string, scheme string, value string, provider string, exchange_mic string, valid_from timestamp, valid_to timestamp")
    refs = spark.createDataFrame(
        [(1, None, "AAA", None, None), (2, None, "BBB", None, None), (3, None, "BBB", None, "XLON"), (4, "isin", "AAA", None, None)],
        "row_number int, scheme string, value string, provider string, exchange_mic string")
    at = lambda when: {r["row_number"]: (r["status"], r["security_id"]) for r in intervals.resolve(refs, ids, as_of=when).collect()}
    assert at(CUT) == {1: ("resolved", "s2"), 2: ("ambiguous", None), 3: ("resolved", "s4"), 4: ("not_found", None)}
    assert at("2021-06-01T00:00:00+00:00")[1] == ("resolved", "s1")


def test_interval_overlap_rules(spark):
    schema = "security_id string, valid_from timestamp, valid_to timestamp, tag string"
    stored = spark.createDataFrame([("a", utc(2024, 1, 1), utc(2024, 2, 1), "x")], schema)
    rows = [("a", utc(2024, 1, 1), utc(2024, 2, 1), "x"), ("a", utc(2024, 2, 1), utc(2024, 3, 1), "y"), ("b", utc(2024, 1, 10), None, "z")]
    kept, bad = intervals.insert_intervals(stored, spark.createDataFrame(rows, schema), keys=["security_id"], tie_break=["tag"], payload=["tag"])
    assert {r["tag"] for r in kept.collect()} == {"y", "z"} and bad.count() == 0
    clash = spark.createDataFrame([("a", utc(2023, 12, 1), utc(2024, 1, 2), "w")], schema)
    kept, bad = intervals.insert_intervals(stored, clash, keys=["security_id"], tie_break=["tag"], payload=["tag"])
    assert kept.count() == 0 and [r["tag"] for r in bad.collect()] == ["w"]
    # Columns that say nothing on the interval come through, on both sides and in their order.
    wide = spark.createDataFrame(rows, schema).unionByName(clash).withColumns({"note": F.concat(F.lit("n"), "tag"), "weight": F.lit(0.5)}).select("note", "security_id", "valid_from", "valid_to", "tag", "weight")
    kept, bad = intervals.insert_intervals(stored, wide, keys=["security_id"], tie_break=["tag"], payload=["tag"])
    assert kept.columns == bad.columns == wide.columns
    assert {(r["tag"], r["note"], r["weight"]) for r in kept.collect()} == {("y", "ny", 0.5), ("z", "nz", 0.5)} and [r["note"] for r in bad.collect()] == ["nw"]


# Every cutoff operator, as (vintage rows, cutoff) -> rows.
OPERATORS = {
    "vintage": lambda df: pit.latest_vintage_as_of(df, as_of=CUT, keys=["security_id", "metric"], tie_break=["value"]),
    "history": lambda df: pit.latest_vintage_history(df, cutoffs=["2024-01-03T00:00:00+00:00", CUT], keys=["security_id"], tie_break=["value"]),
    "revisions": lambda df: estimates.estimate_revisions(df, as_of=CUT, keys=["security_id"], value="value", tie_break=["value"]),
    "breadth": lambda df: estimates.revision_breadth(df, as_of=CUT, lookback_days=2, groups=["metric"], contributor="security_id", value="value", tie_break=["value"]),
    "screen": lambda df: screens.run_screen(
        df.withColumn("feature_name", F.lit("f")), screens.Screen("s", (screens.Criterion("f", "greater_than", 0.0),)), as_of=CUT, tie_break=["value"]),
    "insider": lambda df: positioning.insider_activity(df.withColumn("transaction_type", F.lit("buy")), as_of=CUT).where("classified_transactions > 0"),
}
STAMPS = st.lists(st.tuples(st.sampled_from("abc"), st.integers(-9, 9), st.integers(0, 96)), min_size=1, max_size=12)


@pytest.mark.parametrize("name", OPERATORS)
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(past=STAMPS, future=STAMPS)
def test_future_rows_change_nothing(spark, name, past, future):
    start, cut = utc(2024, 1, 1), utc(2024, 1, 5)
    before = [(k, "m", "p", float(v), start + timedelta(hours=h)) for k, v, h in past]
    after = [(k, "m", "p", float(v), cut + timedelta(seconds=1 + h)) for k, v, h in future]
    results = [
        sorted(map(str, OPERATORS[name](vintages(spark, rows)).collect())) for rows in (before, before + after)
    ]
    assert results[0] == results[1]


def test_guards_hold_when_other_columns_are_read(spark):
    late = spark.createDataFrame([(utc(2024, 1, 2), utc(2024, 1, 3), 1.0)], "decision_at timestamp, available_at timestamp, value double")
    with pytest.raises(ValueError, match="unavailable at decision time"):
        pit.assert_available_by_decision(late).select("value").collect()
    row = ("a", "signal", "v1", 1.0, utc(2024, 1, 2), utc(2024, 1, 2), utc(2024, 1, 2), "c")
    pins = spark.createDataFrame([("signal", "v1")], "feature_name string, feature_version string")
    tied = snapshots(spark, [row, ("a", "signal", "v1", 2.0, *row[4:])])
    with pytest.raises(ValueError, match="ambiguous feature snapshots"):
        pit.require_unambiguous(pit.panel_as_of(tied, pins=pins, as_of=CUT, config_version="c")).select("value").collect()


def test_rows_are_checked_and_stored_in_one_evaluation(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.range(50).mapInArrow(count, "id long")
    late = lambda n: pit.stored_once(df, violates=F.col("id") >= n, shown=["id"], message="too late", then=lambda rows: rows.where("id < 5").select((F.col("id") * 2).alias("twice")))
    kept = late(50)
    assert sorted(r.twice for r in kept.collect()) == [0, 2, 4, 6, 8] and kept.count() == 5
    assert reads.value == 50
    with pytest.raises(ValueError, match="too late: .*49.*1 rows"):  # the row that ``then`` drops
        late(49)
    assert pit.stored_once(df.limit(0), violates=F.lit(True), shown=["id"], message="never").count() == 0


def test_same_interval_with_another_payload_overlaps(spark):
    from knownby.operators import intervals as iv

    schema = "security_id long, benchmark_security_id long, valid_from timestamp, valid_to timestamp"
    one = (1, 7, utc(2024, 1, 1), utc(2024, 2, 1))
    found = lambda rows: iv.overlapping_intervals(spark.createDataFrame(rows, schema), keys=["security_id"], tie_break=["benchmark_security_id"]).count()
    assert found([one, one]) == 0
    assert found([one, (1, 9, *one[2:])]) == 1


def test_pins_and_cutoffs_never_group_snapshots_by_feature_or_day(spark):
    """Few features or days would be few tasks, each with a whole feature or day."""
    at = utc(2024, 1, 2)
    rows = [(f"s{i}", "f", "v1", float(i), at, at, at, "c", "x") for i in range(50)]
    schema = ("security_id string, feature_name string, feature_version string, value double, effective_at timestamp, "
              "available_at timestamp, calculated_at timestamp, config_version string, code_version string")
    features = spark.createDataFrame(rows, schema)
    pins = spark.createDataFrame([("f", "v1")], "feature_name string, feature_version string")
    panel = pit.panel_as_of(features, pins=pins, as_of=CUT)
    history = pit.latest_vintage_history(features, cutoffs=[CUT], keys=["security_id", "feature_name"])
    for df in (panel, history):
        assert df.count() == 50
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_queries_cut_shuffles_finely_unless_the_cluster_says_otherwise(spark):
    from knownby.session import FINE, prepare

    kept = {key: spark.conf.get(key, None) for key in FINE}
    try:
        for key in FINE:
            spark.conf.unset(key)
        prepare(spark)
        assert {key: spark.conf.get(key) for key in FINE} == FINE
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
        assert prepare(spark).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
    finally:
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
