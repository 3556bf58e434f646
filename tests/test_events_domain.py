from datetime import date

import pytest
from conftest import close_to, series, utc
from pyspark.sql import functions as F

from knownby.operators import estimates as es
from knownby.operators import events as ev
from knownby.operators import positioning as pos
from knownby.operators import series as ts

K = ["security_id"]
EVENTS = "event_id string, security_id string, event_at timestamp, available_at timestamp, timing string"
SPEC = ev.EventStudySpec((ev.EventWindow("pre", -2, -1), ev.EventWindow("day", 0, 0), ev.EventWindow("post", 1, 2)))


def sessions(spark, days):
    return spark.createDataFrame([(date(2024, 1, d),) for d in days], "session_date date")


def test_alignment(spark):
    rows = [("bmo", "a", utc(2024, 1, 5, 13), None, None), ("amc", "a", utc(2024, 1, 5, 21, 30), None, None),
            ("sat", "a", utc(2024, 1, 6, 17), None, None), ("late", "a", utc(2024, 2, 1), None, None), ("flag", "a", utc(2024, 1, 5, 13), None, "after-market-close")]
    out = ev.align_events(spark.createDataFrame(rows, EVENTS), sessions(spark, [4, 5, 8, 9]), SPEC)
    got = {r["event_id"]: (r["event_timing"], r["response_session"] and r["response_session"].day, r["alignment_rule"]) for r in out.collect()}
    assert got["bmo"] == ("BMO", 5, "same_or_next_open_session")
    assert got["amc"] == ("AMC", 8, "strict_next_session_after_close_holiday_or_weekend_roll")
    assert got["sat"] == ("INTRADAY", 8, "same_or_next_open_session_holiday_or_weekend_roll")
    assert got["late"][1:] == (None, "no_future_session")
    assert got["flag"][:2] == ("AMC", 8)
    bad = spark.createDataFrame([("x", "a", utc(2024, 1, 5), None, "lunch")], EVENTS)
    with pytest.raises(Exception, match="unsupported event timing"):
        ev.align_events(bad, sessions(spark, [5]), SPEC).collect()


def returns(spark):
    return series(spark, {"r": [0.01, 0.02, 0.03, 0.04, 0.05]})


def study(spark, rows, policy="flag"):
    spec = ev.EventStudySpec(SPEC.windows, overlap_policy=policy)
    return {r["event_id"]: r for r in ev.extract_event_windows(returns(spark), spark.createDataFrame(rows, EVENTS), spec, keys=K, value="r").collect()}


def test_windows_and_boundaries(spark):
    out = study(spark, [("mid", "a", utc(2024, 1, 3, 13), utc(2024, 1, 3, 13), None), ("edge", "a", utc(2024, 1, 1, 13), utc(2024, 1, 1), None)])
    mid, edge = out["mid"], out["edge"]
    close_to([mid["pre"], mid["day"], mid["post"]], [1.01 * 1.02 - 1, 0.03, 1.04 * 1.05 - 1])
    assert mid["is_complete"] and mid["overlaps_another_event"] and mid["is_eligible"]
    assert edge["pre"] is None and not edge["is_complete"] and not edge["is_eligible"]
    out = study(spark, [("a1", "a", utc(2024, 1, 3, 13), None, None), ("a2", "a", utc(2024, 1, 3, 14), None, None)], "exclude")
    assert not out["a1"]["is_eligible"] and not out["a2"]["is_eligible"]


def test_events_unknown_at_the_cutoff_are_left_out(spark):
    rows = spark.createDataFrame([("a", "a", utc(2024, 1, 3), utc(2024, 1, 3), None), ("b", "a", utc(2024, 1, 3), utc(2024, 1, 9), None)], EVENTS)
    assert [r["event_id"] for r in ev.filter_events_as_of(rows, as_of="2024-01-05T00:00:00+00:00").collect()] == ["a"]


def test_macro_study_equals_plain_study(spark):
    """Day expansion gives each series the rows of its own event study."""
    one, two = returns(spark), series(spark, {"r": [0.1, 0.2, 0.3]}, key="b").where("session_date <> '2024-01-02'")
    both = one.unionByName(two)
    stamps = [utc(2023, 12, 20, 13), utc(2024, 1, 2, 13), utc(2024, 1, 2, 22), utc(2024, 1, 3, 22), utc(2024, 1, 9, 13)]
    releases = spark.createDataFrame([(f"r{i}", s) for i, s in enumerate(stamps)], "event_id string, release_at timestamp")
    got = ev.macro_event_study(both, releases, SPEC, keys=K, value="r", release_at="release_at", available=None)
    columns = ["security_id", "event_id", "response_session", "alignment_rule", "day", "is_complete", "overlaps_another_event"]
    rows = [(f"r{i}", k, s, s, None) for i, s in enumerate(stamps) for k in ("a", "b")]
    want = ev.extract_event_windows(both, spark.createDataFrame(rows, EVENTS), SPEC, keys=K, value="r")
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(got) == key(want)


def test_earnings_features(spark):
    bars = series(spark, {"open": [100.0, 101, 104, 105], "close": [100.0, 102, 103, 105], "volume": [10.0, 11, 12, 13]})
    rows = spark.createDataFrame([("e", "a", utc(2024, 1, 2, 22), utc(2024, 1, 2, 22), None, 1.1, 1.0)], EVENTS + ", actual_eps double, consensus_eps double")
    row = ev.earnings_event_features(bars, rows, ev.EventStudySpec((ev.EventWindow("event_day", 0, 0),)), volume_window=2, volume_minimum=2).collect()[0]
    close_to([row["event_day"], row["overnight_gap"], row["eps_surprise"]], [103 / 102 - 1, 104 / 102 - 1, 0.10])
    ratios = spark.createDataFrame([(1.1, 1.0), (-0.8, -1.0), (1.0, 0.0)], "a double, c double").select(ev.surprise_ratio("a", "c").alias("s"))
    close_to([r["s"] for r in ratios.collect()], [0.10, 0.20, None])


def test_revisions_breadth_and_dispersion(spark):
    schema = "security_id string, metric string, fiscal_period string, consensus double, available_at timestamp"
    rows = [("a", "eps", "FY", 100.0, utc(2024, 1, 1)), ("a", "eps", "FY", 110.0, utc(2024, 1, 4)), ("a", "eps", "FY", 999.0, utc(2024, 1, 9))]
    row = es.estimate_revisions(spark.createDataFrame(rows, schema), as_of="2024-01-05T00:00:00+00:00", lookback_days=(2, 7)).collect()[0]
    assert row["revision_2d"] == pytest.approx(0.10) and row["revision_7d"] is None
    schema = schema.replace("consensus", "contributor_id string, estimate")
    early, late = utc(2024, 1, 1), utc(2024, 1, 30)
    rows = [("a", "eps", "FY", c, v, t) for c, before, now in (("raise", 1.0, 2.0), ("cut", 2.0, 1.0), ("flat", 1.0, 1.0)) for v, t in ((before, early), (now, late))]
    rows.append(("a", "eps", "FY", "new", 5.0, late))
    row = es.revision_breadth(spark.createDataFrame(rows, schema), as_of="2024-02-01T00:00:00+00:00", lookback_days=20).collect()[0]
    assert (row["revision_breadth"], row["contributors_paired"], row["contributors_changed"]) == (0.0, 3, 2)
    row = es.estimate_dispersion(series(spark, {"v": [1.0, 2.0, 3.0, None]}), keys=K, value="v").collect()[0]
    assert row["coefficient_of_variation"] == 0.5


def test_valuation(spark):
    df = series(spark, {"v": [1.0, 2.0, 3.0, 4.0, 100.0]}).withColumn("at", F.col("session_date").cast("timestamp"))
    row = es.valuation_distribution(df, keys=K, order="at", value="v", as_of="2024-01-04T12:00:00+00:00", lookback=10, minimum=4, ddof=0).collect()[0]
    close_to([row["zscore"], row["percentile"], row["median"]], [1.5 / 1.25 ** 0.5, 1.0, 2.5])
    peers = spark.createDataFrame([("g", "t", 4.0), ("g", "p", 1.0), ("g", "q", 2.0), ("g", "r", 3.0)], "g string, security_id string, v double")
    out = es.peer_relative_zscore(peers, peer_group=["g"], value="v", minimum=3, exclude_self=True)
    assert {r["security_id"]: r["peer_zscore"] for r in out.collect()}["t"] == pytest.approx(2 / (2 / 3) ** 0.5)
    row = es.valuation_decomposition(series(spark, {"p": [0.2], "e": [0.1]}), price_return="p", earnings_revision="e").collect()[0]
    close_to([row["multiple_return"], row["reconstructed_return"]], [1.2 / 1.1 - 1, 0.2])


CHAIN = "security_id string, side string, volume double, open_interest double, expiry date, available_at timestamp, delta double, implied_volatility double"


def test_options(spark):
    old, new, exp = utc(2024, 1, 1), utc(2024, 1, 2), date(2024, 2, 16)
    rows = [("a", "call", 100.0, 50.0, exp, new, 0.2, 0.20), ("a", "call", 100.0, 50.0, exp, new, 0.26, 0.25), ("a", "call", 9.0, 9.0, exp, old, 0.25, 0.9),
            ("a", "put", 300.0, 120.0, exp, new, -0.25, 0.30), ("b", "call", None, 0.0, exp, new, None, 0.2)]
    chain = spark.createDataFrame(rows, CHAIN)
    out = {r["security_id"]: r for r in pos.put_call_ratios(chain).collect()}
    assert (out["a"]["put_call_volume_ratio"], out["a"]["put_call_open_interest_ratio"], out["a"]["status"]) == (1.5, 1.2, "OK")
    assert out["b"]["status"] == "PARTIAL" and out["b"]["warnings"] == ["partial_volume", "zero_call_open_interest"]
    risk = {r["security_id"]: r for r in pos.delta_risk_reversal(chain.where(F.col("available_at") == F.lit(new))).collect()}
    assert risk["a"]["call_minus_put_iv"] == pytest.approx(-0.05) and risk["b"]["warning"] == "no_liquid_delta_match"
    days = spark.createDataFrame([("a", date(2024, 1, d)) for d in (3, 10, 29)] + [("a", date(2024, 3, 15))], "security_id string, expiry date")
    assert pos.select_target_expiry(days, as_of="2024-01-01T00:00:00+00:00").collect()[0]["target_expiry"] == date(2024, 1, 29)


def test_ownership(spark):
    t = utc(2024, 1, 2)
    rows = [("a", "Open Market Purchase", 100.0, t), ("a", "Sale", -40.0, t), ("a", "Gift", 50.0, t), ("a", "Purchase", 1000.0, utc(2024, 6, 1)), ("b", "Buy", 1.0, utc(2020, 1, 1)), ("c", "buy", 5.0, t)]
    df = spark.createDataFrame(rows, "security_id string, transaction_type string, value double, available_at timestamp")
    out = {r["security_id"]: r for r in pos.insider_activity(df, as_of="2024-02-01T00:00:00+00:00").collect()}
    a = out["a"]
    assert (a["net_value"], a["buy_sell_ratio"], a["classified_transactions"], a["unclassified_transactions"], a["status"]) == (60.0, 2.5, 2, 1, "PARTIAL")
    assert out["b"]["warnings"] == ["no_transactions_in_window"] and out["c"]["buy_sell_ratio"] == float("inf")
    change = pos.institutional_position_change(series(spark, {"share_change": [10.0, -5.0, None]})).collect()[0]
    assert (change["mean_share_change"], change["total_share_change"], change["status"]) == (2.5, 5.0, "PARTIAL")
    short = spark.createDataFrame([(100.0, 80.0, 1.5, "n/a")], "shares_short double, shares_short_prior double, short_percent_of_float double, days_to_cover string")
    row = pos.short_interest_metrics(short).collect()[0]
    assert (row["change_in_shares_short"], row["change_percent"], row["short_percent_of_float"], row["status"]) == (20.0, 0.25, None, "PARTIAL")


def test_macro_surprise_scaling(spark):
    out = ts.rolling_standardized_surprise(series(spark, {"x": [0.0, 2.0, 0.0, 2.0, 5.0]}), keys=K, order="session_date", value="x", window=4, minimum=4, ddof=0)
    close_to([r["standardized_surprise"] for r in out.orderBy("session_date").collect()], [None] * 4 + [4.0])


def test_an_event_id_counts_once_in_a_series(spark):
    rows = [("a1", "a", utc(2024, 1, 3, 13), None, None), ("a1", "a", utc(2024, 1, 4, 13), None, None)]
    with pytest.raises(ValueError, match="one event id twice"):
        ev.extract_event_windows(returns(spark), spark.createDataFrame(rows, EVENTS), SPEC, keys=K, value="r")
