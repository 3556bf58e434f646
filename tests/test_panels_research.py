from datetime import timedelta

import pytest
from conftest import close_to, utc
from pyspark.sql import functions as F

from knownby.functions.ids import research_id, uuid5
from knownby.operators import filings, naive, portfolio, research, screens

FEATURES = "security_id string, feature_name string, feature_version string, value double, effective_at timestamp, available_at timestamp, calculated_at timestamp, config_version string"
SCREEN = screens.Screen(
    "demo", (screens.Criterion("signal", "less_than_or_equal", -1.0), screens.Criterion("quality", "is_finite")), rank=("signal", "ascending"),
    feature_versions={"signal": "v1", "quality": "v1"}, config_version="c")


def features(spark):
    def row(s, f, v, day, version="v1"):
        return (s, f, version, v, utc(2024, 1, day), utc(2024, 1, day), utc(2024, 1, day), "c")

    return spark.createDataFrame(
        [row("a", "signal", -2.0, 2), row("a", "quality", 1.0, 2), row("b", "signal", -3.0, 2), row("c", "signal", 5.0, 2), row("c", "quality", 1.0, 3),
         row("a", "signal", 0.0, 9), row("b", "quality", 2.0, 9), row("b", "signal", None, 12)], FEATURES)


CUTS = ["2024-01-01T00:00:00+00:00", "2024-01-05T00:00:00+00:00", "2024-01-10T00:00:00+00:00", "2024-01-15T00:00:00+00:00"]


def test_screen_one_off_equals_history(spark):
    df = features(spark)
    history = screens.screen_history(df, SCREEN, cutoffs=CUTS)
    columns = ["security_id", "signal", "quality", "excluded_for_missing_data", "matches"]
    for cut in CUTS:
        single = screens.run_screen(df, SCREEN, as_of=cut)
        at = history.where(F.col("as_of") == F.lit(cut).cast("timestamp"))
        assert sorted(map(str, single.select(*columns).collect())) == sorted(map(str, at.select(*columns).collect()))
    top = screens.screen_matches(history, SCREEN).orderBy("as_of", "match_rank").collect()
    assert [(r["as_of"].day, r["security_id"]) for r in top] == [(5, "a"), (10, "b")]


def test_pinned_screen_lists_absent_securities(spark):
    universe = spark.createDataFrame([("a",), ("zz",)], "security_id string")
    out = {r["security_id"]: r for r in screens.evaluate_pinned(features(spark), SCREEN, universe, as_of=CUTS[1]).collect()}
    assert out["a"]["matches"] and out["zz"]["excluded_for_missing_data"] and not out["zz"]["matches"]
    with pytest.raises(ValueError, match="missing"):
        screens.validated_pins(screens.Screen("x", SCREEN.criteria, feature_versions={"signal": "v1"}, config_version="c"))
    with pytest.raises(ValueError, match="disabled"):
        screens.run_screen(features(spark), screens.CHEAP_POSITIVE_REVISIONS, as_of=CUTS[1])


def test_missing_policy_fail_and_pins(spark):
    strict = screens.Screen("strict", SCREEN.criteria, missing_policy="fail")
    with pytest.raises(Exception, match="missing screen inputs"):
        screens.run_screen(features(spark), strict, as_of=CUTS[1]).collect()
    issues = screens.pin_issues([screens.CHEAP_POSITIVE_REVISIONS, screens.RELATIVE_STRENGTH_BREAKOUT], screens.price_feature_registry(spark))
    assert {r["issue"] for r in issues.collect()} == {"unknown_version"} and issues.count() == 3


def test_criteria_validation():
    for bad in (("f", "between", 1.0, None), ("f", "is_finite", 1.0, None), ("f", "greater_than", None, None), ("f", "between", 2.0, 1.0), ("f", "odd", 1.0, None)):
        with pytest.raises(ValueError):
            screens.Criterion(*bad)


def portfolio_inputs(spark):
    start = utc(2024, 1, 1)
    days = [start + timedelta(days=i) for i in range(4)]
    flips = [1, -1]
    panel, returns = [], []
    for i, day in enumerate(days):
        sign = flips[0] if i == 0 else flips[1]
        for j, name in enumerate("abcd"):
            panel.append((day, day, name, "signal", float(j + 1) * (1 if i == 0 else sign)))
            low, high = (-0.01, 0.01)
            returns.append((day, name, high if (j >= 2) == (i <= 1) else low))
    schema = "decision_at timestamp, available_at timestamp, security_id string, feature_name string, value double"
    return spark.createDataFrame(panel, schema), spark.createDataFrame(returns, "session timestamp, security_id string, ret double")


def test_portfolio_lag_turnover_and_costs(spark):
    panel, returns = portfolio_inputs(spark)
    spec = portfolio.PortfolioSpec("signal", "2024-01-01T00:00:00+00:00", "2024-01-31T00:00:00+00:00", quantiles=2, rebalance="daily", minimum_names=4)
    result, _ = portfolio.evaluate_portfolio(panel, returns, spec)
    rows = result.orderBy("session").collect()
    close_to([r["gross_return"] for r in rows], [0.0, 0.02, 0.02, 0.02])
    # From cash into the first position, then a full reversal.
    close_to([r["turnover"] for r in rows], [0.0, 1.0, 2.0, 0.0])
    close_to([r["net_return"] for r in rows], [0.0, 0.018, 0.016, 0.02])


def test_portfolio_rejects_look_ahead_and_duplicates(spark):
    panel, returns = portfolio_inputs(spark)
    spec = portfolio.PortfolioSpec("signal", "2024-01-01T00:00:00+00:00", "2024-01-31T00:00:00+00:00", quantiles=2, rebalance="daily", minimum_names=4)
    with pytest.raises(Exception, match="unavailable at decision time"):
        portfolio.evaluate_portfolio(panel.withColumn("available_at", F.col("available_at") + F.expr("interval 1 second")), returns, spec)
    with pytest.raises(Exception, match="duplicate security values"):
        portfolio.evaluate_portfolio(panel.unionByName(panel), returns, spec)
    with pytest.raises(ValueError):
        portfolio.PortfolioSpec("signal", "2024-01-02T00:00:00+00:00", "2024-01-01T00:00:00+00:00")


def test_performance_conventions(spark):
    df = spark.createDataFrame([("p", i, r) for i, r in enumerate([-0.5, 0.1, -0.1])], "p string, i int, r double")
    row = portfolio.summarize_performance(df, keys=["p"], order="i", value="r").collect()[0]
    assert row["max_drawdown"] == pytest.approx(-0.1)  # the first loss is not a drawdown here
    ruin = spark.createDataFrame([("p", 0, -2.0)], "p string, i int, r double")
    assert portfolio.summarize_performance(ruin, keys=["p"], order="i", value="r").collect()[0]["cagr"] == -1.0


def test_materiality(spark):
    names = list(research.DEFAULT_WEIGHTS)
    df = spark.createDataFrame([tuple([0.4] * 8 + [-0.04])], ", ".join(f"{n} double" for n in names) + ", w double")
    row = research.score_materiality(df, research.Materiality(), {n: n for n in names}, position_weight="w").collect()[0]
    assert (row["raw_score"], row["priority_score"], row["materiality_tier"]) == (pytest.approx(0.4), pytest.approx(0.48), "watch")
    row = research.score_materiality(df.withColumn("abnormal_price", F.lit(1.0)), research.Materiality(), {"abnormal_price": "abnormal_price"}).collect()[0]
    assert (row["raw_score"], row["completeness"]) == (pytest.approx(0.15), pytest.approx(0.15))
    bad = research.score_materiality(df.withColumn("abnormal_price", F.lit(1.5)), research.Materiality(), {"abnormal_price": "abnormal_price"}).collect()[0]
    assert bad["score_violation"] == "abnormal_price"
    with pytest.raises(ValueError):
        research.score_materiality(df, research.Materiality(), {"other": "w"})


def test_identifiers_equal_uuid5(spark):
    import uuid

    names = ["", "evidence:x", "ünïcode – 7", "a" * 200]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(research.price_bar_evidence.__globals__["research_id"].__globals__["RESEARCH_NAMESPACE"], "n").alias("u"))
    space = uuid.UUID("656fba2e-f396-4efd-a529-a2b63d810576")
    assert {r["n"]: r["u"] for r in df.collect()} == {n: str(uuid.uuid5(space, n)) for n in names}
    got = spark.range(1).select(research_id("Finding", F.lit(" key ")).alias("u")).collect()[0]["u"]
    assert got == str(uuid.uuid5(space, "finding:key"))


def test_price_finding_and_card(spark):
    at = utc(2024, 1, 5, 21)
    columns = "research_run_id string, security_id string, as_of timestamp, effective_at timestamp, available_at timestamp, created_at timestamp, daily_return double, residual_return double, residual_zscore double, volume_zscore double, realized_volatility_20d double, beta_126d double, relative_return_sector_63d double, observations int, evidence_ids array<string>, position_weight double"
    df = spark.createDataFrame([("run", "s", at, at, at, at, -0.04, -0.03, -3.0, None, 0.2, 1.1, -0.1, 300, ["e2", "e1"], 0.035)], columns)
    found = research.build_price_findings(df, research.Materiality())
    row = found.collect()[0]
    assert (row["category"], row["direction"], row["event_novelty"]) == ("price_anomaly", "negative", 0.75)
    assert row["finding_key"] == "daily-price:run:s:2024-01-05T21:00:00+00:00" and row["confidence"] == "high"
    card = research.build_cards(found, df.select("research_run_id", "security_id", "position_weight", "daily_return"))
    text = research.render_card_markdown(card.withColumn("security_label", F.lit("ACME"))).collect()[0]
    assert text["contribution_bps"] == pytest.approx(-14.0) and text["evidence_ids"] == ["e1", "e2"]
    for part in ("-14.0 bps", "-3.00 sigma", "3.50%", "# ACME — ROUTINE"):
        assert part in text["markdown"]
    brief = research.morning_brief(card.withColumn("security_label", F.lit("ACME"))).collect()[0]["brief"]
    assert brief.endswith(research.BRIEF_EMPTY)


def test_numeric_claims(spark):
    text = "Up 5.2% to $1,234.50, 12 bps wider; 3x cover, a5 b-7 and 2024. x9"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [(r["value"], r["unit"]) for r in filings.extract_numeric_claims(df).orderBy("position").collect()]
    assert [u for _, u in got] == ["percent", "currency", "basis_points", "multiple", "number", "number"]
    close_to([v for v, _ in got], [0.052, 1234.5, 0.0012, 3.0, 7.0, 2024.0])
    facts = F.array(F.struct(F.lit(0.052).alias("value"), F.lit("percent").alias("unit"), F.lit(0.0).alias("absolute_tolerance")))
    row = filings.validate_numeric_claims(df.withColumn("facts", facts)).collect()[0]
    assert not row["numbers_valid"] and len(row["unsupported_claims"]) == 5


def test_sections_and_version_comparison(spark):
    old = "RISK FACTORS\nalpha\nbeta\nR&D/OTHER ITEMS\nsame\nRISK FACTORS\n\n"
    new = "RISK FACTORS\nalpha\ngamma\nR&D/OTHER ITEMS\nsame\nNEW PART\nhello"
    df = spark.createDataFrame([(1, old, new), (2, "  ", "plain")], "doc_id int, old string, new string")
    parts = {(r["doc_id"], r["section"]): r["body"] for r in filings.segment_sections(df, text="old").collect()}
    assert parts == {(1, "Risk Factors"): "alpha\nbeta", (1, "R&D/Other Items"): "same"}
    rows = {(r["doc_id"], r["section"]): r for r in filings.compare_versions(df, key="doc_id", previous="old", current="new").collect()}
    assert set(rows) == {(1, "Risk Factors"), (1, "New Part"), (2, "DOCUMENT")}
    changed = rows[(1, "Risk Factors")]
    assert (changed["added_lines"], changed["removed_lines"], changed["change_ratio"]) == (1, 1, 0.5)
    assert rows[(1, "New Part")]["change_ratio"] == 1.0


def test_fixed_digits_formats_like_the_number_itself(spark):
    import random

    from knownby.functions.numeric import fixed_digits

    rng = random.Random(8)
    values = [0.125, 0.375, 2.675, 111.205, -111.205, 1.005, -0.005, 0.0, 4.35, 1e9 + 0.125, -1e-9]
    values += [round(rng.uniform(-500, 500), 3) for _ in range(3000)] + [rng.uniform(-5, 5) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.format_string("%.2f", fixed_digits(F.col("v"), 2)).alias("t")).collect()
    wrong = [(r["v"], r["t"]) for r in rows if r["t"].replace("-0.00", "0.00") != f"{r['v']:.2f}".replace("-0.00", "0.00")]
    assert not wrong


def test_evidence_checks(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"], 4, 3), ([], [], 0, 0)], "got array<string>, want array<string>, n int, k int")
    out = filings.evaluate_evidence(df, predicted="got", expected="want", claims="n", supported="k").collect()
    assert (out[0]["evidence_precision"], out[0]["evidence_recall"], out[0]["numerical_accuracy"]) == (0.5, 1.0, 0.75)
    assert (out[1]["evidence_precision"], out[1]["evidence_recall"]) == (1.0, 1.0)
    flags = df.select(filings.has_evidence("got").alias("ok")).collect()
    assert [r["ok"] for r in flags] == [True, False]


def test_squeeze_flag(spark):
    df = spark.createDataFrame([(0.2, 6.0), (0.1, 6.0), (None, 9.0)], "a double, b double").select(naive.squeeze_flag("a", "b").alias("f"))
    assert [r["f"] for r in df.collect()] == [True, False, False]


def test_look_ahead_in_another_feature_is_refused(spark):
    panel, returns = portfolio_inputs(spark)
    spec = portfolio.PortfolioSpec("signal", "2024-01-01T00:00:00+00:00", "2024-01-31T00:00:00+00:00", quantiles=2, rebalance="daily", minimum_names=4)
    late = panel.limit(1).withColumns({"feature_name": F.lit("other"), "available_at": F.col("decision_at") + F.expr("interval 1 second")})
    with pytest.raises(ValueError, match="unavailable at decision time"):
        portfolio.evaluate_portfolio(panel.unionByName(late), returns, spec)


def test_positions_in_long_texts_take_time_in_proportion(spark):
    import time

    from knownby.operators.filings import numeric_claims

    def seconds(n):
        text = " ".join(f"é {i % 997}.5%" for i in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        began = time.perf_counter()
        claims = df.select(numeric_claims("text").alias("c")).first()["c"]
        took = time.perf_counter() - began
        assert [text[c.start:c.end] for c in claims[::501]] == [c.raw for c in claims[::501]] and len(claims) == n
        return took

    seconds(100)
    short, long = seconds(10_000), seconds(40_000)
    assert long < 8 * short + 1  # sixteen times, if every match walked the others


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 700])
def test_running_merges_before_each_element(spark, n):
    from knownby.functions.text import running

    values = [(i * 37) % 101 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    got = df.select(running(F.col("v"), lambda a, x: a + x).alias("s"), running(F.col("v"), lambda a, x: F.greatest(a, x)).alias("m")).first()
    assert got["s"] == [sum(values[:i]) for i in range(n)]
    assert got["m"] == [max([0, *values[:i]]) for i in range(n)]


def test_a_sorted_panel_reads_stored_rows(spark):
    """Sorting looks at its rows twice; their windows must not be computed twice."""
    from knownby.operators import screens

    rows = spark.range(20).selectExpr(
        "id AS security_id", "'f' AS feature_name", "'v' AS feature_version", "sum(id) OVER (ORDER BY id) * 1.0D AS value", "timestamp'2024-01-01' AS effective_at",
        "timestamp'2024-01-01' AS available_at", "timestamp'2024-01-01' AS calculated_at", "'c' AS config_version", "'x' AS code_version")
    panel = screens.snapshots_to_panel(rows, decision_at="2024-02-01T00:00:00+00:00")
    assert panel.inputFiles() and "Window" not in panel._jdf.queryExecution().optimizedPlan().toString()
    assert [r["security_id"] for r in panel.collect()] == list(range(20))


def test_rebalance_query_reads_its_signal_from_one_stored_evaluation(spark):
    from knownby.catalog import QUERIES

    plan = QUERIES["l1_rebalance_decisions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "lineitem" not in plan
