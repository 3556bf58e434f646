import math

import numpy as np
import pytest
from conftest import close_to, column, series
from pyspark.sql import functions as F

from knownby.functions.student_t import critical_value, two_sided_p
from knownby.operators import inference as inf

K, T = ["security_id"], "session_date"


def one(df):
    return df.collect()[0]


def test_student_t_table_values():
    # Published two-sided 5 % critical values.
    for df, value in ((1, 12.706), (4, 2.776), (10, 2.228), (30, 2.042), (120, 1.980)):
        assert critical_value(0.95, np.array([df]))[0] == pytest.approx(value, abs=6e-4)
        assert two_sided_p(np.array([value]), np.array([df]))[0] == pytest.approx(0.05, abs=2e-4)
    assert two_sided_p(np.array([0.0]), np.array([9.0]))[0] == 1.0
    assert two_sided_p(np.array([1.959964]), np.array([1e7]))[0] == pytest.approx(0.05, abs=1e-6)


def test_invalid_reasons(spark):
    short = one(inf.mean_test_iid(series(spark, {"v": [0.1, 0.2]}), keys=K, value="v", minimum_observations=3))
    assert (short["valid"], short["warning"], short["p_value"]) == (False, "insufficient_observations", None)
    flat = one(inf.mean_test_iid(series(spark, {"v": [0.01] * 20}), keys=K, value="v"))
    assert flat["warning"] == "zero_sample_variance"


def newey_west(x, lags):
    e = np.asarray(x) - np.mean(x)
    total = e @ e + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    return math.sqrt(total) / len(e)


@pytest.mark.parametrize("lags", [None, 0, 1, 7, 200])
@pytest.mark.parametrize("bucketed", [False, True])
def test_hac_error_equals_lag_sums(spark, lags, bucketed):
    x = list(np.random.default_rng(2).normal(size=60).cumsum())
    used = min(math.floor(4 * (60 / 100) ** (2 / 9)) if lags is None else lags, 59)
    bucket = F.floor(F.datediff(T, F.lit("2024-01-01").cast("date")) / 7) if bucketed else None
    row = one(inf.mean_test_hac(series(spark, {"v": x}), keys=K, value="v", order=[T], max_lags=lags, bucket=bucket))
    assert row["standard_error"] == pytest.approx(newey_west(x, used))
    assert row["method"] == f"hac_mean(max_lags={used})"


def test_hac_literal(spark):
    row = one(inf.mean_test_hac(series(spark, {"v": [0.0, 0.125] * 15}), keys=K, value="v", order=[T]))
    assert row["estimate"] == 0.0625 and row["standard_error"] > 0 and row["confidence_lower"] < 0.0625 < row["confidence_upper"]


def test_benjamini_hochberg(spark):
    out = inf.benjamini_hochberg(series(spark, {"p_value": [0.01, 0.04, 0.03, None]}), keys=K)
    close_to(column(out, "q_value"), [0.03, 0.04, 0.04, None])
    assert column(out, "fdr_rejected") == [True, True, True, False]
    tied = inf.benjamini_hochberg(series(spark, {"p_value": [0.02, 0.02, 0.5, 0.9]}), keys=K)
    close_to(column(tied, "q_value"), [0.04, 0.04, 0.5 * 4 / 3, 0.9])
    with pytest.raises(Exception, match="between zero and one"):
        inf.benjamini_hochberg(series(spark, {"p_value": [1.5]}), keys=K).collect()


def test_step_up_buckets_are_bounded_however_values_crowd(spark, monkeypatch):
    from knownby.operators import scale

    monkeypatch.setattr(inf, "BUCKET_ROWS", 50)
    fold, sizes = scale.running_fold, []

    def watched(df, *, keys, bucket, **rest):
        sizes.extend(r["n"] for r in df.groupBy(*keys, bucket.alias("b")).agg(F.count("*").alias("n")).collect())
        return fold(df, keys=keys, bucket=bucket, **rest)

    monkeypatch.setattr(inf, "running_fold", watched)
    for n in (200, 1600):  # all within a hair of one
        p = [1 - 1e-9 * i for i in range(n)]
        out = inf.benjamini_hochberg(series(spark, {"p_value": p}), keys=K)
        order = np.argsort(p)
        want = np.empty(n)
        want[order] = np.minimum(np.minimum.accumulate((np.array(p)[order] * n / np.arange(1, n + 1))[::-1])[::-1], 1.0)
        close_to(column(out, "q_value"), want.tolist())
        assert max(sizes) <= 50 and len(sizes) >= n / 50
        sizes.clear()


def test_bootstrap_is_reproducible_and_centred(spark):
    x = list(np.random.default_rng(4).normal(0.5, 1.0, 64))
    df = series(spark, {"v": x})
    call = lambda data: one(inf.block_bootstrap_mean(data, keys=K, value="v", order=[T], resamples=300, seed=1))
    first, again = call(df), call(df.repartition(3))
    assert first["standard_error"] == pytest.approx(again["standard_error"])
    assert first["block_size"] == 4 and first["confidence_lower"] < np.mean(x) < first["confidence_upper"]
    assert first["standard_error"] == pytest.approx(np.std(x) / 8, rel=0.4)


def test_descriptive_statistics(spark):
    row = one(inf.descriptive_statistics(series(spark, {"v": [1.0, -1.0, 4.0, None]}), keys=K, value="v"))
    close_to([row["mean"], row["median"], row["win_rate"]], [4 / 3, 1.0, 2 / 3])


def test_period_returns_and_seasonality(spark):
    days = 31 + 29 + 31
    df = series(spark, {"r": [0.01] * 31 + [-0.01] * 29 + [0.02] * 31})
    whole = inf.compound_period_returns(df, keys=K, order=T, value="r", exclude_boundary_periods=False)
    close_to([r["period_return"] for r in whole.orderBy("period").collect()], [1.01 ** 31 - 1, 0.99 ** 29 - 1, 1.02 ** 31 - 1])
    inner = inf.compound_period_returns(df, keys=K, order=T, value="r").collect()
    assert [r["period"].month for r in inner] == [2] and days == 91
    table = inf.monthly_seasonality(df, keys=K, order=T, value="r")
    assert table.count() == 12


def test_weekdays_do_not_count_missing_returns(spark):
    values = [None] + [0.01 * (i % 3) for i in range(11)]
    table = inf.weekday_seasonality(series(spark, {"r": values}).where(F.weekday(T) < 5), keys=K, order=T, value="r")
    rows = {r["label"]: r for r in table.collect()}
    assert rows["Monday"]["observations"] == 1 and not rows["Monday"]["test_valid"]
    assert sum(r["observations"] for r in rows.values()) == 9


def test_bootstrap_draws_stay_in_their_rows_and_long_series_agree(spark, monkeypatch):
    rows = [(f"s{k}", i, float((i * 37 + k) % 11)) for k in range(3) for i in range(40 + k)]
    df = spark.createDataFrame(rows, "security_id string, at int, x double")
    run = lambda: inf.block_bootstrap_mean(df, keys=["security_id"], value="x", order=["at"], resamples=100, seed=3)
    one = run()
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    # Draws are generated above all joins on series: no join looks up a draw's start.
    assert "__k___start" not in plan
    inside = sorted(one.collect())
    monkeypatch.setattr(inf, "_SERIES", 41)  # one series is longer
    mixed = sorted(run().collect())
    monkeypatch.setattr(inf, "_SERIES", 0)
    looked_up = sorted(run().collect())
    for other in (mixed, looked_up):
        assert [r["security_id"] for r in inside] == [r["security_id"] for r in other]
        for a, b in zip(inside, other):
            for c in ("estimate", "standard_error", "confidence_lower", "confidence_upper"):
                assert a[c] == pytest.approx(b[c], abs=1e-12)
