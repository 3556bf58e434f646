"""Order statistics against brute force, with one group holding a third of the rows."""

import numpy as np
import pandas as pd
from conftest import close_to
from pyspark.sql import functions as F

from knownby.operators import panels
from knownby.operators.scale import (
    average_rank, exact_quantiles, magnitude_bucket, running_fold, running_position,
)


def skewed(spark, n=3000):
    rng = np.random.default_rng(3)
    key = np.where(rng.random(n) < 0.34, "hot", [f"k{i}" for i in rng.integers(0, 40, n)])
    value = np.round(rng.normal(0, 10, n), 1)
    value[rng.random(n) < 0.2] = 1.5
    frame = pd.DataFrame({"id": range(n), "k": key, "v": value})
    frame.loc[frame.index % 17 == 0, "v"] = np.nan
    return frame, spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), "id bigint, k string, v double")


def test_bucket_is_monotone(spark):
    values = sorted([0.0, -1e-300, 1e-300, -5.0, -5.0000001, 7.0, 7.1, 1e300, -1e300, 1.0, -1.0, 0.5])
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", magnitude_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    buckets = [r["b"] for r in rows]
    assert buckets == sorted(buckets)


def test_quantiles_are_exact(spark):
    frame, df = skewed(spark)
    got = {r["k"]: (r["a"], r["b"], r["c"]) for r in exact_quantiles(df, keys=["k"], value="v", quantiles={"a": 0.05, "b": 0.5, "c": 0.99}).collect()}
    for key, group in frame.groupby("k"):
        close_to(got[key], list(group["v"].dropna().quantile([0.05, 0.5, 0.99])))


def test_average_rank_matches_pandas(spark):
    frame, df = skewed(spark)
    got = {r["id"]: (r["rank"], r["rank_count"]) for r in average_rank(df, keys=["k"], value="v").collect()}
    want = frame.groupby("k")["v"].rank(method="average")
    assert len(got) == len(frame)
    for i, rank in enumerate(want):
        assert (got[i][0] is None) if np.isnan(rank) else got[i][0] == rank


def test_running_position_and_folds(spark):
    frame, df = skewed(spark)
    ordered = frame.sort_values(["k", "id"])
    bucket = F.floor(F.col("id") / 100)
    got = {r["id"]: r["position"] for r in running_position(df, keys=["k"], order=["id"], bucket=bucket).collect()}
    want = ordered.groupby("k").cumcount() + 1
    assert got == dict(zip(ordered["id"], want))
    for kind, name in (("sum", "cumsum"), ("max", "cummax"), ("min", "cummin")):
        filled = df.fillna(0.0)
        out = running_fold(filled, keys=["k"], order=["id"], bucket=bucket, value=F.col("v"), kind=kind, name="x")
        got = {r["id"]: r["x"] for r in out.collect()}
        expected = getattr(ordered.assign(v=ordered["v"].fillna(0.0)).groupby("k")["v"], name)()
        close_to([got[i] for i in ordered["id"]], list(expected), 1e-6)


def test_cross_section_literals(spark):
    df = spark.createDataFrame([("d", i, float(v)) for i, v in enumerate([1, 2, 3])], "d string, id int, v double")
    out = panels.cross_sectional_zscore(df, keys=["d"], value="v", minimum=3).orderBy("id").collect()
    close_to([r["zscore"] for r in out], [-1 / (2 / 3) ** 0.5, 0.0, 1 / (2 / 3) ** 0.5])
    df = spark.createDataFrame([("d", i, float(v)) for i, v in enumerate([0, 1, 2, 100])], "d string, id int, v double")
    out = panels.normalize_factor(df, keys=["d"], value="v", lower=0.0, upper=0.75, minimum=4).orderBy("id").collect()
    assert out[3]["winsorized"] == 26.5 and out[3]["percentile"] == 1.0
    thin = panels.winsorize(df, keys=["d"], value="v", minimum=5).collect()
    assert {r["winsorized"] for r in thin} == {None}


def test_close_values_spread_over_many_parts(spark):
    """Values near one offset share a magnitude, not a task."""
    from knownby.operators.scale import _value_counts

    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.col("id") + 1.7e9).alias("v"))
    sizes = [r["count"] for r in _value_counts(df, ["g"], "v").groupBy("g", "__b").count().collect()]
    assert len(sizes) > 3 * 200 and max(sizes) < 3 * 200_000 / len(sizes)
    odd = spark.createDataFrame([("a", v) for v in (1e300, -1e300, 0.0, 5.0, 5.0, float("nan"), None)], "g string, v double")
    assert sorted((r["__v"], r["__c"]) for r in _value_counts(odd, ["g"], "v").collect()) == [(-1e300, 1), (0.0, 1), (5.0, 2), (1e300, 1)]


def test_a_normalized_factor_comes_from_one_evaluation_and_one_placing(spark, monkeypatch):
    """Ties, groups that clip to one value, thin groups, nulls: as pandas has them, and no window is left in the plan."""
    from pyspark.sql import Window

    from knownby.operators import scale

    calls = []
    real = scale._value_counts
    monkeypatch.setattr(scale, "_value_counts", lambda *a: calls.append(1) or real(*a))
    rng = np.random.default_rng(5)
    groups = {"ties": rng.integers(0, 6, 80).astype(float), "spread": rng.normal(size=90), "one": np.array([7.0] * 30 + [9.0]), "thin": np.array([1.0, 2.0]), "below": -rng.integers(0, 3, 40) / 3}
    rows = [(g, i, float(v)) for g, vs in groups.items() for i, v in enumerate(vs)] + [("ties", 900, None), ("spread", 901, float("nan"))]
    df = spark.createDataFrame(rows, "d string, id int, v double").withColumn("v", F.max("v").over(Window.partitionBy("d", "id")))
    out = panels.normalize_factor(df, keys=["d"], value="v", lower=0.1, upper=0.9, minimum=5)
    assert len(calls) == 1 and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["d"], r["id"]): (r["winsorized"], r["percentile"], r["zscore"]) for r in out.collect()}
    assert len(got) == len(rows) and got["ties", 900] == got["spread", 901] == got["thin", 0] == (None, None, None)
    for g in ("ties", "spread", "one", "below"):
        v = pd.Series(groups[g])
        clipped = v.clip(v.quantile(0.1), v.quantile(0.9))
        close_to([got[g, i][0] for i in range(len(v))], list(clipped))
        close_to([got[g, i][1] for i in range(len(v))], list(clipped.rank() / len(v)))
        if g != "one":
            close_to([got[g, i][2] for i in range(len(v))], list((clipped - clipped.mean()) / clipped.std(ddof=0)))
