"""Order statistics and running values without one-task groups.

A window partitioned by a hot key sorts that whole key in one task, and the
built-in exact percentile keeps every distinct value of a group in one buffer.
The operators here instead cut each group into many buckets by a *monotone* and
*deterministic* function of the ordering value:

1. pre-aggregate, so equal values of a group travel as one counted row;
2. order inside a bucket (parallel over buckets);
3. carry totals across buckets with a window over one small row per bucket.

Because the bucket function is monotone the results are exact whatever the data
looks like. It depends on the row and on stored cuts alone, so a recomputed task
after a lost executor reproduces the same bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownby.functions.numeric import all_of, finite, ratio
from knownby.session import materialize

# Buckets per e-fold of magnitude: about 0.05 % relative width.
_RESOLUTION = 2000
# Larger than the resolution times the largest |ln(double)|, so signs never mix.
_OFFSET = 1_600_000
# Parts that a group is cut into, at quantiles of its own values.
PARTS = 256


def magnitude_bucket(value: Column) -> Column:
    """Monotone map of a finite double to a logarithmically spaced bucket number, for values spread over magnitudes."""
    step = F.floor(F.ln(F.abs(value)) * F.lit(_RESOLUTION)) + F.lit(_OFFSET)
    return (
        F.when(value > 0, step).when(value < 0, -step).when(value == 0, F.lit(0)).cast("bigint")
    )


def attach(df: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-key facts onto rows, treating null keys as equal.

    No broadcast hint: Spark broadcasts the facts when their size allows it and
    otherwise shuffles, splitting skewed partitions of the row side.
    """
    if not keys:
        # Facts of an ungrouped table are a single row.
        return df.join(facts, F.lit(True), how)
    renamed = facts.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[F.col(c) for c in facts.columns if c not in keys],
    )
    on = all_of([F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return df.join(renamed, on, how).drop(*[f"__k_{k}" for k in keys])


def _value_counts(df: DataFrame, keys: Sequence[str], value: Column | str) -> DataFrame:
    """One row per distinct finite value of a group, with its multiplicity and rank start."""
    rows = df.select(*keys, finite(value).alias("__v")).where(F.col("__v").isNotNull())
    counted = rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    # Close values, offsets and outliers alike: the cuts follow the group's own distribution. They only decide which
    # task sees a value, so approximate quantiles, merged from every task's summary, leave the results exact. They are
    # written once, because a summary computed again could differ and move values between parts.
    cuts = materialize(rows.groupBy(*keys).agg(
        F.percentile_approx("__v", [i / PARTS for i in range(1, PARTS)], F.lit(10 * PARTS)).alias("__cuts")
    ))
    part = F.size(F.filter("__cuts", lambda c: c < F.col("__v"))).cast("bigint")
    return attach(counted, cuts, keys).withColumn("__b", part).select(*keys, "__b", "__v", "__c")


def _bucket_offsets(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the group below each bucket, and rows of the group overall."""
    per_bucket = counted.groupBy(*keys, "__b").agg(F.sum("__c").alias("__bc"))
    # One row per (group, bucket): bounded by the bucket range, not by the data.
    order = Window.partitionBy(*keys).orderBy("__b")
    return per_bucket.select(
        *keys,
        "__b",
        "__bc",
        (F.sum("__bc").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__bc")).alias(
            "__below"
        ),
        F.sum("__bc").over(Window.partitionBy(*keys)).alias("__n"),
    )


def value_positions(df: DataFrame, *, keys: Sequence[str], value: Column | str) -> DataFrame:
    """Distinct values of each group with the rank interval [first, last] they occupy.

    Output: keys, value, first, last (1-based, inclusive), n (finite values of the group).
    """
    counted = _value_counts(df, keys, value)
    offsets = _bucket_offsets(counted, keys)
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = counted.withColumn("__cum", F.sum("__c").over(inside))
    joined = attach(local, offsets, [*keys, "__b"], "inner")
    last = F.col("__below") + F.col("__cum")
    return joined.select(
        *keys,
        F.col("__v").alias("value"),
        (last - F.col("__c") + 1).alias("first"),
        last.alias("last"),
        F.col("__n").alias("n"),
    )


def average_rank(
    df: DataFrame,
    *,
    keys: Sequence[str],
    value: str,
    rank: str = "rank",
    count: str = "rank_count",
) -> DataFrame:
    """Attach the average rank of each finite value and the finite count of its group.

    The input is read for the counts and again for the rows; ``materialize`` a
    costly one first.
    """
    ranks = value_positions(df, keys=keys, value=value).select(
        *keys,
        F.col("value").alias("__v"),
        ((F.col("first") + F.col("last")) / F.lit(2.0)).alias(rank),
        F.col("n").alias(count),
    )
    return attach(df.withColumn("__v", finite(value)), ranks, [*keys, "__v"]).drop("__v")


def exact_quantiles(
    df: DataFrame, *, keys: Sequence[str], value: Column | str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one output column per entry."""
    for q in quantiles.values():
        if not 0.0 <= q <= 1.0:
            raise ValueError("quantiles must lie between zero and one")
    counted = _value_counts(df, keys, value)
    offsets = _bucket_offsets(counted, keys)
    hit = F.lit(False)
    for q in quantiles.values():
        place = (F.col("__n") - 1) * F.lit(float(q))
        for position in (F.floor(place), F.ceil(place)):
            hit = hit | ((position >= F.col("__below")) & (position < F.col("__below") + F.col("__bc")))
    # Only buckets that contain a wanted rank are ordered in full.
    candidates = attach(counted, offsets.where(hit), [*keys, "__b"], "inner")
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = candidates.withColumn(
        "__end", F.col("__below") + F.sum("__c").over(inside)
    ).withColumn("__start", F.col("__end") - F.col("__c"))
    return _interpolated(placed, keys, quantiles)


def placed_quantiles(places: DataFrame, *, keys: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """``exact_quantiles`` of values whose ``value_positions`` are at hand."""
    placed = places.select(
        *keys, F.col("value").alias("__v"), (F.col("first") - 1).alias("__start"), F.col("last").alias("__end"), F.col("n").alias("__n")
    )
    return _interpolated(placed, keys, quantiles)


def _interpolated(placed: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """Quantiles from values that hold the places ``__start`` to ``__end``, exclusive, of ``__n``."""
    picked: list[Column] = [F.max("__n").alias("__n")]
    outputs = []
    for name, q in quantiles.items():
        place = (F.col("__n") - 1) * F.lit(float(q))
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (at >= F.col("__start")) & (at < F.col("__end"))
            picked.append(F.max(F.when(here, F.col("__v"))).alias(f"{name}__{side}"))
        low, high = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        outputs.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return placed.groupBy(*keys).agg(*picked).select(*keys, *outputs)


def running_position(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = "position",
    count: str | None = None,
) -> DataFrame:
    """1-based position of each row in its group; ``bucket`` is monotone in the first order column."""
    rows = df.withColumn("__b", bucket)
    per_bucket = rows.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__bc"))
    order_buckets = Window.partitionBy(*keys).orderBy("__b")
    offsets = per_bucket.select(
        *keys,
        "__b",
        (
            F.sum("__bc").over(order_buckets.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("__bc")
        ).alias("__below"),
        F.sum("__bc").over(Window.partitionBy(*keys)).alias("__n"),
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    placed = attach(
        rows.withColumn("__r", F.row_number().over(inside)), offsets, [*keys, "__b"], "inner"
    ).withColumn(name, F.col("__below") + F.col("__r"))
    if count is not None:
        placed = placed.withColumn(count, F.col("__n"))
    return placed.drop("__b", "__r", "__below", "__n")


def running_fold(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: Column,
    kind: str,
    name: str,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum, max or min in order, carried across buckets of one group."""
    fold = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
    rows = df.withColumn("__b", bucket).withColumn("__x", value)
    before = Window.unboundedPreceding
    carried = (
        rows.groupBy(*keys, "__b")
        .agg(fold("__x").alias("__t"))
        .select(
            *keys,
            "__b",
            fold("__t")
            .over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(before, -1))
            .alias("__carry"),
        )
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(
        before, 0 if inclusive else -1
    )
    joined = attach(rows.withColumn("__own", fold("__x").over(inside)), carried, [*keys, "__b"])
    if kind == "sum":
        combined = F.when(
            F.col("__own").isNotNull() | F.col("__carry").isNotNull(),
            F.coalesce("__own", F.lit(0.0)) + F.coalesce("__carry", F.lit(0.0)),
        )
    else:
        combined = (F.greatest if kind == "max" else F.least)(F.col("__own"), F.col("__carry"))
    return joined.withColumn(name, combined).drop("__b", "__x", "__own", "__carry")


def group_moments(
    df: DataFrame, *, keys: Sequence[str], value: Column | str, ddof: int, prefix: str = "__g"
) -> DataFrame:
    """Count, mean and standard deviation per group by partial aggregation."""
    number = finite(value)
    spread = F.stddev_pop(number) if ddof == 0 else F.sqrt(
        F.var_pop(number) * ratio(F.count(number).cast("double"), F.count(number) - F.lit(ddof))
    )
    return df.groupBy(*keys).agg(
        F.count(number).alias(f"{prefix}_n"),
        F.avg(number).alias(f"{prefix}_mean"),
        F.when(F.count(number) > ddof, spread).alias(f"{prefix}_sd"),
    )
