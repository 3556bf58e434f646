"""Feature panels, version pins and declarative screens at one or many cutoffs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownby.functions.numeric import all_of, finite
from knownby.operators.pit import (
    Instant, cutoff_table, instant, ordered_cutoffs, panel_as_of, require_columns,
    refuse, require_unambiguous, with_first_cutoff,
)
from knownby.session import materialize

PANEL_COLUMNS = (
    "decision_at", "security_id", "feature_name", "feature_version", "value", "effective_at",
    "available_at", "calculated_at", "config_version", "code_version",
)

OPERATORS = (
    "greater_than", "greater_than_or_equal", "less_than", "less_than_or_equal", "between", "is_finite",
)


@dataclass(frozen=True)
class Criterion:
    feature: str
    operator: str
    value: float | None = None
    upper: float | None = None

    def __post_init__(self) -> None:
        if not self.feature or self.operator not in OPERATORS:
            raise ValueError("criterion needs a feature and a known operator")
        bounds = (self.value is not None, self.upper is not None)
        wanted = {"is_finite": (False, False), "between": (True, True)}.get(self.operator, (True, False))
        if bounds != wanted:
            raise ValueError(f"wrong bounds for {self.operator}")
        if self.operator == "between" and self.upper < self.value:
            raise ValueError("between upper bound must be >= lower bound")

    def holds(self) -> Column:
        """Two-valued: a missing feature fails the criterion."""
        v = F.col(self.feature)
        test = {
            "greater_than": lambda: v > self.value,
            "greater_than_or_equal": lambda: v >= self.value,
            "less_than": lambda: v < self.value,
            "less_than_or_equal": lambda: v <= self.value,
            "between": lambda: v.between(self.value, self.upper),
            "is_finite": lambda: v.isNotNull(),
        }[self.operator]()
        return F.coalesce(test, F.lit(False))


@dataclass(frozen=True)
class Screen:
    screen_id: str
    criteria: tuple[Criterion, ...]
    rank: tuple[str, str] | None = None
    limit: int = 25
    enabled: bool = True
    missing_policy: str = "exclude"
    requires: tuple[str, ...] = ()
    feature_versions: dict[str, str] = field(default_factory=dict)
    config_version: str | None = None

    def __post_init__(self) -> None:
        if not self.criteria or not 1 <= self.limit <= 10_000:
            raise ValueError("a screen needs criteria and a limit in [1, 10000]")
        if self.missing_policy not in ("exclude", "fail"):
            raise ValueError("missing_policy must be exclude or fail")
        if self.rank is not None and self.rank[1] not in ("ascending", "descending"):
            raise ValueError("rank direction must be ascending or descending")

    @property
    def features(self) -> tuple[str, ...]:
        names = [c.feature for c in self.criteria] + list(self.requires)
        if self.rank is not None:
            names.append(self.rank[0])
        return tuple(dict.fromkeys(names))


# The three shipped screen definitions.
ABNORMAL_RESIDUAL_DECLINE = Screen(
    screen_id="abnormal-residual-decline-v0",
    criteria=(
        Criterion("residual_return_zscore_1d", "less_than_or_equal", -2.0),
        Criterion("dollar_volume_zscore_20d", "greater_than_or_equal", 1.0),
    ),
    rank=("residual_return_zscore_1d", "ascending"),
    feature_versions={
        "residual_return_zscore_1d": "price-mvp-v0",
        "dollar_volume_zscore_20d": "price-mvp-v0",
    },
    config_version="equity-mvp-v0",
)
RELATIVE_STRENGTH_BREAKOUT = Screen(
    screen_id="relative-strength-breakout-v0",
    criteria=(
        Criterion("relative_return_sector_63d", "greater_than_or_equal", 0.05),
        Criterion("realized_volatility_20d", "is_finite"),
    ),
    rank=("relative_return_sector_63d", "descending"),
    feature_versions={
        "relative_return_sector_63d": "price-mvp-v0",
        "realized_volatility_20d": "price-mvp-v0",
    },
    config_version="equity-mvp-v0",
)
CHEAP_POSITIVE_REVISIONS = Screen(
    screen_id="cheap-positive-revisions-v0",
    enabled=False,
    criteria=(
        Criterion("eps_revision_breadth_20d", "greater_than", 0.30),
        Criterion("forward_pe_zscore_5y", "less_than", 0.0),
        Criterion("residual_momentum_20d", "greater_than", 0.0),
    ),
    rank=("eps_revision_breadth_20d", "descending"),
    requires=("eps_revision_breadth_20d", "forward_pe_zscore_5y", "residual_momentum_20d"),
    feature_versions={
        "eps_revision_breadth_20d": "estimates-mvp-v0",
        "forward_pe_zscore_5y": "valuation-mvp-v0",
        "residual_momentum_20d": "price-mvp-v0",
    },
    config_version="equity-estimates-v0",
)
SHIPPED = (ABNORMAL_RESIDUAL_DECLINE, RELATIVE_STRENGTH_BREAKOUT, CHEAP_POSITIVE_REVISIONS)

# The registered price features (name, version, unit, inputs, sessions needed).
PRICE_FEATURES = (
    ("daily_return", "price-mvp-v0", "decimal_return", "adjusted_close", 2),
    ("residual_return_zscore_1d", "price-mvp-v0", "zscore", "adjusted_close,benchmark_returns", 64),
    ("dollar_volume_zscore_20d", "price-mvp-v0", "zscore", "close,volume", 21),
    ("realized_volatility_20d", "price-mvp-v0", "annualized_decimal", "adjusted_close", 21),
    ("beta_126d", "price-mvp-v0", "coefficient", "adjusted_close,market_returns", 64),
    ("relative_return_sector_63d", "price-mvp-v0", "decimal_return", "adjusted_close,sector_returns", 64),
)


def price_feature_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(PRICE_FEATURES),
        "feature_name string, feature_version string, unit string, required_inputs string, "
        "minimum_history_sessions int",
    )


def redefined_features(definitions: DataFrame) -> DataFrame:
    """(name, version) pairs registered with more than one definition."""
    keys = ["feature_name", "feature_version"]
    body = F.struct(*[c for c in definitions.columns if c not in keys])
    return definitions.groupBy(*keys).agg(F.count_distinct(body).alias("definitions")).where("definitions > 1")


def pin_issues(screens: Sequence[Screen], registry: DataFrame) -> DataFrame:
    """Missing, unused and unknown version pins of each screen, from specs and registry alone."""
    spark = registry.sparkSession
    rows = [
        (s.screen_id, name, s.feature_versions.get(name), name in s.features, name in s.feature_versions)
        for s in screens for name in dict.fromkeys([*s.features, *s.feature_versions])
    ]
    pins = spark.createDataFrame(
        rows, "screen_id string, feature_name string, feature_version string, used boolean, pinned boolean"
    )
    known = registry.select("feature_name", "feature_version", F.lit(True).alias("known"))
    joined = pins.join(known, ["feature_name", "feature_version"], "left")
    issue = (
        F.when(~F.col("pinned"), "missing_pin").when(~F.col("used"), "unused_pin")
        .when(F.col("known").isNull(), "unknown_version")
    )
    return joined.select("screen_id", "feature_name", "feature_version", issue.alias("issue")).where(
        "issue is not null"
    )


def validated_pins(screen: Screen) -> dict[str, str]:
    """Pins of a screen, checked on the driver before any data is read."""
    if not screen.config_version:
        raise ValueError("config_version is required for a version-pinned screen")
    missing = sorted(set(screen.features) - set(screen.feature_versions))
    unused = sorted(set(screen.feature_versions) - set(screen.features))
    if missing or unused:
        raise ValueError(f"feature version pins missing {missing}, unused {unused}")
    return dict(screen.feature_versions)


def require_enabled(screen: Screen) -> None:
    if not screen.enabled:
        raise ValueError(f"screen {screen.screen_id!r} is disabled")


def snapshots_to_panel(snapshots: DataFrame, *, decision_at: Instant) -> DataFrame:
    """Rows in the columns of a panel, ordered by security and feature.

    A sort looks at its rows twice, for the bounds of its ranges and to deal them out, so they are stored first.
    """
    panel = snapshots.select(*[c for c in PANEL_COLUMNS if c != "decision_at"])
    return materialize(panel).withColumn("decision_at", instant(decision_at)).select(*PANEL_COLUMNS).orderBy("security_id", "feature_name")


def _judge(wide: DataFrame, screen: Screen) -> DataFrame:
    missing = F.lit(False)
    for name in screen.features:
        missing = missing | F.col(name).isNull()
    if screen.missing_policy == "fail":
        refuse(wide.where(missing).select("security_id"), "missing screen inputs")
        missing = F.lit(False)
    return wide.withColumn("excluded_for_missing_data", missing).withColumn(
        "matches", all_of([c.holds() for c in screen.criteria])
    )


def run_screen(features: DataFrame, screen: Screen, *, as_of: Instant,
               tie_break: Sequence[str] = ()) -> DataFrame:
    """Every security with a known referenced feature: values, missing flag, match flag.

    The newest vintage of every feature is picked and pivoted in one aggregation
    per security.
    """
    require_enabled(screen)
    require_columns(features, ["security_id", "feature_name", "value", "available_at", *tie_break])
    known = features.where(
        F.col("feature_name").isin(*screen.features) & (F.col("available_at") <= instant(as_of))
    )
    return _judge(newest_values(known, screen, tie_break).withColumn("as_of", instant(as_of)), screen)


def newest_values(known: DataFrame, screen: Screen, tie_break: Sequence[str] = ()) -> DataFrame:
    """The newest value of every feature of the screen, one row per security; an aggregation, over a table or a stream.

    The value breaks the last tie, so the order in which rows arrive never shows.
    """
    order = F.struct("available_at", *tie_break, finite("value"))
    return known.groupBy("security_id").agg(
        *[
            F.max_by(finite("value"), F.when(F.col("feature_name") == name, order)).alias(name)
            for name in screen.features
        ]
    )


def judged(wide: DataFrame, screen: Screen, *, as_of: Instant) -> DataFrame:
    """Rows of ``newest_values`` with missing and match flags at the cutoff."""
    return _judge(wide.withColumn("as_of", instant(as_of)), screen)


def screen_matches(evaluated: DataFrame, screen: Screen) -> DataFrame:
    """Top matches per cutoff in rank order (nulls last), with ``match_rank``.

    The rank filter becomes a per-task top-k before the shuffle, so no cutoff's
    full match list meets in one task.
    """
    if screen.rank is None:
        order = [F.col("security_id")]
    else:
        name, direction = screen.rank
        c = F.col(name)
        order = [c.asc_nulls_last() if direction == "ascending" else c.desc_nulls_last(), F.col("security_id")]
    ranked = evaluated.where("matches").withColumn(
        "match_rank", F.row_number().over(Window.partitionBy("as_of").orderBy(*order))
    )
    return ranked.where(F.col("match_rank") <= screen.limit)


def evaluate_pinned(features: DataFrame, screen: Screen, universe: DataFrame, *, as_of: Instant) -> DataFrame:
    """Version-pinned screen over a requested universe; absent securities appear as missing."""
    require_enabled(screen)
    pins = validated_pins(screen)
    spark = features.sparkSession
    pin_table = spark.createDataFrame(list(pins.items()), "feature_name string, feature_version string")
    wanted = universe.select("security_id").distinct()
    panel = require_unambiguous(
        panel_as_of(features, pins=pin_table, as_of=as_of, config_version=screen.config_version, securities=wanted)
    )
    wide = panel.groupBy("security_id").agg(
        *[F.max(F.when(F.col("feature_name") == n, finite("value"))).alias(n) for n in screen.features],
    )
    full = wanted.join(wide, "security_id", "left")
    return _judge(full.withColumn("as_of", instant(as_of)), screen)


def screen_history(features: DataFrame, screen: Screen, *, cutoffs: Sequence[Instant],
                   tie_break: Sequence[str] = ()) -> DataFrame:
    """``run_screen`` at every cutoff in one plan.

    Vintages are reduced to the newest per (security, first cutoff knowing it,
    feature); values then carry forward over the cutoffs of each security.
    """
    require_enabled(screen)
    total = len(ordered_cutoffs(cutoffs))
    picked = features.where(F.col("feature_name").isin(*screen.features))
    indexed = with_first_cutoff(picked, cutoffs, available="available_at")
    order = F.struct("available_at", *tie_break)
    boxed = F.struct(finite("value").alias("v"))
    changes = indexed.groupBy("security_id", "cutoff_index").agg(
        *[
            F.max_by(boxed, F.when(F.col("feature_name") == name, order)).alias(name)
            for name in screen.features
        ]
    )
    w = Window.partitionBy("security_id").orderBy("cutoff_index")
    carried = changes.select(
        "security_id",
        "cutoff_index",
        F.lead("cutoff_index", 1, total).over(w).alias("__until"),
        *[
            F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).getField("v").alias(name)
            for name in screen.features
        ],
    )
    spread = carried.withColumn(
        "cutoff_index", F.explode(F.sequence(F.col("cutoff_index"), F.col("__until") - 1))
    ).drop("__until")
    dated = spread.join(cutoff_table(features.sparkSession, cutoffs), "cutoff_index").drop("cutoff_index")
    return _judge(dated, screen)
