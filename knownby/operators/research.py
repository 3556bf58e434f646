"""Findings, materiality scores, evidence and ranked research cards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knownby.functions.ids import iso_instant, research_id
from knownby.functions.numeric import finite, fixed_digits
from knownby.operators.pit import Instant, availability_violations, instant
from knownby.operators.scale import attach

# Tiers and confidence levels from lowest to highest.
TIERS = ("routine", "watch", "material", "critical")
CONFIDENCE = ("low", "medium", "high")

# Default materiality configuration.
DEFAULT_WEIGHTS = {
    "estimate_change": 0.20,
    "abnormal_price": 0.15,
    "abnormal_volume": 0.10,
    "valuation_change": 0.10,
    "factor_change": 0.10,
    "fundamental_change": 0.10,
    "event_novelty": 0.10,
    "thesis_relevance": 0.15,
}
DEFAULT_LABELS = (("critical", 0.80), ("material", 0.65), ("watch", 0.30), ("routine", 0.0))

# Wording of findings and cards.
PRICE_TITLE = "Abnormal residual price move"
PRICE_CHANGE = "The latest return was a {} residual outlier after market and sector controls."
VOLUME_TITLE = "Unusual trading volume"
VOLUME_CHANGE = "Latest volume was unusual relative to its trailing history."
DAILY_TITLE = "Daily quantitative snapshot"
DAILY_CHANGE = "Daily price, relative-return, and risk diagnostics were refreshed."
PRICE_QUESTION = (
    "Is the residual move explained by new fundamental evidence or a temporary dislocation?"
)
VOLUME_QUESTION = "What catalyst or positioning change explains the abnormal volume?"
OTHER_QUESTION = "Which new data would most change the current research thesis?"
PRICE_RISK = "The cause of the residual move is not yet resolved."
CONTRIBUTION_NOTE = (
    "Contribution is a simple weight x return estimate, not accounting-grade attribution."
)
BRIEF_HEAD = "# Morning research brief\n\n"
BRIEF_EMPTY = "No material quantitative developments at this cutoff.\n"

# Metric name, snapshot column, unit, horizon.
METRICS = (
    ("daily_return", "daily_return", "decimal_return", "1d"),
    ("residual_return", "residual_return", "decimal_return", "1d"),
    ("residual_return_zscore", "residual_zscore", "zscore", "1d"),
    ("volume_zscore", "volume_zscore", "zscore", "1d"),
    ("realized_volatility", "realized_volatility_20d", "annualized_decimal", "20d"),
    ("beta", "beta_126d", "coefficient", "126d"),
    ("relative_return_sector", "relative_return_sector_63d", "decimal_return", "63d"),
)


@dataclass(frozen=True)
class Materiality:
    """Component weights (summing to one), priority modifier and descending tier thresholds."""

    weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    labels: Sequence[tuple[str, float]] = DEFAULT_LABELS
    k: float = 1.0
    unheld_position_weight: float = 0.0
    maximum_position_weight: float = 10.0
    input_min: float = 0.0
    input_max: float = 1.0
    version: str = "materiality-v0"

    def __post_init__(self) -> None:
        if abs(sum(self.weights.values()) - 1.0) > 1e-9 or min(self.weights.values()) < 0:
            raise ValueError("component weights must be non-negative and sum to one")
        floors = [f for _, f in self.labels]
        if floors != sorted(floors, reverse=True) or floors[-1] != 0.0 or len(set(floors)) != len(floors):
            raise ValueError("labels must descend to zero")
        if any(name not in TIERS for name, _ in self.labels):
            raise ValueError("unsupported materiality label")


def score_materiality(df: DataFrame, config: Materiality, components: Mapping[str, str], *,
                      position_weight: str | None = None) -> DataFrame:
    """Adds raw_score, completeness, priority_modifier, priority_score, materiality_tier.

    A missing component contributes zero. ``score_violation`` names the first
    component outside its input range.
    """
    unknown = sorted(set(components) - set(config.weights))
    if unknown:
        raise ValueError(f"unknown materiality components: {', '.join(unknown)}")
    raw, present, violation = F.lit(0.0), F.lit(0.0), F.lit(None).cast("string")
    for name, weight in config.weights.items():
        if name not in components:
            continue
        value = F.col(components[name]).cast("double")
        usable = finite(value).between(config.input_min, config.input_max)
        raw = raw + F.coalesce(F.when(usable, value * F.lit(weight)), F.lit(0.0))
        present = present + F.when(value.isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))
        bad = value.isNotNull() & ~F.coalesce(usable, F.lit(False))
        violation = F.coalesce(violation, F.when(bad, F.lit(name)))
    held = F.lit(None).cast("double") if position_weight is None else F.col(position_weight).cast("double")
    relevance = F.when(held.isNull(), F.lit(config.unheld_position_weight)).otherwise(
        F.least(F.abs(held), F.lit(config.maximum_position_weight))
    )
    tier = F.lit(None).cast("string")
    for name, floor in reversed(list(config.labels)):
        tier = F.when(F.col("raw_score") >= F.lit(floor), F.lit(name)).otherwise(tier)
    total = sum(config.weights.values())
    return (
        df.withColumn("raw_score", raw)
        .withColumn("completeness", present / F.lit(total))
        .withColumn("priority_modifier", F.lit(1.0) + F.lit(config.k) * F.sqrt(relevance))
        .withColumn("priority_score", F.col("raw_score") * F.col("priority_modifier"))
        .withColumn("materiality_tier", tier)
        .withColumn("score_violation", violation)
    )


def price_components(df: DataFrame) -> DataFrame:
    """Materiality inputs of a price snapshot, each in [0, 1] or missing."""
    def capped(c: str, full: float) -> Column:
        v = finite(c)
        return F.when(v.isNotNull(), F.least(F.abs(v) / F.lit(full), F.lit(1.0)))

    out = df.withColumns(
        {
            "abnormal_price": capped("residual_zscore", 4.0),
            "abnormal_volume": capped("volume_zscore", 4.0),
            "factor_change": capped("relative_return_sector_63d", 0.20),
        }
    )
    return out.withColumn("event_novelty", F.greatest("abnormal_price", "abnormal_volume"))


PRICE_COMPONENTS = {
    name: name for name in ("abnormal_price", "abnormal_volume", "factor_change", "event_novelty")
}


def build_price_findings(snapshots: DataFrame, config: Materiality, *,
                         position_weight: str | None = "position_weight") -> DataFrame:
    """One finding per price snapshot: category, wording, metrics, score, tier, confidence."""
    scored = score_materiality(
        price_components(snapshots), config, PRICE_COMPONENTS, position_weight=position_weight
    )
    z, v = F.col("residual_zscore"), F.col("volume_zscore")
    price = F.coalesce(F.abs(z) >= 2.0, F.lit(False))
    volume = ~price & F.coalesce(F.abs(v) >= 2.0, F.lit(False))
    side = F.when(z < 0, "negative").otherwise("positive")
    metrics = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(source).isNotNull(),
                    F.struct(
                        F.lit(name).alias("name"), F.col(source).alias("value"), F.lit(unit).alias("unit"),
                        F.lit(horizon).alias("horizon"), F.col("as_of").alias("as_of"),
                    ),
                )
                for name, source, unit, horizon in METRICS
            ]
        )
    )
    key = F.concat(
        F.lit("daily-price:"), F.col("research_run_id"), F.lit(":"), F.col("security_id").cast("string"),
        F.lit(":"), iso_instant("as_of"),
    )
    before, after = PRICE_CHANGE.split("{}")
    return (
        scored.withColumn("finding_key", key)
        .withColumn("finding_id", research_id("finding", F.col("finding_key")))
        .withColumn(
            "category",
            F.when(price, "price_anomaly").when(volume, "volume_anomaly").otherwise("other"),
        )
        .withColumn("direction", F.when(price, side).when(volume, F.when(v > 0, "high").otherwise("low")))
        .withColumn(
            "title", F.when(price, PRICE_TITLE).when(volume, VOLUME_TITLE).otherwise(DAILY_TITLE)
        )
        .withColumn(
            "change",
            F.when(price, F.concat(F.lit(before), side, F.lit(after)))
            .when(volume, VOLUME_CHANGE).otherwise(DAILY_CHANGE),
        )
        .withColumn("metrics", metrics)
        .withColumn(
            "confidence",
            F.when((F.col("observations") >= 252) & (F.col("completeness") >= 0.35), "high")
            .when(F.col("observations") >= 126, "medium").otherwise("low"),
        )
    )


def price_bar_evidence(bars: DataFrame) -> DataFrame:
    """One evidence reference per provider record vintage."""
    key = F.concat_ws(":", F.col("source"), F.col("source_record_id"), iso_instant("available_at"))
    named = bars.select(
        research_id("evidence", key).alias("evidence_id"), F.lit("market_data").alias("source_type"),
        F.col("source").alias("provider"), "source_record_id", "effective_at", "available_at", "ingested_at",
    )
    return named.dropDuplicates(["evidence_id"])


def evidence_violations(evidence: DataFrame, *, data_cutoff_at: Instant) -> DataFrame:
    """Evidence that was not knowable at the data cutoff."""
    return availability_violations(
        evidence.withColumn("__cutoff", instant(data_cutoff_at)), decision="__cutoff"
    ).drop("__cutoff")


def _level(names: Sequence[str], column: str) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))


def _level_name(names: Sequence[str], position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), position.cast("int"))


def build_cards(findings: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Merge findings into one card per (run, security).

    Findings are ordered by falling priority, then key. The first metric per
    (name, horizon) wins, the tier is the highest and the confidence the lowest.
    ``context`` may carry position_weight, daily_return, benchmark_return,
    sector_return, data_cutoff_at, created_at per (research_run_id, security_id).
    """
    keys = ["research_run_id", "security_id"]
    order = F.struct((-F.col("priority_score")).alias("p"), F.col("finding_key").alias("k"))
    ordered = findings.withColumn("__o", order)
    metric = (
        ordered.select(*keys, "__o", F.explode("metrics").alias("__m"))
        .groupBy(*keys, "__m.name", "__m.horizon").agg(F.min_by("__m", "__o").alias("__m"))
        .groupBy(*keys)
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("__m.name", "__m.horizon", F.col("__m").alias("m")))),
                lambda x: x["m"],
            ).alias("quant_evidence")
        )
    )
    evidence = (
        ordered.select(*keys, F.explode("evidence_ids").alias("__e")).distinct()
        .groupBy(*keys).agg(F.array_sort(F.collect_list("__e")).alias("evidence_ids"))
    )
    lead = F.min_by(F.struct("category", "finding_id", "as_of"), F.col("__o"))
    listed = F.array_sort(F.collect_list(F.struct("__o", "finding_id", "change")))
    cards = ordered.groupBy(*keys).agg(
        lead.alias("__lead"),
        listed.alias("__list"),
        F.max(_level(TIERS, "materiality_tier")).alias("__tier"),
        F.min(_level(CONFIDENCE, "confidence")).alias("__confidence"),
    )
    cards = attach(attach(cards, metric, keys), evidence, keys)
    if context is not None:
        cards = attach(cards, context, keys)
    for name in ("position_weight", "daily_return", "benchmark_return", "sector_return"):
        if name not in cards.columns:
            cards = cards.withColumn(name, F.lit(None).cast("double"))
    contribution = F.col("position_weight") * F.col("daily_return") * F.lit(10_000.0)
    category = F.col("__lead.category")
    card_key = F.concat(
        F.lit("daily-card:"), F.col("research_run_id"), F.lit(":"), F.col("security_id").cast("string"),
        F.lit(":"), iso_instant(F.col("__lead.as_of")),
    )
    return (
        cards.withColumn("as_of", F.col("__lead.as_of"))
        .withColumn("card_key", card_key)
        .withColumn("card_id", research_id("card", F.col("card_key")))
        .withColumn("materiality_tier", _level_name(TIERS, F.col("__tier")))
        .withColumn("confidence", _level_name(CONFIDENCE, F.col("__confidence")))
        .withColumn(
            "change",
            F.array_join(F.array_distinct(F.transform("__list", lambda x: x["change"])), " "),
        )
        .withColumn("finding_ids", F.transform("__list", lambda x: x["finding_id"]))
        .withColumn("lead_finding_id", F.col("__lead.finding_id"))
        .withColumn("contribution_bps", contribution)
        .withColumn(
            "notes", F.array_compact(F.array(F.when(contribution.isNotNull(), F.lit(CONTRIBUTION_NOTE))))
        )
        .withColumn("thesis_impact", F.lit("none"))
        .withColumn("key_risk_or_opportunity", F.when(category == "price_anomaly", PRICE_RISK))
        .withColumn(
            "next_research_question",
            F.when(category == "price_anomaly", PRICE_QUESTION)
            .when(category == "volume_anomaly", VOLUME_QUESTION).otherwise(OTHER_QUESTION),
        )
        .withColumn("renderer_version", F.lit("deterministic-card-v0"))
        .drop("__lead", "__list", "__tier", "__confidence")
    )


def render_card_markdown(cards: DataFrame, *, label: str = "security_label", name: str = "markdown") -> DataFrame:
    """Card text as one string expression per row."""
    def line(m: Column) -> Column:
        v, unit = m["value"], m["unit"]
        shown = (
            F.when(unit.isin("decimal_return", "annualized_decimal"), F.format_string("%.2f%%", fixed_digits(v * 100, 2)))
            .when(unit == "basis_points", F.format_string("%.1f bps", fixed_digits(v * 10_000, 1)))
            .when(unit == "zscore", F.format_string("%+.2f sigma", fixed_digits(v, 2)))
            .otherwise(F.format_string("%.3f", fixed_digits(v, 3)))
        )
        horizon = F.when(m["horizon"].isNotNull() & (m["horizon"] != ""), F.concat(F.lit(" ("), m["horizon"], F.lit(")"))).otherwise("")
        return F.concat(F.lit("- "), m["name"], horizon, F.lit(": "), shown)

    evidence = F.array_join(F.transform("quant_evidence", line), "\n")
    weight = F.when(
        F.col("position_weight").isNotNull(),
        F.format_string(
            "- Position weight: %.2f%%", fixed_digits(F.col("position_weight").cast("double") * 100, 2)
        ),
    )
    gain = F.when(
        F.col("contribution_bps").isNotNull(),
        F.format_string("- Indicative daily contribution: %+.1f bps", fixed_digits(F.col("contribution_bps"), 1)),
    )
    noted = F.transform("notes", lambda x: F.concat(F.lit("- "), x))
    context = F.array_join(F.concat(F.array_compact(F.array(weight, gain)), noted), "\n")
    or_else = lambda c, text: F.when(F.coalesce(c, F.lit("")) == "", F.lit(text)).otherwise(c)
    return cards.withColumn(
        name,
        F.concat(
            F.lit("# "), F.col(label), F.lit(" — "), F.upper("materiality_tier"),
            F.lit("\n\n## Change\n\n"), F.col("change"),
            F.lit("\n\n## Quant evidence\n\n"), or_else(evidence, "- No displayable metric."),
            F.lit("\n\n## Context\n\n"), or_else(context, "- Not held or holdings context unavailable."),
            F.lit("\n\n## Thesis impact\n\n"), F.initcap("thesis_impact"),
            F.lit("\n\n## Confidence\n\n"), F.initcap("confidence"),
            F.lit("\n\n## Next research question\n\n"),
            F.coalesce("next_research_question", F.lit("Insufficient evidence.")), F.lit("\n"),
        ),
    )


def morning_brief(cards: DataFrame, *, label: str = "security_label", limit: int = 8) -> DataFrame:
    """The brief as one row: the top non-routine cards, rendered in order."""
    if limit < 1:
        raise ValueError("limit must be positive")
    rank = -_level(TIERS, "materiality_tier")
    top = (
        render_card_markdown(cards.where("materiality_tier <> 'routine'"), label=label)
        .select(
            F.struct(rank.alias("r"), F.col("as_of"), F.col("security_id").cast("string").alias("s"), "markdown").alias("__c")
        )
        .orderBy("__c").limit(limit)
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("__c")), lambda x: x["markdown"]), "\n\n---\n\n")
    return top.agg(F.count(F.lit(1)).alias("cards"), joined.alias("__body")).select(
        "cards",
        F.concat(F.lit(BRIEF_HEAD), F.when(F.col("cards") > 0, F.col("__body")).otherwise(BRIEF_EMPTY)).alias("brief"),
    )


def inbox(cards: DataFrame, *, minimum_tier: str = "watch") -> DataFrame:
    """Cards at or above a tier, highest tier first and newest first within it."""
    if minimum_tier not in TIERS:
        raise ValueError("unknown tier")
    level = _level(TIERS, "materiality_tier")
    return cards.where(level >= TIERS.index(minimum_tier) + 1).orderBy(level.desc(), F.col("as_of").desc(), "card_id")


FEEDBACK_KINDS = ("useful", "noise", "already_known", "wrong", "investigate")  # fixed values


def feedback_counts(cards: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback of each kind per card; feedback is reduced before it meets the cards."""
    counts = feedback.groupBy("card_id").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in FEEDBACK_KINDS]
    )
    joined = cards.join(counts, "card_id", "left")
    return joined.fillna(0, subset=list(FEEDBACK_KINDS))


def structured_query(findings: DataFrame, *, security_ids: Sequence[str] = (),
                     categories: Sequence[str] = (), minimum_materiality: float = 0.0,
                     limit: int = 20) -> DataFrame:
    """Allow-listed retrieval over findings, most material first."""
    if not 0.0 <= minimum_materiality <= 1.0 or not 1 <= limit <= 200:
        raise ValueError("minimum_materiality must be in [0, 1] and limit in [1, 200]")
    picked = findings.where(F.col("raw_score") >= minimum_materiality)
    if security_ids:
        picked = picked.where(F.col("security_id").cast("string").isin(*security_ids))
    if categories:
        picked = picked.where(F.col("category").isin(*categories))
    return picked.orderBy(F.col("raw_score").desc(), F.col("finding_key")).limit(limit)
