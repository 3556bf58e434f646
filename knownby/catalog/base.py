"""Query registry, proxy views over the driver's tables, and their SQL twins.

The driver's tables hold no market data, so every query starts from a proxy view
that aggregates or renames a whole table. Each proxy is defined once for Spark
and once as a SQL common table expression.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownby.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def register(name: str, sql: Callable[[], str] | None = None, digits: int = 6) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(prepare(spark), sf_dir), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: rounded doubles, text dates and instants, joined arrays."""
    columns = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            c = F.array_join(c, ",")
        columns.append(c.alias(field.name))
    return df.select(*columns)


CTES: dict[str, tuple[Sequence[str], str]] = {}


def cte(name: str, body: str, uses: Sequence[str] = ()) -> None:
    CTES[name] = (uses, body.strip())


def oracle(*args, **kwargs) -> Callable[[], str]:
    """SQL text built on demand, once every proxy is defined."""
    return lambda: sql_text(*args, **kwargs)


def sql_text(body: str, uses: str = "", floats: str = "", dates: str = "", stamps: str = "",
             digits: int = 6) -> str:
    """The needed proxies, the body, and the same presentation as ``present``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for parent in CTES[name][0]:
            visit(parent)
        if name not in order:
            order.append(name)

    for name in uses.split():
        visit(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"result_rows AS ({body.strip()})"]
    shown = [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in floats.split()]
    shown += [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()]
    shown += [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in stamps.split()]
    replace = f" REPLACE ({', '.join(shown)})" if shown else ""
    return f"WITH {', '.join(parts)} SELECT *{replace} FROM result_rows"


# -- Spark proxies -----------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with its zone-less timestamps read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in stamps}) if stamps else df


def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per user from positive event values."""
    return (
        table(spark, sf, "events").where("value > 0")
        .groupBy(F.col("user_id").alias("security_id"), F.to_date("ts").alias("session_date"))
        .agg(
            F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
            F.max("ts").alias("effective_at"),
        )
        .withColumn("available_at", F.col("effective_at") + F.expr("interval 5 minutes"))
    )


cte("bars_daily", """
SELECT user_id AS security_id, CAST(ts AS DATE) AS session_date, arg_min(value, (ts, event_id)) AS open,
       max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
       CAST(count(*) AS DOUBLE) AS volume, max(ts) AS effective_at,
       max(ts) + INTERVAL 5 MINUTE AS available_at
FROM events WHERE value > 0 GROUP BY 1, 2""")


def daily_returns(spark: SparkSession, sf: str) -> DataFrame:
    from knownby.operators.series import simple_returns

    return simple_returns(bars_daily(spark, sf), keys=["security_id"], order="session_date", value="close", name="ret")


cte("daily_returns", """
SELECT *, close / nullif(lag(close) OVER (PARTITION BY security_id ORDER BY session_date), 0) - 1 AS ret
FROM bars_daily""", ["bars_daily"])


def weekly_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Traded amount and units per supplier and week, in whole hundredths.

    Integer sums do not depend on the order of addition; the week is truncated on
    dates, which needs no time-zone arithmetic per row.
    """
    hundredths = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return lines.groupBy(
        F.col("l_suppkey").alias("security_id"), F.trunc(F.col("l_shipdate").cast("date"), "week").alias("session_date")
    ).agg(hundredths("l_extendedprice").alias("amount"), hundredths("l_quantity").alias("units"))


cte("weekly_sums", """
SELECT l_suppkey AS security_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS session_date,
       sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS amount, sum(CAST(round(l_quantity * 100) AS BIGINT)) AS units
FROM lineitem GROUP BY 1, 2""")


def _priced(df: DataFrame) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c not in ("amount", "units")],
        F.try_divide(F.col("amount").cast("double"), F.col("units").cast("double")).alias("close"),
        (F.col("units") / F.lit(100.0)).alias("volume"),
    )


def bars_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return _priced(weekly_sums(spark, sf))


cte("bars_weekly", """
SELECT security_id, session_date, CAST(amount AS DOUBLE) / nullif(CAST(units AS DOUBLE), 0) AS close,
       units / 100.0 AS volume FROM weekly_sums""", ["weekly_sums"])


def supplier_regions(spark: SparkSession, sf: str) -> DataFrame:
    suppliers, nations = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey).select(
        F.col("s_suppkey").alias("security_id"), F.col("n_regionkey").cast("bigint").alias("region"),
        F.col("s_nationkey").cast("bigint").alias("nation"),
    )


cte("supplier_regions", """
SELECT s_suppkey AS security_id, CAST(n_regionkey AS BIGINT) AS region, CAST(s_nationkey AS BIGINT) AS nation
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")


def weekly_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars with own, market and sector (region) returns."""
    from knownby.operators.series import simple_returns

    sums = weekly_sums(spark, sf)
    regions = supplier_regions(spark, sf)
    own = simple_returns(_priced(sums), keys=["security_id"], order="session_date", value="close", name="ret")
    placed = sums.join(regions, "security_id")
    totals = [F.sum("amount").alias("amount"), F.sum("units").alias("units")]
    sector = simple_returns(
        _priced(placed.groupBy("region", "session_date").agg(*totals)), keys=["region"], order="session_date",
        value="close", name="sec_ret",
    ).select("region", "session_date", "sec_ret")
    # The market is the sum of the regions: one short series, not a second scan.
    market = simple_returns(
        _priced(placed.groupBy("session_date").agg(*totals)).withColumn("one", F.lit(1)), keys=["one"],
        order="session_date", value="close", name="mkt_ret",
    ).select("session_date", "mkt_ret")
    return own.join(regions, "security_id").join(market, "session_date", "left").join(
        sector, ["region", "session_date"], "left"
    )


cte("weekly_market", """
SELECT session_date, close / nullif(lag(close) OVER (ORDER BY session_date), 0) - 1 AS mkt_ret
FROM (SELECT session_date, CAST(sum(amount) AS DOUBLE) / nullif(CAST(sum(units) AS DOUBLE), 0) AS close
      FROM weekly_sums GROUP BY 1)""", ["weekly_sums"])
cte("weekly_sector", """
SELECT region, session_date, close / nullif(lag(close) OVER (PARTITION BY region ORDER BY session_date), 0) - 1 AS sec_ret
FROM (SELECT region, session_date, CAST(sum(amount) AS DOUBLE) / nullif(CAST(sum(units) AS DOUBLE), 0) AS close
      FROM weekly_sums JOIN supplier_regions USING (security_id) GROUP BY 1, 2)""", ["weekly_sums", "supplier_regions"])
cte("weekly_panel", """
SELECT b.security_id, b.session_date, b.close, b.volume, r.region, r.nation,
       b.close / nullif(lag(b.close) OVER (PARTITION BY b.security_id ORDER BY b.session_date), 0) - 1 AS ret,
       m.mkt_ret, s.sec_ret
FROM bars_weekly b JOIN supplier_regions r USING (security_id)
LEFT JOIN weekly_market m USING (session_date)
LEFT JOIN weekly_sector s ON s.region = r.region AND s.session_date = b.session_date""",
    ["bars_weekly", "supplier_regions", "weekly_market", "weekly_sector"])


def vintages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("security_id"), F.col("event_type").alias("metric"), F.col("ts").alias("available_at"),
        "value", "event_id",
    )


cte("vintages", "SELECT user_id AS security_id, event_type AS metric, ts AS available_at, value, event_id FROM events")


def contributors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.col("user_id") % 25).alias("security_id"), F.col("event_type").alias("metric"), F.lit("FY").alias("fiscal_period"),
        F.col("user_id").alias("contributor_id"), F.col("value").alias("estimate"), F.col("ts").alias("available_at"),
        "event_id",
    )


cte("contributors", """
SELECT user_id % 25 AS security_id, event_type AS metric, 'FY' AS fiscal_period, user_id AS contributor_id,
       value AS estimate, ts AS available_at, event_id FROM events""")


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: from each order date to the next one."""
    starts = table(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(
        F.min("o_orderkey").alias("order_key"), F.min("o_orderstatus").alias("status"),
        F.min("o_orderpriority").alias("priority"),
    )
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    return starts.select(
        F.col("o_custkey").alias("security_id"), F.col("o_orderdate").alias("valid_from"),
        F.lead("o_orderdate").over(w).alias("valid_to"), "order_key", "status", "priority",
    )


cte("intervals", """
SELECT security_id, valid_from, lead(valid_from) OVER (PARTITION BY security_id ORDER BY valid_from) AS valid_to,
       order_key, status, priority
FROM (SELECT o_custkey AS security_id, o_orderdate AS valid_from, min(o_orderkey) AS order_key,
             min(o_orderstatus) AS status, min(o_orderpriority) AS priority FROM orders GROUP BY 1, 2)""")


def weekly_features(spark: SparkSession, sf: str) -> DataFrame:
    """Long feature vintages per supplier and week, under the registered names."""
    from knownby.operators.series import (
        relative_return, rolling_total_return, rolling_volatility, rolling_zscore, volume_zscore,
    )

    k, t = ["security_id"], "session_date"
    work = weekly_panel(spark, sf)
    work = rolling_zscore(work, keys=k, order=t, value="ret", window=20, minimum=10, name="residual_return_zscore_1d")
    work = volume_zscore(work, keys=k, order=t, volume="volume", window=20, minimum=10, name="dollar_volume_zscore_20d")
    work = rolling_volatility(work, keys=k, order=t, value="ret", window=20, minimum=10, name="realized_volatility_20d")
    work = relative_return(work, asset="ret", benchmark="sec_ret", name="rel")
    work = rolling_total_return(work, keys=k, order=t, value="rel", window=20, minimum=10, name="relative_return_sector_63d")
    cells = F.array(*[F.struct(F.lit(n).alias("feature_name"), F.col(n).alias("value")) for n in FEATURE_NAMES])
    return work.select("security_id", "session_date", F.explode(cells).alias("c")).select(
        "security_id", "c.feature_name", "c.value", F.lit("price-mvp-v0").alias("feature_version"),
        F.lit("equity-mvp-v0").alias("config_version"), F.lit("code-v0").alias("code_version"),
        F.col("session_date").cast("timestamp").alias("effective_at"),
        (F.col("session_date").cast("timestamp") + F.expr("interval 5 days")).alias("available_at"),
        (F.col("session_date").cast("timestamp") + F.expr("interval 6 days")).alias("calculated_at"),
    )


FEATURE_NAMES = (
    "residual_return_zscore_1d", "dollar_volume_zscore_20d", "realized_volatility_20d", "relative_return_sector_63d",
)
_BASE = "OVER (PARTITION BY security_id ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_TRAIL = "OVER (PARTITION BY security_id ORDER BY session_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
cte("weekly_signals", f"""
SELECT security_id, session_date,
  CASE WHEN count(ret) {_BASE} >= 10 AND stddev_samp(ret) {_BASE} > 1e-12
       THEN (ret - avg(ret) {_BASE}) / stddev_samp(ret) {_BASE} END AS residual_return_zscore_1d,
  CASE WHEN count(lv) {_BASE} >= 10 AND stddev_samp(lv) {_BASE} > 1e-12
       THEN (lv - avg(lv) {_BASE}) / stddev_samp(lv) {_BASE} END AS dollar_volume_zscore_20d,
  CASE WHEN count(ret) {_TRAIL} >= 10 THEN stddev_samp(ret) {_TRAIL} * sqrt(252) END AS realized_volatility_20d,
  CASE WHEN count(rel) {_TRAIL} >= 10 THEN product(1 + rel) {_TRAIL} - 1 END AS relative_return_sector_63d
FROM (SELECT *, ln(1 + volume) AS lv, (1 + ret) / nullif(1 + sec_ret, 0) - 1 AS rel FROM weekly_panel)""",
    ["weekly_panel"])
cte("weekly_features", " UNION ALL ".join(
    f"""SELECT security_id, '{n}' AS feature_name, {n} AS value, 'price-mvp-v0' AS feature_version,
        'equity-mvp-v0' AS config_version, 'code-v0' AS code_version, CAST(session_date AS TIMESTAMP) AS effective_at,
        CAST(session_date AS TIMESTAMP) + INTERVAL 5 DAY AS available_at,
        CAST(session_date AS TIMESTAMP) + INTERVAL 6 DAY AS calculated_at FROM weekly_signals"""
    for n in FEATURE_NAMES), ["weekly_signals"])


def cutoff_values(cutoffs: Sequence[str]) -> str:
    """SQL VALUES list of cutoffs."""
    return ", ".join(f"(TIMESTAMP '{c[:19].replace('T', ' ')}')" for c in cutoffs)
