import tempfile

import pytest
from conftest import utc
from pyspark.sql import functions as F

from knownby.plans import daily, workflows
from knownby.sources import appends, bars, contracts, identifiers, uploads
from knownby.streaming import live


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


RAW = "security_id string, session_date string, open double, high double, low double, close double, volume double, available_at timestamp"


def test_price_normalization(spark):
    rows = [("a", "2024-01-02", 10.0, 12.0, 9.0, 11.0, 5.0, utc(2024, 1, 2)), ("a", "2024-01-02", 10.0, 12.0, 9.0, 11.5, 5.0, utc(2024, 1, 3)),
            ("a", "2024-01-03", 10.0, 9.0, 9.0, 11.0, 5.0, utc(2024, 1, 3)), ("a", "bad", 10.0, 12.0, 9.0, 0.0, -5.0, utc(2024, 1, 3)),
            ("a", "2024-01-05", 1.0, 1.0, 1.0, 1.0, 0.0, utc(2024, 1, 5))]
    raw = spark.createDataFrame(rows, RAW)
    kept, rejected = bars.normalize_prices(raw)
    assert [(r["session_date"].day, r["close"], r["adjusted_close"]) for r in kept.orderBy("session_date").collect()] == [(2, 11.5, 11.5), (5, 1.0, 1.0)]
    reasons = sorted(r["violations"] for r in rejected.collect())
    assert reasons == [["inconsistent_range"], ["invalid_session_date", "non_positive_price", "negative_volume", "inconsistent_range"]]
    calendar = spark.createDataFrame([(f"2024-01-0{d}",) for d in (2, 3, 4, 5)], "session_date string")
    report = bars.price_quality_report(raw, kept, calendar=calendar).collect()[0]
    assert report["missing_sessions"] == 2 and report["warnings"] == ["2 expected trading sessions are absent", bars.NO_ADJUSTED]


def test_identifiers(spark):
    df = spark.createDataFrame([(" ab  c ", "Yahoo"), ("  ", "BBGID"), ("x", "mic-ticker")], "v string, s string")
    out = df.select(identifiers.canonical_identifier("v").alias("v"), identifiers.canonical_scheme("s").alias("s")).collect()
    assert [(r["v"], r["s"]) for r in out] == [("AB C", "yahoo_symbol"), (None, "figi"), ("X", "mic_ticker")]


def test_request_fingerprint_equals_json_hash(spark):
    import hashlib
    import json
    import uuid

    rows = [("p", "id2", "BBB"), ("p", "id1", "AAA")]
    df = spark.createDataFrame(rows, "provider string, security_id string, provider_identifier string").withColumn(
        "start_date", F.lit("2024-01-01").cast("date")).withColumn("end_date", F.lit("2024-01-31").cast("date")).withColumn("frequency", F.lit("1d"))
    got = identifiers.request_fingerprints(df).collect()[0]
    body = {"items": [["id1", "AAA"], ["id2", "BBB"]], "start_date": "2024-01-01", "end_date": "2024-01-31", "frequency": "1d"}
    want = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got["request_fingerprint"] == want
    assert got["batch_id"] == str(uuid.uuid5(uuid.UUID(identifiers.BATCH_NAMESPACE), f"p:{want}"))


def test_requests_of_any_size_pass_through_the_digest(spark):
    import hashlib

    rows = [("big", f"{i:05d}", f"N{i}") for i in range(25_000)] + [(f"p{i % 40}", f"{i}", "X") for i in range(400)]
    rows += [("void", None, "X"), ("void", None, None), (None, "1", "Y"), ("big", "00007", "N7")]
    df = spark.createDataFrame(rows, "provider string, security_id string, provider_identifier string").withColumns(
        {"start_date": F.lit("2024-01-01").cast("date"), "end_date": F.lit("2024-01-31").cast("date"), "frequency": F.lit("1d")})
    undated = df.where("provider = 'p1'").withColumns({"provider": F.lit("undated"), "start_date": F.lit(None).cast("date")})
    found = identifiers.request_fingerprints(df.unionByName(undated).repartition(7)).collect()
    got = {r["provider"]: r["request_fingerprint"] for r in found}
    assert len(found) == len(got) == 44
    for provider in ("big", "p3", "void", None):
        items = sorted(f'["{i}","{n}"]' for p, i, n in rows if p == provider and i is not None and n is not None)
        body = f'{{"end_date":"2024-01-31","frequency":"1d","items":[{",".join(items)}],"start_date":"2024-01-01"}}'
        assert got[provider] == hashlib.sha256(body.encode()).hexdigest()
    assert got["undated"] is None
    assert identifiers.request_fingerprints(df.limit(0)).count() == 0


def test_content_hash_sees_any_change_and_no_order(spark):
    rows = [("b", f"r{i}", utc(2024, 1, 2), 1.0, 2.0, 0.5, float(i), None, 3.0) for i in range(20)]
    schema = "ingestion_batch_id string, source_record_id string, available_at timestamp, open double, high double, low double, close double, adjusted_close double, volume double"
    df = spark.createDataFrame(rows, schema)
    hash_of = lambda d: identifiers.batch_content_hash(d).collect()[0]["content_hash"]
    assert hash_of(df) == hash_of(df.orderBy(F.rand(1)))
    assert hash_of(df) != hash_of(df.withColumn("close", F.when(F.col("source_record_id") == "r7", 99.0).otherwise(F.col("close"))))


def test_csv_upload(spark):
    path = folder() + "/holdings.csv"
    with open(path, "w") as f:
        f.write("Identifier,Weight,identifier_type,note\naaa,0.5,TICKER,x\n,,,\nbbb,55,,\naaa,0.1,ticker,\nccc,-0.25,,\n")
    rows = uploads.read_upload(spark, path)
    assert uploads.header_issues(rows, uploads.HOLDINGS) == [("note", "warning")]
    good, issues = uploads.parse_upload(rows, uploads.HOLDINGS)
    assert [(r["row_number"], r["identifier"], float(r["weight"])) for r in good.orderBy("row_number").collect()] == [(2, "AAA", 0.5), (6, "CCC", -0.25)]
    assert sorted((r["row_number"], r["field"]) for r in issues.collect()) == [(4, "weight"), (5, "identifier")]
    with pytest.raises(ValueError, match="missing required columns"):
        uploads.parse_upload(rows.drop("weight"), uploads.HOLDINGS)
    assert len(uploads.upload_hash(spark, path).collect()[0]["source_hash"]) == 64


def test_import_is_all_or_nothing(spark):
    ids = spark.createDataFrame([("s1", "ticker", "AAA", None, None, utc(2020, 1, 1), None), ("s9", "ticker", "SPY", None, None, utc(2020, 1, 1), None)],
                                "security_id string, scheme string, value string, provider string, exchange_mic string, valid_from timestamp, valid_to timestamp")
    secs = spark.createDataFrame([("s1", "Tech"), ("s9", None)], "security_id string, sector string")
    maps = spark.createDataFrame([("s1", "s9", "market", utc(2020, 1, 1), None)], "security_id string, benchmark_security_id string, kind string, valid_from timestamp, valid_to timestamp")
    schema = "row_number int, identifier string, weight double, thesis_id string, benchmark string, identifier_scheme string, provider string, exchange_mic string"
    fine = [(2, "AAA", 0.5, None, None, None, None, None)]
    call = lambda rows: uploads.import_rows(spark.createDataFrame(rows, schema), ids, secs, maps, as_of="2024-01-01T00:00:00+00:00")
    accepted, issues = call(fine)
    assert [(r["security_id"], r["benchmark_security_id"]) for r in accepted.collect()] == [("s1", "s9")] and issues.count() == 0
    accepted, issues = call(fine + [(3, "ZZZ", 0.1, None, None, None, None, None)])
    assert accepted.count() == 0 and [(r["row_number"], r["issue"]) for r in issues.collect()] == [(3, "security_not_found")]


BAR = "security_id string, frequency string, source string, effective_at timestamp, available_at timestamp, open double, high double, low double, close double, adjusted_close double, volume double"


def bar(s, day, close, later=0):
    return (s, "1d", "x", utc(2024, 1, day), utc(2024, 1, day + later), close, close, close, close, close, 1.0)


def test_append_is_idempotent_and_conflicts_store_nothing(spark):
    path = folder() + "/bars"
    rows = spark.createDataFrame([bar("a", 2, 1.0), bar("a", 3, 2.0), bar("a", 3, 2.0)], BAR)
    assert appends.append_vintages(spark, path, rows, appends.PRICE_BARS) == 2
    assert appends.append_vintages(spark, path, rows, appends.PRICE_BARS) == 0
    assert appends.append_vintages(spark, path, spark.createDataFrame([bar("a", 3, 5.0, later=1)], BAR), appends.PRICE_BARS) == 1
    with pytest.raises(Exception, match="conflicting price_bar vintage"):
        appends.append_vintages(spark, path, spark.createDataFrame([bar("a", 2, 9.0), bar("b", 2, 1.0)], BAR), appends.PRICE_BARS)
    assert spark.read.parquet(path).count() == 3


def test_contracts(spark):
    df = spark.createDataFrame([(utc(2024, 1, 2), utc(2024, 1, 1), utc(2024, 1, 3), None, "failed", 1), (utc(2024, 1, 1), utc(2024, 1, 2), utc(2024, 1, 3), utc(2024, 1, 4), "succeeded", 1)],
                               "requested_at timestamp, started_at timestamp, x timestamp, completed_at timestamp, status string, row_count int")
    out = [r["violations"] for r in contracts.check_contract(df, "batch").collect()]
    assert out == [["started_before_requested", "terminal_without_completion"], []]
    with pytest.raises(ValueError):
        contracts.check_contract(df, "nothing")


def daily_inputs(spark, days=30):
    from datetime import timedelta

    rows = []
    for name in ("acme", "spy", "tiny"):
        for i in range(days if name != "tiny" else 5):
            at = utc(2024, 1, 1) + timedelta(days=i)
            close = 100.0 + i if name == "acme" else 200.0 + (i % 3)
            rows.append((name, at.date(), "1d", at, at, at, close, close, close, close, None, 10.0 + i, "fixture", f"{name}:{i}", "b1"))
    schema = "security_id string, session_date date, frequency string, effective_at timestamp, available_at timestamp, ingested_at timestamp, open double, high double, low double, close double, adjusted_close double, volume double, source string, source_record_id string, ingestion_batch_id string"
    members = spark.createDataFrame([("list", n, "spy", utc(2023, 1, 1), None) for n in ("acme", "tiny")], "coverage_list_id string, security_id string, benchmark_security_id string, valid_from timestamp, valid_to timestamp")
    maps = spark.createDataFrame([("acme", "spy", "market", utc(2023, 1, 1), None)], "security_id string, benchmark_security_id string, kind string, valid_from timestamp, valid_to timestamp")
    weights = spark.createDataFrame([("acme", 0.04)], "security_id string, weight double")
    return dict(members=members, mappings=maps, bars=spark.createDataFrame(rows, schema), weights=weights)


def test_daily_run_is_isolated_repeatable_and_idempotent(spark):
    request = daily.DailyRequest("list", "2024-01-30T00:00:00+00:00", "2024-01-31T00:00:00+00:00", "fixture")
    inputs = daily_inputs(spark)
    run = daily.daily_research(request, **inputs)
    assert [(r["security_id"], r["message"]) for r in run.failures.collect()] == [("tiny", "insufficient price history: 5 bars; need at least 21")]
    head = run.run.collect()[0]
    assert (head["status"], head["members"], head["failures"]) == ("partial", 2, 1)
    card = run.cards.collect()[0]
    assert card["daily_return"] == pytest.approx(129 / 128 - 1) and card["position_weight"] == 0.04
    # The sector repeats the market benchmark, so no sector feature appears.
    assert "relative_return_sector_63d" not in {r["feature_name"] for r in run.features.collect()}
    again = daily.daily_research(request, **inputs)
    assert again.cards.collect()[0]["card_id"] == card["card_id"]
    root = folder()
    daily.store_daily_run(run, root)
    daily.store_daily_run(again, root)
    assert spark.read.parquet(f"{root}/cards").count() == 1 and spark.read.parquet(f"{root}/evidence").count() == run.evidence.count()


def test_members_that_a_step_refuses_leave_with_their_reasons(spark):
    from knownby.operators.research import Materiality

    request = daily.DailyRequest("list", "2024-01-30T00:00:00+00:00", "2024-01-31T00:00:00+00:00", "fixture")
    inputs = daily_inputs(spark)
    bars, members = inputs["bars"], inputs["members"]
    calm = bars.where("security_id = 'spy'").withColumns({"security_id": F.lit("calm"), "source_record_id": F.concat(F.lit("calm"), "source_record_id")})
    # Its last session jumps in volume, so a component passes the range asked for below.
    loud = calm.withColumns({"security_id": F.lit("loud"), "source_record_id": F.concat(F.lit("loud"), "source_record_id"),
                             "volume": F.when(F.col("session_date") == "2024-01-30", 1e6).otherwise(F.col("volume"))})
    early = bars.where("security_id = 'acme'").withColumns({"security_id": F.lit("early"), "source_record_id": F.concat(F.lit("early"), "source_record_id")})
    # Its own bars, and those of its benchmark, are dated as known a day before their sessions.
    shift = lambda df: df.withColumn("available_at", F.col("available_at") - F.expr("interval 1 day"))
    odd = shift(early).unionByName(shift(calm.withColumns({"security_id": F.lit("odd"), "source_record_id": F.concat(F.lit("odd"), "source_record_id")})))
    more = [("list", n, b, utc(2023, 1, 1), None) for n, b in (("calm", "spy"), ("loud", "spy"), ("early", "odd"))]
    inputs["members"] = members.unionByName(spark.createDataFrame(more, members.schema))
    inputs["bars"] = bars.unionByName(calm).unionByName(loud).unionByName(odd)
    run = daily.daily_research(request, **inputs, materiality=Materiality(input_max=0.9))
    reasons = {r["security_id"]: r["message"] for r in run.failures.collect()}
    assert set(reasons) == {"tiny", "loud", "early"}
    assert reasons["loud"] == "materiality input out of range: abnormal_volume"
    assert reasons["early"] == "available before it is effective: 2024-01-29 00:00:00 against 2024-01-30 00:00:00"
    head = run.run.collect()[0]
    assert (head["status"], head["members"], head["failures"]) == ("partial", 5, 3)
    for table in (run.cards, run.findings, run.features, run.snapshots):
        assert {r["security_id"] for r in table.select("security_id").distinct().collect()} == {"acme", "calm"}
    assert {r["source_record_id"].rstrip("0123456789:") for r in run.evidence.select("source_record_id").collect()} == {"acme", "calmspy", "spy"}


def test_daily_run_ignores_later_vintages(spark):
    request = daily.DailyRequest("list", "2024-01-30T00:00:00+00:00", "2024-01-31T00:00:00+00:00", "fixture")
    inputs = daily_inputs(spark)
    base = sorted(map(str, daily.daily_research(request, **inputs).features.drop("feature_snapshot_id").collect()))
    late = inputs["bars"].withColumn("close", F.col("close") * 9).withColumn("available_at", F.lit("2024-02-02 00:00:00").cast("timestamp"))
    inputs["bars"] = inputs["bars"].unionByName(late)
    assert sorted(map(str, daily.daily_research(request, **inputs).features.drop("feature_snapshot_id").collect())) == base


def test_price_ingest_pipeline(spark):
    asked = spark.createDataFrame([("s1", "AAA"), ("s2", "BBB")], "security_id string, provider_identifier string").withColumn(
        "start_date", F.lit("2024-01-02").cast("date")).withColumn("end_date", F.lit("2024-01-03").cast("date"))
    offered = spark.createDataFrame([("aaa", d, 1.0, 1.0, 1.0, 1.0, 5.0) for d in ("2024-01-01", "2024-01-02", "2024-01-03")],
                                    "provider_identifier string, session_date string, open double, high double, low double, close double, volume double").withColumn("session_date", F.to_date("session_date"))
    loaded = bars.load_batch(asked, offered, source="fixture", batch_id=F.lit("b"), ingested_at=F.lit("2024-02-01 00:00:00").cast("timestamp"))
    batches = spark.createDataFrame([("b", 2, "partial", "abc")], "ingestion_batch_id string, row_count bigint, status string, request_fingerprint string")
    path = folder() + "/bars"
    assert workflows.ingest_prices(spark, path, loaded, asked, batches) == {"received": 2, "inserted": 2, "status": "partial"}
    assert workflows.ingest_prices(spark, path, loaded, asked, batches)["inserted"] == 0
    with pytest.raises(ValueError, match="row_count_mismatch"):
        workflows.ingest_prices(spark, path, loaded, asked, batches.withColumn("row_count", F.lit(7)))


def test_stream_ingest_drops_repeats_and_reports_conflicts(spark):
    root = folder()
    rows = spark.createDataFrame([bar("a", 2, 1.0), bar("a", 2, 1.0), bar("a", 3, 2.0)], BAR)
    rows.write.parquet(f"{root}/in")
    start = lambda: live.ingest_vintages(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), appends.PRICE_BARS, path=f"{root}/out", checkpoint=f"{root}/cp")
    start().awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == 2
    spark.createDataFrame([bar("a", 3, 7.0)], BAR).write.mode("append").parquet(f"{root}/in")
    with pytest.raises(Exception, match="conflicting price_bar vintage"):
        start().awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == 2


def test_event_routing(spark):
    df = spark.createDataFrame([("e", "fomc"), ("f", "regulatory")], "event_id string, event_type string")
    got = sorted((r["event_id"], r["module"]) for r in live.route_events(df).collect())
    assert got == [("e", "macro_sensitivity"), ("e", "price_anomaly"), ("f", "price_anomaly")]


def test_appends_read_only_the_touched_months(spark):
    path = folder() + "/table"
    rows = lambda *days: spark.createDataFrame([bar("a", d, 1.0) for d in days], BAR)
    assert appends.append_vintages(spark, path, rows(2, 3), appends.PRICE_BARS) == 2
    later = rows(3).withColumn("effective_at", F.col("effective_at") + F.expr("interval 60 days"))
    assert appends.append_vintages(spark, path, later.unionByName(rows(3)), appends.PRICE_BARS) == 1
    stored = spark.read.parquet(path)
    assert stored.select("period").distinct().count() == 2
    picked = appends.touched_periods(stored, later, appends.PRICE_BARS)
    assert picked.count() == 1 and "period" not in picked.columns
    plan = picked._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "period" in filters and "PushedFilters" in plan


def test_late_vintages_are_stored(spark):
    root = folder()
    start = lambda: live.ingest_vintages(spark.readStream.schema(BAR).parquet(f"{root}/in"), appends.PRICE_BARS, path=f"{root}/out", checkpoint=f"{root}/cp").awaitTermination()
    for day in (10, 20, 2):  # the last is much older than what came before
        spark.createDataFrame([bar("a", day, float(day))], BAR).write.mode("append").parquet(f"{root}/in")
        start()
    assert sorted(r["close"] for r in appends.read_vintages(spark, f"{root}/out").collect()) == [2.0, 10.0, 20.0]


def test_status_of_batches_without_rows_in_range(spark):
    loaded = spark.createDataFrame([], "ingestion_batch_id string, session_date date, provider_identifier string")
    asked = spark.createDataFrame([("b",)], "ingestion_batch_id string")
    row = bars.batch_status(loaded, requested=asked).first()
    assert (row["row_count"], row["missing_symbols"], row["status"]) == (0, 0, "succeeded")


def test_live_screen_keeps_state_and_reads_no_table(spark, tmp_path):
    from knownby.operators import screens
    from knownby.streaming import live

    screen = screens.RELATIVE_STRENGTH_BREAKOUT
    schema = "security_id string, feature_name string, available_at timestamp, value double"
    batches = [
        [("a", "relative_return_sector_63d", utc(2024, 1, 3), 0.10), ("a", "realized_volatility_20d", utc(2024, 1, 3), 0.2), ("b", "relative_return_sector_63d", utc(2024, 1, 3), 0.01)],
        [("a", "relative_return_sector_63d", utc(2024, 1, 2), 0.01), ("b", "realized_volatility_20d", utc(2024, 1, 4), 0.3)],  # late: older than what is known
        [("a", "relative_return_sector_63d", utc(2024, 1, 9), 0.0), ("a", "other", utc(2024, 1, 4), 9.0)],  # after the cutoff, and no feature of the screen
        [("b", "relative_return_sector_63d", utc(2024, 1, 5), 0.20), ("a", "realized_volatility_20d", utc(2024, 1, 3), 0.2)],
    ]
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    rows = []
    for k, batch in enumerate(batches):
        rows += batch
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = live.live_screen(stream, screen, results_path=str(tmp_path / "out"), checkpoint=str(tmp_path / "check"), as_of="2024-01-08T00:00:00+00:00")
        query.awaitTermination()
        assert query.lastProgress["numInputRows"] == len(batch)
        got = {r.security_id: r for r in live.current_screen(spark, str(tmp_path / "out")).collect()}
        want = {r.security_id: r for r in screens.run_screen(spark.createDataFrame(rows, schema), screen, as_of="2024-01-08T00:00:00+00:00").collect()}
        assert {s: (r.matches, r.excluded_for_missing_data, r.relative_return_sector_63d) for s, r in got.items()} == {
            s: (r.matches, r.excluded_for_missing_data, r.relative_return_sector_63d) for s, r in want.items()}
    assert got["a"].matches and got["b"].matches
    changed = [{r.security_id for r in spark.read.parquet(str(tmp_path / f"out/batch={k}")).collect()} for k in (0, 2)]
    assert changed == [{"a", "b"}, set()]
    assert spark.conf.get("spark.sql.shuffle.partitions") == shuffles


def test_recompute_reads_the_last_months_only(spark, tmp_path):
    from datetime import date, datetime, timedelta, timezone

    from knownby.sources.appends import PRICE_BARS, append_vintages
    from knownby.streaming import live

    rows = []
    for name, first in (("a", date(2015, 1, 1)), ("b", date(2020, 6, 1))):
        day = first
        while day < date(2021, 1, 1):
            at = datetime(day.year, day.month, day.day, tzinfo=timezone.utc)
            rows.append((name, "1d", "s", at, at, day, 1.0 + day.toordinal() % 7))
            day += timedelta(days=1)
    bars = spark.createDataFrame(rows, "security_id string, frequency string, source string, effective_at timestamp, available_at timestamp, session_date date, close double")
    for c in ("open", "high", "low", "adjusted_close", "volume"):
        bars = bars.withColumn(c, F.col("close"))
    path = str(tmp_path / "bars")
    append_vintages(spark, path, bars, PRICE_BARS)
    only_a = spark.createDataFrame([("a",)], "security_id string")
    recent = live.trailing_bars(spark, path, only_a, 128)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [period" in plan or "period" in plan.split("PartitionFilters")[1][:40]
    own = recent.where("security_id = 'a'")
    newest = own.orderBy(F.col("session_date").desc()).limit(128).agg(F.min("session_date")).first()[0]
    assert own.count() >= 128 and newest == date(2021, 1, 1) - timedelta(days=128)
    assert own.agg(F.min("session_date")).first()[0] > date(2019, 6, 1)
    # One whose history is shorter is read whole, and with it everything else there is.
    both = live.trailing_bars(spark, path, spark.createDataFrame([("a",), ("b",)], "security_id string"), 400)
    assert both.where("security_id = 'b'").count() == sum(r[0] == "b" for r in rows)


def test_latest_features_equal_the_last_row_of_all(spark):
    import random
    from datetime import date, timedelta

    from knownby.plans import daily

    pick, rows = random.Random(3), []
    for name, n in (("m", 300), ("s", 300), ("x", 300), ("y", 150), ("z", 40)):
        price = 100.0
        for i in range(n):
            if name == "x" and i % 11 == 0:
                continue
            price *= 1 + pick.gauss(0, 0.02)
            rows.append((name, date(2020, 1, 1) + timedelta(days=300 - n + i), price, 1000.0 + pick.random()))
    df = spark.createDataFrame(rows, "security_id string, session_date date, close double, volume double")
    df = df.withColumns({"adjusted_close": F.col("close"), "effective_at": F.col("session_date").cast("timestamp"), "available_at": F.col("session_date").cast("timestamp"), "source_record_id": F.lit("r")})
    returns = daily.session_returns(df)
    factors = spark.createDataFrame([("x", "m", "s"), ("y", "m", None), ("z", "m", "s")], "security_id string, market_id string, sector_id string")
    names = ["security_id", "session_date", "bars", "observations", "daily_return", "residual_return", "residual_zscore", "volume_zscore", "realized_volatility_20d", "beta_126d", "relative_return_sector_63d"]
    whole = {r.security_id: r for r in daily.last_session(daily.price_features(returns, factors)).select(*names).collect()}
    recent = {r.security_id: r for r in daily.latest_features(returns, factors).select(*names).collect()}
    assert set(whole) == set(recent) == {"x", "y", "z"}
    for name, row in whole.items():
        for column, value in row.asDict().items():
            got = recent[name][column]
            assert got == value if not isinstance(value, float) else got == pytest.approx(value, rel=1e-9)


def test_appends_write_few_files_and_keep_every_row(spark):
    from glob import glob

    path = folder() + "/table"
    bars_of = lambda names: spark.createDataFrame([bar(n, d, float(d)) for n in names for d in range(1, 29)], BAR).withColumn(
        "effective_at", F.expr("effective_at + make_interval(0, cast(close as int) % 5, 0, 0, 0, 0, 0)")).repartition(16)
    assert appends.append_vintages(spark, path, bars_of("ab"), appends.PRICE_BARS) == 56
    assert len(glob(f"{path}/*/*.parquet")) == 5  # one for each month, not one from each of the tasks
    # The next has bars that are stored, bars that are new, and repeats of its own.
    more = bars_of("bc")
    assert appends.append_vintages(spark, path, more.unionByName(more.where("security_id = 'c'")), appends.PRICE_BARS) == 28
    stored = appends.read_vintages(spark, path)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, bars_of("abc").select(*stored.columns).collect()))
    assert appends.append_vintages(spark, path, bars_of("abc"), appends.PRICE_BARS) == 0


def test_latest_features_of_dependent_benchmarks_move_no_window(spark):
    import random
    from datetime import date, timedelta

    from knownby.plans import daily

    pick, rows = random.Random(5), []
    moves = {"m": [pick.gauss(0, 0.02) for _ in range(200)]}
    moves["copy"] = moves["m"]  # repeats the market: not of full rank
    moves["near"] = [0.5 * r + 1e-7 * pick.gauss(0, 1) for r in moves["m"]]  # close to it: fitted on its rows
    moves["flat"] = [0.0] * 200
    for name in ("p", "q", "r", "s", "t"):
        moves[name] = [pick.gauss(0, 0.02) + 0.8 * r for r in moves["m"]]
    for name, returns in moves.items():
        price = 100.0
        for i, r in enumerate(returns):
            price *= 1 + r
            if name != "t" or i >= 110:
                rows.append((name, date(2020, 1, 1) + timedelta(days=i), price, 1000.0 + pick.random()))
    df = spark.createDataFrame(rows, "security_id string, session_date date, close double, volume double")
    df = df.withColumns({"adjusted_close": F.col("close"), "effective_at": F.col("session_date").cast("timestamp"), "available_at": F.col("session_date").cast("timestamp"), "source_record_id": F.lit("r")})
    returns = daily.session_returns(df)
    factors = spark.createDataFrame([("p", "m", "copy"), ("q", "m", "near"), ("r", None, "flat"), ("s", "m", None), ("t", "m", "near")],
                                    "security_id string, market_id string, sector_id string")
    whole = {r.security_id: r.asDict() for r in daily.last_session(daily.price_features(returns, factors)).collect()}
    latest = daily.latest_features(returns, factors)
    recent = {r.security_id: r.asDict() for r in latest.collect()}
    assert set(whole) == set(recent) == {"p", "q", "r", "s", "t"}
    for name, row in whole.items():
        for column, value in row.items():
            got = recent[name][column]
            assert got == value if not isinstance(value, float) else got == pytest.approx(value, rel=1e-6, abs=1e-12), (name, column)
    assert recent["p"]["residual_return"] is None and recent["q"]["residual_return"] is not None
    assert "Window" not in latest._jdf.queryExecution().executedPlan().toString()


def test_touched_securities_are_those_of_the_batch_and_of_its_benchmarks(spark, tmp_path):
    from datetime import date, datetime, timedelta, timezone

    rows = []
    for name in ("a", "b", "m"):
        for i in range(30):
            at = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(days=i)
            rows.append((name, "1d", "s", at, at, date(2024, 1, 1) + timedelta(days=i), 100.0 + i % 7, f"{name}{i}"))
    df = spark.createDataFrame(rows, "security_id string, frequency string, source string, effective_at timestamp, available_at timestamp, session_date date, close double, source_record_id string")
    df = df.withColumns({c: F.col("close") for c in ("open", "high", "low", "adjusted_close", "volume")})
    factors = spark.createDataFrame([("a", "m", None), ("b", None, None)], "security_id string, market_id string, sector_id string")
    touched = []
    for k, part in enumerate(("security_id in ('a', 'b')", "security_id = 'm'", "security_id = 'b' and session_date > '2024-01-20'")):
        batch = df.where(part)
        if k == 2:
            batch = batch.withColumn("effective_at", F.col("effective_at") + F.expr("interval 1 hour"))
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = live.recompute_touched(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), bars_path=str(tmp_path / "bars"), factors=factors,
                                       results_path=str(tmp_path / "results"), checkpoint=str(tmp_path / "check"), table=appends.PRICE_BARS)
        query.awaitTermination()
        touched.append({r.security_id: r.benchmark_return for r in spark.read.parquet(str(tmp_path / f"results/batch={k}")).collect()})
    assert [set(t) for t in touched] == [{"a", "b"}, {"a"}, {"b"}]
    assert touched[0]["a"] is None and touched[1]["a"] == pytest.approx(101.0 / 100.0 - 1)


def test_replayed_bars_come_in_as_many_batches_whatever_their_size(spark, monkeypatch):
    from knownby.catalog import QUERIES, stream_queries

    class Seen(Exception):
        pass

    def seen(_spark, df, _root):
        raise Seen(df.rdd.getNumPartitions())

    monkeypatch.setattr(stream_queries, "replay", seen)
    files = set()
    for parts in ("3", "60"):  # what larger tables are cut into
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k" if parts == "60" else "128m")
        try:
            QUERIES["q4_recompute_touched"](spark, "/root/testdata/sf0.001")
        except Seen as found:
            files.add(found.args[0])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert files == {12}


def test_short_histories_are_read_without_counting(spark, monkeypatch):
    path = folder() + "/bars"
    at = F.col("effective_at") + F.expr("make_interval(0, cast(close as int) % 5, 0, 0, 0, 0, 0)")
    rows = spark.createDataFrame([bar("a", d, float(d)) for d in range(1, 29)], BAR).withColumn("effective_at", at).withColumn("session_date", F.to_date("effective_at"))
    appends.append_vintages(spark, path, rows, appends.PRICE_BARS)
    counts = []
    monkeypatch.setattr(live, "materialize", lambda df: counts.append(1) or df)
    only = spark.createDataFrame([("a",)], "security_id string")
    assert live.trailing_bars(spark, path, only, 128).count() == 28 and not counts
    # Of five months the first turn takes one, the second two more, which hold enough.
    assert live.trailing_bars(spark, path, only, 10).count() == 17 and len(counts) == 2
