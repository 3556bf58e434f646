"""Text operators over whole documents: numeric claims, sections, version comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knownby.functions.numeric import col, ratio
from knownby.functions.text import bound, match_starts
from knownby.operators.scale import attach

# What counts as a numeric claim and as a filing heading.
NUMERIC_CLAIM = (
    r"(?i)(?<![\p{L}\p{N}_])[$€£]?[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
    r"(?:\s*(?:%|bps?\b|x\b))?"
)
HEADING = r"(?md)^(?:item\s+\d+[a-z]?\.?\s*)?([A-Z][A-Z\s&/-]{3,})$"
UNITS = ("percent", "basis_points", "multiple", "currency", "number")

_OPEN, _CLOSE = "\u0001", "\u0002"


def numeric_claims(text: Column | str) -> Column:
    """Array of (raw, value, unit, start, end) in text order, by regex scans of the row, no shuffle; offsets count characters."""
    def parse(found: Column) -> Column:
        raw = found["raw"]
        unit_text = F.lower(F.regexp_replace(raw, r"[^%a-zA-Z]", ""))
        number = F.regexp_replace(raw, r"[^0-9.+-]", "").try_cast("double")
        unit = (
            F.when(unit_text == "%", "percent")
            .when(unit_text.startswith("bp"), "basis_points")
            .when(unit_text == "x", "multiple")
            .when(raw.rlike("^[$€£]"), "currency")
            .otherwise("number")
        )
        scale = F.when(unit_text == "%", 100.0).when(unit_text.startswith("bp"), 10_000.0).otherwise(1.0)
        return F.struct(
            raw.alias("raw"), (number / scale).alias("value"), unit.alias("unit"),
            found["start"].alias("start"), (found["start"] + F.char_length(raw)).alias("end"),
        )

    raws = F.regexp_extract_all(col(text), F.lit(NUMERIC_CLAIM), F.lit(0))
    starts = match_starts(F.transform(F.split(col(text), NUMERIC_CLAIM, -1), F.char_length), F.transform(raws, F.char_length))
    return F.transform(F.arrays_zip(raws, starts).cast("array<struct<raw:string,start:bigint>>"), parse)


def extract_numeric_claims(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.select(key, F.posexplode(numeric_claims(text)).alias("position", "claim")).select(
        key, "position", "claim.raw", "claim.value", "claim.unit", "claim.start", "claim.end"
    )


def claims_supported(claims: Column, facts: Column) -> Column:
    """Per claim: does a fact of the same unit agree within tolerance.

    ``facts`` is array<struct<value,unit,absolute_tolerance>> on the same row.
    """
    def supported(claim: Column) -> Column:
        def agrees(fact: Column) -> Column:
            gap = F.abs(fact["value"] - claim["value"])
            relative = F.lit(1e-6) * F.greatest(F.abs(fact["value"]), F.abs(claim["value"]))
            return (fact["unit"] == claim["unit"]) & (
                gap <= F.greatest(relative, fact["absolute_tolerance"])
            )

        return F.exists(facts, agrees)

    return F.transform(claims, lambda c: supported(c))


def validate_numeric_claims(df: DataFrame, *, text: str = "text", facts: str = "facts") -> DataFrame:
    """Adds claims, unsupported_claims and numbers_valid to each text."""
    work = df.withColumn("claims", numeric_claims(text)).withColumn(
        "__ok", claims_supported(F.col("claims"), F.coalesce(F.col(facts), F.expr(f"slice({facts}, 1, 0)")))
    )
    flagged = F.arrays_zip("claims", "__ok")
    bad = F.transform(F.filter(flagged, lambda x: ~F.coalesce(x["__ok"], F.lit(False))), lambda x: x["claims"])
    return work.withColumn("unsupported_claims", bad).withColumn(
        "numbers_valid", F.size("unsupported_claims") == 0
    ).drop("__ok")


def has_evidence(evidence_ids: Column | str) -> Column:
    """At least one evidence id, none of them blank."""
    ids = col(evidence_ids)
    return F.coalesce(
        (F.size(ids) > 0) & ~F.exists(ids, lambda x: F.coalesce(F.trim(x) == "", F.lit(True))), F.lit(False)
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _title(text: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the rest."""
    def cased(letters: Column) -> Column:
        return F.transform(
            letters,
            lambda c, i: F.when(
                (i > 0) & F.coalesce(F.try_element_at(letters, i).rlike("^[A-Za-z]$"), F.lit(False)), F.lower(c)
            ).otherwise(c),
        )

    return F.array_join(bound(F.split(text, ""), cased), "")


def sections(text: Column | str) -> Column:
    """Array of (section, body) split at all-caps headings, computed inside the row.

    Text without a heading is one DOCUMENT section; of sections with the same
    name the last non-empty body counts (see ``segment_sections``).
    """
    source = col(text)
    marked = F.regexp_replace(source, F.lit(HEADING), F.lit(f"{_OPEN}$1{_CLOSE}"))

    def part(p: Column) -> Column:
        name = _title(_strip(F.regexp_replace(F.substring_index(p, _CLOSE, 1), r"\s+", " ")))
        body = F.substring(p, F.instr(p, _CLOSE) + 1, F.length(p))
        return F.struct(name.alias("section"), _strip(body).alias("body"))

    whole = F.array(F.struct(F.lit("DOCUMENT").alias("section"), _strip(source).alias("body")))

    def named(parts: Column) -> Column:
        headed = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), part)
        return F.when(F.size(parts) > 1, headed).otherwise(whole)

    return F.filter(bound(F.split(marked, _OPEN), named), lambda s: s["body"] != "")


def segment_sections(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per (document, section)."""
    found = documents.withColumn("__s", sections(text))
    last = F.filter(
        F.transform(
            F.col("__s"),
            lambda s, i: F.struct(
                s.alias("s"),
                F.exists(F.slice(F.col("__s"), i + 2, F.size("__s")), lambda later: later["section"] == s["section"]).alias("again"),
            ),
        ),
        lambda x: ~x["again"],
    )
    return found.select(key, F.explode(F.transform(last, lambda x: x["s"])).alias("__x")).select(
        key, "__x.section", "__x.body"
    )


def compare_versions(pairs: DataFrame, *, key: str, previous: str, current: str) -> DataFrame:
    """Changed sections per version pair: lines added and removed, their counts, the change ratio and its rank in the pair.

    Lines are compared as multisets: both versions are exploded with opposite
    signs and cancelled in one aggregation per (pair, section, line).
    """
    def lines(text: str, sign: int) -> DataFrame:
        parts = segment_sections(pairs, key=key, text=text)
        return parts.select(
            key, "section", F.posexplode(F.split("body", "\r\n|\n|\r")).alias("at", "line"), F.lit(sign).alias("sign")
        )

    balanced = (
        lines(previous, -1).unionByName(lines(current, 1)).groupBy(key, "section", "line")
        .agg(
            F.sum(F.when(F.col("sign") > 0, 1).otherwise(0)).alias("now"),
            F.sum(F.when(F.col("sign") < 0, 1).otherwise(0)).alias("before"), F.min("at").alias("at"),
        )
        .withColumn("shown", F.col("line").rlike(r"\S"))
    )
    more, fewer = F.col("now") - F.col("before"), F.col("before") - F.col("now")
    zero = F.lit(0)

    def texts(surplus: Column) -> Column:
        """The changed lines of a section in order of their first place; one filing's section bounds the list."""
        copies = F.array_repeat(_strip(F.col("line")), F.greatest(surplus, zero).cast("int"))
        placed = F.collect_list(F.when(F.col("shown") & (surplus > 0), F.struct("at", "line", copies.alias("copies"))))
        return F.flatten(F.transform(F.array_sort(placed), lambda x: x["copies"]))

    per_section = balanced.groupBy(key, "section").agg(
        F.sum(F.when(F.col("shown"), F.greatest(more, zero)).otherwise(0)).alias("added_lines"),
        F.sum(F.when(F.col("shown"), F.greatest(fewer, zero)).otherwise(0)).alias("removed_lines"),
        texts(more).alias("added"), texts(fewer).alias("removed"),
        F.sum(F.least("now", "before")).alias("__same"),
        F.sum(F.col("now") + F.col("before")).alias("__all"),
    )
    changed = per_section.where("added_lines > 0 or removed_lines > 0").select(
        key, "section", "added_lines", "removed_lines", "added", "removed",
        (F.lit(1.0) - ratio(F.lit(2.0) * F.col("__same"), F.col("__all"))).alias("change_ratio"),
    )
    order = Window.partitionBy(key).orderBy(F.col("change_ratio").desc(), "section")
    return changed.withColumn("change_rank", F.row_number().over(order))


def evaluate_evidence(df: DataFrame, *, predicted: str, expected: str, claims: str, supported: str) -> DataFrame:
    """Evidence precision and recall, and numeric accuracy, per card."""
    got, want = F.array_distinct(F.col(predicted)), F.array_distinct(F.col(expected))
    hit = F.size(F.array_intersect(got, want)).cast("double")
    precision = F.when(F.size(got) > 0, ratio(hit, F.size(got))).otherwise(
        F.when(F.size(want) > 0, 0.0).otherwise(1.0)
    )
    recall = F.when(F.size(want) > 0, ratio(hit, F.size(want))).otherwise(F.lit(1.0))
    accuracy = F.when(F.col(claims) > 0, ratio(F.col(supported).cast("double"), F.col(claims))).otherwise(1.0)
    return df.withColumn("evidence_precision", precision).withColumn(
        "evidence_recall", recall
    ).withColumn("numerical_accuracy", accuracy)
