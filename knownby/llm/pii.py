"""Personal data and the terms that give it away, in DataFrame functions only.

Base spans are four kinds of identifiers found by patterns. The words of the texts
with an identifier can reveal it even when it is masked: if a name turns up only where
one telephone number does, the name tells the number. The strength of that
disclosure is measured on the corpus: for an entity e (a distinct identifier) and
a term t, PMI(e; t) = log(N n(e,t) / (n(e) n(t))) is the information t gives on e,
and its share of the entity's own information, PMI / log(N / n(e)), is 1 when t
appears nowhere else. N is the number of documents; n(t), n(e) and n(e,t) count those
with the term, with the entity and with both, anywhere in the text. Terms
with a share of ``generalise`` or more become a class word wherever they stand in a
document with the entity, from ``remove`` on they go. Pairs count only when seen in
``support`` documents that show the entity in different contexts (``WIDTH`` characters
on each side), since any word of a single text, or of copies of it, would otherwise
reveal whatever that text holds.

Cost: the texts are scanned once for identifiers and once for words. An entity needs
``support`` documents of its own, and a term in more than n(e)**g N**(1 - g) documents
(g = ``generalise``) cannot reach the share even if it is in all of the entity's, so
exactly the pairs below that bound are formed. Term counts are reduced per task before
they are shuffled.

Rows: a null text is empty and has no spans. Rows are told apart by doc_id and a
hash of the text; a null doc_id is a value of its own. Repeated rows get repeated
results; they count as often as they occur, as one piece of evidence. Base spans of different kinds may overlap and are
all reported; a term inside a base span is not; ``sanitise`` replaces overlapping spans once, from the first start to
the last end, by the kind that starts first (then in the order below). An empty
table gives no rows. Only the two named columns are read; ``sanitise`` keeps the
others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knownby.functions.text import bound, match_starts, part, pieces, running
from knownby.llm.catalog import query
from knownby.llm.substring_dedup import text_hash, with_changes
from knownby.llm.tables import table
from knownby.session import materialize

WIDTH = 80
SUPPORT = 3
GENERALISE = 0.7
REMOVE = 0.9

#: The same matches as the plain patterns, written so that the regex engine never recurses or rescans:
#: possessive loops, and an address starts at the start of a run of its characters or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
WORD = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'-]*+"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Do the digits pass Luhn's check?"""
    reverse = F.reverse(digits(c))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.sequence(F.lit(1), F.length(reverse)), lambda i: F.substring(reverse, i, F.lit(1)).cast("int"))
    each = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(doubled(d)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def small_parts(c: Column) -> Column:
    """Is every dotted part at most 255? Leading zeros do not count."""
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (F.lpad(bare, 3, "0").cast("int") <= 255)

    return F.forall(F.split(c, r"\."), small)


def valid(kind: str, c: Column) -> Column:
    if kind == "ip":
        return small_parts(c)
    if kind == "card":
        return F.when(F.length(digits(c)).between(14, 19), luhn(c)).otherwise(False)
    if kind == "phone":
        return F.length(digits(c)).between(10, 15)
    return F.lit(True)


GATES = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


PARTS = "array<struct<v:string,s:bigint>>"


def matches(text: Column, kind: str) -> Column:
    """Valid spans of one kind as an array."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    starts = match_starts(F.transform(gaps, F.char_length), F.transform(found, F.char_length))
    rank = KINDS.index(kind)
    parts = F.arrays_zip(found, starts).cast(PARTS)
    spans = F.transform(parts, lambda x: F.struct(
        x["s"].alias("start"), F.lit(rank).alias("rank"), (x["s"] + F.char_length(x["v"])).alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value")))
    kept = F.filter(spans, lambda x: valid(kind, x["value"]))
    return F.when(text.rlike(GATES[kind]), kept).otherwise(F.array()).cast(SPAN)


def with_contexts(text: Column, spans: Column) -> Column:
    """The spans with a hash of the text around each."""
    def add(cut: Column, x: Column) -> Column:
        first = F.greatest(x["start"] - WIDTH, F.lit(0))
        return x.withField("context", F.xxhash64(part(cut, first, x["start"]), part(cut, x["end"], x["end"] + WIDTH)))

    found = lambda v: bound(pieces(text), lambda cut: F.transform(v, lambda x: add(cut, x)))
    return bound(spans, lambda v: F.when(F.size(v) > 0, found(v)).otherwise(F.array()))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash and the base spans of each row, by start and kind."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = F.array_sort(F.concat(*(matches(F.col("text"), kind) for kind in PATTERNS)))
    return source.select("doc_id", text_hash("text").alias("text_hash"), with_contexts(F.col("text"), spans).alias("spans"))


def words_with_starts(text: Column) -> Column:
    """Words of a text with their starts in it."""
    found = F.regexp_extract_all(text, F.lit(WORD), 0)
    starts = match_starts(F.transform(F.split(text, WORD, -1), F.char_length), F.transform(found, F.char_length))
    return F.arrays_zip(found, starts).cast("array<struct<word:string,at:bigint>>")


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["_id"]) & (a["text_hash"] == b["_hash"])


def as_key(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})


def entities(base: DataFrame, n: int, support: int, generalise: float) -> DataFrame:
    """doc_id, text_hash, entity, context, times, n_entity, bound: the entities of each row that enough documents show.

    ``context`` stands for all contexts of the entity in the row, ``times`` for the
    repeats of the row, ``bound`` for the documents that a disclosing term can be in.
    """
    seen = base.select("doc_id", "text_hash", F.explode("spans").alias("s")).select(
        "doc_id", "text_hash", F.xxhash64("s.kind", F.lower("s.value")).alias("entity"), "s.context", F.struct("s.rank", "s.start").alias("place"))
    held = materialize(seen.groupBy("doc_id", "text_hash", "entity").agg(
        F.xxhash64(F.array_sort(F.collect_set("context"))).alias("context"), (F.count("*") / F.size(F.collect_set("place"))).cast("long").alias("times")))
    evidence = held.groupBy("entity", "context").agg(F.sum("times").alias("times")).groupBy("entity").agg(F.count("*").alias("contexts"), F.sum("times").alias("n_entity"))
    # A little above, for the rounding of powers and logarithms.
    bound = F.pow("n_entity", F.lit(generalise)) * F.pow(F.lit(float(n)), F.lit(1 - generalise)) * (1 + 1e-9)
    return held.join(evidence.where(F.col("contexts") >= support).select("entity", "n_entity", bound.alias("bound")), "entity")


def candidates(docs: DataFrame, held: DataFrame, doc_id: str, text: str, support: int) -> DataFrame:
    """doc_id, text_hash, term, start, end, n_term: words of rows with entities, without those beyond every bound."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lowered = F.transform(F.regexp_extract_all("text", F.lit(WORD), 0), F.lower)
    counts = source.select(F.explode(F.array_distinct(lowered)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    most = held.agg(F.max("bound").alias("most"))
    rare = counts.where(F.col("n_term") >= support).join(most, F.col("n_term") <= F.col("most")).drop("most")  # one row
    rows = as_key(held.select("doc_id", "text_hash").distinct())
    keyed = source.withColumn("text_hash", text_hash("text"))
    near = keyed.join(rows, same_row(keyed, rows), "left_semi")
    words = near.select("doc_id", "text_hash", F.explode(words_with_starts(F.col("text"))).alias("w")).select(
        "doc_id", "text_hash", F.lower("w.word").alias("term"), F.col("w.at").alias("start"), (F.col("w.at") + F.char_length("w.word")).alias("end"))
    return words.join(rare, "term")


def disclosing_terms(words: DataFrame, held: DataFrame, n: int, support: int, generalise: float) -> DataFrame:
    """_id, _hash, term, share: terms of each row that reveal at least ``generalise`` of the information of an entity in it."""
    once = as_key(words.groupBy("doc_id", "text_hash", "term").agg(F.first("n_term").alias("n_term")))
    linked = materialize(once.join(held, same_row(held, once) & (F.col("n_term") <= F.col("bound"))).select("_id", "_hash", "entity", "term", "context", "times", "n_entity", "n_term"))
    # Copies of one context are one piece of evidence.
    pairs = linked.groupBy("entity", "term", "context").agg(F.sum("times").alias("times"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("times").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    information = F.log(F.lit(float(n)) / F.col("n_entity"))
    shared = F.log(F.lit(float(n)) * F.col("n_both") / (F.col("n_entity").cast("double") * F.col("n_term")))
    share = F.when(information > 0, F.least(shared / information, F.lit(1.0))).otherwise(0.0)
    told = pairs.where(F.col("contexts") >= support).select("entity", "term", share.alias("share")).where(F.col("share") >= generalise)
    return linked.join(told, ["entity", "term"]).groupBy("_id", "_hash", "term").agg(F.max("share").alias("share"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, text_hash, spans (base) and terms (start, end, share, term) of each row; repeated rows once each."""
    base = materialize(detect(docs, doc_id, text))
    n = base.count()
    held = materialize(entities(base, n, support, generalise))
    words = materialize(candidates(docs, held, doc_id, text, support))
    shares = disclosing_terms(words, held, n, support, generalise).withColumnRenamed("term", "_term")
    terms = (words.join(shares, same_row(words, shares) & (F.col("term") == F.col("_term"))).groupBy("doc_id", "text_hash", "start", "end").agg(F.max("share").alias("share"), F.first("term").alias("term"))
             .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "share", "term"))).alias("terms")))
    named = as_key(terms)
    joined = base.join(named, same_row(base, named), "left").drop("_id", "_hash")
    given = F.coalesce("terms", F.array().cast("array<struct<start:bigint,end:bigint,share:double,term:string>>"))
    free = F.filter(given, lambda t: ~F.exists("spans", lambda x: (x["start"] < t["end"]) & (x["end"] > t["start"])))
    return joined.withColumn("terms", free)


MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}


def general_form(term: Column) -> Column:
    """The class word that replaces a term: a number, or a name or word."""
    return F.when(term.rlike("^[0-9]"), "<NUMBER>").otherwise("<WORD>")


def masked(text: Column, spans: Column, terms: Column, remove: float) -> Column:
    """The text with every span replaced; overlapping spans are replaced once."""
    mask = F.create_map(*(F.lit(x) for pair in MASKS.items() for x in pair))
    base = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), mask[s["kind"]].alias("by")))
    more = F.transform(terms, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["share"] >= remove, "").otherwise(general_form(t["term"])).alias("by")))
    ordered = F.array_sort(F.concat(base, more), lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["end"] > b["end"], -1).otherwise(1)))

    def replaced(v: Column, cut: Column) -> Column:
        ends = F.transform(v, lambda s: s["end"].cast("long"))
        # Where the text after all earlier spans begins: a span that starts before is part of what was replaced there.
        before = running(ends, lambda a, x: F.greatest(a, x))
        kept = F.zip_with(v, before, lambda s, at: F.when(s["start"] >= at, F.concat(part(cut, at, s["start"]), s["by"])).otherwise(""))
        return F.concat(F.array_join(kept, ""), part(cut, F.array_max(ends), F.char_length(text).cast("long")))

    whole = bound(ordered, lambda v: bound(pieces(text), lambda cut: replaced(v, cut)))
    return F.when(F.size(spans) + F.size(terms) > 0, whole).otherwise(text)


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Every row with its text sanitised; null texts stay null."""
    found = find(docs, doc_id, text, support, generalise).where((F.size("spans") > 0) | (F.size("terms") > 0))
    once = materialize(found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).agg(F.first("spans").alias("_spans"), F.first("terms").alias("_terms")))
    joined = with_changes(docs, once, doc_id, text)
    changed = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(masked(F.col(text), F.col("_spans"), F.col("_terms"), remove))
    return joined.withColumn(text, changed).select(*docs.columns)


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op6_information_disclosure")
def op6_information_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    found = find(table(spark, sf_dir, "documents"))
    counts = [count_of(kind).alias(f"n_{kind}") for kind in PATTERNS]
    short = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("term")).alias("rank"), F.lit("term").alias("kind"), t["end"].alias("end")))
    return found.select("doc_id", *counts, F.sha2(joined_spans(F.col("spans")), 256).alias("base_sha256"), joined_spans(F.array_sort(F.concat(short, terms))).alias("spans"))
