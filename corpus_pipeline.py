"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept and returns them with the
same columns; the last returns pieces of sequences. Every stage is written to the
shared folder and read again, so a lost executor costs one stage at most.

1. language: documents without a letter, whose language nothing can tell, go; those
   of several languages or of few words stay. A missing ``lang`` is filled in.
2. near_duplicates: the document with the smallest id of each group stays.
3. repeats: passages of 50 words that a document with a smaller id has too are cut.
4. personal_data: identifiers, and terms that give them away, are masked.
5. packing: texts are encoded and cut into powers of two.

``n_chars`` follows the text. A document that loses all its words stays, empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knownby.llm import language_crf, order_minhash, packing, pii, substring_dedup
from knownby.llm.tables import prepare, table
from knownby.session import materialize

#: Learned models, hashing and tokenizers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; a missing language is filled in. Null texts and texts without a letter go; repeated rows each stay or go alike."""
    prepare(spark)
    model = language_crf.fit(docs.select("doc_id", "text", "lang"))
    told = language_crf.predict(docs, model, prefix="_").where(F.col("_lang_pred") != language_crf.UNDETERMINED)
    return told.withColumn("lang", F.coalesce("lang", "_lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; null and empty texts are near to nothing and stay."""
    prepare(spark)
    return order_minhash.deduplicate(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that one with a smaller id has too; null texts stay null, repeated rows get repeated results."""
    prepare(spark)
    return measured(substring_dedup.remove_repeats(docs), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers and terms that give them away masked in the whole text; null texts stay null."""
    return measured(pii.sanitise(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: every id of every document once, and its end id; a null or empty text is the end id alone."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY)).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("personal_data", personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
