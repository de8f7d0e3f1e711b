"""The corpus pipeline: five stages, each over all that the stage before kept, written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, langid, packing, pii, suffixes
from tidemark.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A repeated passage of over 50 words goes, however short its words are; of 400 bytes, however few its words are.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 400
#: A text goes where its trigrams are on average so much (in nats) less likely under its languages than under none.
LEAST_MARGIN = -0.5


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars brought up to date."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null texts, texts without a letter, and texts that a model of no
    language at all (every trigram alike) explains better by LEAST_MARGIN than the best mixture of learned languages. ``lang``
    becomes the language found. Where no language could be learned, texts with a letter stay, with their lang.

    Repeated rows stay or go together, an empty table gives an empty one, a null doc_id stays null, a very long text is one
    text like any other, and columns that documents doesn't have are dropped, whatever their names.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit(langid.training_rows(docs))
    docs = docs.filter(F.regexp("text", F.lit(r"\p{L}")))
    if not model.langs:
        return docs
    return langid.with_language(docs, model).filter(F.col("margin") > LEAST_MARGIN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the least id stays, once; documents without
    an id or a shingle stay. Where one id has several texts, all of them go or stay by the id.

    Repeated rows stay once, an empty table gives an empty one, and columns that documents doesn't have are dropped.
    """
    groups = jaccard.near_duplicates(docs, size=5, percent=80)
    # an id goes if all its texts are copies of lesser ids
    by = groups.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = cut(by.filter(~F.col("stays")).select("doc_id"), "pipeline-gone")
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    return kept.withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of 400 bytes, that occur twice go from every text; so does a character of which only
    some bytes stay. A text of which nothing stays goes as a whole.

    A text that was empty or blank before stays; repeated rows repeat each other; an empty table gives an empty one; columns
    that documents doesn't have are dropped.
    """
    found = suffixes.remove_repeats(docs, carry=("lang", "source", "n_chars"), length=PASSAGE_BYTES, words=PASSAGE_WORDS)
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    # a broken character's bytes become the replacement character
    whole = F.when(F.col("n_removed") == 0, text).otherwise(F.regexp_replace(text, "\ufffd", ""))
    out = found.select("doc_id", whole.alias("text"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_n_chars").alias("n_chars"), "n_removed")
    return _documents(out.filter((F.col("n_removed") == 0) | F.regexp("text", F.lit(r"\S"))))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in square brackets. Null and empty texts stay as they are, repeated rows
    stay, an empty table gives an empty one, and columns that documents doesn't have are dropped."""
    found, model = pii.find(docs, carry=("text", "lang", "source", "n_chars"))
    return _documents(pii.redact_found(found, model))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of up to 2048 ids: nulls, repeats and empty tables as ``packing.pack`` says."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packed),
]
#: Learned models and token ids are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
