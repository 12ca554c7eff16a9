"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage works on all rows that the one before kept, row by row: rows that repeat a
doc_id and rows without one are carried like any other as far as a stage can judge them.
Empty tables pass through; columns beyond those of ``documents`` are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import bpe, common, langid, minhash, mixing, repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text stays if one language covers at least this share of its letters.
LEAST_SHARE = 0.4
#: Copies of a document that are made from one array.
COPIES_AT_ONCE = 1_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language; ``lang`` becomes the one found.

    A document is rejected if its text is null or has no letter, or if no language
    covers LEAST_SHARE of it. Rows without doc_id are judged alike, repeated rows alone.
    """
    rows = docs.select(*COLUMNS)
    labelled = langid.label_rows(rows, langid.train(rows))
    clean = labelled.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE))
    return clean.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of each near-duplicate group.

    Rows without doc_id stay, as do documents without words. Of rows that repeat a
    doc_id, which count as one document, the one with the least text stays (nulls last;
    of equal rows one, the least by its other columns).
    """
    rows = docs.select(*COLUMNS)
    kept = minhash.near_duplicates(rows).where("doc_id is not null and kept").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    kept = common.materialize(kept, "kept")
    stays = rows.join(kept.where("_rows = 1"), "doc_id", "left_semi").select(*COLUMNS).unionByName(rows.where(F.col("doc_id").isNull()))
    again = kept.where("_rows > 1")
    if again.isEmpty():
        return stays
    order = F.struct(F.col("text").isNull().alias("bare"), *COLUMNS[1:])
    least = rows.join(again, "doc_id").groupBy("doc_id").agg(F.min(order).alias("_least"))
    return stays.unionByName(least.select("doc_id", *(F.col(f"_least.{c}").alias(c) for c in COLUMNS[1:])))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut what repeats 100 bytes from before; documents of which nothing is left go.

    A row without doc_id stays as it is, as does one whose text was null or empty
    before. Rows that repeat a doc_id are compared in order of their texts.
    """
    cut = repeats.without_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).where((F.col("n_chars") > 0) | (F.col("n_removed") == 0)).select(*COLUMNS)


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the domains reach their target weights.

    Each row has its own rate and copies, whatever doc_id it has; rows of one doc_id
    share the draw that rounds the rate. Null texts have no tokens and the rate of a
    text without words.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), common.read(spark, sf_dir, "labels"), keep=tuple(COLUMNS)).where("copies > 0")
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES_AT_ONCE))).alias("_part")
    times = F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES_AT_ONCE), F.col("copies") - F.col("_part") * COPIES_AT_ONCE))).alias("_copy")
    return mixed.select(*COLUMNS, "copies", parts).select(*COLUMNS, times).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text; the ids come with digests of ids and decoded text.

    One row for each row, repeated ones and those without doc_id included; a null text
    has no ids.
    """
    return bpe.encoded_rows(docs.select(*COLUMNS), common.package_path(bpe.TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing_rates", mixing_rates),
    ("encoding", encoding),
]
#: SQL has no language model, MinHash or tokenizer; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; between stages the rows go through a written table."""
    docs = common.read(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = common.materialize(docs, name)
    return docs
