"""From raw documents to a training mix: five stages, each a Parquet table for the next.

All stages read the columns of documents and no others, whatever else a table has. Rows
without a doc_id or with one that repeats go through every stage as the operators say;
null and empty texts are judged like any other; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from derivant.llm import decontaminate, mixing, ngram_join, pii, quality
from derivant.llm._shared import discard, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the classifier rejects go, row by row; without labels all stay."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group linked at 0.8 on five-word shingles the smallest doc_id stays.

    Rows without a doc_id or without words are linked with nothing and stay, as do all rows
    of a doc_id that stays.
    """
    return ngram_join.keep_one(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that contain a benchmark item go, those without a doc_id, too."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: personal data is replaced by its kind; n_chars follows the text (null: null)."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one row for each copy that the mix takes; texts without words are not taken."""
    mixed = mixing.mix(docs.select(*COLUMNS), carry=("text", "lang", "source", "n_chars"))
    copies = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return copies.select("doc_id", "copy", *[F.col(f"c_{c}").alias(c) for c in COLUMNS[1:]], "size", "source_size", "target")


STAGES = [
    ("quality", select_quality),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: The classifier of the first stage is trained; SQL has no words for that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*read)  # nothing but the stage just written was made of it
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
