"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftshelf.llm import decontaminate, line_dedup, pieces, simhash, toxicity
from driftshelf.llm.common import new_folder, small_batches, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the models are trained on the labelled ones among them."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines. A document all of whose text was repeated goes; n_chars follows the text."""
    small_batches(spark)
    found = line_dedup.drop_repeated_lines(docs)
    kept = found.where(
        (F.col("dedup.n_removed") == 0) | (F.trim(F.coalesce("dedup.kept", F.lit(""))) != "")
    )
    changed = {"text": F.col("dedup.kept")}
    if "n_chars" in docs.columns:
        shorter = F.length("dedup.kept").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("dedup.n_removed") > 0, shorter).otherwise(F.col("row.n_chars"))
    return kept.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of close fingerprints, by the shingles and distance of the operator."""
    small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids and source spans of each text, beside the columns of documents."""
    small_batches(spark)
    import public_tokenizers

    return pieces.encode_texts(docs, public_tokenizers.path(pieces.MODEL))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]
#: SQL can express neither the trained score nor the linked lines.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what one keeps is written to the shared folder and is the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_folder(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
