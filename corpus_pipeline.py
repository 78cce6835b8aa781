"""A corpus pipeline of five stages, each over all that the one before kept.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import decontam, langid, mixing, packing, simhash
from panelwright.llm.common import crc_mod, row_key, table, written

#: Names that no column of documents has.
KEY = "key of the row"
COPIES, AGAIN = "copies of the row", "no. of the copy"
#: A language is rejected below so many times the probability of a guess, and at the second number at most where languages are few.
MIN_TIMES, MOST = 1.2, 0.6


def keyed_rows(docs: DataFrame) -> DataFrame:
    """With a hash of id, text and source, by which stages decide on rows, whatever their ids."""
    return docs.withColumn(KEY, row_key(docs, "doc_id", "text", "source"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those of which no language is likely, row by row."""
    model = langid.train(docs, crc_mod("doc_id", 4) != 2)
    least = min(MOST, MIN_TIMES / len(model.languages)) if model else 0.0
    keyed = keyed_rows(docs)
    good = langid.predict(keyed.select(F.col(KEY).alias("doc_id"), "text"), model).filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return keyed.join(good.select(F.col("doc_id").alias(KEY)).distinct(), KEY, "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest id, NULL ids last.

    Texts are near if their fingerprints of five-word shingles differ in few
    bits, or if they share 0.8 of these shingles.
    """
    return simhash.keep_one(docs, ngram=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates, row by row."""
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, so some not at all. Of rows alike in all columns one stands for their copies together."""
    keyed = docs.withColumn(KEY, row_key(docs, *docs.columns))
    taken = mixing.mix_sources(keyed.select(F.col(KEY).alias("doc_id"), "text", "source")).groupBy(F.col("doc_id").alias(KEY))
    copies = written(taken.agg(F.sum("copies").alias(COPIES), F.count(F.lit(1)).alias("rows")).filter(F.col(COPIES) > 0), "pipeline-copies")
    once = keyed.join(copies.filter("rows = 1").drop("rows"), KEY)
    repeated = copies.filter("rows > 1").drop("rows")
    if not repeated.isEmpty():  # none are left after near-dedup
        once = once.unionByName(keyed.join(repeated, KEY).dropDuplicates([KEY]))
    return once.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(f"`{COPIES}`").cast("int"))).alias(AGAIN)).drop(AGAIN)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(packing.encode(docs))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("pack", pack)]

#: Hashes, models and tokenizers of the stages have no SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"pipeline-{name}")
    return docs
