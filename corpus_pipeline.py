"""A training corpus from `documents`: select, dedup lines, dedup documents, mix, pack.

Each stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inciflow.llm import line_dedup, mixing, near_copies, packing, quality
from inciflow.llm.common import stored
from inciflow.llm.queries import table, vocabulary


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good by the ordinal model, which learns from the rated ones among `docs`."""
    return quality.select_good(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; a null text stays null."""
    out = line_dedup.dedup_lines(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    new = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return out.withColumns({k: v for k, v in new.items() if k in docs.columns}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by SimHash, to which pairs with a Jaccard similarity of 0.8 or more are added."""
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it, twice at most."""
    return mixing.mix_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality", select_quality),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_windows),
]

#: Learning, SimHash and tokenizing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
