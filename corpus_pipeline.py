"""The corpus pipeline: language, near copies, repeated passages, benchmark leaks, packing.

Every stage but the last returns the columns of its input, as they are but for text and n_chars where passages are cut. Null,
empty and blank texts go with the first stage; rows that share an id are documents of their own; extra columns, whatever they are
called, are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import automaton, decontaminate, langid, packing, simhash
from panelforge.llm.queries import vocabulary
from panelforge.session import materialize, ship

#: Not expressible in SQL: compression, sketches, edit distance and packing decide. tests/llm compares with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts among them) or with too narrow a margin between languages."""
    return langid.accepted(docs, langid.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity of 0.8): the least id; of repeated rows one.

    Rows without an id all stay.
    """
    ship(spark)
    return simhash.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words or more that occur again; n_chars, where there is one, follows the text. A null text stays null."""
    out = automaton.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item with at most a fifth of its words edited; null items match nothing."""
    return decontaminate.clean(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens, a row a piece; a text without a token has its end id."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder before the next reads it."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
