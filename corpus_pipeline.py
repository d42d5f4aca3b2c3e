"""The corpus pipeline: stages over documents, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. No SQL states the whole: the learned weights, the fitted rates and the packing are not relational.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.llm import lines, mixing, packing, shingles, toxicity
from tilequarry.llm.common import materialise, table

#: Lines of fewer distinct words are left alone here: a short line that occurs twice is no copied passage.
LINE_WORDS = 5
#: Tokens of a training sequence.
CAPACITY = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights).where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line matches; a document that is left without any word goes."""
    left = lines.with_text_left(lines.dedup_lines(docs, percent=80, min_tokens=LINE_WORDS), docs.columns)
    return left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return shingles.keep_one(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture uses them, so that the domains' tokens meet their target shares."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; copies of one text never share a sequence."""
    return packing.pack_documents(docs, CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("soft_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage returns is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
