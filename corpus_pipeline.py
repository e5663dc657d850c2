"""The corpus pipeline: toxicity, exact duplicates, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame; all but
the last return the columns of documents. run() writes each stage's rows to the shared folder and
reads them back for the next, so a lost executor costs no more than its tasks of one stage; a stage's
rows are removed when the next are written.

Defined results of every stage: a null text counts as empty; a null id is an id of its own that comes last;
rows that repeat an id are rows of their own, told apart by their texts; other columns are carried and never
read, whatever their names; no documents give no rows. Ties are said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from rasterloom.llm.common import discard, documents, materialise

#: Near duplicates share 80 % of their sets of five words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Documents from this score on are rejected.
TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC_FROM; the model learns from the labels of docs. Rows with
    equal texts have equal scores; without labels of both kinds all documents have the share of toxic ones as score."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("__score") < TOXIC_FROM).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest original, then the smallest id stays, then the text with the smallest hash; empty texts are equal."""
    return exact_dedup.keep_distinct(docs, exact_dedup.DigestIndex(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest id stays; texts without words all stay."""
    return jaccard_join.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs' rows as often as the mixture takes them: 150 % of all words, by source weights 5, 2, 1. Rows without words
    are not taken; rows that agree in id, text and source share what is taken of them."""
    return mixing.mixed_rows(docs, mixing.plan_mix(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens; an empty text is its end id alone, and every row is packed."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
