"""The corpus pipeline: documents to packed training sequences, one stage per operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatscope.llm.decontaminate import drop_contaminated
from seatscope.llm.frames import discard, remainder, staged
from seatscope.llm.packing import pack_documents
from seatscope.llm.pii import pseudonymise, session_key
from seatscope.llm.simhash import keep_one_of_each
from seatscope.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; null and empty texts are scored like any, repeated rows alike.

    Without a toxic label among the training rows, or without documents, nothing goes.
    """
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(F.col("doc_id"), 5) != 0)
    return drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; links as in operator 7.

    Three-word shingles, two differing bits. Null, empty and white texts are one group; of rows that repeat
    id and text one stays; rows of one id and different texts are separate documents.
    """
    return keep_one_of_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark windows go; texts without words stay."""
    return drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to pseudonyms of the same length and format; nulls and all rows stay.

    The key is the session's, see ``session_key``.
    """
    return pseudonymise(docs, session_key(spark), count=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens: one row per piece of a document; a null or empty text is its end token."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("packing", packing),
]

# No SQL: learned scores, tokens and keyed permutations are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again by the next.

    A stage's input is removed from there once its result is written; the last input stays for the result.
    """
    docs = given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        result = staged(spark, stage(spark, docs, sf_dir))
        if docs is not given:
            discard(spark, docs)
        docs = result
    return STAGES[-1][1](spark, docs, sf_dir)
