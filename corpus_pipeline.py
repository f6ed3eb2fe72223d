"""From raw documents to token ids: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolith.llm import decontaminate, pieces, pii, quality, simhash
from topolith.llm.common import table
from topolith.llm.settings import PIECE_MODEL, PII_KEY
from topolith.operators.materialize import Stored, scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, rejects go.

    Null and empty texts get a score as any other and so may go; repeated rows go
    or stay alike. Without two classes among the labels all stay or all go, by
    the share of good ones. Columns are as they were, whatever their names; an
    empty table gives an empty result.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts alike at 0.8 in runs of five words stays: that of the smallest id.

    Null, empty and blank texts are one group. Of rows equal in id and text one
    stays, rows of one id in different groups stay each, and rows without an id come
    last in a group. Columns are as they were; an empty table gives an empty result.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none; null items are left out, and an empty
    benchmark removes nothing. Repeated rows go or stay alike; columns are as
    they were; an empty table gives an empty result.
    """
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values in texts become pseudonyms; ``n_chars`` follows the text.

    All rows stay; a null text stays null, with a null ``n_chars``. Columns keep
    their types; an empty table gives an empty result.
    """
    out = pii.pseudonymise(docs, PII_KEY, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again as a check.

    All rows stay, null texts as empty ones; very long texts are encoded whole;
    an empty table gives an empty result.
    """
    return pieces.encode_documents(docs, PIECE_MODEL, keep=("lang", "source"))


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("sentencepiece encoding and decoding", encode),
]

# training, iteration to a fixed point and piece matching have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again.

    What a stage has stored on its way goes once its result is written, as
    does the result of the stage before.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch():
            held = Stored(stage(spark, docs, sf_dir)).keep()
        if before is not None:
            before.drop()
        docs, before = held.df, held
    return STAGES[-1][1](spark, docs, sf_dir)
