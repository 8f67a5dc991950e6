"""The corpus pipeline: stages over ``documents``, each one operator of ``jsonmend.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``.  Every stage takes nulls in any column, empty and
very long texts, repeated rows and columns beyond those of ``documents``, which
it leaves out; from an empty table it makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonmend.llm import bpe, exact, language, mixing, neardup
from jsonmend.llm.common import fold_bucket, materialize, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction below this is no better than chance among a handful of languages.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts that no language fits; the prediction becomes ``lang``.

    The classifier learns from the labelled two thirds of its own input.  Where
    nothing is labelled, no row is rejected.  Null and empty texts are; repeated
    rows share their fate.
    """
    model = language.train(docs, fold_bucket("doc_id", 3) != 1)
    found = language.predict_language(docs.select(*COLUMNS), model)
    if not model.languages:
        return docs.select(*COLUMNS)
    fits = (F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)
    return found.filter(fits).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal without white space stays: the longest, then the smallest id.

    Null texts count as empty and are copies of one another; of wholly equal rows one stays.
    """
    return exact.drop_exact_copies(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 or more over five-word shingles stays, the smallest id.

    Null and empty texts and rows with a null id are linked with nothing and stay.
    """
    return neardup.drop_near_copies(docs.select(*COLUMNS), percent=80, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or dropped so that the sources meet their target words.

    A null source is one source; texts without words stay once.
    """
    return mixing.mix_documents(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a kept copy: doc_id, token_ids, n_tokens and digests of the ids and the decoded text; null texts have no ids."""
    return bpe.encode_documents(docs, bpe.default_tokenizer(), ("token_ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: Training, sketches and tokenization have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
