"""A corpus pipeline over ``documents``: toxicity, exact dedup, SimHash near-dedup, mixing, packing.

Every stage takes a table with doc_id and text (mixing also lang) and any other columns, whatever their names, and all but the last return the same
columns. Null and empty texts are documents with an empty text, of any length texts are read whole, null ids are no ids, and an empty
table gives an empty one; what ties and repeated rows come to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import new_path, table, written
from tidelog.llm.exact_dedup import DigestIndex, drop_copies
from tidelog.llm.mixing import labelled_languages, mix, resample
from tidelog.llm.packing import default_vocabulary, pack
from tidelog.llm.simhash import drop_near_copies
from tidelog.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is likelier than not go. Each row is judged by its own text, so repeated rows and null ids fare alike; an empty text
    is not toxic. Labels without two grades to tell apart reject nothing.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, null ids being lower than any; null and empty texts are equal. Of rows that repeat id
    and text one stays.
    """
    index = DigestIndex(spark, new_path(spark, "digest-index"))
    kept = drop_copies(docs, index)
    index.close()
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document with the smallest doc_id stays. Texts without words are one group. Rows with a null id stay, as do rows
    that share the id that stays.
    """
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of rarer languages are repeated towards smoothed weights; each stays at least once.

    Rows that share an id are repeated alike, null ids too. Labels are those of ``sf_dir`` for documents that are still there; without any, or
    without a language, there is the one domain and nothing is repeated.
    """
    return resample(docs, mix(docs, labelled_languages(docs, table(spark, sf_dir, "labels"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 2048 tokens; repeated rows are packed each on its own, an empty text is the end id alone."""
    return pack(docs, default_vocabulary())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: A fitted classifier, SimHash and tokenisation have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` of ``sf_dir``, each one's result written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
