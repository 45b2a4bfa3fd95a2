"""Documents to packed training sequences: filter, deduplicate twice, redact, pack.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of documents. An empty table
passes through every stage as one, columns beside doc_id and text stay as they
are whatever their names, and texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecengine.llm import classifier, neardup, packing, secrets, substring
from vecengine.llm.queries import WORD_BPE, table
from vecengine.llm.shared import bound_batches, materialize


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts go; rows that repeat both id and text stay or go together; a null doc_id may stay.
    """
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (80 % or more of their five-word shingles in common) stays.

    The least doc_id stays; of rows that repeat it, the one whose text has the least digest. Null and empty texts are
    like no other and stay, as do rows with a null doc_id.
    """
    bound_batches(spark)
    return neardup.drop_near_duplicates(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier, by (doc_id, place), are cut out of the texts.

    No row goes. Null and empty texts, texts of fewer than 20 words and rows with a null doc_id stay as they are; of
    rows that repeat a doc_id, those with another text than the one of the least digest do, too.
    """
    bound_batches(spark)
    return substring.remove_passages(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark.

    No row goes; null and empty texts stay as they are, and repeated rows are treated alike.
    """
    bound_batches(spark)
    return secrets.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences that hold them.

    A null text is packed as an empty one, which is its end id; repeated rows are packed each for itself.
    """
    bound_batches(spark)
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("near duplicates", keep_one_of_each),
    ("repeated passages", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Tokenising and the classifier are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
