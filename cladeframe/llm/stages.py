"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir), works on all rows of docs, and returns its decision.

What holds for all: nulls, empty and very long texts, repeated rows and other columns are treated as the operator that a
stage calls says; other columns are carried through up to the last stage; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import bpe, jaccard, mixing, pii, quality
from cladeframe.llm.common import held_out, materialise, read
from cladeframe.llm.queries import tokenizer_path

#: Words of a slot of the mix: long enough that a document is seldom cut.
MIX_BLOCK = 256


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars anew, null for a null text; a table without that column gets none."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def screen_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the labels, does not reject.

    A null, empty or wordless text gets the share of good documents as its score, so it stays where that is 0.3 or more.
    """
    return quality.screen(docs, read(spark, sf_dir, "labels", "doc_id", "quality"), ~held_out("doc_id", 5, 0))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id; every row is a document of its own."""
    return jaccard.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; null texts stay null."""
    return with_length(pii.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in the order of its slots: the parts of documents that the slots take, as often as they take them.

    Null, empty and wordless texts are of no size, so the mix takes none of them.
    """
    return with_length(mixing.take(docs, block=MIX_BLOCK))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and digests; a null text has no tokens."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("quality classifier", screen_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact_personal_data),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder; each is written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
