"""The corpus pipeline: quality, near duplicates, benchmark contamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents. A stage works on all rows it is given.

What holds in each of them: null texts count as empty, null ids stay null, and an empty table passes through; texts are read
whole, whatever their length; repeated rows are decided alike, so all of them stay or go; extra columns, whatever their names,
are dropped first.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import decontam, neardup, packing, quality, secrets
from loomframe.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5, that score itself included. An empty text has the score of no evidence, which
    follows the share of good labels. Without labels every score is 0.5, so all documents stay."""
    docs = docs.select(*COLUMNS)
    model = quality.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score_quality(docs, model, keep=COLUMNS).where(F.col("score") >= 0.5).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a similarity of 0.80 or more on five-word shingles.

    Ties do not arise: the smallest id stays. Rows that share a doc_id are one document here and stay or go together.
    """
    docs = docs.select(*COLUMNS)
    found = neardup.near_duplicates(docs.select("doc_id", "text"), percent=80)
    gone = stored(found.where(~F.col("kept")).select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. Texts without words have none, so they stay."""
    found = decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.where(F.col("n_hit") == 0).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets replaced; where spans overlap, the first by position is replaced and the rest
    of the other with it. n_chars counts the text as it is then; it is null for a null text."""
    rest = tuple(c for c in COLUMNS if c not in ("text", "n_chars"))
    found = secrets.scan_secrets(docs.select(*COLUMNS), keep=rest)
    clean = found.withColumn("text", F.col("redacted"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 1024 tokens. An empty text is its end token; repeated rows are
    packed each; pieces of equal length are interchangeable, so ties may fall either way."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result but the last is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses neither the classifier nor the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None
