"""A corpus from documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import mixing, packing, pii, quality, resemblance
from fieldloom.llm.queries import tokenizer_path
from fieldloom.llm.tables import materialise, read, small_batches

# The classifier draws on labels that SQL has no model for.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is ``quality.MIN_TAIL`` or more."""
    small_batches(spark)
    rated = quality.classify(docs, read(spark, sf_dir, "labels"))
    return rated.where(f"`{rated.columns[-1]}`").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group by word shingles of similarity 0.8 or more."""
    small_batches(spark)
    return resemblance.deduplicate(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` counted anew."""
    small_batches(spark)
    return pii.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words in all, in shares by weight; a row for each pass that takes words of a document."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every sequence, with their token ids."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
