"""A corpus pipeline of five stages; each takes what its predecessor kept.

Toxic documents go, one document of each group of near copies stays, secrets
are replaced, sources are mixed to their targets (documents repeat as often as
they are taken), and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import mixing, ngram_join, packing, secrets, toxicity
from tessella.llm.queries import table, vocabulary
from tessella.plans.store import Scratch

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below TOXIC; null and empty texts stay, repeated rows share one fate.  An empty table gives an empty table, as in all stages; columns of any name are kept in all but the last."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxic_column(model, docs) < TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of five-word shingles of 0.8 or more link."""
    return ngram_join.one_of_each(docs, k=5, num=80, den=100)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a marker; null and empty texts as they are, repeated rows each."""
    words = vocabulary("byte_bpe_50k.json")
    return secrets.redact(docs, secrets.fit(vocabulary=words), words)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null texts have no words and are taken as their source's certain copies, repeated rows one by one."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place; a null text is one piece of the end id, repeated documents have pieces each."""
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", replace_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: No stage but the mixing can be said in SQL; tests/llm compares all with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
