"""A corpus pipeline out of the operators of ``tessera.llm``.

STAGES are applied in order, each to all that its predecessor kept: toxic documents go; of near duplicates one stays; personal
data is masked; sources are mixed to target weights; what results is packed into token sequences. All stages but the last
return the columns of ``documents``. Rows need no id of their own: in the second stage their text identifies them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixture, near_copies, packing, pii, toxicity
from tessera.llm.common import cut

#: SQL has no tokenizer, no XXH64 and no fitted model; tests compare with brute force.
ORACLE_SQL = None


def counted(docs: DataFrame) -> DataFrame:
    """With n_chars as it is after a change of texts."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of any toxic grade is below one half."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of its least id: texts whose five-word shingles have a similarity of 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each personal datum in its place."""
    return counted(pii.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that their sources reach their targets."""
    return counted(mixture.repeat(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.digest(packing.pack_documents(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage but the last returns is kept in the checkpoint folder, so that stages read it
    as often as they like and a lost executor costs no earlier stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
