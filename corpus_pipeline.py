"""The corpus pipeline: five stages, each of which works on all that the one before it kept.

Nulls: a null text is an empty one and stays null, a null id stays null; neither makes a stage drop a row. Repeated rows
score, match and are masked alike; near-dedup keeps one of them. Empty and very long texts are read whole. Further
columns, whatever their names, pass all stages but the last. Empty tables give an empty result; without labels of both
classes no document is toxic, and without benchmark items none is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import common, decontaminate, packing, secrets, simhash, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the others stay as they are."""
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays."""
    return simhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the secrets in them are masked."""
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    packed = packing.pack(packing.pieces(docs))
    return packed.select("doc_id", "start", packed["length"].cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The stages train, hash and tokenise, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next; what a stage wrote on its way
    is dropped once its result is there, and that once the next one's is."""
    docs, since = common.table(spark, sf_dir, "documents"), common.made()
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
        common.drop_all_but_last(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)
