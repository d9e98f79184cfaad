"""Corpus cleaning: STAGES in order, each written as Parquet and reread as the next one's documents.

toxicity: documents whose restored text scores as toxic go. near_duplicates: of each group of documents linked by
5-word shingles with a Jaccard similarity of 0.8 or more, the one with the smallest doc_id stays. decontamination:
documents that hold a copy of a benchmark item go. pii: spans are replaced by their kind. packing: sequences of 2048
ids along the Hilbert curve (pieces with their ids; not columns of documents any more).

Cases: rows whose text is null, empty or wordless pass all stages, each as its end id alone; of repeated rows one stays
if they have words; rows are judged by their own text, so a doc_id may repeat or be null; very long texts are
handled whole; ties go by doc_id; an empty table gives no pieces; further columns, of any name, go along up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm.decontamination import drop_leaks
from geoloom.llm.hilbert_pack import pack_documents
from geoloom.llm.parity_join import drop_near_duplicates
from geoloom.llm.pii import mask_pii
from geoloom.llm.runtime import materialise, modest_batches, release, table
from geoloom.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    modest_batches(spark)
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: The decoder, alignments and expectation-maximisation have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        kept = materialise(made, name)
        release(made, docs)  # what the stage wrote for itself, and the stage before
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
