"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last return the columns of
documents, with any others the table has. What a stage wrote on its way is deleted once its output is written.

quality: drops what the base rules or a certified cutoff reject; null and empty texts fail the base rules; repeated rows are
judged one by one; labels with a null are not used, a table without labels leaves the base rules alone.
toxicity: drops what scores 0.7 or more; null and empty texts score as no evidence; without labels of both kinds nothing goes.
near_duplicates: of each class the document with the smallest id stays (a null id comes last), of repeated rows one; texts
without words are copies of nothing and all stay.
mixing: repeats or drops documents to meet the sources' targets; a null source is a source; repeated rows have their own copies;
documents without words stay once.
packing: a row for each piece with its place in a sequence; a null text is the end token alone; repeated rows are packed each.
An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import discard, materialize, read, sweep, written
from corpusloom.llm.minhash import keep_one_of_each
from corpusloom.llm.mixing import mix_documents
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.quality import drop_low_quality
from corpusloom.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs, read(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Toxicity, near-duplicate detection, mixing and packing can't be said in SQL. tests/llm/test_pipeline.py compares quality,
#: near-duplicate detection, mixing and packing with plain Python over the same rows, and toxicity with the model's scores of
#: each text; what the model is worth is measured on held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        mark, before = written(), docs
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
            sweep(spark, mark, docs)
            discard(before)  # the stage's input, if a stage wrote it
    return docs
