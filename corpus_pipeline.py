"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last return the columns of
``docs``.  ``run`` writes each stage's result to the shared folder and gives the next one the files.

* toxicity: the model is fitted on the labelled rows of sf_dir that aren't held out; documents with a score of 0.5 or more go.
* exact dedup: of equal texts the row with the largest doc_id stays.
* near dedup: of linked documents (five words, Jaccard 0.8) the row with the least doc_id stays.
* mixing: the weights keep every document and repeat none more than twice; a document repeats as rows.
* packing: the rows' pieces with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basetrack.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from basetrack.llm.common import folders, materialise, release, shared_dir, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(table(spark, sf_dir, "documents"), labels.where(~toxicity.held_out(labels["doc_id"])))
    others = tuple(c for c in docs.columns if c != "doc_id")
    scored = toxicity.score(docs, model, keep=others)
    return scored.where(F.col(scored.columns[-2]) < 0.5).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_of_groups(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", clean), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("best-fit packing", pack)]

#: A trained network and a tokenizer are no SQL; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before = folders()
        docs = materialise(stage(spark, docs, sf_dir), folder, f"stage-{i}")
        release(spark, (x for x in folders() if x not in before))  # a written stage needs its steps no more
    return STAGES[-1][1](spark, docs, sf_dir)
