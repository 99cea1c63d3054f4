"""The corpus pipeline: quality, near duplicates, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before has kept;
``run`` writes its result as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import dedup, packing, quality, secrets
from quillmesh.llm.common import table
from quillmesh.plans.components import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject; null and empty texts are scored like others."""
    docs = docs.select(*COLUMNS)
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, field).filter(F.col("score") >= quality.KEEP_FROM).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; of repeated rows one.

    Texts without words, and documents without an id, have no group and stay.
    """
    docs = docs.select(*COLUMNS)
    kept = dedup.near_duplicates(docs, k=5, percent=80).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*COLUMNS).unionByName(docs.filter(F.col("doc_id").isNull()))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret replaced by a mark; all documents stay.

    A null text stays null, a repeated row is a row, an empty table stays empty; of other columns
    than those of documents none passes.
    """
    out = secrets.redact_secrets(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: the pieces of all documents with their ids.

    A null text yields its end token alone, a repeated row is packed again, a text of any length is
    cut into windows, an empty table gives none.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("minhash near-dedup", keep_one_of_each),
    ("secret scans", redact),
    ("packing", pack),
]

#: Neither the field nor the tokenizer can be said in SQL; the tests hold a brute-force version against it.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's folder goes once the next one is written, the last stays with its rows."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            _remove(spark, f"{place}/{k - 1}")
    return docs
