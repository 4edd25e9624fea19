"""A corpus pipeline: toxic documents go, one document of each group of near copies stays, contaminated
documents go, personal data is masked, and what is left is packed into token sequences.

Part of the subpackage ``tidemark.llm``.  ``STAGES`` are (name, function); each function takes
(spark, docs, sf_dir) and returns a DataFrame, of the columns of ``docs`` but for the last.

Edge cases: documents with null or empty text stay and are packed as the end id only; a document without
doc_id stays in every stage that decides by doc_id; repeated rows share one decision; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, minhash, packing, pii, toxicity
from tidemark.llm.common import column, new_path, positional, remove, scratch, table


def _of(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """The documents that are among the found ones (``left_semi``), or not (``left_anti``); columns as they are."""
    rows, doc_id = positional(docs), F.col(column(docs, "doc_id")).cast("long")
    return rows.join(found.select(F.col("doc_id").alias("found")), doc_id == F.col("found"), how).toDF(*docs.columns)


#: Rows of an Arrow batch in all stages: with whole texts, the usual 10,000 rows take tens of MB in the JVM and again in each worker.
BATCH = 1000


def _lean(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    return toxicity.accepted(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


#: Jaccard similarity, in percent, from which documents are near copies to this pipeline.
NEAR = 80


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    kept = minhash.near_duplicates(docs, percent=NEAR).where("kept").select("doc_id")
    unnamed = positional(docs).where(F.col(column(docs, "doc_id")).isNull())  # these cannot be told apart, so they stay
    return positional(_of(docs, kept, "left_semi")).union(unnamed).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    return _of(docs, found, "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    return pii.redacted(docs)


#: Chunks of text that a worker of the last stage keeps: executors have grown by then.
CACHE = 250_000


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _lean(spark)
    return packing.packed(docs, cache=CACHE)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("personal_data", mask_personal_data), ("packing", pack)]
#: The stages need a trained network, a trained field and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again.

    What a stage staged on its way goes once its result is written, and that once the next one's is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with scratch():
            result = stage(spark, docs, sf_dir)
            result.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
