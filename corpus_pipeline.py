"""Documents to training windows: quality, recurring lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, line_dedup, near_dup, packing, quality
from skein.llm._text import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for poor or toxic go, as do NULL and empty texts."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs in documents go from all of them but one; n_chars follows the text."""
    out = line_dedup.without_recurring_lines(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id."""
    return near_dup.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that quote a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows: (window_id, at, doc_id, start, n_tokens), a row for each piece of a document."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL has no convolutional network, so the first stage, and with it the whole, is tested against Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another from documents, each written as Parquet in the session's shared folder and read again."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="skein-")
    folder = f"{shared}/pipeline-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    docs = table(spark, sf_dir, "documents")
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
