"""A training corpus from raw documents, in five stages; each one's rows are written as Parquet and reread.

Every stage but the last returns the columns of documents, and its decisions take effect: documents that
fail the quality rules or come from rejected hosts go, one document of each near-duplicate group stays,
documents that hold benchmark items go, personal data is replaced by its kind, and the last stage says
how many words of each document the mix takes.

Null texts have no words and fail the quality rules. Null sources are one host, and one source of the mix,
last in order. Null doc_ids stay null: near-dedup keeps such a row only where its group has no id, and one
row of each text. Rows that repeat a doc_id are one document to near-dedup, which keeps one of them. An
empty table passes through all stages and gives no rows. Extra columns, whatever their names, are carried
along to the last stage, which has columns of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corvex.llm import decontaminate, mixing, pii, quality_rules, simhash
from corvex.llm.common import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("PII", personal_data), ("mixing sources", mixing_sources)]

#: SimHash needs XXH64 bits, and groups a transitive closure over them, which DuckDB SQL can't express at this size.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what lies between them is written to the folder of spark.checkpoint.dir, or the warehouse where none is set.

    A stage's rows are deleted once the next one's are written; the last one's stay for whoever reads the result."""
    docs = table(spark, sf_dir, "documents")
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            _delete(spark, f"{folder}/{number - 1}")
    return docs
