"""What several operators share: words, tables, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these six.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; if its scan has fewer splits than there are cores (a small file is one row group), its rows are dealt to all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def let(value: Column, body) -> Column:
    """body(value) with value computed once: higher-order functions evaluate a captured expression for every element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words, without building them: split leaves an empty part only at the ends."""
    text = F.coalesce(text, F.lit(""))
    return let(
        F.split(text, SPACE),
        lambda p: F.size(p) - F.when(p[0] == "", 1).otherwise(0) - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0),
    ).cast("long")


def own_name(df: DataFrame, name: str) -> str:
    """A column name that df lacks, so that extra columns of the input never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of spark.checkpoint.dir; a folder of our own only where none is set."""
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="corvex-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_python(docs: DataFrame, run, schema: str, text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """docs.mapInPandas over doc_id, text and more, giving doc_id and the columns of schema. doc_id travels as a
    string: one null in a batch of longs would turn its ids into floats, which round those above 2 ** 53."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("text"), *more)
    out = rows.mapInPandas(run, f"doc_id string, {schema}")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def strings(values):
    """A column of Python strings; pandas' own string type may reach Arrow in pieces, which Spark rejects."""
    import pandas as pd

    return pd.Series([None if v is None or v != v else v for v in values], dtype=object)
