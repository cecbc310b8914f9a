"""Tables as DataFrames, and items of unlike kinds as one catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, item_id, body of every document, page (tags replaced by spaces) and turn of a conversation."""
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("item_id"), F.col("text").alias("body"))
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("item_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("body"))
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.concat_ws(":", "conv_id", "turn").alias("item_id"), F.col("text").alias("body"))
    return docs.unionByName(pages).unionByName(turns)


def write(df: DataFrame, path: str, form: str = "parquet", by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Sink: parquet, orc, json or csv, partitioned by columns."""
    out = df.write.mode(mode).format(form)
    (out.partitionBy(*by) if by else out).save(path)


def read(spark: SparkSession, path: str, form: str = "parquet", schema=None) -> DataFrame:
    """Source: parquet, orc, json or csv; text forms need a schema, so that no pass infers one."""
    if form in ("json", "csv") and schema is None:
        raise ValueError(f"{form} needs a schema")
    reader = spark.read.format(form)
    return (reader.schema(schema) if schema is not None else reader).load(path)
