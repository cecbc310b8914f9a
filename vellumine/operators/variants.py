"""JSON of unlike shapes by Spark's variant type: its leaves with their paths, and the shape that all rows share.

Cases: null text has no leaves. Text that is no JSON, or names a key of an object twice, is one row of type malformed with a null path and the text as its value. An empty object or array is a leaf of its own type.
Repeated rows have their leaves each; an empty table has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.names import unused
from vellumine.plans.scratch import Scratch

PLAIN_KEY = r"^[A-Za-z_][A-Za-z_0-9]*$"


def _kind(v: Column, name: Column) -> Column:
    """Type of a leaf's path; name: the variant's type as DDL."""
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "VOID", "null").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(v.isNotNull(), "number").otherwise("malformed")
    )


def _told(rows: DataFrame) -> DataFrame:
    """held, path, type and value of rows that are leaves, and of the others the variant v, null for leaves; rows: held, path, text and v, null for text that is no JSON."""
    named = rows.withColumn("name", F.schema_of_variant("v"))  # once for each row
    empty = (F.col("name") == "OBJECT<>") | ((F.col("name") == "ARRAY<VOID>") & (F.to_json("v") == "[]"))
    nested = F.coalesce(F.col("name").startswith("OBJECT") | F.col("name").startswith("ARRAY"), F.lit(False)) & ~F.coalesce(empty, F.lit(False))
    value = F.when(F.col("v").isNull(), F.col("text")).when(F.col("name") == "STRING", F.expr("variant_get(v, '$', 'string')")).when(F.col("name") != "VOID", F.to_json("v"))
    path = F.when(F.col("v").isNotNull(), F.col("path"))
    return named.select("held", "text", "v", path.alias("path"), _kind(F.col("v"), F.col("name")).alias("type"), nested.alias("nested"), value.alias("value")).select("held", "path", F.when(~F.col("nested"), F.col("type")).alias("type"), F.when(~F.col("nested"), F.col("value")).alias("value"), F.when(F.col("nested"), F.col("v")).alias("v"))


def leaves(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """The columns of keep, path, type (string, number, boolean, null, object, array, malformed) and value, as text, of every leaf of the JSON text in col, however deep; keep has columns of other names.

    Each level of nesting is one pass, which opens what is nested, tells what it finds and writes both leaves and what is still nested; only the latter is read for the next level. So each text is parsed once and each value told once.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "leaves")
    held, text = unused("held", df), unused("text", df)
    rows = df.where(F.col(col).isNotNull()).select(F.struct(*keep).alias(held) if keep else F.lit(None).cast("string").alias(held), F.col(col).alias(text))
    rows = rows.select(F.col(held).alias("held"), F.col(text).alias("text"), F.lit("$").alias("path"), F.try_parse_json(text).alias("v"))
    found, n = None, 0
    while True:
        if n:  # of what the level before has found nested
            step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("key").rlike(PLAIN_KEY), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit('["'), F.replace(F.replace("key", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"]')))
            inner = spark.sql("select held, path, pos, key, value from {v}, lateral variant_explode(v) as e(pos, key, value)", v=level.where("v is not null").select("held", "path", "v"))
            rows = inner.select("held", F.lit(None).cast("string").alias("text"), F.concat("path", step).alias("path"), F.col("value").alias("v"))
        level = scratch.write(_told(rows), f"level{n}")
        own = level.where("v is null").select("held", "path", "type", "value")
        found, n = own if found is None else found.unionByName(own), n + 1
        if level.where("v is not null").isEmpty():
            return found.select("held.*" if keep else F.lit(None).alias("none"), "path", "type", "value").drop(*(() if keep else ("none",)))


def shape(df: DataFrame, col: str, *by: str) -> DataFrame:
    """by, n, malformed (texts that are no JSON) and shape: the one type, as DDL of variants, that holds all well-formed texts of the group; unlike ones are VARIANT there. State grows with the keys in use, not with the rows."""
    v = F.try_parse_json(col)
    return df.groupBy(*by).agg(F.count(col).alias("n"), F.count(F.when(F.col(col).isNotNull() & v.isNull(), 1)).alias("malformed"), F.schema_of_variant_agg(v).alias("shape"))
