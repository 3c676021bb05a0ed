"""Delimited sinks and scans S4-S7, the literal source S8.

The reference writes TSV with f-strings (no quoting), so an embedded tab or newline breaks rows (quirk Q2).  Our own
files escape a backslash as two, a line feed as ``\\n`` and a carriage return as ``\\r``, and write null as ``\\N``; so no
text can equal a null, each record is one line and the scan splits a large file.  Separators and quotes are quoted as
usual, and edge white space is kept on both sides.  ``own=False`` reads files of other writers (quoted newlines, one
task a file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slantspark.operators.features import DOUBLE_FEATURES, FEATURE_COLUMNS

ARTICLES_RAW_SCHEMA = T.StructType([
    T.StructField("article_id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("published_at", T.StringType()), T.StructField("article_text", T.StringType()),
])
TRUTH_RAW_SCHEMA = T.StructType([
    T.StructField("article_id", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("hyperpartisan", T.StringType()), T.StructField("bias", T.StringType()),
    T.StructField("labeled_by", T.StringType()),
])
MERGED_SCHEMA = T.StructType([
    T.StructField("article_id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("article_text", T.StringType()), T.StructField("hyperpartisan", T.BooleanType()),
    T.StructField("bias", T.StringType()),
])
FEATURES_SCHEMA = T.StructType([T.StructField("label", T.StringType()), T.StructField("article_id", T.LongType())] + [
    T.StructField(c, T.DoubleType() if c in DOUBLE_FEATURES else T.IntegerType()) for c in FEATURE_COLUMNS])

NULL_MARK = "\\N"


def _encode(c: Column) -> Column:
    for raw, mark in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(mark))
    return c


def _decode(c: Column) -> Column:
    """Undo ``_encode``: between escaped backslashes only the marks of line ends are left."""
    parts = F.transform(F.split(c, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.when(c.contains("\\"), F.array_join(parts, "\\")).otherwise(c)


def _strings(df: DataFrame, change) -> DataFrame:
    return df.select(*[change(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def _options(sep: str) -> dict:
    return {"header": True, "sep": sep, "quote": '"', "escape": '"', "nullValue": NULL_MARK,
            "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _write(df: DataFrame, path: str, sep: str) -> str:
    _strings(df, _encode).write.mode("overwrite").options(**_options(sep), emptyValue='""').csv(path)
    return path


def _read(spark: SparkSession, path: str, schema: T.StructType, sep: str, own: bool) -> DataFrame:
    reader = spark.read.schema(schema).options(**_options(sep), emptyValue="", mode="FAILFAST", multiLine=not own)
    reader = reader.option("lineSep", "\n") if own else reader
    found = reader.csv(path)
    return _strings(found, _decode) if own else found


def write_tsv(df: DataFrame, path: str) -> str:
    """S4 (quoted and escaped, unlike the reference)."""
    return _write(df, path, "\t")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, own: bool = True) -> DataFrame:
    """S5."""
    return _read(spark, path, schema, "\t", own)


def write_csv(df: DataFrame, path: str) -> str:
    """S6."""
    return _write(df, path, ",")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, own: bool = True) -> DataFrame:
    """S7."""
    return _read(spark, path, schema, ",", own)


def literal_text(spark: SparkSession, text: str, col: str = "article_text") -> DataFrame:
    """One text as a one-row table (the predict entry point)."""
    return spark.createDataFrame([(text,)], f"{col} string")
