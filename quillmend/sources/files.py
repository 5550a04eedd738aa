"""Text and binary files in, text files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .. import functions as fn


def read_broken_json(spark: SparkSession, path: str, schema: str | DataType | None = None, whole: bool = False, prose: bool = False, binary: bool = False) -> DataFrame:
    """Documents of text files: path, value (canonical, null on error), error; with a schema also parsed.

    A document is a line, or with ``whole`` a file; ``binary`` reads whole files whose bytes may not be
    UTF-8; ``prose`` looks for the JSON in the text first.
    """
    if binary:
        files = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("text"))
        result = fn.repair_bytes_result("text")
        out = files.select("path", result.alias("r")).select("path", F.col("r.value").cast("string").alias("value"), F.col("r.error").alias("error"))
    else:
        lines = spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        if prose:
            lines = lines.withColumn("text", F.coalesce(fn.extract("text"), F.col("text")))
        out = lines.select("path", fn.repair_result("text").alias("r")).select("path", "r.value", "r.error")
    if schema is None:
        return out
    return out.withColumn("parsed", fn.from_value("value", schema))


def write_json(df: DataFrame, text: str, path: str, mode: str = "error") -> None:
    """The repaired texts, a line each. A document that can't be repaired fails the job, and nothing is committed."""
    df.select(fn.repair(text).alias("value")).write.mode(mode).text(path)
