"""Generators and aggregates over the column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn


def explode_spans(df: DataFrame, text: str, outer: bool = False) -> DataFrame:
    """A row for each JSON value in a text column: all columns, pos and span. outer keeps texts without any."""
    explode = F.posexplode_outer if outer else F.posexplode
    return df.select("*", explode(fn.extract_all(text)).alias("pos", "span"))


def collect_array(value: Column | str, order: Column | str) -> Column:
    """An aggregate: canonical texts of a group as one JSON array, by ``order``."""
    value, order = fn.columns._col(value), fn.columns._col(order)
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(value, F.lit("null")).alias("v"))))
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["v"]), ", "), F.lit("]"))


def collect_object(key: Column | str, value: Column | str, order: Column | str) -> Column:
    """An aggregate: keys and canonical texts of a group as one JSON object, duplicates kept, by ``order``."""
    key, value, order = (fn.columns._col(x) for x in (key, value, order))
    member = F.concat(fn.json_quote(key), F.lit(": "), F.coalesce(value, F.lit("null")))
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), member.alias("v"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(rows, lambda r: r["v"]), ", "), F.lit("}"))


def repaired(df: DataFrame, text: str, into: str = "repaired") -> DataFrame:
    """``df`` with struct<value, error> of its text column."""
    return df.withColumn(into, fn.repair_result(text))
