"""Sharding by sampled splitters (native: DataFrame and SQL functions only).

Records are range-partitioned by a key whose splitters are quantiles of a size-weighted sample;
overfull ranges are cut again (:mod:`.splitters`). A range's exact bytes and rows then give every
record its place in the whole order, and the law turns the place into a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, splitters

#: Ranges for each shard at least; large tables have more (:data:`.splitters.RANGE_BYTES`), so that one is a task's work.
RANGES_PER_SHARD = 16


def assign(df: DataFrame, key1: str, key2: str, size: str, shards: int, law: str = "bytes", ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... in each shard, gapless).

    key1, key2, size: SQL texts of bigint expressions; a null key sorts as -1, a null or negative size
    counts 0. Rows of one ``key1`` are neighbours and so share a shard, or consecutive ones when they
    are more than a shard's share. law ``bytes``: a record goes where the middle of its bytes lies, so
    shards differ from the mean by less than the largest record. law ``rows``: row counts differ by at
    most one. Ties of both keys are ordered by a hash of the whole row; equal rows are interchangeable.
    An empty table gives an empty result. Input columns named shard or slot give way.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law}")
    keyed = df.select(F.expr(key1).alias("key1"), F.expr(key2).alias("key2"), F.expr(size).alias("size"), F.struct("*").alias("row"))
    columns = [F.col("row")[c].alias(f"in{i}") for i, c in enumerate(df.columns)]
    out = _assign(keyed.select(*columns, "key1", "key2", "size"), shards, law, ranges_per_shard)
    return common.restored(out, df.columns, "shard", "slot")


def _assign(df: DataFrame, shards: int, law: str, ranges_per_shard: int) -> DataFrame:
    key1, key2, size = "key1", "key2", "size"
    a, b, n, r = (common.fresh(df, x) for x in ("key1", "key2", "size", "range"))
    keyed = df.withColumns({a: F.coalesce(F.expr(key1), F.lit(-1)).cast("bigint"), b: F.coalesce(F.expr(key2), F.lit(-1)).cast("bigint"), n: F.greatest(F.coalesce(F.expr(size), F.lit(0)), F.lit(0)).cast("bigint")})
    keys = common.staged(keyed.select(a, b, n), "keys")  # read several times
    ranges = splitters.split(keys, a, b, n, shards * ranges_per_shard)
    before_bytes, before_rows, x, y = [], [], 0, 0
    for s, k in zip(ranges.sizes, ranges.rows, strict=True):
        before_bytes.append(x)
        before_rows.append(y)
        x, y = x + s, y + k
    w = Window.partitionBy(r).orderBy(a, b, "__tie")
    start, row = common.fresh(df, "start"), common.fresh(df, "row")
    placed = keyed.withColumns({r: splitters.range_id(ranges.splitters, a, b), "__tie": F.xxhash64(*[c for c, t in df.dtypes if not t.startswith(("map", "variant"))])})
    placed = placed.withColumns({
        start: F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(n) + F.get(splitters.long_array(before_bytes), F.col(r)),
        row: F.row_number().over(w) - 1 + F.get(splitters.long_array(before_rows), F.col(r)),
    })
    if law == "bytes":
        shard = f"least({shards - 1}, ((2 * {start} + {n}) * {shards}) div {max(1, 2 * x)})"
    else:
        shard = f"({row} * {shards}) div {max(1, y)}"
    kept = common.staged(placed.withColumn("shard", F.expr(shard).cast("int")).select(*df.columns, "shard", row), "shards")
    first = kept.groupBy("shard").agg(F.min(row).alias("__first"))  # one row a shard
    return kept.join(F.broadcast(first), "shard").withColumn("slot", F.col(row) - F.col("__first")).select(*df.columns, "shard", "slot")


#: The query's parameters.
SHARDS = 40


def keys(df: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the two keys (hash of the text, hash of the id) of documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), common.hash60(text).alias("k_text"), common.hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("k_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in shards of near-equal bytes, equal texts side by side."""
    slim = keys(common.table(spark, sf_dir, "documents"))
    out = assign(slim, "k_text", "k_id", "size", SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = """
WITH crc(i, v) AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
  FROM (SELECT unnest(range(256)) AS b)
), tab AS (SELECT list(v ORDER BY i) AS t FROM crc
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, coalesce(text, '') AS text,
         CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS a,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS b
  FROM documents
), p AS (
  SELECT doc_id, size, text, row_number() OVER w - 1 AS r, sum(size) OVER w - size AS s, sum(size) OVER () AS total
  FROM d WINDOW w AS (ORDER BY a, b ROWS UNBOUNDED PRECEDING)
), q AS (SELECT *, least(39, ((2 * s + size) * 40) // (2 * total)) AS shard FROM p
), bytes AS (
  SELECT doc_id, list_transform(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda x: CAST('0x' || x AS BIGINT)) AS bs FROM d
)
SELECT q.doc_id AS doc_id, CAST(size AS BIGINT) AS size,
       xor(list_reduce(list_prepend(4294967295, bs), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS text_crc32,
       'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(r - min(r) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM q JOIN bytes USING (doc_id), tab
"""
