"""Helpers that every corpus operator shares: table access, shared storage, hash keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word for sizes and shingles: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a test-data folder, by whatever path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) is a temporary folder made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmend-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone when Python exits
        pass


def at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the Python process ends."""
    atexit.register(_remove, spark, path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as read back from a new folder of the shared one, and that folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmend/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    else:
        at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage: what reads the result never recomputes what is above it, and a lost executor
    costs only the tasks that it ran. The folder goes with the scope, or when the Python process ends.
    """
    return written(df, name)[0]


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """What is staged inside goes at the end, but for the folders that are taken off the list that this gives."""
    _scopes.append(made := [])
    try:
        yield made
    finally:
        _scopes.pop()
        for path in made:
            _remove(spark, path)


#: Keys that so many rows have may be hot. At most ``MOST_HOT`` keys (of some dozens of bytes) are broadcast for that.
HOT_ROWS, MOST_HOT = 200, 100_000


def hot_from(total: int) -> int:
    """Keys with so many of ``total`` rows or more count as hot: ``MOST_HOT`` of them at most."""
    return max(HOT_ROWS, -(-total // MOST_HOT))


def counted_join(rows: DataFrame, keyed: DataFrame, on: list[str], n: str) -> DataFrame:
    """Inner join of ``rows`` (staged) with ``keyed``: a row for each key, and in ``n`` how many of ``rows`` have it.

    Rows with a hot key meet it by broadcast where they are, the others by a shuffle in which no key is hot.
    """
    keyed = staged(keyed, "keyed")
    least = hot_from(int(keyed.agg(F.sum(n)).first()[0] or 0))
    hot = F.broadcast(keyed.filter(F.col(n) >= least).drop(n))
    others = rows.join(hot.select(*on), on, "left_anti").join(keyed.filter(F.col(n) < least).drop(n), on)
    return rows.join(hot, on).unionByName(others)


def release() -> None:
    """Gives memory that a Python worker no longer needs back to the system, for the stages that come after."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def hash60(text: Column) -> Column:
    """A non-negative 60-bit integer from the first 15 hex digits of the MD5 (DuckDB can compute it too)."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named in0, in1, ... so that no name of its own can clash, and the new name of each."""
    inner = [f"in{i}" for i in range(len(df.columns))]
    return df.toDF(*inner), dict(zip(df.columns, inner, strict=True))


def restored(out: DataFrame, columns: list[str], *added: str) -> DataFrame:
    """The columns of ``columns`` under their own names again, then ``added``; an input column of such a name gives way."""
    taken = {a.lower() for a in added}
    return out.select(*[F.col(f"in{i}").alias(c) for i, c in enumerate(columns) if c.lower() not in taken], *added)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{base}", 0
    while name.lower() in taken:
        n += 1
        name = f"__{base}{n}"
    return name


def placed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` (staged) with ``place``: 0, 1, ... in ascending order of these columns, nulls first.

    The rows are dealt out by ranges of the order and sorted there; a range's first place is how many rows the
    ranges before it have, so no task sees more than its range. Rows equal in all of ``order`` are in any order.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    within = fresh(df, "within")
    kept = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(within, F.monotonically_increasing_id()), "placed")
    part = F.shiftright(F.col(within), 33)  # such an id is the partition's number, and in its lower 33 bits the row's
    counts = kept.groupBy(part.alias("__part")).count().collect()  # a row a partition
    before, n = [], 0
    sizes = {r["__part"]: r["count"] for r in counts}
    for i in range(max(sizes, default=-1) + 1):
        before.append(n)
        n += sizes.get(i, 0)
    firsts = F.split(F.lit(",".join(map(str, before or [0]))), ",").cast("array<bigint>")
    return kept.withColumn("place", F.get(firsts, part.cast("int")) + F.col(within).bitwiseAND((1 << 33) - 1)).drop(within)
