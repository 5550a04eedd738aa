"""Line dedup by content-defined chunks of lines.

Every line is hashed. Boundaries are the least hashes of each window of ``WINDOW`` lines, so they depend on what the
lines are and not on where they stand: lines added at the front shift nothing, and any shared run of that many lines has a
boundary of its own, wherever it stands. A chunk is a window, filed under its boundary; its key is the rolling hash
over its line hashes. Only chunks at boundaries that occur again are hashed, and those of
which the hash does are compared byte by byte; one that has occurred before goes. Chunks overlap, so a
repeated run of any length from two lines goes in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, sharding

#: Lines of a window: the shortest run that is found.
WINDOW = 2

_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def line_hashes(lines: list[bytes]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(line) for line in lines]


def boundaries(hashes: list[int]) -> list[int]:
    """The boundary of each window, in order: the place of its least line hash, the first of several."""
    return [min(range(i, i + WINDOW), key=hashes.__getitem__) for i in range(len(hashes) - WINDOW + 1)]


def rolling(hashes: list[int]) -> list[int]:
    """The rolling hash of each window: the next line comes in, the first one goes out."""
    top, value, out = pow(_P, WINDOW, 1 << 64), 0, []
    for i, h in enumerate(hashes):
        value = (value * _P + h) & _MASK
        if i >= WINDOW:
            value = (value - hashes[i - WINDOW] * top) & _MASK
        if i >= WINDOW - 1:
            out.append(value)
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, line, h) of the boundaries of (id, text)."""
    for batch in batches:
        ids, places, hs = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            body = text.as_py()
            if not body or "\n" not in body:
                continue
            hashes = line_hashes(body.encode("utf-8", "surrogatepass").split(b"\n"))
            for i in dict.fromkeys(boundaries(hashes)):
                ids.append(key)
                places.append(i)
                hs.append(_signed(hashes[i]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(hs, pa.int64())], names=["id", "line", "h"])


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, first, h, k, chunk) of the windows of (id, text, lines) of which the boundary is among these lines."""
    for batch in batches:
        for key, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            lines, wanted = text.encode("utf-8", "surrogatepass").split(b"\n"), set(wanted)
            hashes = line_hashes(lines)
            rolls = rolling(hashes)
            firsts = [i for i, b in enumerate(boundaries(hashes)) if b in wanted]
            chunks = [b"\n".join(lines[i : i + WINDOW]) for i in firsts]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(firsts), pa.int64()), pa.array(firsts, pa.int64()), pa.array([_signed(rolls[i]) for i in firsts], pa.int64()), pa.array([_signed(xxhash.xxh3_64_intdigest(c, 1)) for c in chunks], pa.int64()), pa.array(chunks, pa.binary())], names=["id", "first", "h", "k", "chunk"])


def repeats(docs: DataFrame) -> DataFrame:
    """Chunks (id, first) of rows (id: distinct and not null, text) that occur before, by id and place.

    A chunk that overlaps its own first occurrence (three equal lines) is no repetition of it. Hashes are
    aggregated before they are shuffled, so a line that a third of all rows share is one row a task. Only
    chunks at repeated boundaries are fetched, and only those whose hash occurs again travel with their bytes.
    """
    marked = common.staged(docs.mapInArrow(_marked, "id bigint, line bigint, h bigint"), "boundaries")
    again = marked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = common.counted_join(marked, again, ["h"], "n").groupBy("id").agg(F.collect_list("line").alias("lines"))  # of one document
    found = docs.join(lists, "id").select("id", "text", "lines").mapInArrow(_chunked, "id bigint, first bigint, h bigint, k bigint, chunk binary")
    found = common.staged(found, "chunks")
    counts = found.groupBy("h", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = common.staged(common.counted_join(found, counts, ["h", "k"], "n"), "again")
    kinds = found.groupBy("h", "k", "chunk").agg(F.min(F.struct("id", "first")).alias("f"), F.count(F.lit(1)).alias("n"))
    kinds = common.staged(kinds.select("h", "k", "chunk", F.col("f.id").alias("id0"), F.col("f.first").alias("first0"), "n"), "kinds")
    per_hash = common.staged(kinds.groupBy("h", "k").agg(F.count(F.lit(1)).alias("kinds"), F.min(F.struct("id0", "first0")).alias("f"), F.sum("n").alias("n")), "hashes")
    # all chunks of a hash have the same bytes, as a rule; then the bytes needn't travel again
    one = per_hash.filter("kinds = 1").select("h", "k", F.col("f.id0").alias("id0"), F.col("f.first0").alias("first0"), "n")
    later = common.counted_join(found.drop("chunk"), one, ["h", "k"], "n")
    mixed = per_hash.filter("kinds > 1").select("h", "k")
    if not mixed.isEmpty():
        unlike = found.join(mixed, ["h", "k"], "left_semi").join(kinds.select("h", "k", "chunk", "id0", "first0"), ["h", "k", "chunk"])
        later = later.unionByName(unlike.drop("chunk"))
    return later.filter((F.col("id") != F.col("id0")) | (F.col("first") >= F.col("first0") + WINDOW)).select("id", "first")


def remove(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with ``kept`` (the text without runs of ``WINDOW`` lines or more that occur before) and ``n_removed`` (its lines that went).

    key: a bigint column; a smaller key is earlier, null keys come first, rows of one key are ordered by the
    hash of their text. Null texts stay null; an empty text has no chunk. Lines end with
    a line feed. An empty table gives an empty result; other columns stay, but for ones named like the added.
    """
    inner, at = common.shielded(df)
    return common.restored(_remove(inner, at[key], at[text]), df.columns, "kept", "n_removed")


def _remove(df: DataFrame, key: str, text: str) -> DataFrame:
    uid = common.fresh(df, "uid")
    n = df.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if n[0] == n[1]:
        rows = df.withColumn(uid, F.col(key).cast("bigint"))
    else:
        body = F.coalesce(F.col(text), F.lit(""))
        numbered = df.withColumns({f"{uid}k": F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))), f"{uid}h": F.xxhash64(body), f"{uid}n": F.octet_length(body).cast("bigint") + 16})
        rows = sharding.assign(numbered, f"{uid}k", f"{uid}h", f"{uid}n", 1, "rows").withColumnRenamed("slot", uid).drop("shard", f"{uid}k", f"{uid}h", f"{uid}n")
    gone = repeats(rows.select(F.col(uid).alias("id"), F.col(text).alias("text")).filter(F.col(text).isNotNull()))
    gone = gone.groupBy("id").agg(F.collect_list("first").alias("gone"))  # of one document
    both = rows.join(gone.withColumnsRenamed({"id": f"{uid}g", "gone": f"{uid}r"}), F.col(uid) == F.col(f"{uid}g"), "left").drop(uid, f"{uid}g")
    at = df.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def drop(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept, removed = [], []
            for body, found in zip(frame.iloc[:, at], frame[f"{uid}r"], strict=True):
                lines = {i for s in found for i in range(s, s + WINDOW)} if found is not None else set()
                removed.append(len(lines))
                kept.append(body if not lines else "\n".join(x for i, x in enumerate(body.split("\n")) if i not in lines))
            yield frame.drop(columns=f"{uid}r").assign(kept=kept, n_removed=removed)

    return both.mapInPandas(drop, f"{fields}, kept string, n_removed bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of two or more lines that an earlier one (or itself, before) has."""
    out = remove(common.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"), F.col("n_removed").alias("n_removed_lines"), F.sha2("kept", 256).alias("kept_sha256"))
