"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` cuts the corpus into shards of about ``SHARD_BYTES`` of text and writes, for every word
of a shard, its delta-coded positions (a table of shard, term, postings in the shared folder; a
frequent word is spread over all shards, so no key is hot). ``search`` reads the postings of the test
terms alone, deals them by shard, and for every phrase starts at its rarest term and intersects the
offset-adjusted lists of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARD_BYTES = 4 << 20
#: Phrases are searched in blocks of about so many bytes of text; a block's terms are what is broadcast.
BLOCK_BYTES = 4 << 20
WINDOW = 13

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z become a-z; every other ASCII byte that is no digit or letter becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and anything beyond ASCII, as UTF-8; null: none."""
    return [] if text is None else text.encode().translate(_FOLD).split()


def encode_deltas(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base-128 bytes of non-negative integers, and how many bytes each of them takes."""
    length = np.ones(len(gaps), np.int8)
    most = int(gaps.max(initial=0))
    for k in range(1, 10):
        if most < 1 << (7 * k):
            break
        length += gaps >= 1 << (7 * k)
    start = np.cumsum(length, dtype=np.int64) - length
    out = np.zeros(int(length.sum(dtype=np.int64)), np.uint8)
    has = np.arange(len(gaps))
    for k in range(int(length.max(initial=0))):
        has = has[length[has] > k]
        out[start[has] + k] = ((gaps[has] >> (7 * k)) & 127) | np.where(length[has] > k + 1, 128, 0)
    return out, length


def decode_deltas(data: bytes) -> np.ndarray:
    """The running sums of base-128 integers."""
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    within = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 127).astype(np.int64) << (7 * within)
    return np.cumsum(np.add.reduceat(parts, starts)) if len(ends) else np.zeros(0, np.int64)


class _Shard:
    """Words of consecutive documents; one position stays free after each document."""

    def __init__(self, number: int):
        self.number, self.terms, self.ids, self.docs, self.at, self.bytes = number, {}, [], [], 0, 0

    def add(self, doc_id, text: str | None) -> None:
        found, terms = words(text), self.terms
        self.ids.append(np.fromiter((terms.setdefault(w, len(terms)) for w in found), np.int32, len(found)))
        self.docs.append((doc_id, self.at, len(found)))
        self.at += len(found) + 1
        self.bytes += len(text or "") + 64

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        n = len(self.docs)
        yield pa.RecordBatch.from_arrays([pa.array([self.number] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([d[0] for d in self.docs], schema.field(2).type), pa.array([d[1] for d in self.docs], pa.int64()), pa.array([d[2] for d in self.docs], pa.int64()), pa.nulls(n, pa.binary())], schema=schema)
        if not self.terms:
            return
        ids, kind = np.concatenate(self.ids), np.int32 if self.at < 1 << 31 else np.int64
        at = np.concatenate([np.arange(base, base + len(x), dtype=kind) for (_, base, _), x in zip(self.docs, self.ids, strict=True)])
        self.ids = []
        at, count = at[np.argsort(ids, kind="stable")], np.bincount(ids, minlength=len(self.terms))
        del ids
        first = np.cumsum(count) - count
        gaps = np.diff(at, prepend=kind(0))
        gaps[first] = at[first]
        del at
        data, length = encode_deltas(gaps)
        del gaps
        offsets = np.concatenate([[0], np.add.reduceat(length, first, dtype=np.int64).cumsum()]).astype(np.int32)
        terms = list(self.terms)
        for i in range(0, len(terms), 20_000):
            part = offsets[i : i + 20_001]
            m = len(part) - 1
            postings = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer((part - part[0]).astype(np.int32).tobytes()), pa.py_buffer(data[part[0] : part[-1]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array([self.number] * m, pa.int64()), pa.array(terms[i : i + m], pa.binary()), pa.nulls(m, schema.field(2).type), pa.nulls(m, pa.int64()), pa.array(count[i : i + m], pa.int64()), postings], schema=schema)


def build_index(df: DataFrame, doc: str, text: str) -> DataFrame:
    """The index of ``df``, staged: rows (shard, term, n, postings), and (shard, doc, base, n) for each document.

    doc: any Arrow type, null and repeated values too (each row is a document of its own, known by shard
    and base). Null and empty texts are documents without words.
    """
    kind = dict(df.dtypes)[doc]
    out = f"shard bigint, term binary, doc {kind}, base bigint, n bigint, postings binary"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard, schema = TaskContext.get().partitionId() << 24, None, None
        for batch in batches:
            schema = schema or pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("doc", batch.schema.field(0).type), ("base", pa.int64()), ("n", pa.int64()), ("postings", pa.binary())])
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                if shard is None:
                    shard, number = _Shard(number), number + 1
                shard.add(d.as_py(), t.as_py())
                if shard.bytes >= SHARD_BYTES:
                    yield from shard.batches(schema)
                    shard = None
        if shard is not None:
            yield from shard.batches(schema)
        shard = None
        common.release()

    return common.staged(df.select(F.col(doc), F.col(text).cast("string")).mapInArrow(index, out), "postings")


def _blocks(tests: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """The test items in blocks; each block is what the driver holds at a time."""
    total = tests.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    part = F.pmod(F.xxhash64(F.col(item)), F.lit(blocks))
    for i in range(blocks):
        found = tests.filter(part == i) if blocks > 1 else tests
        yield [(r[0], words(r[1])) for r in found.select(F.col(item), F.col(text)).collect()]


def _seeds(rank: np.ndarray, need: int) -> list[int]:
    """Places such that every window of ``need`` words holds one that is its rarest, or one chosen for an earlier window."""
    out, start = [], 0
    while start + need <= len(rank):
        best = start + int(np.argmin(rank[start : start + need]))
        out.append(best)
        start = best + 1
    return out


def _holds(listed: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(listed, values)
    at[at == len(listed)] = 0
    return listed[at] == values


def _exact(item: list[bytes], lists: dict[bytes, np.ndarray], df: dict[bytes, int], window: int) -> np.ndarray:
    """Spans (start, end) of shard positions covered by occurrences of the item's windows."""
    need, spans = min(window, len(item)), []
    ends = [i for i, w in enumerate(item) if w not in lists]
    start = 0
    for end in [*ends, len(item)]:  # runs of words that the shard has
        run, start = item[start:end], end + 1
        if len(run) < need or not run:
            continue
        for o in _seeds(np.array([df.get(w, 0) for w in run]), need):
            at = lists[run[o]]
            reach = []
            for step in (-1, 1):
                far, alive = np.zeros(len(at), np.int64), np.arange(len(at))
                for j in range(1, need):
                    if not 0 <= o + step * j < len(run) or not len(alive):
                        break
                    alive = alive[_holds(lists[run[o + step * j]], at[alive] + step * j)]
                    far[alive] = j
                reach.append(far)
                if step < 0 and need > 1:
                    most = min(len(run) - 1 - o, need - 1)
                    keep = far + most + 1 >= need  # no other can still get a whole window
                    at, reach = at[keep], [far[keep]]
            if len(at):
                left, right = reach if len(reach) == 2 else (reach[0], np.zeros(len(at), np.int64))
                whole = left + right + 1 >= need
                spans.append(np.stack([at[whole] - left[whole], at[whole] + right[whole] + 1], axis=1))
    return np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)


def _near(item: list[bytes], lists: dict[bytes, np.ndarray], df: dict[bytes, int], slop: int) -> np.ndarray:
    """Shortest spans from each place of the rarest term that hold all distinct terms within len(item) + slop words."""
    terms = sorted(set(item), key=lambda w: (df.get(w, 0), w))
    if not terms or any(w not in lists for w in terms):
        return np.zeros((0, 2), np.int64)
    width, at = len(item) + slop, lists[terms[0]]
    for w in terms[1:]:  # a first intersection: each term within reach of the rarest
        lo = np.searchsorted(lists[w], at - width + 1)
        at = at[(lo < len(lists[w])) & (lists[w][np.minimum(lo, len(lists[w]) - 1)] < at + width)]
    spans = []
    for c in at:
        for low in range(int(c) - width + 1, int(c) + 1):
            ends = [x[i] if (i := np.searchsorted(x, low)) < len(x) else low + width for x in (lists[w] for w in terms)]
            if max(ends) < low + width and c <= max(ends) and min(ends) == low:
                spans.append((low, max(ends) + 1))
                break
    return np.array(spans, np.int64).reshape(-1, 2)


def _matcher(block: list[tuple], df: dict[bytes, int], window: int, slop: int | None):
    """What finds the spans of a block's items in one shard's postings."""

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        postings = frame[frame["term"].notna()]
        lists = {bytes(t): decode_deltas(p) for t, p in zip(postings["term"], postings["postings"], strict=True)}
        places = frame[frame["term"].isna()].sort_values("base")
        base, ids, out = places["base"].to_numpy(np.int64), places["doc"].to_numpy(), []
        for name, ws in block:
            spans = _exact(ws, lists, df, window) if slop is None else _near(ws, lists, df, slop)
            if not len(spans):
                continue
            spans = np.unique(spans, axis=0)
            k = np.searchsorted(base, spans[:, 0], side="right") - 1
            same = k == np.searchsorted(base, spans[:, 1] - 1, side="right") - 1
            out += [(d, b, name, s - b, e - b) for d, b, s, e in zip(ids[k[same]], base[k[same]], spans[same, 0], spans[same, 1], strict=True)]
        got = pd.DataFrame(out, columns=["doc", "base", "item", "start", "end"])
        got.insert(0, "shard", frame["shard"].iloc[0])
        return got

    return match


def search(index: DataFrame, tests: DataFrame, item: str, text: str, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Rows (shard, doc, base, item, start, end): spans of words of a document that occurrences of the item cover.

    Exact (slop None): every run of ``window`` consecutive item words, or the whole item if it is shorter.
    Proximity: all distinct terms of the item within its length plus ``slop`` words, in any order; then a
    span is reported for each place of the rarest term. start and end count from the document's first
    word. Items without words match nothing. Spans of one item may overlap.
    """
    spark, found = index.sparkSession, []
    docs = index.filter(F.col("term").isNull()).select("shard", "doc", "base", "n")
    kind, item_kind = dict(docs.dtypes)["doc"], dict(tests.dtypes)[item]
    for block in _blocks(tests, item, text):
        terms = sorted({w for _, ws in block for w in ws})
        if not terms:
            continue
        wanted = spark.createDataFrame(pd.DataFrame({"term": terms}), "term binary")
        own = index.filter(F.col("term").isNotNull()).join(F.broadcast(wanted), "term")  # at most BLOCK_BYTES
        df = {bytes(r.term): r.n for r in own.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        schema = f"shard bigint, doc {kind}, base bigint, item {item_kind}, start bigint, end bigint"

        both = own.select("shard", "term", F.lit(None).cast(kind).alias("doc"), F.lit(None).cast("bigint").alias("base"), "postings")
        both = both.unionByName(docs.select("shard", F.lit(None).cast("binary").alias("term"), "doc", "base", F.lit(None).cast("binary").alias("postings")))
        found.append(both.groupBy("shard").applyInPandas(_matcher(block, df, window, slop), schema))
    if not found:
        return spark.createDataFrame([], f"shard bigint, doc {kind}, base bigint, item {item_kind}, start bigint, end bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def contamination(index: DataFrame, spans: DataFrame) -> DataFrame:
    """A row for each indexed document: doc, n_words, n_hit (words inside spans, each once), items (sorted as strings)."""
    docs = index.filter(F.col("term").isNull()).select("shard", "base", "doc", F.col("n").alias("n_words"))
    spans = common.staged(spans, "spans")
    order = Window.partitionBy("shard", "base").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(order), F.lit(0))
    fresh = spans.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)))
    hits = fresh.groupBy("shard", "base").agg(F.sum("fresh").alias("n_hit"), F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    out = docs.join(hits, ["shard", "base"], "left")
    return out.select("shard", "base", "doc", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


#: A document counts as contaminated from one hit word in so many on.
ONE_IN = 20


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the windows of 13 words of every benchmark item."""
    index = build_index(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    found = contamination(index, search(index, common.table(spark, sf_dir, "benchmark"), "item_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(13, len(ws)) AS m, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT rid, i, m, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(ws) >= m)
), hit AS (SELECT rid, item_id, i, dw.m AS m FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m
), n AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM hit) GROUP BY rid
), it AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""
