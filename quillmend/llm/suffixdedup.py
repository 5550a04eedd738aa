"""Removal of repeated byte strings by sorting suffixes, deep-shallow.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier. Every window of ``LENGTH``
bytes is filed under the least hash of its short substrings, and neighbouring windows filed alike travel as
one segment, so the text is dealt out once and not once for each position. Segments whose hash is met only
once go no further. Equal segments are settled by an aggregation; the windows of unequal segments under one
hash are sorted: multikey quicksort orders them to a shallow depth, eight bytes at a time, and blind tries
order the groups that still agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, sharding

LENGTH = 100
#: Windows are filed by substrings of so many bytes.
PIECE = 20
#: Depth of the multikey quicksort, in bytes; blind tries go on from there.
SHALLOW = 24
#: The quicksort leaves parts of so many suffixes to one sort of all their words to that depth.
_LEAF = 1 << 11
#: Chunks are small so that their arrays stay in the processor's cache.
_CHUNK_BYTES, _SORT_BYTES = 64 << 10, 4 << 20
#: Longer texts are filed in pieces of so many bytes, as the arrays for a piece are some eighty times as large.
PIECE_BYTES = 1 << 20
#: So many hashes are broadcast at most (8 bytes each); beyond, segments are found by a shuffle and cut from their texts again.
BROADCAST_HASHES = 2_500_000
#: So many bytes of spans are broadcast at most.
BROADCAST_SPANS = 64 << 20
#: Under a hash with more unequal segments than this, windows are aggregated one by one instead of sorted in one task.
HOT_SEGMENTS = 20_000

_WINDOWS = LENGTH - PIECE + 1
_P = 0x9E3779B97F4A7C15
_U = np.uint64


def _power(n: int) -> np.uint64:
    return _U(pow(_P, n, 1 << 64))


def _sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` (minimum or maximum) over every ``width`` neighbours."""
    out, have = x, 1
    while have * 2 <= width:
        out = take(out[:-have], out[have:])
        have *= 2
    return take(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


class Filed:
    """The windows of some concatenated documents and what they are filed under."""

    def __init__(self, data: bytes, ends: np.ndarray):
        """ends: where each document ends, ascending."""
        n = len(data)
        if n < LENGTH:
            self.places = self.starts = self.stops = np.zeros(0, np.int64)
            self.hashes = self.keys = np.zeros(0, np.uint64)
            return
        h1 = np.frombuffer(data, np.uint8).astype(np.uint64) + _U(1)
        h2 = h1[:-1] * _power(1) + h1[1:]
        h4 = h2[:-2] * _power(2) + h2[2:]
        h8 = h4[:-4] * _power(4) + h4[4:]
        h16 = h8[:-8] * _power(8) + h8[8:]
        h = h16[:-4] * _power(4) + h4[16:]
        h ^= h >> _U(31)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
        h |= _U(1)  # never 0
        least = _sliding(h, _WINDOWS, np.minimum)
        start_of = np.zeros(n + 1, np.int64)
        start_of[ends] = 1
        whole = np.ones(len(least), bool)  # windows that end in the document in which they start
        for k in ends[:-1]:
            whole[max(0, k - LENGTH + 1) : k] = False
        least = np.where(whole, least, _U(0))
        # the places whose hash files a window
        pad = np.zeros(_WINDOWS - 1, np.uint64)
        self.places = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), _WINDOWS, np.maximum) == h)
        self.hashes = h[self.places]
        turn = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        stop = np.append(turn[1:], len(least))
        kept = least[turn] != 0
        self.starts, self.stops = turn[kept], stop[kept]  # windows
        self.keys = least[self.starts]

    def doubled(self) -> np.ndarray:
        """Which segments hold the place that files them more than once."""
        again = np.concatenate([[0], np.cumsum(self.hashes[1:] == self.hashes[:-1])]) if len(self.hashes) else np.zeros(1, np.int64)
        low = np.searchsorted(self.places, self.starts)
        high = np.searchsorted(self.places, self.stops - 1 + _WINDOWS - 1, side="right") - 1
        return again[np.maximum(high, low)] > again[low] if len(self.places) else np.zeros(len(self.starts), bool)


def _pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of a text's pieces, so that every window lies in exactly one: they overlap by ``LENGTH`` - 1 bytes."""
    for i in range(0, len(data) - LENGTH + 1, PIECE_BYTES):
        yield i, data[i : i + PIECE_BYTES + LENGTH - 1]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, bytes, np.ndarray]]:
    """(ids, offsets, bytes, ends) of pieces of documents of (id, text), some dozens of KB together; texts under ``LENGTH`` bytes are left out."""
    ids, offsets, parts, size = [], [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for offset, data in _pieces((text.as_py() or "").encode()):
                ids.append(key)
                offsets.append(offset)
                parts.append(data)
                size += len(data)
                if size >= _CHUNK_BYTES:
                    yield ids, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])
                    ids, offsets, parts, size = [], [], [], 0
    if parts:
        yield ids, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])


def _grouped(items: Iterator, n: int) -> Iterator[list]:
    while found := list(islice(items, n)):
        yield found


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for many in _grouped(_chunks(batches), 32):
            values, counts = np.unique(np.concatenate([Filed(data, ends).hashes for _, _, data, ends in many]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "n"])


def _segments(with_bytes: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for ids, offsets, data, ends in _chunks(batches):
                filed = Filed(data, ends)
                at = np.searchsorted(ends, filed.starts, side="right")
                first = np.concatenate([[0], ends[:-1]])[at]
                stops = filed.stops + LENGTH - 1
                columns = [pa.array(filed.keys.view(np.int64)), pa.array(np.array(ids, np.int64)[at]), pa.array(filed.starts - first + np.array(offsets, np.int64)[at]), pa.array(stops - filed.starts), pa.array(filed.doubled())]
                if with_bytes:
                    columns.append(pa.array([data[a:b] for a, b in zip(filed.starts.tolist(), stops.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["h", "id", "at", "len", "twice", "segment"][: len(columns)])

    return cut


def _cut_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from rows (id, text, array of (h, at, len, twice))."""
    for batch in batches:
        for key, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = text.encode()
            yield pa.RecordBatch.from_arrays([pa.array([w["h"] for w in wanted], pa.int64()), pa.array([key] * len(wanted), pa.int64()), pa.array([w["at"] for w in wanted], pa.int64()), pa.array([w["len"] for w in wanted], pa.int64()), pa.array([w["twice"] for w in wanted], pa.bool_()), pa.array([data[w["at"] : w["at"] + w["len"]] for w in wanted], pa.binary())], names=["h", "id", "at", "len", "twice", "segment"])


def _words(data: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there, as a number that orders like them."""
    x = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    for n in (1, 2, 4):
        x = (x[:-n] << _U(8 * n)) | x[n:]
    return x


def _shallow(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort to ``SHALLOW`` bytes: the suffixes in order, and where a group of agreeing ones begins."""
    parts, starts, work = [], [], [(at, 0)]
    while work:
        at, depth = work.pop()
        if not len(at):
            continue
        if depth >= SHALLOW or len(at) <= _LEAF:
            new = np.zeros(len(at), bool)
            if depth < SHALLOW:
                keys = [words[at + d] for d in range(depth, SHALLOW, 8)]
                order = np.lexsort(keys[::-1])
                at = at[order]
                for k in keys:
                    k = k[order]
                    new[1:] |= k[1:] != k[:-1]
            new[0] = True
            parts.append(at)
            starts.append(new)
            continue
        word = words[at + depth]
        some = np.sort(word[:: max(1, len(word) // 31)])
        pivot = some[len(some) // 2]
        low, high = word < pivot, word > pivot
        work += [(at[high], depth), (at[~(low | high)], depth + 8), (at[low], depth)]
    return np.concatenate(parts), np.concatenate(starts)


class _Trie:
    """A blind trie over strings of ``LENGTH`` bytes: a node [depth, children by the byte there, a string below it].

    A new string is led down by the bytes at the nodes' depths alone; what lies between them is skipped, and
    the string that is found there is compared with it once. Where they part, the new one branches off.
    """

    def __init__(self, first: bytes):
        self.root = first

    def add(self, key: bytes) -> bytes:
        """The equal string in the trie: an old one, or the key itself."""
        node = self.root
        while node.__class__ is list:
            below = node[1].get(key[node[0]])
            node = node[2] if below is None else below
        if node == key:
            return node
        apart = LENGTH - 1 - ((int.from_bytes(key) ^ int.from_bytes(node)).bit_length() - 1) // 8
        parent, below = None, self.root
        while below.__class__ is list and below[0] < apart:
            parent, below = below, below[1][key[below[0]]]
        if below.__class__ is list and below[0] == apart:
            below[1][key[apart]] = key
            return key
        branch = [apart, {node[apart]: below, key[apart]: key}, node]
        if parent is None:
            self.root = branch
        else:
            parent[1][key[parent[0]]] = branch
        return key

    def ordered(self) -> Iterator[bytes]:
        """Its strings in order."""
        work = [self.root]
        while work:
            node = work.pop()
            if node.__class__ is list:
                work += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                yield node


def _deep(data: bytes, at: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts ``at`` in the order of their strings of ``LENGTH`` bytes, and a class number for each.

    new: where a group begins that agrees to ``SHALLOW`` bytes; a blind trie orders each.
    """
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    order, classes = at.copy(), np.cumsum(new) - 1  # of groups of one string
    inside = np.zeros(len(at), np.int64)  # further strings in the groups before
    for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        members = at[a : a + n].tolist()
        key = data[members[0] : members[0] + LENGTH]
        trie, places = _Trie(key), {}
        for x in members:
            key = trie.add(data[x : x + LENGTH])
            if key in places:
                places[key].append(x)
            else:
                places[key] = [x]
        i = a
        for k, key in enumerate(trie.ordered()):
            found = places[key]
            order[i : i + len(found)] = found
            if k:
                inside[i] = 1
            i += len(found)
    return order, classes + np.cumsum(inside)


def equal_windows(data: bytes, starts: np.ndarray) -> np.ndarray:
    """A class number for each start (ascending); equal numbers for equal strings of ``LENGTH`` bytes."""
    if not len(starts):
        return np.zeros(0, np.int64)
    words = _words(np.frombuffer(data, np.uint8))
    at, new = _shallow(words, starts)
    at, classes = _deep(data, at, new)
    by_place = np.empty(len(data), np.int64)
    by_place[at] = classes
    return by_place[starts]


def _sorted_spans(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Spans (id, start, stop) of windows of (id, at, segment) that start earlier in another place of the rows."""
    data = b"".join(r[2] for r in rows)
    size = np.array([len(r[2]) for r in rows])
    first = np.cumsum(size) - size
    count = size - LENGTH + 1
    row = np.repeat(np.arange(len(rows)), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    classes = equal_windows(data, first[row] + within)
    ids, at = np.array([r[0] for r in rows], np.int64)[row], np.array([r[1] for r in rows], np.int64)[row] + within
    order = np.lexsort((at, ids, classes))
    later = np.zeros(len(row), bool)
    later[order[1:]] = classes[order[1:]] == classes[order[:-1]]
    # neighbouring windows of a row make one span
    edge = np.diff(np.concatenate([[0], later.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for a, b in [(begin, end)]:
        if len(a) and (row[a] != row[b - 1]).any():  # runs that go over from one row to the next
            cut = np.flatnonzero(later[1:] & later[:-1] & (row[1:] != row[:-1])) + 1
            begin, end = np.sort(np.concatenate([a, cut])), np.sort(np.concatenate([b, cut]))
    yield pa.RecordBatch.from_arrays([pa.array(ids[begin]), pa.array(at[begin]), pa.array(at[end - 1] + LENGTH)], names=["id", "start", "stop"])


def _sort_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (h, id, at, segment) sorted by h; a hash's rows stay together."""
    rows, size, last = [], 0, None
    for batch in batches:
        for h, key, at, segment in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if size >= _SORT_BYTES and h != last:
                yield from _sorted_spans(rows)
                rows, size = [], 0
            rows.append((key, at, segment))
            size, last = size + len(segment), h
    if rows:
        yield from _sorted_spans(rows)


_SPANS = "id bigint, start bigint, stop bigint"


def repeated(docs: DataFrame) -> DataFrame:
    """Spans (id, start, stop) of bytes to remove from rows (id: distinct and not null, text); they may overlap.

    A third of all rows may share a segment: equal segments are aggregated before the shuffle, and joins
    on a hash have one row a segment on one side.
    """
    counted = docs.mapInArrow(_hashes, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    again = common.staged(counted.filter("n > 1").select("h"), "hashes")
    if again.count() <= BROADCAST_HASHES:
        found = docs.mapInArrow(_segments(True), "h bigint, id bigint, at bigint, len bigint, twice boolean, segment binary").join(F.broadcast(again), "h", "left_semi")
    else:
        slim = docs.mapInArrow(_segments(False), "h bigint, id bigint, at bigint, len bigint, twice boolean").join(again, "h", "left_semi")
        wanted = slim.groupBy("id").agg(F.collect_list(F.struct("h", "at", "len", "twice")).alias("wanted"))  # of one document
        found = docs.join(wanted, "id").select("id", "text", "wanted").mapInArrow(_cut_again, "h bigint, id bigint, at bigint, len bigint, twice boolean, segment binary")
    found = common.staged(found, "segments")
    kinds = found.groupBy("h", "segment").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"))
    kinds = common.staged(kinds.select("h", "segment", F.xxhash64("segment").alias("k"), F.col("first.id").alias("id0"), F.col("first.at").alias("at0"), "n", "twice"), "kinds")
    # all but the first of equal segments go as a whole
    copies = found.select("h", F.xxhash64("segment").alias("k"), "id", "at", "len").join(kinds.filter("n > 1").select("h", "k", "id0", "at0"), ["h", "k"])
    spans = copies.filter("id <> id0 or at <> at0").select("id", F.col("at").alias("start"), (F.col("at") + F.col("len")).alias("stop"))
    # the firsts of unequal segments are compared window by window
    unequal = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("any")).filter("kinds > 1 or any")
    unequal = common.staged(kinds.join(unequal, "h").select("h", F.col("id0").alias("id"), F.col("at0").alias("at"), "segment", "kinds"), "unequal")
    sorted_ = unequal.filter(F.col("kinds") <= HOT_SEGMENTS).select("h", "id", "at", "segment").repartition("h").sortWithinPartitions("h").mapInArrow(_sort_all, _SPANS)
    spans = spans.unionByName(sorted_)
    hot = unequal.filter(F.col("kinds") > HOT_SEGMENTS)
    if not hot.isEmpty():
        windows = hot.select("id", "at", F.explode(F.expr(f"transform(sequence(0, length(segment) - {LENGTH}), o -> named_struct('o', o, 'w', substring(segment, o + 1, {LENGTH})))")).alias("x"))
        windows = common.staged(windows.select("id", (F.col("at") + F.col("x.o")).alias("at"), F.col("x.w").alias("w")), "windows")
        first = windows.groupBy("w").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("w", F.col("first.id").alias("id0"), F.col("first.at").alias("at0"))
        later = windows.join(first, "w").filter("id <> id0 or at <> at0")
        spans = spans.unionByName(later.select("id", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("stop")))
    return spans


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with ``removed`` (maximal runs as an array of (start, stop), bytes) and ``kept`` (the rest, binary).

    key: a bigint column; a smaller key is earlier, null keys come first. Rows of one key are ordered by the
    hash of their text. Null and empty texts have no bytes; texts under 100 bytes lose nothing. All other
    columns stay, but for ones named like the added. An empty table gives an empty result.
    """
    inner, at = common.shielded(df)
    return common.restored(_remove(inner, at[key], at[text]), df.columns, "removed", "kept")


def _remove(df: DataFrame, key: str, text: str) -> DataFrame:
    uid = common.fresh(df, "uid")
    n = df.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if n[0] == n[1]:
        rows = df.withColumn(uid, F.col(key).cast("bigint"))
    else:  # repeated or null keys: rows are numbered in their order
        body = F.coalesce(F.col(text), F.lit(""))
        numbered = df.withColumns({f"{uid}k": F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))), f"{uid}h": F.xxhash64(body), f"{uid}n": F.octet_length(body).cast("bigint") + 16})
        rows = sharding.assign(numbered, f"{uid}k", f"{uid}h", f"{uid}n", 1, "rows").withColumnRenamed("slot", uid).drop("shard", f"{uid}k", f"{uid}h", f"{uid}n")
    spans = repeated(rows.select(F.col(uid).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    spans = spans.distinct().groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))  # of one document
    spans = common.staged(spans, "spans")
    size = spans.agg(F.sum(F.size("spans") * 16 + 16)).first()[0] or 0
    both = rows.join((F.broadcast(spans) if size <= BROADCAST_SPANS else spans).withColumnsRenamed({"id": f"{uid}s", "spans": f"{uid}r"}), F.col(uid) == F.col(f"{uid}s"), "left").drop(uid, f"{uid}s")
    at = df.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            removed, kept = [], []
            for body, found in zip(frame.iloc[:, at], frame[f"{uid}r"], strict=True):
                data = b"" if body is None or body != body else body.encode()
                runs = _merge([(s["start"], s["stop"]) for s in found]) if found is not None else []
                removed.append([{"start": a, "stop": b} for a, b in runs])
                edges = [0, *[x for run in runs for x in run], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield frame.drop(columns=f"{uid}r").assign(removed=removed, kept=kept)

    return both.mapInPandas(cut, f"{fields}, removed array<struct<start:bigint,stop:bigint>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 100 that start earlier."""
    out = remove(common.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, r: a + r["stop"] - r["start"])
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), gone.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 100 bytes, the first of each string left out; what is covered goes.
ORACLE = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, array_slice(b, i, i + 99) AS s FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS i FROM d WHERE n >= 100)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1
), g AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM r
), h AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g
), runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM h GROUP BY doc_id, run
), pieces AS (
  SELECT runs.doc_id AS doc_id, a, z, hex(array_slice(b, lag(z, 1, 1) OVER (PARTITION BY runs.doc_id ORDER BY a), a - 1)) AS kept FROM runs JOIN d ON d.doc_id = runs.doc_id
), gone AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(kept, '' ORDER BY a) AS kept FROM pieces GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(gone.kept || hex(array_slice(b, last, n))) END) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
"""


def brute(texts: list[bytes]) -> list[tuple[bytes, int]]:
    """For tests: what is left of each text, in order, and its number of removed runs."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, np.int8)
        for i in range(len(t) - LENGTH + 1):
            w = hashlib.blake2b(t[i : i + LENGTH], digest_size=16).digest()
            if w in seen:
                gone[i + 1 : i + 1 + LENGTH] = 1
            seen.add(w)
        out.append((bytes(b for b, g in zip(t, gone[1:-1], strict=True) if not g), int((np.diff(gone) == 1).sum())))
    return out
