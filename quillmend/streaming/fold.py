"""A keyed, ordered fold over chunks.

For every chunk: seq, whether it was accepted, the whole output, and the change as (keep bytes, text). A
rejected chunk leaves no trace.

In a stream, state is written in proportion to what arrives: an accepted chunk is kept once, under its seq, and a small
checkpoint says where the document stands (:class:`..kernel.fold.Checkpoint`) and with which chunk what isn't settled
begins, so a batch reads and renders that part alone. Chunks that come before their turn (seq counts from 0) wait in the
state store; with event time, a gap that the watermark has passed is closed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import try_repair
from ..kernel.alike import CUT, LONG, Folds, folds
from ..kernel.document import Escapes, Place, render
from ..kernel.fold import Checkpoint, Fold
from ..options import Options

_FIELDS = list(Folds.FIELDS)
_ARROW = dict(zip(["seq", *_FIELDS], [pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True))
#: Documents are folded together as long as the sum of their bytes times chunks, which is about what comes out, is at most so much.
_TOGETHER = 1 << 27
#: The column of event times in milliseconds.
_TIME = "event_time_ms"
_TYPES = dict(zip(["seq", *_FIELDS], "bigint boolean string bigint string string bigint".split(), strict=True))
_OUT = "seq bigint, accepted boolean, output string, keep bigint, text string, error_kind string, error_position bigint"


_DTYPES = {"seq": "int64", "keep": "int64", "accepted": "bool", "output": "object", "text": "object", "error_kind": "object", "error_position": "Int64"}


def _frame(key: str, rows: list[tuple]) -> pd.DataFrame:
    """Column by column, as a frame is made for each key: from rows, with its types changed then, it takes four times as long."""
    columns = list(zip(*rows, strict=True)) or [[]] * (2 + len(_FIELDS))
    return pd.DataFrame({key: pd.Series(list(columns[0])), **{x: pd.Series(list(c), dtype=_DTYPES[x]) for x, c in zip(["seq", *_FIELDS], columns[1:], strict=True)}}, copy=False)


def _texts(chunks: pa.Array) -> list[str]:
    return chunks.fill_null("").to_numpy(zero_copy_only=False).tolist()


def _sizes(offsets: np.ndarray, chunks: pa.Array) -> np.ndarray:
    """Bytes of documents that begin at the offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(pc.binary_length(chunks).to_numpy().astype(np.int64))])[offsets])


def _groups(offsets: np.ndarray, chunks: pa.Array) -> list[tuple[int, int]]:
    """From where to where documents are folded together."""
    grown = np.cumsum(_sizes(offsets, chunks) * np.diff(offsets)) // _TOGETHER
    edges = [0, *(np.flatnonzero(np.diff(grown)) + 1).tolist(), len(grown)]
    return list(zip(edges, edges[1:], strict=False))


def _flat(bases: np.ndarray, counts: np.ndarray) -> pa.Array:
    """base, base + 1, ... for each document, as many as it has chunks."""
    before = np.cumsum(counts) - counts
    return pa.array(np.repeat(bases - before, counts) + np.arange(counts.sum()))


def _changes(alike: Folds, offsets: np.ndarray, chunks: pa.Array, fields: Sequence[str]) -> dict[str, pa.Array]:
    """What each of the chunks does, of documents that begin at the offsets; those of a shape are filled in together."""
    counts = np.diff(offsets)
    short = np.flatnonzero((counts > 0) & (_sizes(offsets, chunks) + counts - 1 <= LONG))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), chunks).take(pa.array(short)), CUT)
    starts = np.concatenate([[0], np.cumsum(pc.binary_length(joined).to_numpy().astype(np.int64))])
    data = np.frombuffer(joined.buffers()[2], np.uint8, starts[-1]) if starts[-1] else np.zeros(0, np.uint8)
    groups: dict = {}
    plain = set(np.flatnonzero(counts > 0).tolist())
    for i, (kept, document) in enumerate(zip(alike.shapes(data, starts, counts[short].tolist()), short.tolist(), strict=True)):
        if kept:
            groups.setdefault(kept, []).append(i)
            plain.discard(document)
    # where the rows of each document begin, in what is the same for a shape and in the texts
    same, texts, outputs = (np.zeros(len(counts), np.int64) for _ in range(3))
    columns, rows, lengths, n, pieces = {x: [] for x in fields if x not in ("seq", "text", "output")}, [], [np.zeros(1, np.int64)], 0, 0
    for kept, members in groups.items():
        documents = short[members]
        rows.append(kept.filled(data, starts[members]).ravel())
        lengths.append(np.tile(kept.lengths, len(members)))
        same[documents] = n
        texts[documents] = pieces + np.arange(len(members)) * len(kept.lengths)
        outputs[documents] = texts[documents] + kept.chunks
        n, pieces = n + kept.chunks, pieces + len(lengths[-1])
        for x, column in columns.items():
            column += kept.columns[x]
    ends = np.cumsum(np.concatenate(lengths)).astype(np.int32)
    strings = [pa.StringArray.from_buffers(pieces, pa.py_buffer(ends), pa.py_buffer(np.concatenate([*rows, np.zeros(0, np.uint8)])))]
    for document in sorted(plain):
        done = alike._plainly(chunks[offsets[document] : offsets[document + 1]].to_pylist())
        came = [*done["text"], *(done["output"] if alike.whole else [])]
        same[document], texts[document], outputs[document] = n, pieces, pieces + counts[document]
        n, pieces = n + int(counts[document]), pieces + len(came)
        strings.append(pa.array(came, pa.string()))
        for x, column in columns.items():
            column += done[x]
    pool = pa.concat_arrays(strings)
    found = {x: pa.array(column, _ARROW[x]).take(_flat(same, counts)) for x, column in columns.items()}
    found["seq"] = _flat(np.zeros(len(counts), np.int64), counts)
    found["text"] = pool.take(_flat(texts, counts)) if "text" in fields else None
    found["output"] = (pool.take(_flat(outputs, counts)) if alike.whole else pa.nulls(len(chunks), pa.string())) if "output" in fields else None
    return {x: found[x] for x in fields}


def _others(keys: pa.Array) -> np.ndarray:
    """For each key but the first whether it isn't the one before it."""
    if pa.types.is_nested(keys.type) or pa.types.is_floating(keys.type):
        values = keys.to_pylist()
        return np.array([a != b for a, b in zip(values[1:], values, strict=False)], bool)
    codes = keys.dictionary_encode("encode").indices.to_numpy()
    return codes[1:] != codes[:-1]


def fold_batch(df: DataFrame, key: str, seq: str, chunk: str, options: Options = Options(), reset: str | None = None, whole: bool = True) -> DataFrame:  # noqa: B008
    """Rows (key, seq, accepted, output, keep, text, error_kind, error_position), a row a chunk.

    Chunks of a key go by seq. A null chunk is an empty one. Where the column ``reset`` is true, the
    document is forgotten before the chunk. Without ``whole`` the column ``output`` is null: the changes say
    it all, and rows take space in proportion to their chunk instead of to the whole document. Documents that are alike but for
    their digits are folded once (:mod:`..kernel.alike`).
    """
    kind = dict(df.dtypes)[key]
    columns = [key, seq, chunk, *([reset] if reset else [])]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key and seq, a row out for each; only a batch and the state of the key at its end are held."""
        alike, state, last = folds(options, whole), None, None

        def pushed(texts: list[str]) -> list[pa.Array]:
            rows = [state.push(c, whole) for c in texts]
            return [pa.array([r[x] for r in rows], _ARROW[x]) for x in _FIELDS]

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, chunks = batch.column(0), batch.column(2).fill_null("")
            begins = _others(keys)
            forget = batch.column(3).fill_null(False).to_numpy(zero_copy_only=False) if reset else None
            edges = [0, *(np.flatnonzero(begins if forget is None else begins | forget[1:]) + 1).tolist(), n]
            parts, first, end = [], 0, edges[-2]
            if state is not None and keys[0].as_py() == last and not (reset and forget[0]):  # goes on from the batch before
                first = edges[1]
                parts.append(pushed(_texts(chunks[:first])))
            if first < end:
                middle = [e for e in edges if first <= e <= end]
                done = _changes(alike, np.array(middle) - first, chunks[first:end], _FIELDS)
                parts.append([done[x] for x in _FIELDS])
            if first < n:  # the last document may go on in the next batch
                state, last = Fold(options), keys[end].as_py()
                parts.append(pushed(_texts(chunks[end:])))
            arrays = [pa.concat_arrays(x) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), *arrays], names=[key, "seq", *_FIELDS])

    rows = df.select(*columns).repartition(key).sortWithinPartitions(key, seq)
    return rows.mapInArrow(fold, f"`{key}` {kind}, {_OUT}")


def fold_lists(df: DataFrame, key: str, chunks: str, options: Options = Options(), whole: bool = True, fields: Sequence[str] = tuple(_TYPES)) -> DataFrame:  # noqa: B008
    """The same for documents whose chunks are the array of a row already: rows (key, changes), a row a document, without a shuffle.

    changes: an array of structs of the ``fields`` (of seq, accepted, output, keep, text, error_kind, error_position), one for each
    chunk in turn; seq counts from 0. A null array has no chunks.
    """
    kind = dict(df.dtypes)[key]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alike = folds(options, whole)
        for batch in batches:
            counts = batch.column(1).value_lengths().fill_null(0).to_numpy().astype(np.int64)
            given, offsets = batch.column(1).flatten().fill_null(""), np.concatenate([[0], np.cumsum(counts)])
            for start, stop in _groups(offsets, given):
                ends = offsets[start : stop + 1] - offsets[start]
                done = _changes(alike, ends, given[offsets[start] : offsets[stop]], fields)
                changes = pa.StructArray.from_arrays(list(done.values()), fields=[pa.field(x, _ARROW[x]) for x in fields])
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), changes)], names=[key, "changes"])

    return df.select(key, chunks).mapInArrow(fold, f"`{key}` {kind}, changes array<struct<{', '.join(f'{x}: {_TYPES[x]}' for x in fields)}>>")


#: The checkpoint in the state store: the next turn; the chunk with which what isn't settled begins and how many of its characters are; when a timer was set; and a
#: :class:`..kernel.fold.Checkpoint` (``levels`` is ``-`` where there is no place).
_AT = "next bigint, first bigint, skip bigint, timer bigint, levels string, values bigint, deepest bigint, prose boolean, before bigint, done bigint, length bigint, wrapped boolean, twice boolean, escaped boolean, raw boolean, waiting boolean"


def _packed(c: Checkpoint) -> tuple:
    p, e = c.place or Place("-"), c.escapes
    return p.levels, p.values, p.deepest, p.prose, c.before, c.done, c.length, c.wrapped, c.twice, e.escaped, e.raw, e.waiting


def _unpacked(row: tuple) -> Checkpoint:
    levels, values, deepest, prose, before, done, length, wrapped, twice, *escapes = row
    return Checkpoint(None if levels == "-" else Place(levels, values, deepest, prose), before, done, length, wrapped, twice, Escapes(*escapes))


class _Document:
    """One key's document in a batch: a fold that goes on from the state, and which chunks what isn't settled comes from."""

    def __init__(self, options: Options, chunks, row: tuple | None):
        self.options, self.chunks = options, chunks
        self.turn, first, skip, self.timer = row[:4] if row else (0, 0, 0, -1)
        self.rest: list[tuple[int, int]] = []  # (seq, characters)
        texts = []
        for s in range(first, self.turn):
            if chunks.containsKey((s,)):
                texts.append(chunks.getValue((s,))[0])
                self.rest.append((s, len(texts[-1])))
        rest = "".join(texts)[skip:]
        checkpoint = _unpacked(row[4:]) if row else Checkpoint()
        self.fold = Fold.at(options, checkpoint, rest, lambda: self._history(first, skip, rest, checkpoint))

    def _history(self, first: int, skip: int, rest: str, c: Checkpoint) -> tuple[str, str]:
        """The text before ``rest``, and its output."""
        before = sorted((k[0], v[0]) for k, v in self.chunks.iterator() if k[0] <= first)
        text = "".join(t if s < first else t[:skip] for s, t in before)
        done = ""
        if c.done:
            whole = render(text + rest, self.options).encode("utf-8", "surrogatepass")
            done = whole[c.wrapped : c.wrapped + c.done].decode("utf-8", "surrogatepass")
        return text, done

    def forget(self) -> None:
        self.fold.reset()
        self.rest = []
        for (s,) in list(self.chunks.keys()):
            self.chunks.removeKey((s,))

    def push(self, chunk: str, whole: bool) -> dict:
        got = self.fold.push(chunk, whole)
        if got["accepted"]:
            self.chunks.updateValue((self.turn,), (chunk,))
            self.rest.append((self.turn, len(chunk)))
        self.turn += 1
        return got

    def row(self) -> tuple:
        left = len(self.fold.rest)
        if left > sum(n for _, n in self.rest):  # rendered from the start again
            self.rest = sorted((k[0], len(v[0])) for k, v in self.chunks.iterator())
        first, skip = self.turn, 0
        for s, n in reversed(self.rest):
            if left <= 0:
                break
            first, skip, left = s, max(0, n - left), left - n
        return (self.turn, first, skip, self.timer, *_packed(self.fold.checkpoint))


class FoldProcessor(StatefulProcessor):
    """The fold for transformWithStateInPandas."""

    def __init__(self, key: str, seq: str, chunk: str, options: Options, idle_ms: int | None = None, reset: str | None = None, time: str | None = None, whole: bool = True):
        self.key, self.seq, self.chunk, self.options, self.idle_ms, self.reset, self.time, self.whole = key, seq, chunk, options, idle_ms, reset, time, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", _AT, self.idle_ms)
        self.chunks = handle.getMapState("chunks", "seq bigint", "chunk string", self.idle_ms)
        self.waiting = handle.getMapState("waiting", "seq bigint", "chunk string, reset boolean, time bigint", self.idle_ms)

    def _refused(self, document: _Document, seq: int, kind: str) -> tuple:
        fold = document.fold
        return seq, False, fold.output if self.whole else None, fold.output_bytes, "", kind, None

    def _go_on(self, document: _Document, out: list[tuple], come: dict[int, tuple], begun: bool) -> None:
        """Takes the chunks whose turn it is; what has ``come`` and must wait is kept, and a timer set where any waits on.

        begun: whether the key has state, so that chunks of earlier batches may be waiting.
        """
        begun = begun and self.waiting.exists()
        for s in sorted(come) if begun else ():
            self.waiting.updateValue((s,), come.pop(s))
        while document.turn in come or (begun and self.waiting.containsKey((document.turn,))):
            turn = document.turn
            if begun:
                chunk, forget, _ = self.waiting.getValue((turn,))
                self.waiting.removeKey((turn,))
            else:
                chunk, forget, _ = come.pop(turn)
            if forget:
                document.forget()
            got = document.push(chunk, self.whole)
            out.append((turn, *(got[x] for x in _FIELDS)))
        for s, x in come.items():
            self.waiting.updateValue((s,), x)
        if self.time and document.timer < 0 and (come or (begun and self.waiting.exists())):
            document.timer = min(v[2] for _, v in self.waiting.iterator())
            self.handle.registerTimer(document.timer)
        self.at.update(document.row())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begun = self.at.exists()
        document, out, come = _Document(self.options, self.chunks, self.at.get() if begun else None), [], {}
        for frame in rows:
            forget = frame[self.reset] if self.reset else [False] * len(frame)
            times = frame[self.time] if self.time else [0] * len(frame)
            for s, c, f, t in zip(frame[self.seq], frame[self.chunk], forget, times, strict=True):
                if int(s) >= document.turn:
                    come[int(s)] = "" if c is None or c != c else str(c), bool(f), int(t)
                else:  # its turn has passed
                    out.append(self._refused(document, int(s), "LateChunk"))
        self._go_on(document, out, come, begun)
        yield _frame(self.key, [(key[0], *r) for r in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed a chunk that waits: those before it aren't waited for any longer."""
        document, out = _Document(self.options, self.chunks, self.at.get() if self.at.exists() else None), []
        document.timer = -1
        if not self.waiting.containsKey((document.turn,)) and self.waiting.exists():
            out.append(self._refused(document, document.turn, "LostChunk"))
            document.turn = min(k[0] for k in self.waiting.keys())
        self._go_on(document, out, {}, True)
        yield _frame(self.key, [(key[0], *r) for r in out])

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, key: str, seq: str, chunk: str, options: Options = Options(), idle_ms: int | None = None, reset: str | None = None, time: str | None = None, delay: str = "0 seconds", whole: bool = True) -> DataFrame:  # noqa: B008
    """The same over a stream (state store: RocksDB). seq counts 0, 1, ... for each key.

    A chunk whose turn has passed is rejected with the error kind LateChunk and changes nothing.
    idle_ms: forget keys that have been idle for so long (processing time); an addition of this engine.
    time, delay: a timestamp column and how far a chunk may lag behind (event time). Once the watermark has passed a chunk
    that waits for earlier ones, these count as lost: a row of the error kind LostChunk has the first missing seq, and the document goes on
    with the waiting chunk. A lost one that comes after all is a LateChunk; none is dropped in silence. Null times count as long ago.
    whole: with False, ``output`` is null (the changes say it all) and no batch reads more than what isn't settled.
    """
    if time and idle_ms:
        raise ValueError("idle_ms goes by processing time, time by event time: give one of them")
    kind = dict(df.dtypes)[key]
    columns = [F.col(c) for c in (key, seq, chunk, *([reset] if reset else []))]
    if time:
        # a plain number, so that Spark doesn't take late rows away before they can be reported
        df = df.withWatermark(time, delay)
        columns.append(F.coalesce(F.unix_millis(F.col(time).cast("timestamp")), F.lit(0)).alias(_TIME))
    processor = FoldProcessor(key, seq, chunk, options, idle_ms, reset, _TIME if time else None, whole)
    mode = "ProcessingTime" if idle_ms else "EventTime" if time else "None"
    return df.select(*columns).groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, {_OUT}", "Append", mode)


def fold_state(spark: SparkSession, checkpoint: str, options: Options = Options()) -> DataFrame:  # noqa: B008
    """The state of :func:`fold_stream` after its last batch, from the folder of its checkpoints: a row a key.

    Columns: the key, next (the seq whose turn it is), input (all accepted text), input_bytes, is_empty, output (null before anything was
    accepted), unsettled_bytes (of the text, read again by the next batch) and waiting (the seqs that came before their turn).
    """
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
    of = read("at").select(F.col("key"), F.col("value.next").alias("next"), F.col("value.length").alias("input_bytes"), (F.col("value.length") - F.col("value.before")).alias("unsettled_bytes"))
    chunks = read("chunks").groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("user_map_key.seq").alias("seq"), F.col("user_map_value.chunk").alias("chunk"))))["chunk"].alias("chunks"))
    waiting = read("waiting").groupBy("key").agg(F.array_sort(F.collect_list("user_map_key.seq")).alias("waiting"))
    found = of.join(chunks, "key", "left").join(waiting, "key", "left").withColumn("input", F.coalesce(F.array_join("chunks", ""), F.lit("")))
    output = try_repair("input", int(options.allow), int(options.repairs))
    return found.select("key.*", "next", "input", "input_bytes", (F.col("input_bytes") == 0).alias("is_empty"), F.when(F.col("input_bytes") > 0, output).alias("output"), "unsettled_bytes", F.coalesce("waiting", F.array().cast("array<bigint>")).alias("waiting"))
