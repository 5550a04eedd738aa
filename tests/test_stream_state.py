"""The fold as a stateful stream: what is written and read for each batch, gaps closed by event time, and the state as a table."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from quillmend import streaming
from quillmend.kernel.document import render
from quillmend.kernel.fold import Fold


class _Map:
    """A map state that counts what is written and read."""

    def __init__(self):
        self.d, self.written, self.read = {}, 0, 0

    def containsKey(self, k):
        return k in self.d

    def getValue(self, k):
        self.read += len(self.d[k][0])
        return self.d[k]

    def updateValue(self, k, v):
        self.written += len(str(v))
        self.d[k] = v

    def removeKey(self, k):
        self.d.pop(k, None)

    def exists(self):
        return bool(self.d)

    def iterator(self):
        self.read += sum(len(v[0]) for v in self.d.values())
        return iter(list(self.d.items()))

    def keys(self):
        return iter(list(self.d))


class _Value:
    def __init__(self):
        self.v, self.written = None, 0

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v
        self.written += len(str(v))


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.states.setdefault(name, _Map())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, _Value())

    def registerTimer(self, at):
        self.timers.append(at)


def _batches(text, size, whole, options=None):
    """Every chunk in a batch of its own, as the state store would see it."""
    import pandas as pd

    from quillmend.options import Options
    from quillmend.streaming.fold import FoldProcessor

    handle, out = _Handle(), []
    for n, i in enumerate(range(0, len(text), size)):
        processor = FoldProcessor("k", "s", "c", options or Options(), whole=whole)
        processor.init(handle)
        for frame in processor.handleInputRows(("x",), iter([pd.DataFrame({"s": [n], "c": [text[i : i + size]]})]), None):
            out += frame.to_dict("records")
    return handle.states, out


@pytest.mark.parametrize("damage", [lambda t: t, lambda t: t.replace('"', "'"), lambda t: t.replace('"key', "key").replace('": {', ": {"), lambda t: "```json\n" + t.replace("}, ", ",}, /* so */ "), lambda t: json.dumps(t)[1:-1]])
def test_state_grows_by_what_arrives(damage):
    """Twice the document is twice the state written and read, whether it is sound or damaged."""
    cost = []
    for n in (60, 120):
        text = damage(json.dumps({f"key{i}": {"n": i, "list": [i, "some text"], "ok": True} for i in range(n)}))
        states, out = _batches(text, 16, False)
        shown = b""
        for r in out:
            shown = shown[: r["keep"]] + r["text"].encode()
        assert shown.decode() == render(text) and all(r["output"] is None for r in out)
        cost.append((states["chunks"].written + states["at"].written + states["waiting"].written, states["chunks"].read))
        assert states["at"].written < 200 * len(out) and states["chunks"].read < 12 * len(text)
    assert cost[1][0] < 2.3 * cost[0][0] and cost[1][1] < 2.3 * cost[0][1]


def test_whole_outputs_over_batches():
    for text in ('{"a": 1, "b": [é', "[\\n1, \\\"a\\\", \"b\"]", '{"n": 1}\n{"n": 2}\n[3', "{'a': 'b, c', d: tru"):
        for size in (1, 3, 7):
            fold = Fold()
            expected = [fold.push(text[i : i + size]) for i in range(0, len(text), size)]
            got = _batches(text, size, True)[1]
            assert [(r["accepted"], r["output"], r["keep"], r["text"]) for r in got] == [(e["accepted"], e["output"], e["keep"], e["text"]) for e in expected], text


def _started(spark, frames, tmp_path, name, **more):
    src = str(tmp_path / "src")
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(src)
        for p in glob.glob(f"{src}/*.parquet"):
            if os.path.getmtime(p) > 10**6 + i:
                os.utime(p, (10**6 + i, 10**6 + i))  # one after the other
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streaming.fold_stream(stream, "k", "s", "c", **more).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return {(r.k, r.seq, r.error_kind): r for r in spark.table(name).collect()}


def test_gaps_close_by_event_time(spark, tmp_path):
    """A lost chunk is waited for until the watermark has passed what waits; a late one is reported."""
    rows = lambda *r: spark.createDataFrame(r, "k string, s bigint, c string, t string").withColumn("t", F.col("t").cast("timestamp"))
    frames = [
        rows(("x", 0, "[1", "2024-01-01 00:00:00"), ("x", 2, ", 3", "2024-01-01 00:00:02"), ("x", 3, ", 4", "2024-01-01 00:00:03"), ("y", 0, "{a: ", "2024-01-01 00:00:00"), ("y", 2, "}", "2024-01-01 00:00:01")),
        rows(("y", 1, "1", "2024-01-01 00:00:05"), ("z", 0, "7", "2024-01-01 00:00:08")),  # in time: y's gap is filled
        rows(("z", 1, "8", "2024-01-01 00:05:00")),  # the watermark passes x's waiting chunks
        rows(("z", 2, "9", "2024-01-01 00:06:00")),
        rows(("x", 1, ", 2", "2024-01-01 00:00:01"), ("x", 4, "]", "2024-01-01 00:07:00")),
    ]
    got = _started(spark, frames, tmp_path, "by_time", time="t", delay="10 seconds")
    assert got["x", 1, "LostChunk"].output == "[1]" and not got["x", 1, "LostChunk"].accepted
    assert got["x", 2, None].output == "[1, 3]" and got["x", 3, None].output == "[1, 3, 4]" and got["x", 4, None].output == "[1, 3, 4]"
    assert got["x", 1, "LateChunk"].output == "[1, 3, 4]"
    assert got["y", 2, None].output == '{"a": 1}' and ("y", 1, "LostChunk") not in got and got["z", 2, None].output == "789"


def test_state_as_a_table(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "k string, s bigint, c string")
    frames = [rows(("x", 0, "{a: 1, "), ("x", 1, "b: [é"), ("y", 5, "later"), ("z", 0, "")), rows(("x", 2, ", 'q"), ("y", 3, "too"))]
    _started(spark, frames, tmp_path, "for_state", whole=False)
    got = {r.k: r for r in streaming.fold_state(spark, str(tmp_path / "cp")).collect()}
    x = got["x"]
    assert (x.next, x.input, x.input_bytes, x.is_empty, x.output, x.waiting) == (3, "{a: 1, b: [é, 'q", 17, False, '{"a": 1, "b": ["é", "q"]}', []) and 0 < x.unsettled_bytes < 17
    assert (got["y"].next, got["y"].waiting, got["y"].output, got["y"].is_empty) == (0, [3, 5], None, True) and got["z"].is_empty


def test_time_and_idle_exclude_each_other(spark):
    with pytest.raises(ValueError, match="one of them"):
        streaming.fold_stream(spark.range(1), "id", "id", "id", idle_ms=5, time="t")


def test_chunks_in_turn_never_wait_in_the_store():
    """Chunks of a batch whose turn it is are written once, as chunks; only those that come early are kept as waiting ones."""
    import pandas as pd

    from quillmend.options import Options
    from quillmend.streaming.fold import FoldProcessor

    def batch(seqs, chunks):
        processor = FoldProcessor("k", "s", "c", Options())
        processor.init(handle)
        return [r for f in processor.handleInputRows(("x",), iter([pd.DataFrame({"s": seqs, "c": chunks})]), None) for r in f.to_dict("records")]

    handle = _Handle()
    assert [r["output"] for r in batch([1, 0, 2], ["1, ", "[", "2"])][-1] == "[1, 2]"
    assert handle.states["waiting"].written == 0 and len(handle.states["chunks"].d) == 3
    assert batch([5, 4], ["5", "4, "]) == [] and sorted(handle.states["waiting"].d) == [(4,), (5,)]
    assert [(r["seq"], r["output"]) for r in batch([3, 0], [", 3, ", "late"])] == [(0, "[1, 2]"), (3, "[1, 2, 3]"), (4, "[1, 2, 3, 4]"), (5, "[1, 2, 3, 4, 5]")]
    assert not handle.states["waiting"].d
