"""Documents that are alike but for their digits: the same rows as folding each by itself."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmend import streaming
from quillmend.kernel import alike
from quillmend.kernel.fold import Fold
from quillmend.options import Allow, Options, Repairs
from quillmend.streaming import fold

_PIECES = ["{", "}", "[", "]", ",", ", ", ":", '"', "'", "\\", '\\"', "\\\\", "\\n", "\\u00e9", "\\x41", "\\1", "&#49;", "&quot;", "&", "#", "//1\n", "/*2*/", "/", "\n", " ", "a", "key7", "true", "None", "nul", "0", "1", "-1", "01", "10", "007", "1.", ".5", "1e5", "0x1", "12345", "%", "%s", "%1", "...", "(", ")", "call1(", "```json2\n", "é", "😀", "http://x.y/1", '{"a":1}', "[1,2]", '"k": "v0"', "'k1': 'v'", "5] x 6", '] "x" y', "٣", "\x1f", "\x1e"]
_OPTIONS = st.sampled_from([Options(), Options.strict(), Options(int(Allow.NOTHING)), Options(int(Allow.OBJ | Allow.STR)), Options(int(Allow.ALL), int(Repairs.ALL & ~Repairs.TRUNCATION)), Options(int(Allow.ALL), int(Repairs.ALL & ~Repairs.NUMBERS))])


def _plain(chunks: list[str], options: Options, whole: bool) -> dict[str, list]:
    fold = Fold(options)
    rows = [fold.push(c, whole) for c in chunks]
    return {x: [r[x] for r in rows] for x in alike.Folds.FIELDS}


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=14), st.sampled_from(["", '{"a": [1, ', "[20, ", "Sure 5: "]), st.integers(0, 7), st.integers(0, 10**9), st.booleans(), st.booleans(), _OPTIONS)
def test_other_digits(pieces, head, step, seed, twice, whole, options):
    draw, folds = random.Random(seed), alike.Folds(options, whole)
    text = head + "".join(pieces)
    text = text.replace('"', '\\"') if twice else text
    cuts = [0]
    while cuts[-1] < len(text):
        cuts.append(cuts[-1] + (step or draw.randrange(6)))
    for _ in range(6):
        changed = re.sub("[0-9]", lambda m: draw.choice("0123456789" if draw.random() < 0.7 else m[0]), text)
        chunks = [changed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] or [""]
        assert folds.fold(chunks) == _plain(chunks, options, whole), chunks


@pytest.mark.parametrize("whole", [True, False])
def test_one_fold_for_all_that_are_alike(whole, monkeypatch):
    pushed = []

    class Counted(Fold):
        def push(self, chunk, whole=True):
            pushed.append(chunk)
            return super().push(chunk, whole)

    texts = [f"```json\n{{\\\"id\\\": {10**6 + i}, 'user': {{n: {100 + i % 900}, /* 5% */}}, list: [1 {10**6 + i * 7}, None".replace("'", '\\"') for i in range(500)]
    lists = [[t[i : i + 7] for i in range(0, len(t), 7)] for t in texts]
    expected = [_plain(c, Options(), whole) for c in lists]
    monkeypatch.setattr(alike, "Fold", Counted)
    folds = alike.Folds(Options(), whole)
    assert [folds.fold(c) for c in lists] == expected
    assert len(pushed) < 10 * len(lists[0])


def test_what_is_kept_is_bounded(monkeypatch):
    monkeypatch.setattr(alike, "_KEPT", 3)
    monkeypatch.setattr(alike, "_SEEN", 5)
    folds = alike.Folds()
    for i in [*range(20), *range(20), *range(19, -1, -1)]:
        chunks = ["[1", "2" + "x" * i, "3"]
        for _ in range(2):
            assert folds.fold(chunks) == _plain(chunks, Options(), True)
        assert len(folds.kept) <= 3 and len(folds.seen) <= 5


def test_lists_are_batches(spark):
    rows = [(i, ["", f"{{a: {i}", f"{i * 7}, 'b'", ": [tr", None, '] "x" y', "ue]"][: i % 8]) for i in range(3000)] + [(3000, None)]
    lists = spark.createDataFrame(rows, "k bigint, c array<string>")
    got = streaming.fold_lists(lists, "k", "c")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.filter("size(changes) = 0").count() == sum(not c for _, c in rows)
    changes = got.select("k", F.explode("changes").alias("x")).select("k", "x.*")
    one = lists.select("k", F.posexplode("c").alias("s", "c"))
    batch = streaming.fold_batch(one, "k", "s", "c")
    assert changes.columns == batch.columns
    ours = sorted(map(str, changes.collect()))
    assert ours == sorted(map(str, batch.collect())) and len(ours) == sum(len(c or []) for _, c in rows)
    by_row = {(r.k, r.seq): r for r in changes.collect()}
    for k, chunks in rows[:100]:
        plain = _plain([c or "" for c in chunks], Options(), True)
        assert [tuple(by_row[k, s][x] for x in alike.Folds.FIELDS) for s in range(len(chunks))] == list(zip(*(plain[x] for x in alike.Folds.FIELDS), strict=True))
    less = streaming.fold_lists(lists, "k", "c", whole=False, fields=("keep", "text"))
    assert less.schema["changes"].dataType.elementType.names == ["keep", "text"]


_ROWS = [["[1", "2, 'a", "%5"], ["[1", "2, 'a", "%5\x1f"], ["[7", "8, 'a", "%9"], ["\x1f0", "1"], ["5", "\x1f0", "1"], [], ["[\x1e", "1"], ["[2", "1"], ["[3", "4"], ["é1", "😀2"], ["é3", "😀4"], ["é5", "😀6"], ["", "01"], ["1", "01"], ["1", "", "01"], ["", "02"], ["2", "03"], [""], [""], ["[\\u004", "1"], ["&#4", "1;"], ["{a: 10", "0}", "] 5"], ["{a: 20", "7}", "] 6"], ["{a: 30", "1}", "] 7"], ["1" * 9000, "2"], ["2" * 9000, "3"], ["3" * 9000, "4"]]


@pytest.mark.parametrize("whole", [True, False])
def test_filled_in_together(whole):
    """Documents of one batch, alike or not, in their order: the columns of folding each by itself."""
    folds = alike.Folds(Options(), whole)
    lists = _ROWS * 3 + [[f"[{i}", f", '{i * 7}", "é"] for i in range(300)]
    offsets = np.cumsum([0, *map(len, lists)])
    chunks = pa.array([c for x in lists for c in x], pa.string())
    got = fold._changes(folds, offsets, chunks, ("seq", *alike.Folds.FIELDS))
    expected = [_plain(x, Options(), whole) for x in lists]
    assert got["seq"].to_pylist() == [s for x in lists for s in range(len(x))]
    for field in alike.Folds.FIELDS:
        assert got[field].to_pylist() == [v for x in expected for v in x[field]], field
    assert any(folds.kept.values())
    middle = fold._changes(folds, offsets[40:60] - offsets[40], chunks[offsets[40] : offsets[59]], ("text",))
    assert list(middle) == ["text"] and middle["text"].to_pylist() == [v for x in expected[40:59] for v in x["text"]]


@pytest.mark.parametrize("whole", [True, False])
def test_like_documents_of_a_batch_are_not_read_one_by_one(whole, monkeypatch):
    """No Python object is made for a chunk of a shape that is known."""
    folds = alike.Folds(Options(), whole)
    monkeypatch.setattr(alike.Folds, "fold", lambda *_: pytest.fail("one by one"))
    lists = [[f"{{id: {10**6 + i}", f", n: [{i % 9 + 1} None"] for i in range(5000)]
    offsets, chunks = np.arange(0, 10001, 2), pa.array([c for x in lists for c in x])
    got = fold._changes(folds, offsets, chunks, alike.Folds.FIELDS)
    assert len(folds.kept) == 1 and got["text"].to_pylist()[-2:] == ['{"id": 1004999}', f', "n": [{4999 % 9 + 1}, null]}}']


def test_lists_of_all_sorts(spark):
    """Null, empty and long lists side by side."""
    rows = [(i, [None, [], [""], [f"[{i}", None, f", {i}"], ["x" * 9000, f"{i}"]][i % 5]) for i in range(200)]
    lists = spark.createDataFrame(rows, "k bigint, c array<string>").coalesce(1)
    got = {r.k: r.changes for r in streaming.fold_lists(lists, "k", "c").collect()}
    assert len(got) == 200
    for k, chunks in rows:
        plain = _plain([c or "" for c in chunks or []], Options(), True)
        assert [tuple(x)[1:] for x in got[k]] == list(zip(*(plain[x] for x in alike.Folds.FIELDS), strict=True)), k


def test_groups(monkeypatch):
    """What comes out at once is bounded, also where one document alone is more."""
    lists = [["ab", "c"], [], ["d" * 50, "e"], ["f"], ["g"] * 3] * 4
    offsets, chunks = np.cumsum([0, *map(len, lists)]), pa.array([c for x in lists for c in x])
    assert fold._groups(offsets, chunks) == [(0, len(lists))]
    monkeypatch.setattr(fold, "_TOGETHER", 100)
    groups = fold._groups(offsets, chunks)
    assert len(groups) > 3 and [a for a, _ in groups[1:]] == [b for _, b in groups[:-1]] and (groups[0][0], groups[-1][1]) == (0, len(lists))
    weight = [sum(map(len, x)) * len(x) for x in lists]
    assert all(sum(weight[a:b]) <= 100 + max(weight) for a, b in groups)


def test_documents_over_batches(spark):
    """Documents that begin, go on, are forgotten and end anywhere in batches of a few rows."""
    rows = [(k, s, c, s == k % 7 + 2) for k in range(60) for s, c in enumerate(["", f"{{a: {k}", f"{k * 7}, 'b'", ": [tr", None, '] "x" y', "ue]", "[1", "2"][: k % 10])]
    df = spark.createDataFrame(rows, "k bigint, s bigint, c string, f boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.k, r.seq): tuple(r)[2:] for r in streaming.fold_batch(df, "k", "s", "c", reset="f").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for k, s, c, f in rows:
        one = Fold() if not s or f else one
        push = one.push(c or "")
        assert got[k, s] == tuple(push[x] for x in alike.Folds.FIELDS), (k, s)
