"""A document in chunks: after each chunk the same as all of it at once, and in time proportional to its length."""

import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmend.errors import JsonTextError
from quillmend.kernel import fold as fold_module
from quillmend.kernel.document import Escapes, escaped_twice, render
from quillmend.kernel.fold import Fold
from quillmend.options import Allow, Options, Repairs


def _same(text: str, cuts: list[int], options: Options) -> None:
    fold, accepted, rebuilt = Fold(options), "", b""
    edges = sorted({min(c, len(text)) for c in cuts} | {0, len(text)})
    for a, b in zip(edges, edges[1:], strict=False):
        chunk = text[a:b]
        got = fold.push(chunk)
        try:
            expected = render(accepted + chunk, options)
        except JsonTextError as e:
            assert not got["accepted"] and (got["error_kind"], got["error_position"]) == (e.kind, e.position), (text, edges)
            assert got["output"].encode() == rebuilt
            continue
        accepted += chunk
        assert got["accepted"] and got["output"] == expected, (text, edges, chunk, got["output"], expected)
        rebuilt = rebuilt[: got["keep"]] + got["text"].encode()
        assert rebuilt.decode() == expected, (text, edges)
        assert fold.output == expected and fold.input == accepted and len(fold) == len(accepted.encode()) and not fold.is_empty() == bool(accepted)


_VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(alphabet='ab "\\\n:,{}[]é😀/', max_size=12),
    lambda x: st.lists(x, max_size=5) | st.dictionaries(st.text(alphabet='ab "\\é', max_size=6), x, max_size=5),
    max_leaves=25,
)
_CUTS = st.lists(st.integers(0, 400), max_size=25)
_OPTIONS = st.builds(Options, st.sampled_from([int(Allow.ALL), int(Allow.NOTHING), int(Allow.OBJ), int(Allow.COLLECTION), int(Allow.OBJ | Allow.STR | Allow.KEY)]), st.sampled_from([int(Repairs.ALL), 0, int(Repairs.ALL & ~Repairs.TRUNCATION), int(Repairs.ALL & ~Repairs.FENCES), int(Repairs.ALL & ~Repairs.NDJSON), int(Repairs.ALL & ~Repairs.UNQUOTED)]))


@settings(max_examples=400, deadline=None)
@given(_VALUES, _CUTS, st.sampled_from([None, 1]), st.sampled_from(["", " ", "```json\n", "Sure: "]), st.sampled_from(["", "\n```", " x", "\n[1]\n{\"a\": 2}\n", "}"]), st.integers(0, 10**9), _OPTIONS)
def test_chunks_and_damage(value, cuts, indent, head, end, seed, options):
    text = json.dumps(value, ensure_ascii=bool(seed % 2), indent=indent)
    draw = random.Random(seed)
    for _ in range(draw.randrange(3)):  # damage
        if text:
            at = draw.randrange(len(text))
            text = text[:at] + draw.choice(["", ",", '"', "'", "}", "]", "\\", "x", ":", "//", "{", "\\\""]) + text[at + draw.randrange(2) :]
    _same(head + text + end, cuts, options)


@settings(max_examples=150, deadline=None)
@given(st.lists(_VALUES, max_size=6), _CUTS, st.sampled_from(["\n", "\r\n", "\n\n", ",", " ", ",\n"]))
def test_lines(values, cuts, between):
    _same(between.join(json.dumps(v) for v in values), cuts, Options())


@settings(max_examples=150, deadline=None)
@given(_VALUES, _CUTS)
def test_escaped_once_too_often(value, cuts):
    text = json.dumps(value)
    _same(json.dumps(text)[1:-1], cuts, Options())
    _same("[1, 2, " + json.dumps(text)[1:-1] + "]", cuts, Options())


#: Pieces of documents, sound and damaged.
_PIECES = ["{", "}", "[", "]", ",", ":", '"', "'", "“", "”", "`", "\\", '\\"', "\\\\", "\\u00e9", "\\ud83d\\ude00", "\\u12", "\\x4", "//", "/*", "*/", "/", "\n", " ", "a", "key", "abc def", "true", "True", "tru", "nul", "None", "1", "-1", "0", "01", "1.", "1e5", "1e", ".5", "-", "+", "...", "(", ")", ";", "call(", "&quot;", "&#39;", "&qu", "```", "```json\n", "é", "😀", "http://x.y/z", "/re/", '{"a":1}', "[1,2]", '"k": "v"', "'k': 'v'", ", ", '"a", ', "\u00a0", "plain words ", "more of it"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=20), _CUTS, st.sampled_from(["", '{"a": 1, ', "Sure, here: "]), st.booleans(), _OPTIONS)
def test_pieces_of_documents(pieces, cuts, head, twice, options):
    text = head + "".join(pieces)
    _same(text.replace('"', '\\"') if twice else text, cuts, options)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(_PIECES), max_size=16), st.integers(1, 4), st.integers(0, 10**6))
def test_going_on_from_a_checkpoint(pieces, step, seed):
    """A fold that is made again from its checkpoint and the rest alone is the fold."""
    text, draw = '{"a": [1, ' + "".join(pieces), random.Random(seed)
    fold, other = Fold(), Fold()
    for i in range(0, len(text), step):
        if draw.random() < 0.4 and not fold.is_empty():
            rest, whole = fold.rest, fold.input
            wrapped, done = fold.checkpoint.wrapped, fold.checkpoint.done
            settled = fold.output.encode()[wrapped : wrapped + done].decode()
            fold = Fold.at(Options(), fold.checkpoint, rest, lambda t=whole[: len(whole) - len(rest)], d=settled: (t, d))
        assert fold.push(text[i : i + step]) == other.push(text[i : i + step])
    assert fold.input == other.input and len(fold) == len(other)


def _document(members: int) -> str:
    return json.dumps({f"key{i}": {"n": i, "list": [i, "some text"], "ok": True} for i in range(members)})


_DAMAGES = {
    "sound": lambda t: t,
    "single quotes": lambda t: t.replace('"', "'"),
    "unquoted keys": lambda t: t.replace('"key', "key").replace('": {', ": {"),
    "comments": lambda t: t.replace("}, ", "}, /* a comment */ "),
    "prose": lambda t: "Sure, here is all that you have asked for, as it was there\n" + t,
    "fence": lambda t: "```json\n" + t,
    "trailing commas": lambda t: t.replace("}, ", ",}, "),
    "python": lambda t: t.replace("true", "True").replace('"', "'"),
    "escaped": lambda t: json.dumps(t)[1:-1],
    "lines": lambda t: "\n".join(json.dumps({"n": i, "s": "text"}) for i in range(len(t) // 24)),
    "one string": lambda t: '{"t": "' + "plain words and more of them " * (len(t) // 29),
    "undamaged tail": lambda t: "{'a': 1, b: 2, " + t[1:],
}


def _work(text: str, monkeypatch) -> int:
    """Characters that are read again or anew while the text comes in chunks of eight."""
    read = []
    plain = fold_module.Renderer

    class Counted(plain):
        def __init__(self, text, *rest):
            read.append(len(text))
            super().__init__(text, *rest)

    monkeypatch.setattr(fold_module, "Renderer", Counted)
    fold, shown = Fold(), b""
    for i in range(0, len(text), 8):
        got = fold.push(text[i : i + 8], whole=False)
        assert got["output"] is None
        shown = shown[: got["keep"]] + got["text"].encode()
    monkeypatch.setattr(fold_module, "Renderer", plain)
    assert shown.decode() == fold.output and fold.output == render(fold.input)
    return sum(read)


@pytest.mark.parametrize("damage", _DAMAGES)
def test_work_is_linear(damage, monkeypatch):
    """51 KB in chunks of eight characters: four times the text is four times the work, whatever its damage."""
    small, large = (_DAMAGES[damage](_document(n)) for n in (208, 832))
    a, b = _work(small, monkeypatch), _work(large, monkeypatch)
    assert len(large) > 40_000 and b < 1.3 * a * len(large) / len(small) and b < 40 * len(large)


def test_time_is_linear():
    def seconds(text: str) -> float:
        fold, start = Fold(), time.process_time()
        for i in range(0, len(text), 8):
            fold.push(text[i : i + 8], whole=False)
        return time.process_time() - start

    text = _DAMAGES["single quotes"](_document(100))
    seconds(text)
    assert seconds(_DAMAGES["single quotes"](_document(1600))) < 16 * 3 * seconds(text) + 0.5


def test_verdict_of_escapes_chunk_by_chunk():
    draw = random.Random(3)
    for _ in range(400):
        text = "".join(draw.choices(["\\", '"', "a", '\\"', "\\\\"], k=draw.randrange(14)))
        state, seen = Escapes(), ""
        for i in range(0, len(text), step := draw.randrange(1, 4)):
            before = state
            state.then("\\\"x")  # a chunk that is rejected leaves nothing
            assert state == before
            state, seen = state.then(text[i : i + step]), seen + text[i : i + step]
            assert state.twice == escaped_twice(seen), seen
    start = time.process_time()
    state = Escapes()
    for _ in range(100_000):
        state = state.then('\\"abc')
    assert time.process_time() - start < 5 and state.twice


def test_verdict_flips():
    """On with the second chunk, off with the third; a rejected chunk in between changes nothing."""
    fold = Fold()
    outputs = [fold.push(c)["output"] for c in ("[\\n1, ", '\\"a\\", ', '"b"]')]
    assert outputs == [render("[\\n1, "), render('[\\n1, \\"a\\", '), render('[\\n1, \\"a\\", "b"]')] and outputs[1] == '[1, "a"]'
    fold = Fold()
    fold.push('[\\"a\\"')
    assert not fold.push('] "x" y')["accepted"] and fold.push(", 2")["output"] == render('[\\"a\\", 2')


def test_a_fold_goes_on_from_what_was_kept():
    text = json.dumps([{"a": i, "b": "x" * (i % 7)} for i in range(60)])
    fold = Fold()
    for i in range(0, len(text), 11):
        fold = Fold(Options(), fold.text, fold.output)
        for chunk in (text[i : i + 5], text[i + 5 : i + 11]):
            if chunk:
                before = fold.output.encode()
                got = fold.push(chunk)
                assert (before[: got["keep"]] + got["text"].encode()).decode() == got["output"] == render(fold.text)
    fold.reset()
    assert fold.is_empty() and fold.push("[1")["output"] == "[1]"
