"""The kernel without Spark: repairs, options, errors, spans, values, folds."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmend.errors import JsonTextError
from quillmend.kernel import spans, tree
from quillmend.kernel.document import render, render_bytes
from quillmend.kernel.fold import Fold
from quillmend.options import Allow, Options, Repairs

REPAIRED = [
    ("{name: 'Ann', tags: [x, y,], ok: True, n: None}", '{"name": "Ann", "tags": ["x", "y"], "ok": true, "n": null}'),
    ('{"k" "v"}', '{"k": "v"}'),
    ("[7 8, , 9,]", "[7, 8, 9]"),
    ('{"a": [1, {"b": 2', '{"a": [1, {"b": 2}]}'),
    ('{"half":', '{"half": null}'),
    ('{"lone"}', '{"lone": null}'),
    ('[{"lone"}, 2]', '[{"lone": null, "2": null}]'),
    ("[.25, 3., 4e, -, 007, 1.10]", '[0.25, 3.0, 4e0, -0, "007", 1.10]'),
    ("// note\n[1, /* two */ 2]", "[1, 2]"),
    ("```json\n[1]\n```", "[1]"),
    ("[```\n{\"q\": 1}\n```]", '{"q": 1}'),
    ("ObjectId(\"5f\")", '"5f"'),
    ("cb([1, 2]);", "[1, 2]"),
    ("\"left \" + 'right'", '"left right"'),
    ("{&quot;t&quot;: &quot;a &amp; b&quot;}", '{"t": "a & b"}'),
    ("“curly” ", '"curly"'),
    ("{\\\"deep\\\": \\\"x\\\"}", '{"deep": "x"}'),
    ("1\n2\n{a: 3}", '[1, 2, {"a": 3}]'),
    ("{site: https://example.org/a?b=1, n: 2}", '{"site": "https://example.org/a?b=1", "n": 2}'),
    ('["red,"green"]', '["red", "green"]'),
    ('{"size": "15" wide"}', '{"size": "15\\" wide"}'),
    ('"a 55" screen"', '"a 55\\" screen"'),
    ('{"open": "yes}', '{"open": "yes"}'),
    ("/ab+c/", '"/ab+c/"'),
    ('["\\ud83d\\ude00", "\\ud800", "\\x41", "\\q"]', '["\U0001f600", "�", "A", "q"]'),
    ("[nul", "[null]"),
    ("{ 'sp':　1}", '{"sp": 1}'),
    ("[1, ...]", "[1]"),
    ('{"n": NaN, "i": -Infinity}', '{"n": "NaN", "i": "-Infinity"}'),
    ('{"a": 2]', '{"a": 2}'),
    ("(3)", "3"),
]


@pytest.mark.parametrize("text,expected", REPAIRED)
def test_repair(text, expected):
    assert render(text) == expected
    json.loads(expected)
    assert render(expected) == expected


@pytest.mark.parametrize(
    "text,kind,position",
    [
        ("", "NoValueFound", 0), ("  \n", "NoValueFound", 0), ("two words\n{}", "TrailingValue", 10), ("[1] [2]", "TrailingValue", 4),
        ("é [1] [2]", "TrailingValue", 0), ("[" * 257, "DepthLimitExceeded", 256),
    ],
)
def test_repair_errors(text, kind, position):
    with pytest.raises(JsonTextError) as e:
        render(text)
    if text.startswith("é"):
        assert e.value.kind == kind
    else:
        assert (e.value.kind, e.value.position) == (kind, position)


@pytest.mark.parametrize(
    "text,kind,position",
    [
        ("[1 2]", "ExpectedComma", 3), ("[1,]", "TrailingComma", 3), ("[,1]", "TrailingComma", 2), ('{"a" 1}', "UnexpectedEnd", 4), ('{"a" "b"}', "ExpectedColon", 5),
        ("[é]", "UnquotedValue", 1), ('["é" 1', "UnexpectedEnd", 1), ("[1", "UnexpectedEnd", 2), ("1 2", "TrailingValue", 2), ("['a']", "UnexpectedCharacter", 1), ("[01]", "UnexpectedCharacter", 1),
        ('["\\x4"]', "InvalidEscape", 4), ('["\\u12"]', "InvalidUnicodeEscape", 4), ("{(1)}", "ExpectedObjectKey", 1), ("// x\n1", "UnexpectedCharacter", 0), ("(1)", "UnexpectedCharacter", 0),
    ],
)
def test_strict(text, kind, position):
    with pytest.raises(JsonTextError) as e:
        render(text, Options.strict())
    assert (e.value.kind, e.value.position) == (kind, position)


@pytest.mark.parametrize("text", ["[1.10, -0, 1E0, -1.5E+3, 0e+2]", '{"a": {"b": [true, false, null]}}', '"\t raw"', "{1: 2}", '{"a": "x"y"z"}'])
def test_strict_accepts(text):
    render(text, Options.strict())


_ORDER = '{"order": 17, "lines": [{"sku": "K-9", "qty": 3}, {"sku": "M-'


@pytest.mark.parametrize(
    ("text", "allow", "expected"),
    [
        (_ORDER, Allow.ALL, '{"order": 17, "lines": [{"sku": "K-9", "qty": 3}, {"sku": "M-"}]}'),
        (_ORDER, Allow.COLLECTION, '{"order": 17, "lines": [{"sku": "K-9", "qty": 3}, {}]}'),
        (_ORDER, Allow.OBJ, '{"order": 17}'),
        (_ORDER, Allow.ARR, None),
        (_ORDER, Allow.OBJ | Allow.STR, '{"order": 17}'),
        (_ORDER + '4"}], "paid', Allow.OBJ, '{"order": 17, "lines": [{"sku": "K-9", "qty": 3}, {"sku": "M-4"}]}'),
        (_ORDER + '4"}], "paid', Allow.OBJ | Allow.KEY, '{"order": 17, "lines": [{"sku": "K-9", "qty": 3}, {"sku": "M-4"}], "paid": null}'),
        (_ORDER + '4"}]}', Allow.NOTHING, '{"order": 17, "lines": [{"sku": "K-9", "qty": 3}, {"sku": "M-4"}]}'),
        ("[-3, 7.25, 8e", Allow.ARR, "[-3, 7.25]"),
        ("[-3, 7.25, 8e", Allow.ARR | Allow.NUM, "[-3, 7.25, 8e0]"),
        ("[null, fals", Allow.ARR, "[null]"),
        ("[null, fals", Allow.ARR | Allow.BOOL, "[null, false]"),
        ("[true, n", Allow.ARR | Allow.BOOL, "[true]"),
        ("[true, n", Allow.ARR | Allow.NULL, "[true, null]"),
    ],
)
def test_partial(text, allow, expected):
    if expected is None:
        with pytest.raises(JsonTextError):
            render(text, Options.partial(allow))
    else:
        assert render(text, Options.partial(allow)) == expected


def test_masks():
    assert Allow.ATOM == Allow.BOOL | Allow.NULL and Allow.COLLECTION == Allow.ARR | Allow.OBJ
    assert sum(int(r) for r in Repairs if r not in (Repairs.ALL, Repairs.NONE)) == Repairs.ALL
    off = Options.all().with_repairs(Repairs.ALL & ~Repairs.QUOTES)
    with pytest.raises(JsonTextError):
        render("['a']", off)


def test_depth():
    assert render("[" * 256 + "]" * 256).count("[") == 256
    with pytest.raises(JsonTextError):
        render("[" * 256 + "]" * 256 + "\n1")


def test_bytes():
    assert render_bytes("{é: 1}".encode()) == '{"é": 1}'.encode()
    with pytest.raises(JsonTextError) as e:
        render_bytes("é".encode() + b"\xff")
    assert (e.value.kind, e.value.position) == ("InvalidUtf8", 2)


def test_spans():
    assert spans.extract("see ```\nx\n``` and ```JSON\n{\"a\": 1}\n```") == '{"a": 1}'
    assert spans.extract("the value {\"a\": \"}\"} is fine") == '{"a": "}"}'
    assert spans.extract("it is 42, really") == "42"
    assert spans.extract("cut {\"a\": 1") is None
    assert spans.extract("nothing here") is None
    assert spans.extract_all("a {1} b [2] c") == ["{1}", "[2]"]
    assert spans.extract_all("1, 2; 'x'") == ["1", "2", "'x'"]
    assert spans.extract_partial("so {\"a\": 1, ") == '{"a": 1, '
    assert spans.extract_partial("none") == ""


def test_tree():
    doc = tree.read('{"a": [1, {"b/c": "x"}], "k": 1, "k": 2, "m~n": 3}')
    assert tree.pointer(doc, "/a/1/b~1c") == "x" and tree.pointer(doc, "/m~0n") == "3" and tree.pointer(doc, "") is doc
    assert tree.pointer(doc, "/a/01") is tree.MISSING and tree.pointer(doc, "k") is tree.MISSING and tree.pointer(doc, "/a/-1") is tree.MISSING
    assert tree.get(doc, "k") == "1"
    assert tree.as_i64(tree.Num("1.0")) is None and tree.as_i64(tree.Num("-0")) == 0 and tree.as_u64(tree.Num("-0")) is None
    assert [tree.float_text(x) for x in (0.1 + 0.2, 40.0, -7.125, 6.02e23, 9e-9, float("-inf"))] == ["0.30000000000000004", "40.0", "-7.125", "6.02e23", "9e-9", "null"]
    assert not tree.equal(tree.read('"1"'), 1) and tree.equal(tree.read("1"), 1) and not tree.equal(tree.read("true"), 1)


def test_fold_rolls_back():
    fold = Fold()
    assert not fold.push("")["accepted"]
    assert fold.push('{"a": ')["output"] == '{"a": null}'
    got = fold.push("1")
    assert (got["output"], got["keep"], got["text"]) == ('{"a": 1}', 6, "1}")
    assert fold.push(', "b": [é')["output"] == '{"a": 1, "b": ["é"]}'


_json = st.recursive(st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.text("abc XYZ_.:-\"\\\né", max_size=12), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text("abcXYZ_", min_size=1, max_size=6), c, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(_json)
def test_valid_json_is_kept(value):
    text = json.dumps(value, ensure_ascii=False)
    assert json.loads(render(text)) == value
    assert render(render(text)) == render(text)


@settings(max_examples=200, deadline=None)
@given(st.text("{}[]:,\"'\\/ab1.-e+ \ntrufalsn`é", max_size=60))
def test_output_is_valid(text):
    try:
        out = render(text)
    except JsonTextError:
        return
    json.loads(out, strict=True)
    assert render(out) == out


@settings(max_examples=80, deadline=None)
@given(_json, st.integers(1, 5))
def test_fold_equals_one_shot(value, size):
    text, fold, accepted = json.dumps(value), Fold(), ""
    rebuilt = b""
    for i in range(0, len(text), size):
        got = fold.push(text[i : i + size])
        if got["accepted"]:
            accepted += text[i : i + size]
            assert got["output"] == render(accepted)
            rebuilt = rebuilt[: got["keep"]] + got["text"].encode()
            assert rebuilt.decode() == got["output"]


def test_sound_parts_change_nothing(monkeypatch):
    """Damaged documents read with and without the short cut for sound parts."""
    import random

    from quillmend.kernel import sound

    rng, short_cut = random.Random(5), sound.ahead

    def value(depth):
        k = rng.randrange(8)
        if depth <= 0 or k < 3:
            return rng.choice([1, -2.5, "x y", 'é"q\\', True, None, "a{b", "c, d", 1e20, "", "http://x/y", "’s"])
        if k < 5:
            return [value(depth - 1) for _ in range(rng.randrange(5))]
        return {rng.choice(["a", "b c", "k:", "é", "x'"]) + str(i): value(depth - 1) for i in range(rng.randrange(6))}

    def outcome(text, options):
        try:
            return render(text, options)
        except JsonTextError as e:
            return e.kind, e.position, e.char

    for _ in range(1500):
        text = json.dumps(value(4), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text) + 1)
            text = rng.choice([text[:at] + text[at + 1 :], text[:at], text[:at] + rng.choice(list("{}[]:,\"'\\/ab1.-+e \n`é“") + ["//c\n", "...", "```", "\\u12"]) + text[at:]])
        options = rng.choice([Options(), Options.strict(), Options.partial(rng.randrange(128)), Options(127, rng.randrange(4096))])
        monkeypatch.setattr(sound, "ahead", short_cut)
        fast = outcome(text, options)
        monkeypatch.setattr(sound, "ahead", lambda *_: None)
        assert fast == outcome(text, options), text
