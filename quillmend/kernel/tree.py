"""Canonical text read as a tree, without loss: looking up, editing, comparing, coercing and rendering.

A tree is None, a bool, a :class:`Num` (its text), a str, a list, or a :class:`Members` (pairs in order,
duplicates kept).
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

from .classes import LONE, quoted


class Num(str):
    """The text of a number."""


class Members(list):
    """Key and value pairs of an object."""


_HALF = re.compile(r"\\u[dD][89a-fA-F]")


def read(text: str):
    """The tree of valid JSON text; halves of surrogate pairs without the other become U+FFFD."""
    node = _DECODER.decode(text)
    return _mended(node) if _HALF.search(text) else node


def _mended(node):
    if isinstance(node, Members):
        return Members((_mended(k), _mended(v)) for k, v in node)
    if isinstance(node, list):
        return [_mended(v) for v in node]
    return LONE.sub("\ufffd", node) if isinstance(node, str) and not isinstance(node, Num) else node


def _constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(object_pairs_hook=Members, parse_float=Num, parse_int=Num, parse_constant=_constant, strict=False)


def write(node) -> str:
    """Canonical text."""
    if node is None:
        return "null"
    if node is True:
        return "true"
    if node is False:
        return "false"
    if isinstance(node, Num):
        return str(node)
    if isinstance(node, str):
        return quoted(node)
    if isinstance(node, Members):
        return "{" + ", ".join(f"{quoted(k)}: {write(v)}" for k, v in node) + "}"
    return "[" + ", ".join(map(write, node)) + "]"


def kind(node) -> str:
    if node is None:
        return "null"
    if isinstance(node, bool):
        return "bool"
    if isinstance(node, Num):
        return "number"
    if isinstance(node, str):
        return "string"
    return "object" if isinstance(node, Members) else "array"


MISSING = object()


def get(node, key: str):
    """The first member of that key."""
    if isinstance(node, Members):
        for k, v in node:
            if k == key:
                return v
    return MISSING


def index(node, i: int):
    return node[i] if kind(node) == "array" and 0 <= i < len(node) else MISSING


def _steps(pointer: str) -> list[str] | None:
    """The tokens of an RFC 6901 pointer; None if it is neither empty nor starts with a slash."""
    if pointer and pointer[0] != "/":
        return None
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]


def _array_index(token: str) -> int:
    sound = token.isascii() and token.isdigit() and (token == "0" or token[0] != "0")
    return int(token) if sound else -1


def _step(node, token: str):
    return get(node, token) if isinstance(node, Members) else index(node, _array_index(token))


def pointer(node, path: str):
    steps = _steps(path)
    if steps is None:
        return MISSING
    for token in steps:
        node = _step(node, token)
        if node is MISSING:
            break
    return node


def replaced(node, path: str, change):
    """The tree with ``change(old)`` in the pointer's place; MISSING if that is nowhere."""
    steps = _steps(path)
    if steps is None:
        return MISSING
    if not steps:
        return change(node)
    parent = pointer(node, path.rpartition("/")[0])
    old = MISSING if parent is MISSING else _step(parent, steps[-1])
    if old is MISSING:
        return MISSING
    new = change(old)
    if isinstance(parent, Members):
        at = next(i for i, (k, _) in enumerate(parent) if k == steps[-1])
        parent[at] = (steps[-1], new)
    else:
        parent[_array_index(steps[-1])] = new
    return node


def _whole(node) -> int | None:
    """An integer by its text, if it has few enough digits to fit any type."""
    return int(node) if isinstance(node, Num) and len(node) <= 40 and node.lstrip("-").isdigit() else None


def as_i64(node) -> int | None:
    """Exactly a 64-bit integer by its text."""
    n = _whole(node)
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def as_u64(node) -> int | None:
    n = _whole(node)
    return n if n is not None and n < 1 << 64 and node[0] != "-" else None


def as_f64(node) -> float | None:
    return float(node) if isinstance(node, Num) else None


def equal(node, other) -> bool:
    """Against a plain value of the same kind: integers exactly, floats by value, no coercion."""
    if isinstance(other, bool):
        return isinstance(node, bool) and node == other
    if isinstance(other, int):
        return isinstance(node, Num) and node.lstrip("-").isdigit() and Decimal(node) == other and not (node.startswith("-") and other > (1 << 63) - 1)
    if isinstance(other, float):
        return isinstance(node, Num) and float(node) == other
    if isinstance(other, str):
        return isinstance(node, str) and not isinstance(node, Num) and node == other
    return other is None and node is None


def float_text(x: float) -> str:
    """The shortest text that reads back; null for what JSON can't spell."""
    if not math.isfinite(x):
        return "null"
    head, mark, power = repr(x).partition("e")
    return head + mark + str(int(power)) if mark else head


def loaded(node):
    """For a lossy view: keys sorted, the last duplicate wins, numbers beyond any float are strings."""
    if isinstance(node, Members):
        last = {k: loaded(v) for k, v in node}
        return Members(sorted(last.items(), key=lambda kv: kv[0].encode("utf-8", "surrogatepass")))
    if isinstance(node, list):
        return [loaded(v) for v in node]
    if isinstance(node, Num):
        if (n := as_i64(node)) is not None or (n := as_u64(node)) is not None:
            return Num(n)
        return Num(float_text(float(node))) if math.isfinite(float(node)) else str(node)
    return node


class Mismatch(ValueError):
    """A value that doesn't fit its type."""


_NAMES = {"null": "`null`", "bool": "a boolean", "number": "a number", "string": "a string", "array": "an array", "object": "an object"}


def _expected(what: str, node) -> Mismatch:
    return Mismatch(f"expected {what}, found {_NAMES[kind(node)]}")


_INTEGERS = {"tinyint": ("i8", 8), "smallint": ("i16", 16), "int": ("i32", 32), "bigint": ("i64", 64)}


def _integer(node, name: str, low: int, high: int) -> int:
    if not isinstance(node, Num):
        raise _expected("a number", node)
    n = None if low == 0 and node.startswith("-") else _whole(node)
    if n is None or not low <= n <= high:
        raise Mismatch(f"number `{node}` does not fit `{name}`")
    return n


def coerced(node, spec: dict | str):
    """The value of a tree for a Spark type in its JSON form (``DataType.jsonValue()``).

    Nothing is converted between kinds; null is a value of every nullable field and element. A struct needs
    an object: members it doesn't name are passed over, a missing one must be nullable, of duplicates the
    first counts.
    """
    if isinstance(spec, dict):
        if spec["type"] == "struct":
            fields = spec["fields"]
            if len(fields) == 2 and fields[0].get("metadata", {}).get("comment", "").split(" ")[0] == "enum":
                return _variant(node, fields)
            if fields and kind(node) == "array" and all(f["name"] == f"_{i}" for i, f in enumerate(fields, 1)):
                if len(node) != len(fields):
                    raise Mismatch(f"expected an array of {len(fields)} elements, found {len(node)}")
                return {f["name"]: _nullable(v, f["type"], f["nullable"]) for f, v in zip(fields, node, strict=True)}
            if not isinstance(node, Members):
                raise _expected("an object", node)
            out = {}
            for field in spec["fields"]:
                value = get(node, field["name"])
                if value is MISSING or value is None:
                    if not field["nullable"]:
                        raise Mismatch(f"missing field `{field['name']}`") if value is MISSING else _expected("a value", None)
                    out[field["name"]] = None
                else:
                    out[field["name"]] = coerced(value, field["type"])
            return out
        if spec["type"] == "array":
            if kind(node) != "array":
                raise _expected("an array", node)
            return [_nullable(v, spec["elementType"], spec["containsNull"]) for v in node]
        if spec["type"] == "map":
            if not isinstance(node, Members):
                raise _expected("an object", node)
            return {k: _nullable(v, spec["valueType"], spec["valueContainsNull"]) for k, v in node}
    name = {"byte": "tinyint", "short": "smallint", "integer": "int", "long": "bigint"}.get(spec, spec)
    if name in _INTEGERS:
        rust, bits = _INTEGERS[name]
        return _integer(node, rust, -(1 << bits - 1), (1 << bits - 1) - 1)
    if name in ("decimal(20,0)", "decimal(38,0)"):
        if name == "decimal(20,0)":
            return Decimal(_integer(node, "u64", 0, (1 << 64) - 1))
        return Decimal(_integer(node, "i128", -(10**38) + 1, 10**38 - 1))
    if name in ("float", "double"):
        if not isinstance(node, Num):
            raise _expected("a number", node)
        x = float(node)
        if not math.isfinite(x) or name == "float" and abs(x) >= 3.4028235677973366e38:
            raise Mismatch(f"number `{node}` is not a finite float and cannot be represented")
        return x
    if name == "boolean":
        if not isinstance(node, bool):
            raise _expected("a boolean", node)
        return node
    if name == "string":
        if kind(node) != "string":
            raise _expected("a string", node)
        return str(node)
    if name == "char(1)":
        if kind(node) != "string" or len(node) != 1:
            raise _expected("a character", node)
        return str(node)
    if name == "binary":
        if kind(node) != "array":
            raise _expected("an array", node)
        return bytes(_integer(v, "u8", 0, 255) for v in node)
    if name == "void":
        if node is not None:
            raise _expected("null", node)
        return None
    raise Mismatch(f"type {name} can't be read from JSON")


def _one_of(names: list[str]) -> str:
    quoted = [f"`{n}`" for n in names]
    if not quoted:
        return "there are no variants"
    return "expected " + (quoted[0] if len(quoted) == 1 else " or ".join(quoted) if len(quoted) == 2 else "one of " + ", ".join(quoted))


def _variant(node, fields: list[dict]) -> dict:
    """A tagged union: the variant's name, or an object whose first member is the name and the content."""
    units = [u.strip() for u in fields[0]["metadata"]["comment"].partition(" ")[2].split(",") if u.strip()]
    contents = {f["name"]: f["type"] for f in fields[1]["type"]["fields"]}
    if kind(node) == "string":
        name, content = str(node), MISSING
    elif isinstance(node, Members):
        if not node:
            raise Mismatch("enum must have exactly one member")
        name, content = node[0]
    else:
        raise _expected("an enum", node)
    if name not in units and name not in contents:
        raise Mismatch(f"unknown variant `{name}`, {_one_of([*units, *contents])}")
    if name in units:
        if content is not MISSING and content is not None:
            raise _expected("`null` content for a unit variant", content)
        return {"variant": name, "payload": None}
    spec = contents[name]
    struct = isinstance(spec, dict) and spec["type"] == "struct" and not spec["fields"][0].get("metadata", {}).get("comment", "").startswith("enum")
    positional = struct and all(f["name"] == f"_{i}" for i, f in enumerate(spec["fields"], 1))
    if content is MISSING:
        raise Mismatch(f"invalid type: unit variant, expected {'tuple' if positional else 'struct' if struct else 'newtype'} variant")
    if positional and kind(content) != "array":
        raise _expected("a tuple variant content", content)
    if struct and not positional and not isinstance(content, Members):
        raise _expected("a struct variant content", content)
    return {"variant": name, "payload": {**dict.fromkeys(contents), name: _nullable(content, spec, True)}}


def _nullable(node, spec, null: bool):
    return None if node is None and null else coerced(node, spec)
