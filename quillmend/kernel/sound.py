"""The sound parts of a damaged document, taken as they are at the speed of C.

The standard decoder says how far a text is strict JSON; what it has passed is put in canonical spelling
by whole-text operations: strings are set aside, white space goes from the rest, separators get their space.
"""

from __future__ import annotations

import json
import re

from .classes import LONE, quoted

_STRING = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)"', re.DOTALL)
_MARKS = re.compile(r"[\[\]{},]")
#: Curly brackets as square ones, and all that is no bracket.
_SQUARE = bytes.maketrans(b"{}", b"[]")
_NO_BRACKETS = bytes(x for x in range(256) if x not in b"[]{}")


def _constant(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_constant)


def respelled(string: str) -> str:
    """A JSON string in canonical spelling."""
    return quoted(LONE.sub("\ufffd", json.loads(string))) if "\\" in string else string


def _split(piece: str) -> list[str]:
    """In turn what is between strings and what is in them; an unfinished string at the end is left out."""
    if '\\"' not in piece:
        parts = piece.split('"')
        return parts if len(parts) % 2 else parts[:-1]
    parts = _STRING.split(piece)
    parts[-1] = parts[-1].partition('"')[0]
    return parts


def _depth(rest: bytes) -> int:
    """How deep brackets nest: as often as innermost pairs can be taken away."""
    left, depth = rest.translate(_SQUARE, _NO_BRACKETS), 0
    while left:
        shorter = left.replace(b"[]", b"")
        if len(shorter) == len(left):  # what is left is cut off
            return depth + max(left.count(b"["), left.count(b"]"))
        left, depth = shorter, depth + 1
    return depth


def canonical(parts: list[str]) -> tuple[str, int]:
    """A split piece of strict JSON in canonical spelling, and how deep it nests."""
    rest = "\0".join(parts[::2]).encode("ascii").translate(None, b" \n\r\t")  # there is nothing else between strings
    out = parts[:]
    out[::2] = rest.replace(b",", b", ").replace(b":", b": ").decode("ascii").split("\0")
    text = '"'.join(out)
    if "\\" in text:
        out[1::2] = [respelled(f'"{s}"')[1:-1] if "\\" in s else s for s in parts[1::2]]
        text = '"'.join(out)
    return text, _depth(rest)


def _last_comma(rest: str) -> int:
    """The last comma directly in the container that opens first, in a piece without what is in its strings; -1 if there is none."""
    depth = rest.count("[") + rest.count("{") - rest.count("]") - rest.count("}")
    for m in _MARKS.finditer(rest[::-1]):  # from the end: it lies before the last member
        ch = m[0]
        if ch == ",":
            if depth == 1:
                return len(rest) - m.end()
        elif ch in "[{":
            depth -= 1
        else:
            depth += 1
    return -1


def ahead(text: str, start: int) -> tuple[int, bool, str, int] | None:
    """How far the container at ``start`` is sound: (its end, True) or (the comma after its last sound member, False).

    Then the sound members in canonical spelling, and how deep they nest.
    """
    try:
        stop, reached = _DECODER.raw_decode(text, start)[1], None
    except json.JSONDecodeError as e:
        reached = e.pos
    except (ValueError, RecursionError):
        return None
    if reached is None:
        return stop, True, *canonical(_split(text[start + 1 : stop - 1]))
    if reached - start < 16:
        return None
    parts = _split(text[start:reached])
    rest = "\0".join(parts[::2])
    comma = _last_comma(rest)
    if comma < 0:
        return None
    n = rest.count("\0", 0, comma)  # strings before it
    parts = parts[: 2 * n + 1]
    parts[-1] = parts[-1][: comma - rest.rfind("\0", 0, comma) - 1]
    stop = start + sum(map(len, parts)) + 2 * n
    parts[0] = parts[0][1:]
    return stop, False, *canonical(parts)
