"""A document that arrives in chunks.

Rendering settles places in a document, sound or damaged: between members, where nothing read so far depended on where the text
ends (:class:`.document.Place`). A fold keeps the last one; what comes before it is never read again, and each chunk renders
only what follows it. A chunk that fails changes nothing: all that it would change is computed first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from ..errors import JsonTextError
from ..options import PASS, Options
from .classes import AFTER_QUOTE, QUOTES, SPACE, quoted
from .document import Escapes, Place, Renderer, bytes_before, origin, place_before_escapes, render, unescaped
from .scanner import Fault

#: What neither ends a string nor makes it end elsewhere nor is written otherwise.
_WITHIN = re.compile(f"(?:[^\\x00-\\x1f\\\\&{re.escape(''.join(sorted(AFTER_QUOTE | QUOTES)))}{SPACE}]| )+\\Z")
#: Deeper documents are rendered whole with each chunk.
_DEEPEST = 128


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _shared(a: str, b: str) -> int:
    """How many characters both begin with."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


@dataclass(frozen=True)
class Checkpoint:
    """Where a fold stands, without what is settled: enough to go on with the text after the settled place alone.

    before, done: bytes of the accepted text and of the output (unwrapped) that are settled; length: bytes of all accepted text; wrapped:
    the output is a list of several values; twice: the text is escaped once too often.
    """

    place: Place | None = None
    before: int = 0
    done: int = 0
    length: int = 0
    wrapped: bool = False
    twice: bool = False
    escapes: Escapes = Escapes()


class _OpenString:
    """A string at the end of the text whose closing quote hasn't come: the output (``parts``) before its closing quote and what ends it, the
    blanks that count if more follows, and how many bytes of the whole output come before ``end``."""

    __slots__ = ("blanks", "bytes", "end", "parts")

    def __init__(self, content: str, end: str, blanks: str, size: int):
        self.parts, self.end, self.blanks, self.bytes = [content], end, blanks, size


class Fold:
    """What has been accepted so far, and its repaired form.

    After each accepted chunk, output is what repairing all accepted text at once gives. A chunk with which
    that fails is dropped as if it had never come.
    """

    def __init__(self, options: Options = Options(), text: str = "", output: str = ""):  # noqa: B008
        self.options = options
        self._unquoted = bool(options.repairs & PASS.UNQUOTED)
        self.reset()
        if text:
            self._escapes = Escapes().then(text)
            self._rests, self._tail, self._length = [text], output, _bytes(text)
            self._twice = self._unquoted and self._escapes.twice

    @classmethod
    def at(cls, options: Options, checkpoint: Checkpoint, rest: str, history: Callable[[], tuple[str, str]]) -> Fold:
        """A fold that goes on from a checkpoint and the accepted text after its settled place.

        history: gives all accepted text before ``rest`` and the settled output; it is only called when these are asked for, or needed
        because the document turns out to be escaped once too often (or no longer), or nests too deep.
        """
        fold = cls(options)
        c = checkpoint
        fold._place, fold._before, fold._done_bytes, fold._length, fold._wrapped, fold._twice, fold._escapes = c.place, c.before, c.done, c.length, c.wrapped, c.twice, c.escapes
        fold._rests, fold._history = [rest], history
        if c.length:
            tail, _, r = fold._rendered(c.place, c.before, c.twice, c.escapes, rest)
            fold._tail = tail if r else render(rest, options)
        return fold

    def reset(self) -> None:
        self._place: Place | None = None
        self._before = self._done_bytes = self._length = 0
        self._wrapped = self._twice = False
        self._escapes = Escapes()
        self._rests: list[str] = []  # the text after the settled place
        self._tail = ""
        self._texts: list[str] = []  # settled, as is what follows
        self._done: list[str] = []
        self._history: Callable[[], tuple[str, str]] | None = None
        self._string: _OpenString | None = None

    def _whole(self) -> None:
        """Fetches what is settled."""
        if self._history:
            text, done = self._history()
            self._texts.insert(0, text)
            self._done.insert(0, done)
            self._history = None
        self._texts, self._done = ["".join(self._texts)], ["".join(self._done)]

    def _rendered(self, place: Place | None, before: int, twice: bool, escapes: Escapes, rest: str) -> tuple[str, int, Renderer | None]:
        """The output after the settled place, how many values there are at the top, and the renderer (None: there was no going on)."""
        final = not (twice and escapes.waiting)  # else the last backslash is part of an escape to come
        r = Renderer(unescaped(rest) if twice else rest, self.options, final)
        try:
            out, values = r.resumed(place) if place else r.values_at_top()
        except Fault as f:
            where = origin(rest, f.at) if twice else bytes_before(rest, f.at)
            raise JsonTextError(f.kind, 0 if f.kind == "NoValueFound" else before + where, f.char) from None
        return (out, values, r) if out is not None and r.deepest <= _DEEPEST else ("", 0, None)

    def push(self, chunk: str, whole: bool = True) -> dict:
        """accepted, output, and the change: keep so many bytes of the output before, then append text.

        Without ``whole`` the output is left out, and the time that this takes with it.
        """
        if self._string and _WITHIN.match(chunk):
            return self._within_string(chunk, whole)
        self._close_string()
        escapes = self._escapes.then(chunk)
        twice = self._unquoted and escapes.twice
        rest, again, r = "".join(self._rests) + chunk, twice != self._twice, None
        try:
            if not again:
                tail, values, r = self._rendered(self._place, self._before, twice, escapes, rest)
                again = r is None and self._place is not None
            if again:  # from the start
                self._whole()
                rest = self._texts[0] + rest
                tail, values, r = self._rendered(None, 0, twice, escapes, rest)
            if r is None:  # as a whole, without places to go on from
                tail, values = render(rest, self.options), 1
        except JsonTextError as e:
            return {"accepted": False, "output": self.output if whole else None, "keep": self.output_bytes, "text": "", "error_kind": e.kind, "error_position": e.position}
        wrapped = values > 1
        if again or wrapped != self._wrapped:
            old, kept = self.output, 0
            new = "[" * wrapped + (tail if again else self._done[0] + tail) + "]" * wrapped
        else:
            old, new, kept = self._tail + "]" * wrapped, tail + "]" * wrapped, wrapped + self._done_bytes
        if again:
            self._texts, self._done, self._place, self._before, self._done_bytes = [], [], None, 0, 0
        n = _shared(old, new)
        self._escapes, self._twice, self._wrapped, self._length = escapes, twice, wrapped, self._length + _bytes(chunk)
        self._accept(rest, tail, r)
        return {"accepted": True, "output": self.output if whole else None, "keep": kept + _bytes(old[:n]), "text": new[n:], "error_kind": None, "error_position": None}

    def _accept(self, rest: str, tail: str, r: Renderer | None) -> None:
        """Moves on to the last place that ``r`` settled."""
        done = 0
        if r is not None and r.settled:
            self._place, where, pieces = r.settled
            if self._twice:
                where = place_before_escapes(rest, where)
            done = sum(map(len, r.out[:pieces]))
            text, out = rest[:where], tail[:done]
            self._texts.append(text)
            self._done.append(out)
            self._before += _bytes(text)
            self._done_bytes += _bytes(out)
            rest, tail = rest[where:], tail[done:]
        self._rests, self._tail = [rest], tail
        if r is not None and r.unfinished and not self._escapes.waiting and "\\" not in rest[-6:]:
            end = sum(map(len, r.out[r.unfinished :])) + 1  # the closing quote and what comes after the string
            content = tail[: len(tail) - end]
            self._string = _OpenString(content, tail[len(tail) - end :], quoted(rest[len(rest.rstrip(SPACE)) :])[1:-1], self._done_bytes + self._wrapped + _bytes(content))

    def _within_string(self, chunk: str, whole: bool) -> dict:
        """A chunk that can but go on with the string in which the text ends, which needs no reading again."""
        s = self._string
        self._rests.append(chunk)
        self._length += _bytes(chunk)
        plain = chunk.rstrip(" ")
        more = s.blanks + plain if plain else ""
        keep, end = s.bytes, s.end + "]" * self._wrapped
        s.blanks = chunk[len(plain) :] if plain else s.blanks + chunk
        if more:
            s.parts.append(more)
            s.bytes += _bytes(more)
            text = more + end
        else:
            keep, text = keep + _bytes(end), ""
        return {"accepted": True, "output": self.output if whole else None, "keep": keep, "text": text, "error_kind": None, "error_position": None}

    def _close_string(self) -> None:
        if self._string:
            self._tail, self._string = "".join(self._string.parts) + self._string.end, None

    def value(self) -> str | None:
        """The canonical text so far, None before anything was accepted."""
        return self.output or None

    @property
    def checkpoint(self) -> Checkpoint:
        return Checkpoint(self._place, self._before, self._done_bytes, self._length, self._wrapped, self._twice, self._escapes)

    @property
    def rest(self) -> str:
        """The accepted text after the settled place."""
        self._rests = ["".join(self._rests)]
        return self._rests[0]

    @property
    def _unsettled(self) -> str:
        """The output after the settled place."""
        if self._string:
            s = self._string
            s.parts = ["".join(s.parts)]
            return s.parts[0] + s.end
        return self._tail

    @property
    def output(self) -> str:
        self._whole()
        return "[" * self._wrapped + self._done[0] + self._unsettled + "]" * self._wrapped

    @property
    def output_bytes(self) -> int:
        if self._string:
            return self._string.bytes + _bytes(self._string.end) + self._wrapped
        return self._done_bytes + _bytes(self._tail) + 2 * self._wrapped

    @property
    def input(self) -> str:
        self._whole()
        return self._texts[0] + self.rest

    @property
    def text(self) -> str:
        return self.input

    def __len__(self) -> int:
        """Bytes of the accepted text."""
        return self._length

    def is_empty(self) -> bool:
        return not self._length
