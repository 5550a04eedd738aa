"""From tokens to canonical JSON text.

One renderer serves all verbs. It appends pieces of output as values are read; a value that is dropped, or a
container that isn't kept, is taken back to the mark where it began. What is sound JSON already, whole
containers and runs of members, isn't read token by token (:mod:`.sound`).
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

from ..errors import JsonTextError
from ..options import KEEP, PASS, Options
from . import classes as c
from . import sound
from .scanner import Fault, Scanner

#: Containers and groups within each other.
DEEPEST = 256
#: A level takes four calls.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * DEEPEST + 2000))

#: What is left of a growing text is as a rule no sound container if it is shorter.
_SHORT = 64
_STARTS = frozenset("{[snbzuw(")
_NOISE = frozenset(".;+")
_KEYS = frozenset("swnbzu")
_SPACED = re.compile(f"[{c.UNICODE_SPACE}]")
_STRINGS = re.compile(r'"(?:[^"\\]|\\.)*"')


def depth_of(text: str) -> int:
    """How deep canonical JSON text nests."""
    depth = most = 0
    for ch in _STRINGS.sub("", text):
        if ch in "[{":
            depth += 1
            most = max(most, depth)
        elif ch in "]}":
            depth -= 1
    return most


class _Level:
    """An open container: whether it has no member yet, whether a comma waits for one, and after how many
    members read by token to look for sound ones again (more each time)."""

    __slots__ = ("comma", "empty", "keyed", "patience", "wait")

    def __init__(self, keyed: bool, empty: bool = True, comma: bool = False):
        self.keyed, self.empty, self.comma = keyed, empty, comma
        self.patience = self.wait = 4

    def filled(self) -> None:
        self.empty = self.comma = False


@dataclass(frozen=True)
class Place:
    """A place between members (or between values at the top) up to which a document is settled: whatever
    follows, what comes before is read and rendered the same.

    levels: for each open container ``{`` or ``[``, or with a comma waiting ``(`` or ``<``, or still empty ``}`` or ``]``, or both ``)`` or
    ``>``; values: complete ones at the top; deepest: how deep it has nested; prose: it began with words.
    """

    levels: str = ""
    values: int = 0
    deepest: int = 0
    prose: bool = False


#: How a level is written in a :class:`Place`: (keyed, empty, comma).
_LEVELS = {(True, False, False): "{", (False, False, False): "[", (True, False, True): "(", (False, False, True): "<", (True, True, False): "}", (False, True, False): "]", (True, True, True): ")", (False, True, True): ">"}
_OF_LEVEL = {v: k for k, v in _LEVELS.items()}


class Renderer:
    def __init__(self, text: str, options: Options, settling: bool = False):
        self.scanner = Scanner(text, options.allow, options.repairs)
        self.allow, self.repairs, self.strict = self.scanner.allow, self.scanner.repairs, self.scanner.strict
        self.out: list[str] = []
        self.next: tuple | None = None  # a token read ahead
        self.ended = False
        self.depth = self.deepest = 0
        self.values = 0  # at the top
        self.levels: list[_Level] = []
        self.groups, self.prose = 0, False
        #: with ``settling``, the last settled place, where it is in the text and how many pieces of the output come before it
        self.settling, self.settled = settling, None
        #: after how many pieces of the output the text ended in the middle of a string, read as one that will be closed (0: it didn't)
        self.unfinished = 0

    # -- tokens

    def peek(self, key: bool = False) -> str:
        """The kind of the next token, '' at the end."""
        if self.next is None:
            self.next = self.scanner.token(key, self.depth > 0)
        return "" if self.next is None else self.next[0]

    def take(self) -> tuple:
        token, self.next = self.next, None
        return token

    @property
    def place(self) -> int:
        return self.scanner.at if self.next is None else self.next[3]

    def fault(self, kind: str, at: int | None = None, char: str | None = None) -> Fault:
        return Fault(kind, self.place if at is None else at, char)

    def _unless_strict(self, kind: str) -> None:
        """Takes a punctuator that doesn't belong here."""
        if self.strict:
            raise self.fault("UnexpectedCharacter", char=kind)
        self.take()

    def _kept(self, cut: bool, at: int) -> bool:
        """Whether a string that may be cut off counts."""
        if cut and not self.repairs & PASS.TRUNCATION:
            raise Fault("UnexpectedEnd", at)
        return not cut or bool(self.allow & KEEP.STR)

    # -- the whole document

    def document(self) -> str:
        text, values = self.values_at_top()
        if values > 1:
            text = f"[{text}]"
        if self.deepest + 1 > DEEPEST and depth_of(text) > DEEPEST:
            raise Fault("DepthLimitExceeded", self.scanner.end)
        return text

    def values_at_top(self) -> tuple[str, int]:
        """All values, not yet wrapped as a list, and how many there are."""
        first = self.peek()
        self.prose = first == "w" and bool(_SPACED.search(self.next[1]))
        if not self.value():
            raise Fault("NoValueFound", 0)
        self.values = 1
        return self._rest(), self.values

    def _rest(self) -> str:
        """The values after those there are; all of them that this renderer has seen, unwrapped."""
        self._settle()
        while self._another(self.prose):
            mark = len(self.out)
            if self.values == 1 and self.deepest >= DEEPEST - 1 and depth_of("".join(self.out)) >= DEEPEST:
                raise self.fault("DepthLimitExceeded")
            self.out.append(", ")
            if not self.value():
                self._back_to(mark)
                break
            self.values += 1
            self._settle()
        return "".join(self.out)

    def resumed(self, place: Place) -> tuple[str | None, int]:
        """What follows a settled place, for the text after it, and how many values there are in all at the top.

        None if a container that is open there is dropped.
        """
        self.values, self.prose = place.values, place.prose
        self.levels = [_Level(*_OF_LEVEL[x]) for x in place.levels]
        self.depth, self.deepest = len(self.levels), place.deepest
        for level in reversed(self.levels[:]):
            if not self._members(level):
                if not self.repairs & PASS.TRUNCATION:
                    raise self.fault("UnexpectedEnd")
                if not self.allow & (KEEP.OBJ if level.keyed else KEEP.ARR):
                    return None, 0
            self.out.append("}" if level.keyed else "]")
            self.levels.pop()
            self.depth -= 1
        self.values += bool(place.levels)
        return self._rest(), self.values

    def _settle(self) -> None:
        """Notes this place as settled if no decision so far has depended on where the text ends."""
        if self.settling and self.next is None and not self.scanner.open and not self.groups:
            around = ["{" if x.keyed else "[" for x in self.levels[:-1]]  # whose member this container is
            inner = [_LEVELS[x.keyed, x.empty, x.comma] for x in self.levels[-1:]]
            self.settled = Place("".join(around + inner), self.values, self.deepest, self.prose), self.scanner.at, len(self.out)

    def _back_to(self, mark: int) -> None:
        """Takes the output back; what was settled within it isn't."""
        del self.out[mark:]
        if self.settled and self.settled[2] > mark:
            self.settled = None
        self.unfinished = 0

    def _another(self, prose: bool) -> bool:
        """Passes what stands between values at the top; whether one follows."""
        comma = False
        while (kind := self.peek()) and kind not in _STARTS:
            if kind != ",":
                self._unless_strict(kind)
                continue
            self.take()
            if comma and self.strict:
                raise self.fault("TrailingComma")
            comma = True
        if not kind:
            if comma and self.strict:
                raise self.fault("TrailingComma")
            return False
        if not (comma or self.next[4]) or prose or not self.repairs & PASS.NDJSON:
            raise self.fault("TrailingValue")
        return True

    # -- values

    def value(self) -> bool:
        """Renders the next value; False (and nothing rendered) if there is none or it is dropped."""
        while (kind := self.peek()) in _NOISE and kind:
            self._unless_strict(kind)
        if kind in ("{", "["):
            return self.container(kind)
        if kind == "(":
            return self.group()
        if kind == "s":
            return self.string()
        if kind == "w":
            return self.word()
        if kind in ("n", "b", "z", "u"):
            _, text, cut, _, _ = self.take()
            if cut and not self.allow & KEEP.NUM:
                return False
            self.out.append(text)
            return True
        return False

    def string(self) -> bool:
        _, text, cut, start, _ = self.take()
        if not self._kept(cut, start):
            return False
        # only a plus may be read ahead here: the token after it could be a key
        while (self.next or self.scanner.ahead() == "+") and self.peek() == "+":
            if not self.repairs & PASS.CONCATENATION:
                raise self.fault("UnexpectedCharacter", char="+")
            head = self.scanner.ahead()
            if not head or (head not in c.QUOTES and head not in "&\\"):
                break
            self.take()
            if self.peek() != "s":
                break
            _, more, cut, start, _ = self.take()
            if not self._kept(cut, start):
                return False
            text += more
        self.out.append(c.quoted(text))
        if cut and self.scanner.within:
            self.unfinished = len(self.out)
        return True

    def word(self) -> bool:
        _, text, cut, start, _ = self.take()
        if (self.next or self.scanner.ahead() == "(") and self.peek() == "(":
            if not self.repairs & PASS.CALLS:
                raise Fault("UnexpectedCharacter", start, "(")
            return self.group()
        if not self.repairs & PASS.UNQUOTED:
            raise Fault("UnquotedValue", start)
        if not self._kept(cut, start):
            return False
        self.out.append(c.quoted(text))
        return True

    def _deeper(self) -> None:
        if self.depth + (self.values >= 1) >= DEEPEST:
            raise self.fault("DepthLimitExceeded")
        self.depth += 1
        self.deepest = max(self.deepest, self.depth)

    def group(self) -> bool:
        """What is in parentheses."""
        self._deeper()
        if self.strict:
            raise self.fault("UnexpectedCharacter", char="(")
        self.take()
        self.groups += 1
        found = self.value()
        while True:
            kind = self.peek()
            if kind == ";" or kind == ")":
                self.take()
                if kind == ")":
                    break
            elif kind in _STARTS and kind and not found:
                found = self.value()
            else:
                break
        self.depth -= 1
        self.groups -= 1
        return found

    def container(self, opener: str) -> bool:
        mark, level, keyed = len(self.out), _Level(opener == "{"), opener == "{"
        self._deeper()
        start = self.take()[3]
        self.out.append(opener)
        self.levels.append(level)
        closed = self._sound(level, self.scanner.text, start) or self._members(level)
        self.levels.pop()
        kept = True
        if not closed:
            if not self.repairs & PASS.TRUNCATION:
                raise self.fault("UnexpectedEnd")
            kept = bool(self.allow & (KEEP.OBJ if keyed else KEEP.ARR))
        if kept:
            self.out.append("}" if keyed else "]")
        else:
            self._back_to(mark)
        self.depth -= 1
        return kept

    def _sound(self, level: _Level, text: str, start: int, skipped: int = 0) -> bool:
        """Takes the sound members after the opener at ``start``; whether they end with the closer.

        skipped: how many characters of the document aren't in ``text`` (but for an opener put before the rest).
        """
        if self.settling and len(text) - start < _SHORT:
            return False
        found = sound.ahead(text, start)
        if not found:
            return False
        stop, closed, piece, deep = found
        if self.depth + deep + (self.values >= 1) > DEEPEST:
            return False  # for the error's place
        if piece:
            if not level.empty:
                self.out.append(", ")
            self.out.append(piece)
            level.filled()
        self.deepest = max(self.deepest, self.depth + deep)
        self.scanner.at, self.next = stop + skipped, None
        return closed

    def _resumed(self, level: _Level, keyed: bool) -> bool | None:
        """After some members read by token, again the sound ones; None if there are none."""
        at = self.next[3]
        text = ("{" if keyed else "[") + self.scanner.text[at:]
        if len(text) < 64:
            level.wait = 1 << 60
            return None
        before = self.scanner.at, self.next
        size = len(self.out)
        closed = self._sound(level, text, 0, at - 1)
        if len(self.out) > size or closed:
            level.wait = level.patience
            return closed
        self.scanner.at, self.next = before
        level.patience *= 2
        level.wait = level.patience
        return None

    def _members(self, level: _Level) -> bool:
        """Renders members until the closer (True) or until no more can be had (False)."""
        keyed, scanner = level.keyed, self.scanner
        own = "}" if keyed else "]"
        while True:
            if scanner.at >= scanner.end and self.next is None:
                scanner.open = True
                return False
            if self.settling and not scanner.open:
                self._settle()
            kind = self.peek(keyed)
            if not kind:
                return False
            if kind in "}]":
                if self.strict and (kind != own or level.comma):
                    raise self.fault("UnexpectedCharacter", char=kind) if kind != own else self.fault("TrailingComma")
                self.take()
                return True
            if kind == ",":
                self.take()
                if self.strict and (level.empty or level.comma):
                    raise self.fault("TrailingComma")
                level.comma = True
            elif kind in ";.:+":
                self._unless_strict(kind)
            else:
                if self.strict and not level.empty and not level.comma:
                    raise self.fault("ExpectedComma")
                level.wait -= 1
                if level.wait < 0 and (resumed := self._resumed(level, keyed)) is not None:
                    if resumed:
                        return True
                    continue
                if not (self._member(level, kind) if keyed else self._item(level, None)):
                    return False

    def _item(self, level: _Level, key: str | None) -> bool:
        mark = len(self.out)
        if not level.empty:
            self.out.append(", ")
        if key is not None:
            self.out.append(c.quoted(key) + ": ")
        if not self.value():
            self._back_to(mark)
            return False
        level.filled()
        return True

    def _null(self, level: _Level, key: str) -> None:
        """A member whose value is missing."""
        self.out.append(("" if level.empty else ", ") + c.quoted(key) + ": null")
        level.filled()

    def _member(self, level: _Level, kind: str) -> bool:
        """A key and its value; False ends the object without its closer."""
        if kind in "{[":
            return False
        if kind not in _KEYS:
            if self.strict:
                raise self.fault("ExpectedObjectKey")
            self.take()
            return True
        _, key, cut, start, _ = self.take()
        if kind == "w" and not self.repairs & PASS.UNQUOTED:
            raise Fault("UnquotedValue", start)
        if cut:
            if not self.repairs & PASS.TRUNCATION:
                raise self.fault("UnexpectedEnd")
            if not self.allow & KEEP.KEY:
                return False
        kind = self.peek()
        if kind == ":":
            self.take()
        elif kind == "":
            if self.repairs & PASS.TRUNCATION and self.allow & KEEP.KEY:
                self._null(level, key)
            return False
        elif kind in _STARTS:
            if self.strict:
                raise self.fault("ExpectedColon")
        else:
            if kind not in ",;":
                self.take()  # a closer right after a key is lost
            self._null(level, key)
            return True
        kind = self.peek()
        if kind == "":
            if self.repairs & PASS.TRUNCATION:
                self._null(level, key)
            return False
        if kind in "}],;" and not self.strict:
            self._null(level, key)
            return True
        return self._item(level, key)


def bytes_before(text: str, at: int) -> int:
    return len(text[:at].encode("utf-8", "surrogatepass"))


@dataclass(frozen=True)
class Escapes:
    """What a text's double quotes tell, chunk by chunk: whether there are escaped ones, raw ones, and whether a backslash is waiting at its end."""

    escaped: bool = False
    raw: bool = False
    waiting: bool = False

    def then(self, chunk: str) -> Escapes:
        """After one more chunk; the chunk is undone by going on with the value from before it."""
        text = "\\" * self.waiting + chunk
        escaped = self.escaped or bool('\\"' in text and c.ESCAPED_QUOTE.search(text))
        raw = self.raw or bool('"' in text and c.RAW_QUOTE.search(text))
        return Escapes(escaped, raw, (len(text) - len(text.rstrip("\\"))) % 2 == 1)

    @property
    def twice(self) -> bool:
        """Whether every double quote is escaped, so that the whole document lost its outermost string."""
        return self.escaped and not self.raw


def escaped_twice(text: str) -> bool:
    return '\\"' in text and not c.RAW_QUOTE.search(text)


def unescaped(text: str) -> str:
    """A document without the outermost escapes."""
    return c.ESCAPED.sub(lambda m: c.ESCAPES.get(m[1], m[0]), text)


def place_before_escapes(text: str, at: int) -> int:
    """The place in ``text`` that a place in its unescaped form comes from."""
    seen, last = 0, 0
    for m in c.ESCAPED.finditer(text):
        plain = m.start() - last
        if at < seen + plain:
            return last + at - seen
        seen += plain
        width = 1 if m[1] in c.ESCAPES else 2
        if at < seen + width:
            return m.start() + (at - seen if width == 2 else 0)
        seen, last = seen + width, m.end()
    return min(len(text), last + at - seen)


def origin(text: str, at: int) -> int:
    """The byte of ``text`` that a place in its unescaped form comes from."""
    return bytes_before(text, place_before_escapes(text, at))


def render(text: str, options: Options = Options()) -> str:  # noqa: B008 - frozen
    """Canonical JSON text of a damaged document; raises JsonTextError."""
    twice = bool(options.repairs & PASS.UNQUOTED) and escaped_twice(text)
    try:
        return Renderer(unescaped(text) if twice else text, options).document()
    except Fault as f:
        raise JsonTextError(f.kind, origin(text, f.at) if twice else bytes_before(text, f.at), f.char) from None


def render_bytes(data: bytes, options: Options = Options()) -> bytes:  # noqa: B008
    """The same for UTF-8 bytes."""
    try:
        text = data.decode()
    except UnicodeDecodeError as e:
        raise JsonTextError("InvalidUtf8", e.start) from None
    return render(text, options).encode()
