"""Tokens of a damaged document, read on demand by compiled patterns.

A token is (kind, text, cut, start, after_newline). Kinds: a punctuator itself, ``.`` for an ellipsis, ``s``
string, ``n`` number, ``b`` true or false, ``z`` null, ``u`` undefined, ``w`` bare word. cut: the text ends
where the document does (or where a missing quote was supposed). Places are code points. ``Scanner.open`` tells whether anything read so
far would have been read otherwise if the document went on.
"""

from __future__ import annotations

from ..options import KEEP, PASS
from . import classes as c

PUNCTUATORS = frozenset("{}[]:,;+()")
WORDS = {"true": ("b", "true"), "false": ("b", "false"), "null": ("z", "null")}
FOREIGN_WORDS = {"True": ("b", "true"), "False": ("b", "false"), "None": ("z", "null"), "undefined": ("u", "null")}


#: What neither is nor begins blanks, a comment or a fence.
_NO_TRIVIA = frozenset("\"'}],:;+()-.0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")


class Fault(Exception):
    """An error at a place (code points)."""

    def __init__(self, kind: str, at: int, char: str | None = None):
        super().__init__(kind, at, char)
        self.kind, self.at, self.char = kind, at, char


class Scanner:
    def __init__(self, text: str, allow: int, repairs: int):
        self.text, self.at, self.end = text, 0, len(text)
        self.allow, self.repairs = allow, repairs = int(allow), int(repairs)
        self.strict = repairs & PASS.ALL == 0
        self.blanks = c.ALL_BLANKS if repairs & PASS.WHITESPACE else c.BLANKS
        self.line_blanks = c.ALL_LINE_BLANKS if repairs & PASS.WHITESPACE else c.LINE_BLANKS
        self.comments, self.fences = repairs & PASS.COMMENTS, repairs & PASS.FENCES
        #: where only white space is left
        self.last = len(text.rstrip(c.SPACE))
        #: a decision has depended on where the text ends
        self.open = False
        #: the text ends within a string in which nothing has to be told yet
        self.within = False

    # -- between tokens

    def _trivia(self, at: int) -> tuple[int, bool]:
        """Where the next token starts, and whether a line ends before it."""
        text, newline = self.text, False
        if at < self.end and text[at] in _NO_TRIVIA:
            return at, False
        while True:
            start = at
            at = self.blanks.match(text, at).end()
            if at > start and "\n" in text[start:at]:
                newline = True
            head = text[at : at + 1]
            if head == "/" and self.comments:
                m = c.COMMENT.match(text, at)
                if m:
                    newline = newline or "\n" in m[0]
                    at = m.end()
                    head = text[at : at + 1]
            if self.fences and head and head in "`[{":
                m = c.FENCE.match(text, at)
                if m:
                    at = m.end()
                elif self.end - at < 4 and not text[at + 1 :].strip("`"):
                    self.open = True  # may become a fence
            if at == start:
                self._reached(at + (head == "/"))
                return at, newline

    def ahead(self) -> str:
        """The character of the next token ('' at the end), without reading the token."""
        at, _ = self._trivia(self.at)
        return self.text[at : at + 1]

    # -- tokens

    def token(self, key: bool, inside: bool) -> tuple | None:
        """The next token; key: a bare word ends at a colon; inside: within a container."""
        self.at, newline = self._trivia(self.at)
        start = self.at
        if start >= self.end:
            return None
        head = self.text[start]
        if head in PUNCTUATORS:
            self.at += 1
            return head, head, False, start, newline
        kind, text, cut = self._scan(head, start, key, inside)
        return kind, text, cut, start, newline

    def _scan(self, head: str, start: int, key: bool, inside: bool) -> tuple[str, str, bool]:
        text, unquoted = self.text, self.repairs & PASS.UNQUOTED
        if head == '"':
            return self._string(head, start + 1, False, inside)
        if head in c.QUOTES:
            if not self.repairs & PASS.QUOTES:
                raise Fault("UnexpectedCharacter", start, head)
            return self._string(head, start + 1, False, inside)
        if head == "." and text.startswith("...", start):
            self.at = self.blanks.match(text, start + 3).end()
            self._reached(self.at)
            if text.startswith(",", self.at):
                self.at += 1
            return ".", "...", False
        if head in "-.0123456789":
            return self._number(start) or self._word(start, key)
        if head in "/\\":
            self._reached(start + 1)
        if head == "/":
            if text.startswith(("//", "/*"), start) or not unquoted:
                raise Fault("UnexpectedCharacter", start, "/")
            m = c.REGEX.match(text, start)
            self.at = m.end()
            self._reached(self.at)
            return "s", m[0], self.at >= self.end
        if head == "\\" and unquoted and text[start + 1 : start + 2] in c.QUOTES and start + 1 < self.end:
            return self._string(text[start + 1], start + 2, False, inside)
        if head == "&" and self.repairs & PASS.ENTITIES:
            found = self._entity(start)
            if found and found[0] in c.QUOTES:
                return self._string(found[0], found[1], True, inside)
        return self._word(start, key)

    def _reached(self, at: int) -> None:
        """What stands at ``at`` decides."""
        if at >= self.end:
            self.open = True

    def _entity(self, at: int) -> tuple[str, int] | None:
        found = c.entity_at(self.text, at)
        if not found:
            self._reached(c.ENTITY_RUN.match(self.text, at).end())
        return found

    def _number(self, start: int) -> tuple[str, str, bool] | None:
        """A number, respelled if need be; a string if it has leading zeros; None if it is a word."""
        m = c.SOUND_NUMBER.match(self.text, start)
        if m:
            self.at = m.end()
            self._reached(self.at)
            return "n", m[0], False
        m = c.NUMBER.match(self.text, start)
        raw, (sign, whole, point, mark, plus, power) = m[0], m.groups()
        end = m.end()
        self._reached(end)
        if not raw or not (end >= self.end or self.text[end] in c.AFTER_QUOTE or self.text[end] in c.SPACE):
            return None
        at_end, cut, number = end >= self.end, False, sign + whole
        if raw == "-":
            number, cut = "-0", at_end
        if point is not None:
            number = number if whole else sign + "0"
            number += point
            if point == ".":
                number += "0"
                cut = at_end
        wrong = len(whole) > 1 and whole[0] == "0"
        if mark is not None:
            wrong = wrong or number == "-"
            number += mark + plus + power
            if not power:
                number += "0"
                cut = at_end
        if wrong:
            if self.strict:
                raise Fault("UnexpectedCharacter", start, "0")
            self.at = end
            return "s", raw, False
        if number != raw and not self.repairs & PASS.NUMBERS:
            raise Fault("UnexpectedCharacter", start, ".")
        self.at = end
        return "n", number, cut

    def _word(self, start: int, key: bool) -> tuple[str, str, bool]:
        text = self.text
        end = (c.KEY_WORD if key else c.WORD).match(text, start).end()
        self._reached(end)
        end = start + len(text[start:end].rstrip(c.SPACE))
        end = max(end, start + 1)  # an odd character is a word, so that reading goes on
        if text[end - 1] == ":" and self.end - end < 2:
            self.open = True
        if text[end - 1] == ":" and text.startswith("//", end):
            at = end - 1
            while at > start and text[at - 1] not in c.SPACE:
                at -= 1
            if text[at:end] in c.SCHEMES:
                end = c.URL.match(text, end).end()
                self._reached(end)
        word, cut = text[start:end], end >= self.last
        if cut:
            self.open = True
        # in abc" the quote closes a string that was never opened
        self.at = end + 1 if text.startswith('"', end) else end
        known = WORDS.get(word) or (FOREIGN_WORDS.get(word) if self.repairs & PASS.KEYWORDS else None)
        if known:
            return *known, False
        if cut and not key and self.repairs & PASS.TRUNCATION:
            for whole, kind, flag in (("true", "b", KEEP.BOOL), ("false", "b", KEEP.BOOL), ("null", "z", KEEP.NULL)):
                if self.allow & flag and whole.startswith(word):
                    return kind, whole, False
        return "w", word, cut

    # -- strings

    def _string(self, quote: str, start: int, entity: bool, inside: bool) -> tuple[str, str, bool]:
        """A string whose content starts at ``start``.

        Reads under one supposition after the other: that it is closed properly; that it ends at a certain
        comma; that it ends at the first delimiter. Each try may find that it must be read otherwise.
        """
        ends, cutting, comma = c.closers(quote), False, -1
        while True:
            found = self._attempt(ends, start, entity, inside, cutting, comma)
            if len(found) == 2:
                cutting, comma = found
                continue
            text, self.at, cut = found
            return "s", text.rstrip(c.SPACE) if cut else text, cut

    def _attempt(self, ends: str, start: int, entity: bool, inside: bool, cutting: bool, comma: int) -> tuple:
        """(text, end, cut), or (cutting, comma) for another try."""
        text, end = self.text, self.end
        plain = (c.PLAIN_CUT if cutting else c.PLAIN_ENTITY if entity else c.PLAIN)[ends]
        parts: list[str] = []
        at, decoded, delimiter_last = start, False, False
        while True:
            stop = plain.match(text, at).end()
            if at <= comma <= stop:
                stop = comma
            if stop > at:
                parts.append(text[at:stop])
                delimiter_last = text[stop - 1] in c.AFTER_QUOTE
                at = stop
            if at >= end:
                settled, self.open = not self.open, True
                if delimiter_last and not cutting:
                    return True, comma
                self.within = settled and not cutting and comma < 0 and not entity
                return "".join(parts), at, True
            if at == comma:
                return "".join(parts), at, True
            head = text[at]
            if head == "&" and entity:
                found = self._entity(at)
                if found:
                    if found[0] in ends:
                        return "".join(parts), found[1], False
                    parts.append(found[0])
                    at, decoded, delimiter_last = found[1], True, found[0] in c.AFTER_QUOTE
                    continue
            if head == "\\":
                decoded = True
                at += 1
                if at == comma:
                    return "".join(parts), at, True
                piece, at = self._escape(at)
                if piece is None:
                    return "".join(parts), end, True
                parts.append(piece)
                delimiter_last = False
                continue
            if head in ends:
                at += 1
                if cutting:
                    return "".join(parts), at, True
                if self._closes(at, parts, inside, True):
                    return "".join(parts), at, False
                if not text.startswith("\\", at):
                    before = at - 2
                    while before >= 0 and text[before] in c.SPACE:
                        before -= 1
                    mark = text[before] if before >= 0 else ""
                    if mark in c.AFTER_QUOTE and mark and not self._escaped(before):
                        if mark == ",":
                            if comma != before:
                                return cutting, before
                        else:
                            return True, comma
                # part of the content; once something has been decoded, in its plain spelling
                parts.append('"' if decoded else head)
                delimiter_last = False
                continue
            if cutting and head in c.CUT_AT:
                if head == "/" and "".join(parts) in c.SCHEMES:
                    stop = c.URL.match(text, at).end()
                    self._reached(stop)
                    parts.append(text[at:stop])
                    delimiter_last = text[stop - 1] in c.AFTER_QUOTE
                    at = stop
                    continue
                return "".join(parts), at, True
            parts.append(head)
            at += 1
            delimiter_last = head in c.AFTER_QUOTE

    def _escaped(self, at: int) -> bool:
        n = at
        while n > 0 and self.text[n - 1] == "\\":
            n -= 1
        return (at - n) % 2 == 1

    def _closes(self, at: int, parts: list[str], inside: bool, outer: bool) -> bool:
        """Whether what follows at ``at`` lets the quote before it be a closing one."""
        text = self.text
        while True:
            start = at
            at = self.line_blanks.match(text, at).end()
            if self.comments and text.startswith("/", at):
                m = c.COMMENT.match(text, at)
                at = m.end() if m else at
                if not m:
                    self._reached(at + 1)
            if at == start:
                break
        if at >= self.end:
            self.open = True
            return True
        head = text[at]
        if head in c.AFTER_QUOTE:
            if inside or head not in ")]}":
                return True
            opener, content = {")": "(", "]": "[", "}": "{"}[head], "".join(parts)
            return content.count(opener) <= content.count(head)
        return head in c.QUOTES and outer and not self._closes(at + 1, parts, inside, False)

    def _escape(self, at: int) -> tuple[str | None, int]:
        """What the escape after a backslash stands for, and where it ends; None: the text ends in it."""
        text = self.text
        if at >= self.end:
            self.open = True
            return "", at
        head = text[at]
        if head in c.ESCAPES:
            return c.ESCAPES[head], at + 1
        at += 1
        if head in "xu":
            self._reached(at + (1 if head == "x" else 3))
        if head == "x":
            m = c.HEX2.match(text, at)
            if m:
                return chr(int(m[0], 16)), m.end()
            if self.strict:
                raise Fault("InvalidEscape", at)
            return "x", at
        if head != "u":
            return head, at
        m = c.HEX4.match(text, at)
        if m:
            code = int(m[0], 16)
            if 0xD800 <= code <= 0xDBFF:
                self._reached(m.end() + 5)
            if 0xD800 <= code <= 0xDBFF and text.startswith("\\u", m.end()):
                low = c.HEX4.match(text, m.end() + 2)
                if low and 0xDC00 <= int(low[0], 16) <= 0xDFFF:
                    return chr(0x10000 + ((code - 0xD800) << 10) + int(low[0], 16) - 0xDC00), low.end()
            return c.scalar(code), m.end()
        if self.strict:
            raise Fault("InvalidUnicodeEscape", at)
        if c.HEX_TO_END.match(text, at):
            return None, self.end
        return "u", at
