"""Character sets and compiled patterns (fixed values)."""

from __future__ import annotations

import re

BLANK = " \n\r\t"
ODD_BLANK = "\u00a0\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u205f\u3000\ufeff"
SPACE = BLANK + ODD_BLANK
DOUBLE = "\"\u201c\u201d\u201e\u201f"
SINGLE = "'\u2018\u2019\u201a\u201b`\u00b4"
QUOTES = frozenset(DOUBLE + SINGLE)
#: What may follow a closing quote.
AFTER_QUOTE = frozenset(",:[]/{}()\n+")
#: What ends a string whose closing quote is missing.
CUT_AT = frozenset(",[]/{}\n+")
SCHEMES = frozenset(("http:", "https:", "ftp:", "mailto:", "file:", "data:", "irc:"))
ENTITIES = {"quot": '"', "amp": "&", "lt": "<", "gt": ">", "apos": "'"}
ESCAPES = {'"': '"', "\\": "\\", "/": "/", "'": "'", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
#: White space by Unicode, which trimming of extracted spans goes by.
UNICODE_SPACE = "\t\n\x0b\x0c\r \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

URL = re.compile(r"[A-Za-z0-9\-._~:/?#@!$&'()*+;=]*")
ENTITY = re.compile(r"&(?:(quot|amp|lt|gt|apos)|#[xX](\+?[0-9A-Fa-f]+)|#(\+?[0-9]+));")
#: As much of an entity as there is.
ENTITY_RUN = re.compile(r"&#?[+0-9A-Za-z]*")
FENCE = re.compile(r"[\[{]?```[A-Za-z0-9_$]*[\]}]?")
BLANKS = re.compile(r"[ \n\r\t]*")
ALL_BLANKS = re.compile(f"[ \\n\\r\\t{ODD_BLANK}]*")
LINE_BLANKS = re.compile(r"[ \r\t]*")
ALL_LINE_BLANKS = re.compile(f"[ \\r\\t{ODD_BLANK}]*")
COMMENT = re.compile(r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)")
NUMBER = re.compile(r"(-?)([0-9]*)(\.[0-9]*)?(?:([eE])([+-]?)([0-9]*))?")
SOUND_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?=[,:\[\]/{}()\n+ \r\t]|\Z)")
_WORD = "\\n\\r\"'(),/+\\[\\]{}" + "".join(sorted(QUOTES - set("\"'`")))
WORD = re.compile(f"[^{_WORD}]*")
KEY_WORD = re.compile(f"[^{_WORD}:]*")
HEX4 = re.compile(r"[0-9A-Fa-f]{4}")
HEX2 = re.compile(r"[0-9A-Fa-f]{2}")
HEX_TO_END = re.compile(r"[0-9A-Fa-f]{0,3}\Z")
REGEX = re.compile(r"/(?:\\(?s:.)|[^\\/])*(?:/|\\?\Z)")
RAW_QUOTE = re.compile(r'(?<!\\)(?:\\\\)*"')
ESCAPED_QUOTE = re.compile(r'(?<!\\)(?:\\\\)*\\"')
ESCAPED = re.compile(r"\\(?s:(.))")


def closers(quote: str) -> str:
    """The quotes that close a string opened by ``quote``."""
    if quote in "\"'":
        return quote
    return DOUBLE if quote in DOUBLE else SINGLE


#: For each set of closers: runs of plain content; where an entity may close; where a delimiter closes, too.
_cut = re.escape("".join(sorted(CUT_AT)))
PLAIN = {c: re.compile(f"[^\\\\{re.escape(c)}]*") for c in ('"', "'", DOUBLE, SINGLE)}
PLAIN_ENTITY = {c: re.compile(f"[^\\\\&{re.escape(c)}]*") for c in PLAIN}
PLAIN_CUT = {c: re.compile(f"[^\\\\&{re.escape(c)}{_cut}]*") for c in PLAIN}


def entity_at(text: str, at: int) -> tuple[str, int] | None:
    """The character of the HTML entity at a place, and where it ends."""
    m = ENTITY.match(text, at)
    if not m:
        return None
    if m[1]:
        return ENTITIES[m[1]], m.end()
    code = int(m[2], 16) if m[2] else int(m[3])
    return None if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else (chr(code), m.end())


def scalar(code: int) -> str:
    """The character of a code; U+FFFD for what is none."""
    return "\ufffd" if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)


#: Halves of surrogate pairs, which are no characters.
LONE = re.compile("[\ud800-\udfff]")
_PLAIN_OUT = re.compile(r'[^"\\\x00-\x1f]*\Z')
_OUT = re.compile(r'["\\\x00-\x1f]')
_NAMED = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(text: str) -> str:
    """A JSON string: the least that must be escaped is escaped."""
    if _PLAIN_OUT.match(text):
        return f'"{text}"'
    return '"' + _OUT.sub(lambda m: _NAMED.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'
