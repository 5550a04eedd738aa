"""Where JSON is in prose."""

from __future__ import annotations

import re

from . import classes as c

_BRACKET = re.compile(r"[{\[]")
_SCALAR = re.compile(f"[-+0-9{re.escape(c.DOUBLE)}{re.escape(c.SINGLE.replace('`', '').replace(chr(0xB4), ''))}]|\\.(?=[0-9])")
_SCALAR_END = re.compile(f"[,}}\\]);{re.escape(c.SPACE)}]")
_STEP = re.compile(f"[{re.escape(c.DOUBLE + c.SINGLE)}{{}}\\[\\]]|/[/*]")
_CLOSE = {q: re.compile(f"\\\\(?s:.)|[{re.escape(c.closers(q))}]") for q in c.QUOTES}


def _trim(text: str) -> str:
    return text.strip(c.UNICODE_SPACE)


def _string_end(text: str, at: int, quote: str) -> int:
    """Where a string ends whose content starts at ``at``; -1 if nowhere."""
    for m in _CLOSE[quote].finditer(text, at):
        if m[0][0] != "\\":
            return m.end()
    return -1


def _container_end(text: str, at: int) -> int:
    """Where the container at ``at`` is balanced; -1 if nowhere. Any bracket closes any other."""
    depth = 0
    while m := _STEP.search(text, at):
        head = m[0]
        at = m.end()
        if head in c.QUOTES:
            at = _string_end(text, at, head)
            if at < 0:
                return -1
        elif head[0] == "/":
            close = "\n" if head == "//" else "*/"
            end = text.find(close, at)
            at = len(text) if end < 0 else end + len(close)
        elif head in "{[":
            depth += 1
        else:
            depth -= 1
            if depth == 0:
                return at
    return -1


def _value_end(text: str, at: int) -> int:
    head = text[at]
    if head in "{[":
        return _container_end(text, at)
    if head in c.QUOTES:
        return _string_end(text, at + 1, head)
    m = _SCALAR_END.search(text, at)
    end = m.start() if m else len(text)
    return end if end > at else -1


def _first(text: str) -> int:
    m = _BRACKET.search(text) or _SCALAR.search(text)
    return m.start() if m else -1


def fenced(text: str) -> str | None:
    """The body of the first fence that says json, else of the first one with a body."""
    first, at = None, 0
    while (opened := text.find("```", at)) >= 0:
        line = text.find("\n", opened + 3)
        body = len(text) if line < 0 else line + 1
        tag = _trim(text[opened + 3 : body])
        end = text.find("```", body)
        end = len(text) if end < 0 else end
        if end > body and _trim(text[body:end]):
            if tag[:4].lower() == "json" and tag[:4].isascii():
                return text[body:end]
            if first is None:
                first = text[body:end]
        if end <= at:
            break
        at = min(end + 3, len(text))
    return first


def extract(text: str) -> str | None:
    """The JSON in a text: a fenced block, else the first bracketed value, else the first scalar."""
    body = fenced(text)
    if body is not None:
        return _trim(body)
    at = _first(text)
    end = _value_end(text, at) if at >= 0 else -1
    return _trim(text[at:end]) if end >= 0 else None


def extract_partial(text: str) -> str:
    """From the first value's start to the end of the text."""
    at = _first(text)
    return text[at:] if at >= 0 else ""


def extract_all(text: str) -> list[str]:
    """All values at the top, up to one that doesn't end; scalars only where no bracket follows."""
    found: list[str] = []
    at = 0
    m = _BRACKET.search(text)
    while at < len(text):
        if m and m.start() < at:
            m = _BRACKET.search(text, at)
        start = m or _SCALAR.search(text, at)
        if not start:
            break
        end = _value_end(text, start.start())
        if end < 0:
            break
        found.append(_trim(text[start.start() : end]))
        at = max(end, start.start() + 1)
    return found
