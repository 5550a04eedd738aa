"""Error classes, their messages, and the struct in which queries return them."""

from __future__ import annotations

#: Fixed values.
MESSAGES = {
    "UnexpectedEnd": "unexpected end of input",
    "UnexpectedCharacter": "unexpected character",
    "ExpectedObjectKey": "object key expected",
    "ExpectedColon": "colon expected",
    "NoValueFound": "no JSON value found",
    "InvalidEscape": "invalid escape sequence",
    "InvalidUnicodeEscape": "invalid unicode escape",
    "ExpectedComma": "comma expected",
    "TrailingComma": "trailing comma",
    "TrailingValue": "unexpected text around the first top-level value (try extract())",
    "UnquotedValue": "unquoted value",
    "DepthLimitExceeded": "maximum nesting depth exceeded",
    "InvalidUtf8": "input is not valid UTF-8",
}

ERROR_TYPE = "struct<kind:string,char:string,position:bigint,message:string>"


class JsonTextError(ValueError):
    """What is wrong with a document, and at which byte of it."""

    def __init__(self, kind: str, position: int, char: str | None = None):
        self.kind, self.position, self.char = kind, position, char
        super().__init__(kind, position, char)

    def __str__(self) -> str:
        text = f"{MESSAGES[self.kind]} at byte {self.position}"
        if self.char is None:
            return text
        shown = {"'": "\\'", "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}.get(self.char, self.char)
        return f"{text} ('{shown}')"

    def row(self) -> dict:
        return {"kind": self.kind, "char": self.char, "position": self.position, "message": str(self)}
