"""Spark types of JSON documents: their text form read without a session, enums, and typed values as canonical text."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, ByteType, CharType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, NullType, ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType, VarcharType, VariantType,
)

from . import document, tree
from .classes import quoted

_PLAIN = {
    "boolean": BooleanType, "tinyint": ByteType, "byte": ByteType, "smallint": ShortType, "short": ShortType, "int": IntegerType, "integer": IntegerType, "bigint": LongType, "long": LongType, "float": FloatType, "real": FloatType, "double": DoubleType,
    "string": StringType, "binary": BinaryType, "date": DateType, "timestamp": TimestampType, "timestamp_ntz": TimestampNTZType, "variant": VariantType, "void": NullType,
}
_TOKEN = re.compile(r"\s*(?:([A-Za-z_][A-Za-z0-9_]*|[0-9]+|`(?:[^`]|``)+`)|('(?:[^'\\]|\\.)*')|([<>,:()]))")


class _Types:
    """A type's text, token by token."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        m = _TOKEN.match(self.text, self.at)
        return m[0].strip() if m else ""

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if not token or wanted is not None and token.lower() != wanted:
            raise ValueError(f"no type: {self.text!r} at {self.at}")
        self.at = _TOKEN.match(self.text, self.at).end()
        return token

    def accept(self, wanted: str) -> bool:
        return self.peek().lower() == wanted and bool(self.take())

    def kind(self) -> DataType:
        name = self.take().lower()
        if name == "array":
            self.take("<")
            found = ArrayType(self.kind())
            self.take(">")
            return found
        if name == "map":
            self.take("<")
            key = self.kind()
            self.take(",")
            found = MapType(key, self.kind())
            self.take(">")
            return found
        if name == "struct":
            self.take("<")
            fields: list[StructField] = []
            while self.peek() != ">":
                if fields:
                    self.take(",")
                fields.append(self.field())
            self.take(">")
            return StructType(fields)
        if name in ("decimal", "dec", "numeric", "char", "varchar"):
            numbers = []
            if self.accept("("):
                numbers.append(int(self.take()))
                if self.accept(","):
                    numbers.append(int(self.take()))
                self.take(")")
            return CharType(*numbers) if name == "char" else VarcharType(*numbers) if name == "varchar" else DecimalType(*(numbers or [10, 0]))
        if name not in _PLAIN:
            raise ValueError(f"no type: {name} in {self.text!r}")
        return _PLAIN[name]()

    def field(self) -> StructField:
        name = self.take()
        if name[0] == "`":
            name = name[1:-1].replace("``", "`")
        self.accept(":")
        kind, null, metadata = self.kind(), True, {}
        if self.accept("not"):
            self.take("null")
            null = False
        if self.accept("comment"):
            metadata["comment"] = self.take()[1:-1].replace("\\'", "'")
        return StructField(name, kind, null, metadata)


def type_of(text: str) -> DataType:
    """A Spark type from its text (as in DDL), in a worker too, where there is no session to ask."""
    reader = _Types(text)
    found = reader.kind()
    if reader.text[reader.at :].strip():
        raise ValueError(f"no type: {text!r}")
    return found


def enum_of(variants: dict[str, DataType | str | None]) -> StructType:
    """The target type of a tagged union: struct<variant, payload>, with a payload field for each variant that has one.

    A variant without content (None) comes as its name alone or with null content, others as an object of one member:
    of any type, of a struct (an object) or of a struct of fields _1, _2, ... (an array). The mark is the comment ``enum``
    on the field ``variant``, then the names of the variants without content; so DDL can say the same.
    """
    units = [name for name, kind in variants.items() if kind is None]
    payload = StructType([StructField(name, type_of(kind) if isinstance(kind, str) else kind) for name, kind in variants.items() if kind is not None])
    return StructType([StructField("variant", StringType(), True, {"comment": " ".join(["enum", ", ".join(units)]).strip()}), StructField("payload", payload)])


# -- typed values as canonical text


def plain_only(kind: DataType) -> bool:
    """Whether Catalyst alone can spell the type: no floats (their shortest text) and no variants."""
    if isinstance(kind, StructType):
        return all(plain_only(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return plain_only(kind.elementType)
    if isinstance(kind, MapType):
        return plain_only(kind.valueType)
    return not isinstance(kind, FloatType | DoubleType | VariantType)


def _f32_text(x: float) -> str:
    """The shortest text that a 32-bit float reads back from."""
    import numpy as np

    head, mark, power = str(np.float32(x)).partition("e")
    if "." not in head:
        head += "" if mark else ".0"
    return head + mark + str(int(power)) if mark else head


def spelled(value, kind: DataType, nulls: bool = False) -> str:
    """Canonical text of a value (as Arrow gives it) of a type; Mismatch for a float that JSON can't spell, or null if ``nulls``."""
    if value is None:
        return "null"
    if isinstance(kind, StructType):
        return "{" + ", ".join(f"{quoted(f.name)}: {spelled(value[f.name], f.dataType, nulls)}" for f in kind.fields) + "}"
    if isinstance(kind, ArrayType):
        return "[" + ", ".join(spelled(v, kind.elementType, nulls) for v in value) + "]"
    if isinstance(kind, MapType):
        return "{" + ", ".join(f"{quoted(_key(k))}: {spelled(v, kind.valueType, nulls)}" for k, v in (value.items() if isinstance(value, dict) else value)) + "}"
    if isinstance(kind, BooleanType):
        return "true" if value else "false"
    if isinstance(kind, FloatType | DoubleType):
        text = _f32_text(value) if isinstance(kind, FloatType) else tree.float_text(float(value))
        if text in ("null", "nan", "inf", "-inf") or "inf" in text or "nan" in text:
            if nulls:
                return "null"
            raise tree.Mismatch(f"number `{'NaN' if value != value else 'inf' if value > 0 else '-inf'}` is not a finite float and cannot be represented")
        return text
    if isinstance(kind, DecimalType):
        return format(Decimal(value), "f")
    if isinstance(kind, BinaryType):
        return "[" + ", ".join(map(str, bytes(value))) + "]"
    if isinstance(kind, VariantType):  # its JSON text
        return document.render(value)
    if isinstance(kind, StringType | CharType | VarcharType | DateType | TimestampType | TimestampNTZType):
        return quoted(str(value))
    return str(int(value))


def _key(k) -> str:
    return ("true" if k else "false") if isinstance(k, bool) else str(k)


def classified(node):
    """A tree with every number as the first of i64, u64 and f64 that it fits; Mismatch where that is no finite float."""
    if isinstance(node, tree.Members):
        return tree.Members([(k, classified(v)) for k, v in node])
    if isinstance(node, list):
        return [classified(v) for v in node]
    if not isinstance(node, tree.Num):
        return node
    if (n := tree.as_i64(node)) is not None or (n := tree.as_u64(node)) is not None:
        return tree.Num(n)
    text = tree.float_text(float(node))
    if text == "null":
        raise tree.Mismatch(f"number `{node}` is not a finite float and cannot be represented")
    return tree.Num(text)
