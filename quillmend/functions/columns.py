"""The verbs and the JSON accessors as column functions.

Verbs come in three flavours: ``f`` raises, ``try_f`` gives null, ``f_result`` gives struct<value, error>.
The kernel runs in Arrow-batched pandas UDFs; rows that are canonical already skip it (a null goes to
Python in their place), and what Catalyst can express stays with Catalyst. Null in, null out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, CharType, DataType, DateType, MapType, StringType, StructType, TimestampNTZType, TimestampType, VarcharType, VariantType

from ..errors import ERROR_TYPE, JsonTextError
from ..kernel import document, spans, tree, types
from ..kernel.types import enum_of
from ..options import Allow, Options, Repairs

__all__ = [
    "deserialize", "deserialize_result", "deserialize_value", "enum_of", "extract", "extract_all", "extract_partial", "fenced_block", "from_value", "from_value_result", "is_valid_json", "json_array", "json_as_bigint", "json_as_bool", "json_as_double", "json_as_number", "json_as_string", "json_as_ubigint", "json_at", "json_elements", "json_encode", "json_encode_result", "json_entries", "json_eq", "json_get", "json_index", "json_is", "json_is_empty", "json_kind", "json_len", "json_object", "json_of", "json_pointer", "json_push", "json_put", "json_quote", "json_set", "json_take", "loads", "loads_result", "loads_text", "parse", "parse_partial", "parse_result", "repair", "repair_bytes", "repair_bytes_into", "repair_bytes_result", "repair_extract", "repair_into", "repair_result", "serialize", "serialize_result", "try_deserialize", "try_json_encode", "try_loads", "try_loads_text", "try_parse", "try_parse_partial", "try_repair", "try_repair_bytes", "try_repair_extract", "try_serialize", "validate",
]

_ALL, _PASSES = int(Allow.ALL), int(Repairs.ALL)

#: Texts that are their own repair: a flat object or array, or a scalar, in canonical spelling with plain strings.
_TEXT = r'"[A-Za-z0-9 _.-]*"'
_SCALAR = rf"(?:{_TEXT}|true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?)"
# the repetitions are possessive: the JVM runs those as loops, others as a call for each round, which long arrays don't survive
_MEMBER = f"{_TEXT}: {_SCALAR}"
CANONICAL = rf"^(?:\{{(?:{_MEMBER}(?:, {_MEMBER})*+)?\}}|\[(?:{_SCALAR}(?:, {_SCALAR})*+)?\])\z"


#: Nested canonical text: its strings are blanked out, then its scalars, and then the innermost containers so many times.
NESTED_LEVELS = 6
_STRING_TEXT = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\bfnrt]|u00(?:0[0-7bef]|1[0-9a-f]))[^"\\\x00-\x1f]*+)*+"'
_SCALAR_TEXT = r"(?<![^\[\x20])(?:true|false|null|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)(?![^,\]}])"
_INNERMOST = "\\{(?:\x01: [\x01\x02](?:, \x01: [\x01\x02])*+)?\\}|\\[(?:[\x01\x02](?:, [\x01\x02])*+)?\\]"


def _is_canonical(c: Column) -> Column:
    """Whether a text is its own repair, as far as Catalyst can tell: flat, or of some levels. False means that the kernel decides.

    What can't be canonical is told by its first and last characters or once its strings are gone, so damaged texts cost a pass or two.
    """
    blank = F.regexp_replace(c, F.lit(_STRING_TEXT), F.lit("\x01"))
    left = F.regexp_replace(blank, F.lit(_SCALAR_TEXT), F.lit("\x02"))
    for _ in range(NESTED_LEVELS):
        left = F.regexp_replace(left, F.lit(_INNERMOST), F.lit("\x02"))
    framed = c.rlike(r"^[{\[](?s:.*)[}\]]\z") & ~c.rlike(r"[\x00-\x1f]")
    nested = F.when(~framed, False).when(~blank.rlike(r"^[\x01\[\]{}:, 0-9aeflnrstuE.+-]*\z"), False).otherwise(left == "\x02")
    return F.when(c.rlike(CANONICAL), True).otherwise(nested)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _mapped(function: Callable, kind: str):
    """A pandas UDF of a scalar function; nulls stay null."""

    def series(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else function(v) for v in values], index=values.index, dtype=object)

    return pandas_udf(series, kind)


def _tabled(function: Callable, fields: tuple[str, ...], kind: str):
    """A pandas UDF of a function that gives a dict; a null gives nulls."""

    def frame(values: pd.Series) -> pd.DataFrame:
        rows = [dict.fromkeys(fields) if v is None else function(v) for v in values]
        return pd.DataFrame({f: pd.Series([r[f] for r in rows], dtype=object) for f in fields})

    return pandas_udf(frame, kind)


def _attempt(function: Callable) -> Callable:
    def quiet(value):
        try:
            return function(value)
        except JsonTextError:
            return None

    return quiet


def _reported(function: Callable) -> Callable:
    def report(value):
        try:
            return {"value": function(value), "error": None}
        except JsonTextError as e:
            return {"value": None, "error": e.row()}

    return report


@lru_cache(maxsize=256)
def _verb(name: str, flavour: str, allow: int, repairs: int):
    options = Options(allow, repairs)

    def whole(text: str) -> str:
        return document.render(text, options)

    def from_bytes(data: bytes) -> bytes:
        return document.render_bytes(bytes(data), options)

    def found(text: str) -> str:
        span = spans.extract(text)
        if span is not None:
            try:
                return document.render(span, options)
            except JsonTextError:
                pass
        return document.render(text, options)

    function, kind = {"repair": (whole, "string"), "repair_bytes": (from_bytes, "binary"), "repair_extract": (found, "string")}[name]
    if flavour == "result":
        return _tabled(_reported(function), ("value", "error"), f"struct<value:{kind},error:{ERROR_TYPE}>")
    if flavour == "empty":
        quiet = _attempt(function)
        return _mapped(lambda text: quiet(text) or "", kind)
    return _mapped(_attempt(function) if flavour == "try" else function, kind)


def _fast(c: Column, udf) -> Column:
    """Canonical rows as they are, the others through the kernel; ``udf`` gives a text for every text, an empty one where it fails."""
    return F.coalesce(udf(F.when(~_is_canonical(c), c)), c)


def repair(c: Column | str, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    """Canonical valid JSON of a damaged document; an error ends the query."""
    c = _col(c)
    return _fast(c, _verb("repair", "raise", int(allow), int(repairs)))


def try_repair(c: Column | str, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    c = _col(c)
    return F.nullif(_fast(c, _verb("repair", "empty", int(allow), int(repairs))), F.lit(""))


def repair_result(c: Column | str, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    return _verb("repair", "result", int(allow), int(repairs))(_col(c))


def repair_into(prefix: Column | str, c: Column | str, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    """``prefix`` with the repaired document after it, or alone where that fails."""
    prefix = _col(prefix)
    return F.coalesce(F.concat(prefix, try_repair(c, allow, repairs)), prefix)


def repair_bytes(c: Column | str, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    return _verb("repair_bytes", "raise", int(allow), int(repairs))(_col(c))


def try_repair_bytes(c: Column | str, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    return _verb("repair_bytes", "try", int(allow), int(repairs))(_col(c))


def repair_bytes_result(c: Column | str, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    return _verb("repair_bytes", "result", int(allow), int(repairs))(_col(c))


def repair_bytes_into(prefix: Column | str, c: Column | str, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    """``prefix`` (binary) with the repaired bytes after it, or alone where that fails."""
    prefix = _col(prefix)
    return F.coalesce(F.concat(prefix, try_repair_bytes(c, allow, repairs)), prefix)


def repair_extract(c: Column | str) -> Column:
    """The JSON found in a text, repaired; the repaired whole text if that fails."""
    return _verb("repair_extract", "raise", _ALL, _PASSES)(_col(c))


def try_repair_extract(c: Column | str) -> Column:
    return _verb("repair_extract", "try", _ALL, _PASSES)(_col(c))


#: A tree is its canonical text, so parsing is repairing.
parse, try_parse, parse_result = repair, try_repair, repair_result


def parse_partial(c: Column | str, allow: int, repairs: int = _PASSES) -> Column:
    """As parse, for a document that is cut off; ``allow`` says which cut-off values are kept."""
    return _verb("repair", "raise", int(allow), int(repairs))(_col(c))


def try_parse_partial(c: Column | str, allow: int, repairs: int = _PASSES) -> Column:
    return _verb("repair", "try", int(allow), int(repairs))(_col(c))


def validate(c: Column | str) -> Column:
    """struct<ok, value, error> under strict rules."""
    r = _verb("repair", "result", _ALL, 0)(_col(c))
    return F.when(_col(c).isNotNull(), F.struct(r["error"].isNull().alias("ok"), r["value"].alias("value"), r["error"].alias("error")))


def is_valid_json(c: Column | str) -> Column:
    return F.when(_col(c).isNotNull(), _verb("repair", "try", _ALL, 0)(_col(c)).isNotNull())


# -- spans


@lru_cache
def _span(name: str):
    return _mapped(getattr(spans, name), {"extract": "string", "extract_partial": "string", "extract_all": "array<string>"}[name])


def extract(c: Column | str) -> Column:
    """The JSON in a text as it stands there, or null."""
    return _span("extract")(_col(c))


def extract_partial(c: Column | str) -> Column:
    return _span("extract_partial")(_col(c))


def extract_all(c: Column | str) -> Column:
    """All top-level values as an array; explode it, or use the table function json_spans in SQL."""
    return _span("extract_all")(_col(c))


def fenced_block(c: Column | str) -> Column:
    """The body of the first fence that says json, else of the first with a body, trimmed; by Catalyst alone."""
    pattern = F.lit(r"```([^\n]*)(?:\n|\z)((?s:.*?))(?:```|\z)")
    tags, bodies = F.regexp_extract_all(_col(c), pattern, F.lit(1)), F.regexp_extract_all(_col(c), pattern, F.lit(2))
    both = F.filter(F.arrays_zip(tags.alias("t"), bodies.alias("b")), lambda x: ~x["b"].rlike(r"^\p{IsWhite_Space}*\z"))
    named = F.filter(both, lambda x: F.lower(F.substring(F.regexp_replace(x["t"], r"^\p{IsWhite_Space}+", ""), 1, 4)) == "json")
    body = F.coalesce(F.try_element_at(named, F.lit(1))["b"], F.try_element_at(both, F.lit(1))["b"])
    return F.regexp_replace(body, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


# -- values (their columns hold canonical text)


def _reading(function: Callable) -> Callable:
    def read(text: str):
        try:
            node = tree.read(text)
        except (ValueError, RecursionError):
            return None
        return function(node)

    return read


def _text(node) -> str | None:
    return None if node is tree.MISSING else tree.write(node)


@lru_cache(maxsize=256)
def _looked_up(verb: str, *args):
    functions = {
        "get": lambda n: _text(tree.get(n, *args)),
        "index": lambda n: _text(tree.index(n, *args)),
        "pointer": lambda n: _text(tree.pointer(n, *args)),
        "string": lambda n: str(n) if tree.kind(n) == "string" else None,
        "bool": lambda n: n if isinstance(n, bool) else None,
        "number": lambda n: str(n) if isinstance(n, tree.Num) else None,
        "double": tree.as_f64,
        "bigint": tree.as_i64,
        "elements": lambda n: [tree.write(v) for v in n] if tree.kind(n) == "array" else None,
        "entries": lambda n: [{"key": k, "value": tree.write(v)} for k, v in n] if isinstance(n, tree.Members) else None,
        "len": lambda n: len(n) if isinstance(n, list) else 0,
        "eq": lambda n: tree.equal(n, *args),
    }
    kinds = {"bool": "boolean", "double": "double", "bigint": "bigint", "elements": "array<string>", "entries": "array<struct<key:string,value:string>>", "len": "int", "eq": "boolean"}
    return _mapped(_reading(functions[verb]), kinds.get(verb, "string"))


def json_get(c: Column | str, key: str) -> Column:
    """The first member of that key, as canonical text; null if there is none."""
    return _looked_up("get", key)(_col(c))


def json_at(c: Column | str, at: str | int) -> Column:
    """The member of that key or the element of that number; the text null where there is none."""
    return F.when(_col(c).isNotNull(), F.coalesce(json_index(c, at) if isinstance(at, int) else json_get(c, at), F.lit("null")))


def json_index(c: Column | str, i: int) -> Column:
    return _looked_up("index", i)(_col(c))


def json_pointer(c: Column | str, path: str) -> Column:
    """What an RFC 6901 pointer leads to."""
    return _looked_up("pointer", path)(_col(c))


def json_kind(c: Column | str) -> Column:
    """null, bool, number, string, array or object, by the first character."""
    head = F.substring(_col(c), 1, 1)
    return F.when(head == "{", "object").when(head == "[", "array").when(head == '"', "string").when(head.isin("t", "f"), "bool").when(head == "n", "null").when(head.rlike("^[-0-9]"), "number")


def json_is(c: Column | str, kind: str) -> Column:
    return json_kind(c) == kind


def json_as_string(c: Column | str) -> Column:
    return _looked_up("string")(_col(c))


def json_as_bool(c: Column | str) -> Column:
    return F.when(_col(c).isin("true", "false"), _col(c) == "true")


def json_as_number(c: Column | str) -> Column:
    """The text of a number."""
    return F.when(json_kind(c) == "number", _col(c))


def json_as_double(c: Column | str) -> Column:
    return _looked_up("double")(_col(c))


def json_as_bigint(c: Column | str) -> Column:
    """Exactly a 64-bit integer by its text (1.0 and 1e3 aren't)."""
    return F.when(_col(c).rlike(r"^-?[0-9]+\z"), _col(c).try_cast("bigint"))


def json_as_ubigint(c: Column | str) -> Column:
    n = F.when(_col(c).rlike(r"^[0-9]+\z"), _col(c).try_cast("decimal(38,0)"))
    return F.when(n <= F.lit("18446744073709551615").cast("decimal(20,0)"), n).cast("decimal(20,0)")


def json_elements(c: Column | str) -> Column:
    return _looked_up("elements")(_col(c))


def json_entries(c: Column | str) -> Column:
    """Members in order, duplicates kept."""
    return _looked_up("entries")(_col(c))


def json_len(c: Column | str) -> Column:
    """Elements or members; 0 for scalars."""
    return _looked_up("len")(_col(c))


def json_is_empty(c: Column | str) -> Column:
    return json_len(c) == 0


def json_eq(c: Column | str, value) -> Column:
    """Whether it equals a Python value of the same kind; nothing is coerced."""
    return _col(c) == "null" if value is None else _looked_up("eq", value)(_col(c))


def json_quote(c: Column | str) -> Column:
    """A JSON string, by Catalyst alone."""
    out = F.replace(F.replace(_col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    plain = out
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(named.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(_col(c).rlike(r"[\x00-\x1f]"), out).otherwise(plain), F.lit('"'))


# -- edits: the changed document; null where the pointer leads nowhere


def _edited(function: Callable):
    def edit(docs: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for d, v in zip(docs, values, strict=True):
            try:
                out.append(None if d is None or v is None else _text(function(tree.read(d), v)))
            except (ValueError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return pandas_udf(edit, "string")


@lru_cache(maxsize=256)
def _edit(verb: str, *args):
    if verb == "set":
        return _edited(lambda n, v: tree.replaced(n, args[0], lambda _: tree.read(v)))
    if verb == "push":
        return _edited(lambda n, v: tree.replaced(n, args[0], lambda a: [*a, tree.read(v)] if tree.kind(a) == "array" else a))
    if verb == "put":
        return _edited(lambda n, v: tree.replaced(n, args[0], lambda o: tree.Members([*o, (args[1], tree.read(v))]) if isinstance(o, tree.Members) else o))

    def take(text: str) -> dict:
        taken: list = []
        try:
            rest = tree.replaced(tree.read(text), args[0], lambda old: taken.append(old))
        except (ValueError, RecursionError):
            return {"taken": None, "rest": None}
        return {"taken": _text(taken[0]) if taken else None, "rest": _text(rest) if taken else text}

    return _tabled(take, ("taken", "rest"), "struct<taken:string,rest:string>")


def json_set(c: Column | str, path: str, value: Column | str) -> Column:
    """The document with ``value`` (canonical text) in the pointer's place."""
    return _edit("set", path)(_col(c), _col(value))


def json_push(c: Column | str, path: str, value: Column | str) -> Column:
    """With one more element at the end of an array."""
    return _edit("push", path)(_col(c), _col(value))


def json_put(c: Column | str, path: str, key: str, value: Column | str) -> Column:
    """With one more member at the end of an object; an equal key stays beside it."""
    return _edit("put", path, key)(_col(c), _col(value))


def json_take(c: Column | str, path: str) -> Column:
    """struct<taken, rest>: what was there, and the document with null in its place."""
    return _edit("take", path)(_col(c))


# -- building


@lru_cache
def _float_text():
    return _mapped(tree.float_text, "string")


def json_of(c: Column | str, kind: str | None = None) -> Column:
    """The canonical text of a plain column: kind is string, bool, int, float (text as short as it reads back) or null."""
    c = _col(c)
    if kind == "string":
        text = json_quote(c)
    elif kind == "float":
        text = _float_text()(c.cast("double"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("null"))


def json_array(*items: Column | str) -> Column:
    """Of canonical texts."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[F.coalesce(_col(i), F.lit("null")) for i in items]), F.lit("]"))


def json_object(*pairs: Column | str) -> Column:
    """Of key, value, key, value: keys are plain texts, values canonical ones; duplicates are kept."""
    if len(pairs) % 2:
        raise ValueError("keys and values go in pairs")
    members = [F.concat(json_quote(F.lit(k) if isinstance(k, str) else k), F.lit(": "), F.coalesce(_col(v), F.lit("null"))) for k, v in zip(pairs[::2], pairs[1::2], strict=True)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


# -- other models


@lru_cache(maxsize=256)
def _loads(flavour: str, allow: int, repairs: int):
    options = Options(allow, repairs)

    def loaded(text: str) -> str:
        return tree.write(tree.loaded(tree.read(document.render(text, options))))

    if flavour == "result":
        return _tabled(_reported(loaded), ("value", "error"), f"struct<value:string,error:{ERROR_TYPE}>")
    return _mapped(_attempt(loaded) if flavour == "try" else loaded, "string")


def loads_text(c: Column | str, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    """Repaired, keys sorted, the last of duplicates, numbers beyond any float as strings."""
    return _loads("raise", int(allow), int(repairs))(_col(c))


def try_loads_text(c: Column | str, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    return _loads("try", int(allow), int(repairs))(_col(c))


def loads(c: Column | str, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    """Repaired, as VARIANT (which loses the order of keys and the spelling of numbers)."""
    return F.parse_json(loads_text(c, allow, repairs))


def try_loads(c: Column | str, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    return F.parse_json(try_loads_text(c, allow, repairs))


def loads_result(c: Column | str, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    """struct<value: variant, error>."""
    r = _loads("result", int(allow), int(repairs))(_col(c))
    return F.when(_col(c).isNotNull(), F.struct(F.parse_json(r["value"]).alias("value"), r["error"].alias("error")))


def _typed_value(text: str, spec, options: Options | None):
    """A document as a Spark type; raises JsonTextError for its text and Mismatch for its types."""
    try:
        node = tree.read(text if options is None else document.render(text, options))
    except JsonTextError:
        raise
    except (ValueError, RecursionError):
        document.render(text, Options(_ALL, 0))  # says what is wrong with the text, and where
        raise tree.Mismatch("no JSON value in canonical text") from None
    return tree.coerced(node, spec)


def _typed_error(e: ValueError) -> dict:
    """The error's row: a text error has its kind and byte, a type error the kind Mismatch and no place."""
    return e.row() if isinstance(e, JsonTextError) else {"kind": "Mismatch", "char": None, "position": None, "message": str(e)}


@lru_cache(maxsize=64)
def _typed(schema: str, spec_json: str, flavour: str, repaired: bool, allow: int, repairs: int):
    import json

    spec, options = json.loads(spec_json), Options(allow, repairs) if repaired else None

    def attempt(text: str) -> dict:
        try:
            return {"value": _typed_value(text, spec, options), "error": None}
        except ValueError as e:
            if flavour == "raise":
                raise
            return {"value": None, "error": None if flavour == "try" else _typed_error(e) if flavour == "result" else str(e)}

    error = ERROR_TYPE if flavour == "result" else "string"
    return _tabled(attempt, ("value", "error"), f"struct<value:{schema},error:{error}>")


def _spec(schema: str | DataType) -> tuple[str, str]:
    import json
    import re

    kind = _type(schema)
    return re.sub(r"\bchar\(1\)", "string", kind.simpleString()), json.dumps(kind.jsonValue())


def _read_as(c: Column | str, schema: str | DataType, flavour: str, repaired: bool, allow: int, repairs: int) -> Column:
    if _spec(schema)[0] == "variant":  # any value
        if not repaired:
            r = _verb("repair", "result", _ALL, 0)(_col(c))
            text, error = F.when(r["error"].isNull(), _col(c)), r["error"]
        else:
            r = _loads("result", int(allow), int(repairs))(_col(c))
            text, error = r["value"], r["error"]
        return F.struct(F.parse_json(text).alias("value"), (error if flavour == "result" else error["message"]).alias("error"))
    return _typed(*_spec(schema), flavour, repaired, int(allow), int(repairs))(_col(c))


def deserialize(c: Column | str, schema: str | DataType, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    """struct<value, error>: the repaired document as a Spark type, or what is wrong with it as a text.

    Beside Spark's own types: ``variant`` (alone) takes any value; ``char(1)`` a string of one character; a struct
    of fields _1, _2, ... an array of so many elements; ``binary`` an array of numbers from 0 to 255.
    """
    return _read_as(c, schema, "text", True, allow, repairs)


def deserialize_result(c: Column | str, schema: str | DataType, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    """struct<value, error<kind, char, position, message>>; the kind of an error of types is Mismatch."""
    return _read_as(c, schema, "result", True, allow, repairs)


def deserialize_value(c: Column | str, schema: str | DataType, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    """The value alone; an error ends the query."""
    if _spec(schema)[0] == "variant":
        return loads(c, allow, repairs)
    return _read_as(c, schema, "raise", True, allow, repairs)["value"]


def try_deserialize(c: Column | str, schema: str | DataType, allow: int = _ALL, repairs: int = _PASSES) -> Column:
    """The value, or null where the document can't be repaired or read as the type."""
    return _read_as(c, schema, "try", True, allow, repairs)["value"]


def from_value(c: Column | str, schema: str | DataType) -> Column:
    """struct<value, error> from canonical text."""
    return _read_as(c, schema, "text", False, _ALL, _PASSES)


def from_value_result(c: Column | str, schema: str | DataType) -> Column:
    return _read_as(c, schema, "result", False, _ALL, _PASSES)


# -- typed columns as canonical text


def _type(schema: str | DataType) -> DataType:
    return types.type_of(schema) if isinstance(schema, str) else schema


def _spelled_by_catalyst(c: Column, kind: DataType) -> Column:
    """For types of which every value has one text."""
    if isinstance(kind, StructType):
        members = [F.concat(json_quote(F.lit(f.name)), F.lit(": "), _spelled_by_catalyst(c[f.name], f.dataType)) for f in kind.fields]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda v: _spelled_by_catalyst(v, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, MapType):
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(json_quote(e["key"].cast("string")), F.lit(": "), _spelled_by_catalyst(e["value"], kind.valueType))), ", "), F.lit("}"))
    elif isinstance(kind, StringType | CharType | VarcharType | DateType | TimestampType | TimestampNTZType):
        text = json_quote(c.cast("string"))
    elif isinstance(kind, BinaryType):
        pairs = F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.substring(F.hex(c), 2 * i - 1, F.lit(2)), 16, 10))
        text = F.when(F.octet_length(c) == 0, "[]").otherwise(F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]")))
    else:
        text = c.cast("string")
    return F.coalesce(F.when(c.isNotNull(), text), F.lit("null"))


def _without_variants(c: Column, kind: DataType) -> Column:
    """Variants as their JSON text, which Arrow can carry."""
    if isinstance(kind, VariantType):
        return F.to_json(c)
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[_without_variants(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda v: _without_variants(v, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: _without_variants(v, kind.valueType))
    if isinstance(kind, DateType | TimestampType | TimestampNTZType):
        return c.cast("string")
    return c


@lru_cache(maxsize=64)
def _spelling(kind_json: str, flavour: str, nulls: bool):
    from pyspark.sql.types import _parse_datatype_json_string

    kind = _parse_datatype_json_string(kind_json)

    def attempt(value) -> dict:
        try:
            return {"value": None if value is None else types.spelled(value, kind, nulls), "error": None}
        except ValueError as e:
            if flavour == "raise":
                raise
            return {"value": None, "error": _typed_error(e)}

    error = pa.struct([("kind", pa.string()), ("char", pa.string()), ("position", pa.int64()), ("message", pa.string())])

    def column(values: pa.Array) -> pa.Array:
        return pa.array([attempt(v) for v in values.to_pylist()], pa.struct([("value", pa.string()), ("error", error)]))

    return arrow_udf(column, f"struct<value:string,error:{ERROR_TYPE}>")  # Arrow keeps nulls, integers and nesting as they are


def _encoded(c: Column | str, schema: str | DataType, flavour: str, nulls: bool) -> Column:
    c, kind = _col(c), _type(schema)
    if types.plain_only(kind):
        text = F.when(c.isNotNull(), _spelled_by_catalyst(c, kind))
        return F.struct(text.alias("value"), F.lit(None).cast(ERROR_TYPE).alias("error")) if flavour == "result" else text
    r = _spelling(kind.json(), flavour, nulls)(_without_variants(c, kind))
    return r if flavour == "result" else r["value"]


def json_encode(c: Column | str, schema: str | DataType, nulls: bool = False) -> Column:
    """Canonical text of a column of that type (``df.schema["c"].dataType``), without loss: :func:`deserialize` gives the value back.

    Structs and maps are objects in their order, arrays and ``binary`` arrays, integers and decimals their digits, floats the
    shortest text that reads back, variants their JSON, dates and times strings. A float that isn't finite has no text: that ends the query, or
    with ``nulls`` it is null. Types without floats and variants never leave the JVM.
    """
    return _encoded(c, schema, "raise", nulls)


def try_json_encode(c: Column | str, schema: str | DataType) -> Column:
    return _encoded(c, schema, "try", False)


def json_encode_result(c: Column | str, schema: str | DataType) -> Column:
    """struct<value, error>."""
    return _encoded(c, schema, "result", False)


@lru_cache
def _serialized(flavour: str):
    def spelled(text: str) -> str:
        try:
            node = tree.read(text)
        except (ValueError, RecursionError):
            document.render(text, Options(_ALL, 0))  # says what is wrong with the text, and where
            raise tree.Mismatch("no JSON value in canonical text") from None
        return tree.write(types.classified(node))

    def attempt(text: str) -> dict:
        try:
            return {"value": spelled(text), "error": None}
        except ValueError as e:
            return {"value": None, "error": _typed_error(e)}

    if flavour == "result":
        return _tabled(attempt, ("value", "error"), f"struct<value:string,error:{ERROR_TYPE}>")
    return _mapped(spelled if flavour == "raise" else lambda text: attempt(text)["value"], "string")


def serialize(c: Column | str) -> Column:
    """A value (canonical text) as other data models take it: every number is the first of i64, u64 and f64 that it fits, order and
    duplicates stay. A number that is no finite float is never retyped: it ends the query.
    """
    return _serialized("raise")(_col(c))


def try_serialize(c: Column | str) -> Column:
    return _serialized("try")(_col(c))


def serialize_result(c: Column | str) -> Column:
    return _serialized("result")(_col(c))
