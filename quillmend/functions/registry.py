"""SQL names."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, CharType, DataType, MapType, StringType, StructField, StructType, VariantType, VariantVal
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..errors import ERROR_TYPE, JsonTextError
from ..kernel import document, spans, tree
from ..kernel.classes import quoted
from ..kernel.types import type_of
from ..options import Options
from . import columns


def _masked(strict: bool, name: str):
    """A verb with its masks as columns: name(text, allow, repairs)."""

    def series(texts: pd.Series, allow: pd.Series, repairs: pd.Series) -> pd.Series:
        out = []
        for t, a, r in zip(texts, allow, repairs, strict=True):
            try:
                out.append(None if t is None else document.render(t, Options(int(a), int(r))))
            except JsonTextError:
                if strict:
                    raise
                out.append(None)
        return pd.Series(out, dtype=object)

    return pandas_udf(series, "string")


def _by_column(function, kind: str):
    """An accessor with its argument as a column."""

    def series(docs: pd.Series, args: pd.Series) -> pd.Series:
        out = []
        for d, a in zip(docs, args, strict=True):
            try:
                got = tree.MISSING if d is None or a is None else function(tree.read(d), a)
            except (ValueError, RecursionError):
                got = tree.MISSING
            out.append(None if got is tree.MISSING else tree.write(got))
        return pd.Series(out, dtype=object)

    return pandas_udf(series, kind)


def _rows(columns_: tuple[pd.Series, ...], function) -> list:
    """The function over rows; null where an argument is null, or where a text is no JSON."""
    out = []
    for row in zip(*columns_, strict=True):
        try:
            out.append(None if any(v is None for v in row) else function(*row))
        except (ValueError, RecursionError):
            out.append(None)
    return out


def _edit_by_columns(function):
    """An edit with its pointer and values as columns; null where the pointer leads nowhere."""

    def series(*args: pd.Series) -> pd.Series:
        return pd.Series(_rows(args, lambda d, *rest: columns._text(function(tree.read(d), *rest))), dtype=object)

    by_count = {
        3: lambda f: (lambda a, b, c: f(a, b, c)),
        4: lambda f: (lambda a, b, c, d: f(a, b, c, d)),
    }
    wrapped = by_count[function.__code__.co_argcount](series)
    wrapped.__annotations__ = {**dict.fromkeys(wrapped.__code__.co_varnames, pd.Series), "return": pd.Series}
    return pandas_udf(wrapped, "string")


def _take_by_columns():
    def taken(document_: str, path: str) -> dict:
        old: list = []
        rest = tree.replaced(tree.read(document_), path, lambda v: old.append(v))
        return {"taken": columns._text(old[0]) if old else None, "rest": columns._text(rest) if old else document_}

    def frame(docs: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rows = [r or {"taken": None, "rest": None} for r in _rows((docs, paths), taken)]
        return pd.DataFrame({f: pd.Series([r[f] for r in rows], dtype=object) for f in ("taken", "rest")})

    return pandas_udf(frame, "struct<taken:string,rest:string>")


@udtf(returnType="pos int, value string")
class JsonSpans:
    """Every top-level value of a text, as it stands there."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(spans.extract_all(text))


def _stored(kind: DataType) -> DataType:
    """The type as a column has it."""
    return StringType() if isinstance(kind, CharType) else kind


@dataclass
class _Typed(AnalyzeResult):
    """What the analysis of a typed read has found."""

    kind: DataType = None
    spec: str = ""


@udtf
class JsonDeserialize:
    """value, error: a document as the type that a literal names ('struct<id:bigint>') or a typed null has."""

    def __init__(self, analyzed: _Typed):
        self.kind, self.spec = analyzed.kind, analyzed.spec

    @staticmethod
    def analyze(text: AnalyzeArgument, schema: AnalyzeArgument, allow: AnalyzeArgument | None = None, repairs: AnalyzeArgument | None = None) -> AnalyzeResult:
        kind = type_of(schema.value) if isinstance(schema.value, str) else schema.dataType
        if not schema.isConstantExpression or isinstance(kind, StringType) and schema.value is None and schema.dataType == StringType():
            raise ValueError("no type: the second argument is a literal text of one, or a null of one")
        return _Typed(StructType([StructField("value", _columns_of(kind)), StructField("error", StringType())]), kind=kind, spec=json.dumps(kind.jsonValue()))

    def eval(self, text: str, schema: object, allow: int | None = None, repairs: int | None = None) -> Iterator[tuple]:
        if text is None:
            yield None, None
            return
        options = Options(columns._ALL if allow is None else int(allow), columns._PASSES if repairs is None else int(repairs))
        try:
            if isinstance(self.kind, VariantType):
                yield VariantVal.parseJson(tree.write(tree.loaded(tree.read(document.render(text, options))))), None
            else:
                yield columns._typed_value(text, json.loads(self.spec), options), None
        except ValueError as e:
            yield None, str(e)


def _columns_of(kind: DataType) -> DataType:
    """The type with char(1) as string, which columns have."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _columns_of(f.dataType), True) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(_columns_of(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(kind.keyType, _columns_of(kind.valueType))
    return _stored(kind)


def _built(opener: str, closer: str, pairs: bool):
    """A builder of one argument or more (an empty array is the text itself); a null element is null, a null key gives null."""

    def series(*parts: pd.Series) -> pd.Series:
        out = []
        for row in zip(*parts, strict=True):
            if pairs:
                keys, values = row[::2], row[1::2]
                items = None if None in keys else [f"{quoted(k)}: {'null' if v is None else v}" for k, v in zip(keys, values, strict=True)]
            else:
                items = ["null" if v is None else v for v in row]
            out.append(None if items is None else opener + ", ".join(items) + closer)
        return pd.Series(out, dtype=object)

    return pandas_udf(series, "string")


def _by_expression(spark: SparkSession, name: str, arguments: str, kind: str, body: str) -> None:
    """A SQL function that Catalyst puts in the place of its calls."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")


#: Control characters by code, as the builders spell them.
_CONTROLS = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}


def _quote_body(c: str) -> str:
    out = f"replace(replace({c}, chr(92), repeat(chr(92), 2)), chr(34), concat(chr(92), chr(34)))"
    plain = out
    for code in range(32):
        out = f"replace({out}, chr({code}), concat(chr(92), '{_CONTROLS.get(code, f'u{code:04x}')}'))"
    return f"concat(chr(34), CASE WHEN {c} RLIKE concat('[', chr(92), 'x00-', chr(92), 'x1f]') THEN {out} ELSE {plain} END, chr(34))"


def _expressions(spark: SparkSession) -> None:
    head = "substr(c, 1, 1)"
    _by_expression(spark, "json_kind", "c STRING", "STRING", f"CASE {head} WHEN chr(123) THEN 'object' WHEN '[' THEN 'array' WHEN chr(34) THEN 'string' WHEN 't' THEN 'bool' WHEN 'f' THEN 'bool' WHEN 'n' THEN 'null' ELSE CASE WHEN c RLIKE '^[-0-9]' THEN 'number' END END")
    _by_expression(spark, "json_quote", "c STRING", "STRING", _quote_body("c"))
    _by_expression(spark, "is_valid_json", "c STRING", "BOOLEAN", "CASE WHEN c IS NOT NULL THEN validate_result(c).error IS NULL END")
    _by_expression(spark, "json_of_string", "c STRING", "STRING", f"coalesce({_quote_body('c')}, 'null')")
    _by_expression(spark, "json_of_bigint", "c BIGINT", "STRING", "coalesce(CAST(c AS STRING), 'null')")
    _by_expression(spark, "json_of_boolean", "c BOOLEAN", "STRING", "coalesce(CAST(c AS STRING), 'null')")
    _by_expression(spark, "json_at", "c STRING, k STRING", "STRING", "CASE WHEN c IS NOT NULL THEN coalesce(CASE WHEN substr(c, 1, 1) = '[' THEN json_index(c, try_cast(k AS INT)) ELSE json_get(c, k) END, 'null') END")
    _by_expression(spark, "json_loads", "c STRING", "VARIANT", "parse_json(json_loads_text(c))")
    _by_expression(spark, "try_json_loads", "c STRING", "VARIANT", "parse_json(try_json_loads_text(c))")
    _by_expression(spark, "repair_into", "p STRING, c STRING", "STRING", "coalesce(concat(p, try_repair(c)), p)")


def register_all(spark: SparkSession) -> None:
    """Registers the functions for SQL.

    repair, repair_bytes, repair_extract, each with try_ before and _result after it; validate_result;
    json_extract, json_extract_partial, json_extract_all; repair_with and try_repair_with (text, allow, repairs), which
    parse_partial and try_parse_partial are other names of; json_get, json_index, json_pointer (document, argument);
    json_set, json_push (document, pointer, value), json_put (document, pointer, key, value), json_take (document,
    pointer); json_elements, json_entries, json_len; json_as_text, json_as_f64; json_loads_text and try_json_loads_text;
    the builders json_array, json_object (key, value, ...) and json_of_double; serialize_json. As expressions: json_kind,
    json_quote, is_valid_json, json_at (document, key or number), json_of_string, json_of_bigint, json_of_boolean,
    json_loads and try_json_loads (to VARIANT), repair_into (prefix, text). Table functions: json_spans (text);
    json_deserialize (text, type, allow, repairs) gives value and error, so typed reads are
    ``SELECT value.id FROM t, LATERAL json_deserialize(text, 'struct<id:bigint>')``.
    """
    every, passes = columns._ALL, columns._PASSES
    for name in ("repair", "repair_bytes", "repair_extract"):
        spark.udf.register(name, columns._verb(name, "raise", every, passes))
        spark.udf.register(f"try_{name}", columns._verb(name, "try", every, passes))
        spark.udf.register(f"{name}_result", columns._verb(name, "result", every, passes))
    spark.udf.register("validate_result", columns._verb("repair", "result", every, 0))
    for name in ("extract", "extract_partial", "extract_all"):
        spark.udf.register(f"json_{name}", columns._span(name))
    spark.udf.register("repair_with", _masked(True, "repair"))
    spark.udf.register("try_repair_with", _masked(False, "repair"))
    spark.udf.register("parse_partial", _masked(True, "repair"))
    spark.udf.register("try_parse_partial", _masked(False, "repair"))
    spark.udf.register("json_set", _edit_by_columns(lambda n, path, v: tree.replaced(n, path, lambda _: tree.read(v))))
    spark.udf.register("json_push", _edit_by_columns(lambda n, path, v: tree.replaced(n, path, lambda a: [*a, tree.read(v)] if tree.kind(a) == "array" else a)))
    spark.udf.register("json_put", _edit_by_columns(lambda n, path, key, v: tree.replaced(n, path, lambda o: tree.Members([*o, (key, tree.read(v))]) if isinstance(o, tree.Members) else o)))
    spark.udf.register("json_take", _take_by_columns())
    spark.udf.register("json_of_double", columns._float_text())
    spark.udf.register("json_get", _by_column(tree.get, "string"))
    spark.udf.register("json_index", _by_column(lambda n, i: tree.index(n, int(i)), "string"))
    spark.udf.register("json_pointer", _by_column(tree.pointer, "string"))
    for name, verb in (("json_elements", "elements"), ("json_entries", "entries"), ("json_len", "len"), ("json_as_text", "string"), ("json_as_f64", "double")):
        spark.udf.register(name, columns._looked_up(verb))
    spark.udf.register("json_loads_text", columns._loads("raise", every, passes))
    spark.udf.register("try_json_loads_text", columns._loads("try", every, passes))
    spark.udf.register("json_array", _built("[", "]", False))
    spark.udf.register("json_object", _built("{", "}", True))
    spark.udf.register("serialize_json", columns._serialized("raise"))
    spark.udtf.register("json_spans", JsonSpans)
    spark.udtf.register("json_deserialize", JsonDeserialize)
    _expressions(spark)


__all__ = ["ERROR_TYPE", "JsonSpans", "register_all"]
