"""Tagged unions, typed columns as text and back, and typed reads by SQL name."""

import datetime
import decimal
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from quillmend import functions as fn
from quillmend.kernel import tree
from quillmend.kernel.types import enum_of, spelled, type_of

SHAPE = enum_of({"Unit": None, "Other": None, "Note": "string", "Pair": "struct<_1:int,_2:string>", "Point": "struct<x:int,y:double>", "Many": "array<int>"})


def test_types_are_read_as_spark_reads_them(spark):
    for text in ("int", "array<map<string,decimal(20,0)>>", "struct<a:int NOT NULL COMMENT 'it''s',`b c`:char(1),d:struct<>>", "struct<a: bigint, b: varchar(3), c: timestamp_ntz, d: variant>", "decimal", "ARRAY<STRING>", "map<string, struct<_1: tinyint>>"):
        if "''" in text:
            text = text.replace("it''s", "its")
        assert type_of(text) == _parse_datatype_string(text), text
    for text in ("", "nothing", "array<int", "struct<a int>>", "map<int>", "int int"):
        with pytest.raises(ValueError, match="no type"):
            type_of(text)


@pytest.mark.parametrize(
    ("text", "variant", "payload"),
    [
        ("'Unit'", "Unit", None), ("{Unit: null}", "Unit", None), ("{Note: hello}", "Note", {"Note": "hello"}), ("{Note: 'a', Unit: 1, z: 2}", "Note", {"Note": "a"}), ("{Pair: [7, x]}", "Pair", {"Pair": {"_1": 7, "_2": "x"}}),
        ("{Point: {y: 2.5, x: 1, z: 3}}", "Point", {"Point": {"x": 1, "y": 2.5}}), ("{Many: [1, 2", "Many", {"Many": [1, 2]}), ("{Note: null}", "Note", {"Note": None}),
    ],
)
def test_enums(spark, text, variant, payload):
    r = spark.createDataFrame([(text,)], "t string").select(fn.deserialize("t", SHAPE).alias("r")).first().r
    assert r.error is None and r.value.variant == variant
    got = r.value.payload and {k: v for k, v in r.value.payload.asDict(True).items() if v is not None or k in (payload or {})}
    assert got == payload


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("{}", "enum must have exactly one member"), ("7", "expected an enum, found a number"), ("Nothing", "unknown variant `Nothing`, expected one of `Unit`, `Other`, `Note`, `Pair`, `Point`, `Many`"), ("{Unit: 1}", "expected `null` content for a unit variant, found a number"),
        ("Note", "invalid type: unit variant, expected newtype variant"), ("Pair", "invalid type: unit variant, expected tuple variant"), ("Point", "invalid type: unit variant, expected struct variant"), ("{Pair: 1}", "expected a tuple variant content, found a number"),
        ("{Point: [1]}", "expected a struct variant content, found an array"), ("{Note: 5}", "expected a string, found a number"), ("{Pair: [300000000000, a]}", "number `300000000000` does not fit `i32`"),
    ],
)
def test_enum_errors(spark, text, error):
    r = spark.createDataFrame([(text,)], "t string").select(fn.deserialize("t", SHAPE).alias("r"), fn.deserialize_result("t", SHAPE)["error"].alias("e"), fn.try_deserialize("t", SHAPE).alias("n")).first()
    assert r.r.error == error and r.e.message == error and r.e.kind == "Mismatch" and r.n is None


def test_nested_enums(spark):
    kind = "struct<id:int, shapes:array<struct<variant:string COMMENT 'enum Unit', payload:struct<Note:string>>>>"
    r = spark.createDataFrame([("{id: 1, shapes: [Unit, {Note: x}, {Unit: null}]}",)], "t string").select(fn.deserialize("t", kind)["value"].alias("v")).first().v
    assert [(s.variant, s.payload and s.payload.Note) for s in r.shapes] == [("Unit", None), ("Note", "x"), ("Unit", None)]


TYPED = "struct<i:bigint,t:tinyint,u:decimal(20,0),s:string,b:boolean,a:array<bigint>,m:map<string,array<string>>,n:struct<x:bigint,y:binary>,d:double,f:float,fs:array<double>>"


def _row(i):
    return (i - 2**62, i % 127, decimal.Decimal(2**64 - 1 - i), f'a "quoted"\n\\ é \x01 {i}', i % 2 == 0, [i, None, 2**63 - 1], {f"k{i}": ["x", None], "z": []}, (None, bytes([i % 256, 0, 255])), i / 7, i / 4, [float(i), None, -0.0, 1e300, 5e-324])


def test_encoding_is_lossless(spark):
    df = spark.createDataFrame([(_row(i),) for i in range(50)] + [(None,)], f"v {TYPED}")
    got = df.select("v", fn.json_encode("v", TYPED).alias("t")).select("v", "t", fn.deserialize("t", TYPED).alias("back"), fn.validate("t")["ok"].alias("ok"), fn.repair("t").alias("same")).collect()
    for r in got:
        assert r.v is None and r.t is None or r.back.error is None and r.back.value == r.v and r.ok and r.same == r.t
    plain = "struct<i:bigint,s:string,a:array<bigint>,m:map<string,bigint>,n:struct<y:binary,when:date>,u:decimal(20,0)>"
    rows = [((i - 5, f'"{i}\t', [None, i], {f"k{i}": i}, (bytes(range(i)), datetime.date(2024, 1, 1 + i)), decimal.Decimal(i)),) for i in range(6)] + [((None,) * 6,), (None,)]
    both = spark.createDataFrame(rows, f"v {plain}").select("v", fn.json_encode("v", plain).alias("t")).collect()
    assert [r.t for r in both] == [None if r.v is None else spelled(r.v.asDict(True) | {"n": r.v.n and r.v.n.asDict()}, type_of(plain)) for r in both]  # Catalyst's spelling is the kernel's
    plan = spark.createDataFrame(rows, f"v {plain}").select(fn.json_encode("v", plain))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_floats_without_a_text(spark):
    df = spark.createDataFrame([([1.5, float("nan")],), ([float("-inf")],), ([2.0],)], "v array<double>")
    got = [r.r for r in df.select(fn.json_encode_result("v", "array<double>").alias("r")).collect()]
    assert [r.error and r.error.message for r in got] == ["number `NaN` is not a finite float and cannot be represented", "number `-inf` is not a finite float and cannot be represented", None] and got[2].value == "[2.0]"
    assert [r[0] for r in df.select(fn.try_json_encode("v", "array<double>")).collect()] == [None, None, "[2.0]"] and [r[0] for r in df.select(fn.json_encode("v", "array<double>", nulls=True)).collect()] == ["[1.5, null]", "[null]", "[2.0]"]
    with pytest.raises(Exception, match="not a finite float"):
        df.select(fn.json_encode("v", "array<double>")).collect()


def test_variants(spark):
    df = spark.sql("""SELECT parse_json('{"b": [1, 2.50, null], "a": "x\\\\"y"}') AS v, named_struct('v', parse_json('[true]'), 'd', 0.1D) AS s""")
    r = df.select(fn.json_encode("v", "variant").alias("v"), fn.json_encode("s", "struct<v:variant,d:double>").alias("s")).first()
    assert r.v == '{"a": "x\\"y", "b": [1, 2.5, null]}' and r.s == '{"v": [true], "d": 0.1}'


def test_floats_are_as_short_as_they_can_be(spark):
    values = [0.1, 1e21, 1e22, 1e300, 5e-324, -0.0, 123456789.125, 2**53 + 0.0, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    texts = [r[0] for r in df.select(fn.json_encode("v", "double")).collect()]
    assert [float(t) for t in texts] == values and texts == [tree.float_text(v) for v in values] and math.copysign(1, float(texts[5])) == -1
    single = [r[0] for r in df.select(F.when(F.abs("v") < 1e38, F.col("v")).alias("v")).select(fn.json_encode(F.col("v").cast("float"), "float")).collect()]
    assert single[0] == "0.1" and single[3] is None and single[8] == "0.33333334"


def test_serialized_numbers(spark):
    texts = ["[1.10, 1e2, -0, 18446744073709551615, 18446744073709551616, 1E400]", '{"a": 1.50, "b": {"a": 007}}', '{"z": 1e5, "a": -1.0, "z": 12345678901234567890}', "x"]
    got = [r.r for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fn.serialize_result("t").alias("r")).collect()]
    assert got[0].error.message == "number `1E400` is not a finite float and cannot be represented" and got[0].error.kind == "Mismatch"
    assert got[1].value is None and got[1].error.kind == "UnexpectedCharacter" and got[3].error is not None
    assert got[2].value == '{"z": 100000.0, "a": -1.0, "z": 12345678901234567890}'


def test_typed_reads_in_sql(spark):
    fn.register_all(spark)
    spark.createDataFrame([(1, "{id: 7, tags: [a, b]}"), (2, "{id: x}"), (3, None), (4, "")], "n int, t string").createOrReplaceTempView("replies")
    got = spark.sql("SELECT n, value.id AS id, value.tags AS tags, error FROM replies, LATERAL json_deserialize(t, 'struct<id:bigint, tags:array<string>>') ORDER BY n").collect()
    assert [tuple(r) for r in got] == [(1, 7, ["a", "b"], None), (2, None, None, "expected a number, found a string"), (3, None, None, None), (4, None, None, "no JSON value found at byte 0")]
    r = spark.sql("SELECT value.payload.Note AS note FROM json_deserialize('{Note: hi}', 'struct<variant:string COMMENT ''enum Unit'', payload:struct<Note:string>>')").first()
    assert r.note == "hi"
    r = spark.sql("SELECT value FROM json_deserialize('[1, 2', CAST(NULL AS array<int>))").first()
    assert r.value == [1, 2]
    assert spark.sql("SELECT error FROM json_deserialize('[1, 2', 'array<int>', 0, 4095)").first().error is not None  # cut-off values aren't kept
    with pytest.raises(Exception, match="no type"):
        spark.sql("SELECT * FROM json_deserialize('1', 'strange')").collect()


def test_builders_and_variants_in_sql(spark):
    fn.register_all(spark)
    row = spark.sql("""SELECT json_array(json_of_string('a"b'), '1', NULL, json_of_double(0.1D)) AS a, json_object('k', '[1]', 'k', json_of_bigint(5L), 'b', json_of_boolean(true)) AS o, json_at('{"a": [5]}', 'a') AS g,
        json_at('[1, 2]', '1') AS i, json_at('[1]', 'x') AS none, variant_get(json_loads('{a: [1, 2'), '$.a[1]', 'int') AS v, try_json_loads('') IS NULL AS t, repair_into('x = ', '{a: 1') AS r, repair_into('x = ', '') AS rn, json_kind('[1]') AS kind, json_quote('a\\n"') AS q, is_valid_json('{a: 1}') AS bad, is_valid_json('[1.0]') AS good""").first()
    assert tuple(row) == ('["a\\"b", 1, null, 0.1]', '{"k": [1], "k": 5, "b": true}', "[5]", "2", "null", 2, True, 'x = {"a": 1}', "x = ", "array", '"a\\n\\""', False, True)
    plan = spark.sql("SELECT json_kind(t), json_quote(t) FROM replies")._jdf.queryExecution().executedPlan().toString() if spark.catalog.tableExists("replies") else ""
    assert "Python" not in plan
