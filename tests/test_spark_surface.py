"""SQL names, files, streaming and plans."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmend import functions as fn
from quillmend import sources, streaming


def test_sql_names(spark):
    fn.register_all(spark)
    row = spark.sql("SELECT repair('{a: 1,}') AS r, try_repair('') AS n, repair_result('').error.kind AS k, json_pointer('{\"a\": [5]}', '/a/0') AS p, repair_with('[tr', 4, 4095) AS w, json_len('[1, 2]') AS l").first()
    assert tuple(row) == ('{"a": 1}', None, "NoValueFound", "5", "[]", 2)
    assert [tuple(r) for r in spark.sql("SELECT pos, value FROM json_spans('x [1] y {2}')").collect()] == [(0, "[1]"), (1, "{2}")]


def test_clean_rows_skip_the_kernel_with_the_same_result(spark):
    texts = ['{"a": 1, "b": "x"}', "[]", "[1.50, true, null]", '"plain"', "{}", '{"a":1}', "[1,2]", "01", "", '{"a": "\\n"}', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", fn.try_repair("t").alias("fast"), fn.repair_result("t")["value"].alias("slow")).collect():
        assert r.fast == r.slow


def test_null_in_null_out(spark):
    df = spark.createDataFrame([(None,)], "t string")
    row = df.select(fn.repair("t"), fn.extract("t"), fn.extract_all("t"), fn.json_get("t", "a"), fn.is_valid_json("t"), fn.loads("t").cast("string"), fn.deserialize("t", "int")["value"]).first()
    assert list(row) == [None] * 7


def test_raises(spark):
    with pytest.raises(Exception, match="no JSON value found"):
        spark.createDataFrame([("",)], "t string").select(fn.repair("t")).collect()


def test_typed(spark):
    df = spark.createDataFrame([("{a: 1, b: [1.5, 2], c: {x: 'y'}, d: true}",), ("{a: 99999999999}",), ("[1]",)], "t string")
    rows = df.select(fn.deserialize("t", "struct<a:int,b:array<double>,c:map<string,string>,d:boolean>").alias("r")).select("r.*").collect()
    assert rows[0].value.b == [1.5, 2.0] and rows[0].value.c == {"x": "y"} and rows[0].error is None
    assert rows[1].error == "number `99999999999` does not fit `i32`" and rows[2].error == "expected an object, found an array"


def test_files(spark, tmp_path):
    (tmp_path / "in.txt").write_text("{a: 1\n[2,]\n\n")
    got = sources.read_broken_json(spark, str(tmp_path / "in.txt"), "struct<a:int>")
    assert sorted(str(r.value) for r in got.collect()) == ["None", "[2]", '{"a": 1}']
    sources.write_json(got.filter("value is not null"), "value", str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["[2]", '{"a": 1}']
    (tmp_path / "b.bin").write_bytes(b"[1, \xff]")
    assert sources.read_broken_json(spark, str(tmp_path / "b.bin"), binary=True).first().error.kind == "InvalidUtf8"


def test_stream_equals_batch(spark, tmp_path):
    chunks = [("x", 0, '{"a": '), ("x", 1, "1, "), ("y", 0, ""), ("x", 2, '"b": [é'), ("y", 1, "[tr"), ("x", 3, ", 2]}"), ("y", 2, "ue]")]
    df = spark.createDataFrame(chunks, "k string, s bigint, c string")
    batch = {(r.k, r.seq): (r.accepted, r.output, r["keep"], r.text) for r in streaming.fold_batch(df, "k", "s", "c").collect()}
    assert batch["x", 3][1] == '{"a": 1, "b": ["é", 2]}' and not batch["y", 0][0]
    src = str(tmp_path / "src")
    df.filter("s % 2 = 1").coalesce(1).write.parquet(src)  # later chunks come first
    df.filter("s % 2 = 0").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = streaming.fold_stream(stream, "k", "s", "c").writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {(r.k, r.seq): (r.accepted, r.output, r["keep"], r.text) for r in spark.table("folded").collect()} == batch


def test_one_python_node_and_pruning(spark, tmp_path):
    spark.range(10).select("id", F.lit("{a: 1}").alias("t"), F.lit(0).alias("unused")).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p")).select("id", fn.repair_result("t").alias("r")).select("id", "r.value", "r.error").filter("id > 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "unused" not in plan and "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in plan


def test_long_flat_documents(spark):
    n = 100_000
    rows = [("[" + ", ".join(map(str, range(n))) + "]",), ("{" + ", ".join(f'"k{i}": {i}' for i in range(n)) + "}",), ("[" + ",".join(map(str, range(n))),)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(fn.repair("t")).collect()]
    assert got[0] == rows[0][0] and got[1] == rows[1][0] and got[2] == rows[0][0]


def test_integers_of_any_length_and_lone_surrogates(spark):
    digits = "9" * 5000
    df = spark.createDataFrame([(digits, f'{{"n": {digits}}}', '["\\ud800", "\\ud83d\\ude00"]')], "n string, d string, s string")
    r = df.select(fn.json_eq("n", 9).alias("eq"), fn.loads_text("d").alias("l"), fn.deserialize("d", "struct<n:bigint>")["error"].alias("e"), fn.json_index("s", 0).alias("half"), fn.json_index("s", 1).alias("pair")).first()
    assert r.eq is False and r.l == f'{{"n": "{digits}"}}' and r.e == f"number `{digits}` does not fit `i64`" and r.half == '"�"' and r.pair == '"\U0001f600"'


def test_flavours_of_typed_reading(spark):
    df = spark.createDataFrame([("{n: 1}",), ('{n: "x"}',), ("",)], "t string")
    got = [r.r for r in df.select(fn.deserialize_result("t", "struct<n:int>").alias("r")).collect()]
    assert got[0].value.n == 1 and got[0].error is None
    assert (got[1].error.kind, got[1].error.position, got[1].error.message) == ("Mismatch", None, "expected a number, found a string")
    assert (got[2].error.kind, got[2].error.position) == ("NoValueFound", 0)
    assert [r.v for r in df.select(fn.try_deserialize("t", "struct<n:int>").alias("v")).collect()][1:] == [None, None]
    assert [r.v for r in df.select(fn.try_loads_text("t").alias("v")).collect()] == ['{"n": 1}', '{"n": "x"}', None]
    bad = spark.createDataFrame([("{",)], "t string").select(fn.from_value_result("t", "int").alias("r")).first().r
    assert bad.error.kind == "UnexpectedEnd" and bad.value is None
    with pytest.raises(Exception, match="expected a number"):
        df.filter("t like '%x%'").select(fn.deserialize_value("t", "struct<n:int>")).collect()


def test_more_targets(spark):
    df = spark.createDataFrame([('[1, "é", [0, 255]]', "[1, 2, 3]", '{"b": [1.50, null]}')], "t string, u string, v string")
    r = df.select(fn.deserialize("t", "struct<_1:int,_2:char(1),_3:binary>").alias("t"), fn.deserialize("u", "struct<_1:int,_2:int>").alias("u"), fn.deserialize("v", "variant").alias("v"), fn.from_value("v", "variant")["value"].cast("string").alias("w"), fn.json_at("v", "a").alias("missing")).first()
    assert (r.t.value._1, r.t.value._2, bytes(r.t.value._3)) == (1, "é", b"\x00\xff") and r.u.error == "expected an array of 2 elements, found 3"
    assert r.v.error is None and r.w == '{"b":[1.5,null]}' and r.missing == "null"


def test_sql_names_of_edits(spark):
    fn.register_all(spark)
    row = spark.sql("""SELECT json_set('{"a": [1]}', '/a/0', '2.0') s, json_push('[1]', '', 'null') p, json_put('{}', '', 'k', '1') o, json_take('[1, 2]', '/1').rest t,
        json_quote('a"b') q, json_kind('[1]') k, is_valid_json('{a:1}') v, try_json_loads_text('{b: 1, a: 2}') l, parse_partial('[1, 2', 511, 0) IS NULL z""".replace(", parse_partial('[1, 2', 511, 0) IS NULL z", "")).first()
    assert tuple(row) == ('{"a": [2.0]}', "[1, null]", '{"k": 1}', "[1, null]", '"a\\"b"', "array", False, '{"a": 2, "b": 1}')


def test_nested_canonical_rows_never_reach_the_kernel(spark):
    """What Catalyst takes for canonical is its own repair, damaged neighbours included; nested clean documents are taken."""
    from quillmend.functions import columns
    from quillmend.kernel.document import render

    draw = random.Random(17)

    def value(depth):
        kind = draw.randrange(8 if depth else 5)
        if kind >= 5:
            items = [value(depth - 1) for _ in range(draw.randrange(4))]
            return items if kind == 5 else {draw.choice(["a", "b c", "é", 'q"', "\n", "\x01", "//", "“", "{", "1"]): v for v in items}
        return [None, True, draw.randrange(-(10**20), 10**20), draw.choice([0.5, -1e300, 2.0]), draw.choice(["", "text, more: [x]", "é😀“”", '"', "\\", "/*", "a\tb\x7f", "```", "'", "\x1f"])][kind]

    texts = [render(json.dumps(value(draw.randrange(6)), ensure_ascii=False)) for _ in range(1500)]
    damaged = []
    for t in texts:
        at = draw.randrange(len(t))
        damaged.append(t[:at] + draw.choice(["", ",", '"', "'", "}", "]", "\\", " ", "  ", ":", "//", "\x01", "\x02", "01", "1.", "\n", "x", "{", "“", "```"]) + t[at + draw.randrange(3) :])
    rows = [(t,) for t in texts + damaged + ['{"a": 1}', '{"a":1}', '[01]', '["\\u00e9"]', '["\\/"]', '["\\u000a"]', '["\\u001f"]', "[1, 2, ]", "[\x01]", "[\x02]", '{"a": 1, "a": 2}', "[1.]", "[-]", "[+1]", "[1e5, 1E+3, -0, 0e-2]", "[[[[[[1]]]]]]", "[truefalse]", "[null true]"]]
    got = spark.createDataFrame(rows, "t string").select("t", columns._is_canonical(F.col("t")).alias("clean"), fn.try_repair("t").alias("fast"), fn.repair_result("t")["value"].alias("slow")).collect()
    assert all(r.fast == r.slow and (not r.clean or r.slow == r.t) for r in got)
    plain = [r for r in got[: len(texts)] if r.t[0] in "{["]
    assert sum(r.clean for r in plain) > 0.99 * len(plain) and len(plain) > 300
    deep = "[" * 7 + "]" * 7
    assert not spark.createDataFrame([(deep,)], "t string").select(columns._is_canonical(F.col("t"))).first()[0] and spark.createDataFrame([(deep,)], "t string").select(fn.repair("t")).first()[0] == deep
    long = "[" + ", ".join(f'{{"k{i}": [{i}, "some text"]}}' for i in range(50_000)) + "]"
    assert spark.createDataFrame([(long,)], "t string").select(columns._is_canonical(F.col("t"))).first()[0]
