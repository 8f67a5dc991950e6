"""Column functions, table operators, SQL surface and streaming."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from jsonmend.functions.repair import json_repair, json_shape_errors, passes_gate, plain_delimiters, unwrap_simple_fence
from jsonmend.functions.result import confidence
from jsonmend.functions.sql import register
from jsonmend.kernel import texts
from jsonmend.kernel.engine import Limits, Options, Result, repair_text
from jsonmend.kernel.values import is_document
from jsonmend.operators import audit, chat
from jsonmend.operators.frame import repair_df, spread
from jsonmend.plans.queries import QUERIES
from jsonmend.sources.damage import DAMAGE, read_payloads
from jsonmend.streaming.deltas import complete, feed, repair_stream

TEXTS = [
    '{"a":1}', ' [1, 2.50, "x"] ', '{"a":1,}', "{a:1}", '```json\n{"a":1}\n```', "<a>{}</a>", 'Here: {"a":1}', "{name: None}", "not json", "null", "", "  ", None,
    '{"a":1}{"b":2}', '{"a":1} x', "{'a':1}", '{"a":1,"a":2}', "NaN", "[01]", "[1,2", "1,2", "1],2,[3", '"s"', "[" * 70 + "]" * 70, '{"a":"\x01"}', '﻿{"a":1}', '["~gate~"]', "[1e400]", "{“a”：1}",
]


@pytest.fixture(scope="module")
def payloads(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, payload string")


@pytest.mark.parametrize("gate", [True, False])
def test_repair_df_equals_the_kernel(payloads, gate):
    rows = {r.id: r.repair for r in repair_df(payloads, "payload", native_gate=gate).collect()}
    for k, t in enumerate(TEXTS):
        if t is None:
            assert rows[k] is None or rows[k].succeeded is None
            continue
        want = repair_text(t)
        got = rows[k]
        assert (got.succeeded, got.was_repaired, got.repaired_text, got.confidence, got.succeeded_by) == (want.succeeded, want.was_repaired, want.repaired_text, want.confidence, want.succeeded_by), t
        assert [(r.name, r.status, r.note) for r in got.text_repairs] == [tuple(r) for r in want.text_repairs], t
        assert (got.error.kind if got.error else None) == (want.error[0] if want.error else None)


def test_native_gate_is_sound(payloads):
    for r in payloads.select("payload", passes_gate(F.col("payload")).alias("gate")).collect():
        assert not r.gate or is_document(r.payload), r.payload


def test_native_confidence(payloads):
    out = repair_df(payloads.filter("payload IS NOT NULL"), "payload", native_gate=False)
    assert out.filter(F.abs(confidence(F.col("repair")) - F.col("repair.confidence")) > 1e-12).count() == 0


def test_native_text_steps(payloads):
    for r in payloads.select("payload", plain_delimiters(F.col("payload")).alias("d"), unwrap_simple_fence(F.col("payload")).alias("f")).collect():
        if r.payload is not None:
            assert r.d == (texts.plain_delimiters(r.payload).text or r.payload)
            assert r.f is None or r.f == texts.unwrap_fence(r.payload).text


def test_schema_column_and_shape_errors(spark):
    rows = [('{"n":"1"}', '{"type":"object","properties":{"n":{"type":"string"}}}'), ('{"n":1}', '{"type":"object","required":["m"]}'), ("[1]", None)]
    df = spark.createDataFrame(rows, "t string, s string")
    out = [r.r.shape_status for r in df.select(json_repair(F.col("t"), F.col("s")).alias("r")).collect()]
    assert out == ["Matched", "Mismatched", "NotEvaluated"]
    assert [r.e for r in df.select(json_shape_errors(F.col("t"), '{"type":"object"}').alias("e")).collect()] == [[], [], ["$ expected object but found array."]]


def test_sql_surface(spark):
    register(spark, Options())
    assert spark.sql("SELECT json_repair('{a:1}', NULL).repaired_text AS t").first().t == '{"a":1}'
    spark.createDataFrame([("{a:1}",), (None,)], "t string").createOrReplaceTempView("payload_view")
    rows = spark.sql("SELECT r.* FROM payload_view, LATERAL repair_reports(t, CAST(NULL AS STRING)) r").collect()
    assert len(rows) == 11 and rows[0].name == "markdown-json-fence"


def test_audit(payloads, spark, tmp_path):
    out = repair_df(payloads.filter("payload IS NOT NULL"), "payload")
    assert audit.reports(out, keys=("id",)).filter("name = 'salvage'").count() == out.filter("repair.error IS NULL").count()
    assert audit.histogram(out).agg(F.sum("rows")).first()[0] == 11 * out.filter("repair.succeeded").count() + 8 * out.filter("repair.error IS NULL AND NOT repair.succeeded").count()
    assert audit.least_confident(out, "repair.shape_status", 2, "id").count() == 2
    audit.write_audit(out, str(tmp_path / "audit"), keys=("id",))
    assert "payload" not in spark.read.parquet(str(tmp_path / "audit")).columns


def test_chat_tables(spark):
    schema = '{"type":"object","properties":{"rows":{"type":"array","items":{"type":"string"}}}}'
    tools = spark.createDataFrame([("apply", '{"type":"string"}'), ("apply", schema), ("apply", '{"type":"object"}')], "name string, schema_json string")
    calls = spark.createDataFrame([(1, "apply", '{"rows":"[\\"a\\",\\"b\\"]"}', False), (2, "apply", "{rows:[", True), (3, "none", "{a:1", False), (4, "none", "True", False), (5, "none", " \n", False)], "id long, name string, arguments string, informational boolean")
    out = {r.id: r for r in chat.repair_tool_calls(calls, tools).collect()}
    assert {k: r.arguments for k, r in out.items()} == {1: '{"rows":["a","b"]}', 2: "{rows:[", 3: '{"a":1}', 4: "True", 5: " \n"}
    assert out[1].repair_target == "function:apply" and out[2].repair is None and out[5].repair is None
    messages = spark.createDataFrame([(1, "Nothing to report today."), (2, '{"a":1'), (3, "```json\n[1,]\n```")], "id long, text string")
    plain = {r.id: r.text for r in chat.repair_response_texts(messages).collect()}
    assert plain == {1: "Nothing to report today.", 2: '{"a":1', 3: "```json\n[1,]\n```"}
    opted = {r.id: r.text for r in chat.repair_response_texts(messages, chat=chat.ChatOptions(texts_without_schema=True)).collect()}
    assert opted == {1: "Nothing to report today.", 2: '{"a":1}', 3: "[1]"}


def test_chat_options(spark):
    tools = spark.createDataFrame([("apply", '{"type":"object"}')], "name string, schema_json string")
    calls = spark.createDataFrame([(1, "apply", "{a:1"), (2, "none", "{b:2")], "id long, name string, arguments string")
    off = chat.repair_tool_calls(calls, tools, chat=chat.ChatOptions(repair_calls=False))
    assert {r.id: r.arguments for r in off.collect()} == {1: "{a:1", 2: "{b:2"} and "repair" in off.columns
    bare = chat.repair_tool_calls(calls, tools, chat=chat.ChatOptions(keep_audit=False))
    assert {r.id: r.arguments for r in bare.collect()} == {1: '{"a":1}', 2: '{"b":2}'} and bare.columns == calls.columns
    messages = spark.createDataFrame([(1, '{"a":1')], "id long, text string")
    texts = chat.repair_response_texts(messages, chat=chat.ChatOptions(texts_without_schema=True, keep_audit=False))
    assert texts.columns == messages.columns and texts.first().text == '{"a":1}'


def test_raw_arguments_tool_order_and_transforms(spark, monkeypatch, tmp_path):
    tools = spark.createDataFrame([("f", '{"type":"object","properties":{"n":{"type":"string"}}}', 2), ("f", '{"type":"object","properties":{"n":{"type":"integer"}}}', 1)], "name string, schema_json string, place long")
    calls = spark.createDataFrame([(1, "f", None, "{n: 5"), (2, "f", '{"n":5}', None), (3, "f", None, '{"n":"5"}'), (4, None, None, None)], "id long, name string, arguments string, sent string")
    run = lambda **more: {r.id: r.arguments for r in calls.transform(chat.with_repaired_calls(tools, raw="sent", **more)).collect()}
    assert run() == {1: '{"n":"5"}', 2: '{"n":"5"}', 3: '{"n":"5"}', 4: None}  # the first listed schema wants a string
    assert run(order="place")[1] == '{"n":5}'
    monkeypatch.setattr(chat, "SMALL_TOOLS", 0)
    assert run() == {1: '{"n":"5"}', 2: '{"n":"5"}', 3: '{"n":"5"}', 4: None}
    out = chat.repair_tool_calls(calls, tools, raw="sent")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "BroadcastHashJoin" not in plan
    told = audit.notifications(out, keys=("id",)).orderBy("id").collect()
    assert [r.target for r in told] == ["function:f"] * 3 and not {"arguments", "sent", "repaired_text"} & set(told[0].asDict())
    sink = audit.audit_sink(str(tmp_path / "told"))
    sink(out, 0), sink(out, 0)
    assert spark.read.parquet(str(tmp_path / "told")).count() == 3
    texts = spark.createDataFrame([("[1,",)], "text string").transform(chat.with_repaired_texts(chat=chat.ChatOptions(texts_without_schema=True)))
    assert texts.first().text == "[1]" and texts.first().repair_target == "response-text"


@pytest.mark.parametrize("name", ["'f'", "concat('f', id % 3)"])
def test_calls_are_never_broadcast(spark, name):
    tools = spark.createDataFrame([("f", '{"type":"object"}'), ("f1", '{"type":"object"}')], "name string, schema_json string")
    calls = spark.range(100).select("id", F.expr(name).alias("name"), F.lit("{a:1").alias("arguments"))
    plan = chat.repair_tool_calls(calls, tools)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_columns_of_internal_names_survive(spark):
    df = spark.createDataFrame([("{a:1}", 1, 2, "x")], "payload string, __gate int, __kernel int, tool_name string")
    r = repair_df(df, "payload").first()
    assert (r["__gate"], r["__kernel"], r.repair.repaired_text) == (1, 2, '{"a":1}')
    calls = df.select(F.lit("f").alias("name"), F.col("payload").alias("arguments"), "tool_name")
    tools = spark.createDataFrame([("f", '{"type":"object"}')], "name string, schema_json string")
    assert chat.repair_tool_calls(calls, tools).first().tool_name == "x"


def test_readers_and_damage(spark, tmp_path):
    (tmp_path / "x.txt").write_text('{"a":1}\n{b:2}\n')
    assert read_payloads(spark, str(tmp_path / "x.txt")).count() == 2
    assert read_payloads(spark, str(tmp_path / "x.txt"), "whole").count() == 1
    with pytest.raises(ValueError):
        read_payloads(spark, "x", "csv")
    j = F.lit('{"k":1,"s":"O","p":"x"}')
    for name, f in DAMAGE.items():
        damaged = spark.range(1).select(f(j).alias("t")).first().t
        assert not is_document(damaged) and repair_text(damaged).succeeded, name


@pytest.mark.parametrize("size", [1, 4, 30])
def test_feed_orders_chunks(size):
    text = '{"name": "svc-1", "replicas": [1, 2], "note": "a long enough tail"}'
    parts = [text[a : a + size] for a in range(0, len(text), size)]
    chunks = [(k, c, k == len(parts) - 1) for k, c in enumerate(parts)]
    state, out, done = None, "", False
    for batch in (chunks[1::2], chunks[::2], chunks[:1]):
        state, deltas, done = feed(state, sorted(batch), 1 << 20)
        for at, piece in deltas:
            assert at == len(out)
            out += piece
    assert out and state.text == text and text.startswith(out) and state.done and not done
    assert feed(state, [(0, "x", True)], 1 << 20)[1:] == ([], False)  # a late chunk changes nothing


def test_feed_counts_held_chunks_and_utf16_units():
    state, deltas, done = feed(None, [(1, "🙂🙂", False)], 3)
    assert done and not deltas and state.units == 4
    result = complete(state, Options(limits=Limits(input=3)), None)
    assert result.error[0] == "limit" and not result.succeeded
    state, _, done = feed(None, [(0, '{"a":', False), (2, "2}", False)], 100)
    assert not done and state.missing == 1 and state.whole() == '{"a":2}' and complete(state, Options(), None).repaired_text == '{"a":2}'


def test_streaming_query(spark, tmp_path):
    text = '{"name": "svc-1", "replicas": [1, 2], note: "a long enough tail"'
    for k in range(3):
        rows = [json.dumps({"stream_id": s, "seq": k, "chunk": text[k * 25 : (k + 1) * 25], "is_last": k == 2}) for s in ("x", "y")]
        (tmp_path / f"{k}.json").write_text("\n".join(rows))
    chunks = spark.readStream.schema("stream_id string, seq long, chunk string, is_last boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    query = repair_stream(chunks, timeout_ms=None).writeStream.format("memory").queryName("deltas").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    rows = spark.table("deltas").collect()
    done = [r for r in rows if r.kind == "completed"]
    assert {r.stream_id for r in done} == {"x", "y"} and all(json.loads(r.text)["note"] == "a long enough tail" for r in done)
    want = repair_text(text)
    for r in done:
        assert r.missing_seq is None and (r.repair.repaired_text, r.repair.confidence, r.repair.succeeded_by) == (want.repaired_text, want.confidence, want.succeeded_by)
        assert [(x.name, x.status, x.note) for x in r.repair.text_repairs] == [tuple(x) for x in want.text_repairs]
    for s in ("x", "y"):
        pieces = sorted((r.offset, r.text) for r in rows if r.kind == "delta" and r.stream_id == s)
        assert pieces and text.startswith("".join(p for _, p in pieces))


def test_streaming_timeout_flushes_held_chunks(spark, tmp_path):
    """A stream with a gap completes after the timeout with all its chunks; a late chunk does not open it again."""
    source, write = tmp_path / "in", lambda n, rows: (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
    source.mkdir()
    write(0, [{"stream_id": "g", "seq": 0, "chunk": '{"a": [1, 2', "is_last": False}, {"stream_id": "g", "seq": 2, "chunk": ", 3]}", "is_last": True}])
    chunks = spark.readStream.schema("stream_id string, seq long, chunk string, is_last boolean").json(str(source))
    query = repair_stream(chunks, timeout_ms=1_000).writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    completed = lambda: [r for r in spark.table("gaps").collect() if r.kind == "completed"]
    for n in range(1, 60):
        write(n, [{"stream_id": f"tick-{n}", "seq": 0, "chunk": "{", "is_last": False}])
        time.sleep(0.5)
        if any(r.stream_id == "g" for r in completed()):
            break
    query.stop()
    (done,) = [r for r in completed() if r.stream_id == "g"]
    assert done.text == '{"a": [1, 2, 3]}' and done.missing_seq == 1 and done.repair.succeeded


def test_result_accessors_and_consistency():
    good = repair_text('{"a":1,}')
    assert good.check() is good and good.text_or_raise() == '{"a":1}' and good.object_or_raise() == good.value
    with pytest.raises(ValueError):
        good.array_or_raise()
    assert repair_text("[1").array_or_raise() == repair_text("[1").value
    bad = repair_text("not json", configure=lambda o: o.without_salvage())
    assert bad.check() is bad
    for broken in (Result(True, repaired_text="[1]", value=[]), Result(True), Result(False, was_repaired=True), Result(False, shape_status="Mismatched")):
        with pytest.raises(ValueError):
            broken.check()
    for read in (bad.value_or_raise, bad.text_or_raise, bad.object_or_raise):
        with pytest.raises(ValueError):
            read()


def test_codecs_and_struct_schemas(spark):
    from pyspark.sql import Observation
    from pyspark.sql import types as T

    from jsonmend.functions.codec import arguments_from_json, arguments_to_json, schema_of_struct, schema_text
    from jsonmend.kernel.schema import compile_schema

    struct = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("tags", T.ArrayType(T.StringType(), False)), T.StructField("raw", T.MapType(T.StringType(), T.DoubleType(), False), False)])
    assert schema_of_struct(struct)["required"] == ["id", "raw"]
    compiled = compile_schema(schema_text(struct))
    assert compiled.errors({"id": 1, "tags": None, "raw": {"x": 1.5}}) == [] and compiled.errors({"tags": []}) == ["$.id is required.", "$.raw is required."]
    df = spark.createDataFrame([('{"a":1,"b":"x"}',), ("[1]",), ("bad",), (None,)], "t string")
    rows = df.select(arguments_from_json(F.col("t")).alias("m")).select(F.size(F.map_keys("m")).alias("n"), arguments_to_json(F.col("m")).alias("j")).collect()
    assert rows[0].j == '{"a":1,"b":"x"}' and all(r.j is None for r in rows[1:])
    seen = Observation("seen")
    out = audit.observed(repair_df(df, "t"), seen)
    out.count()
    assert seen.get["rows"] == 4 and seen.get["unchanged"] == 2


def test_one_row_group_is_dealt_over_many_tasks(spark, tmp_path):
    """A file of several pieces whose rows all lie in one of them."""
    path = str(tmp_path / "one_group")
    spark.range(0, 40_000, 1, 1).selectExpr("id", "concat('{k:', id, '}') AS payload").write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        rows = spark.read.parquet(path)
        pieces = rows.rdd.getNumPartitions()
        alone = rows.groupBy(F.spark_partition_id()).count().count()
        assert pieces > 4 and alone == 1
        dealt = repair_df(rows, "payload").select("id", F.spark_partition_id().alias("part"))
        counts = [r["count"] for r in dealt.groupBy("part").count().collect()]
        assert sum(counts) == 40_000 and len(counts) >= 4 * 16 and max(counts) <= 2 * 40_000 / (4 * 16)
        once = spread(rows)
        assert spread(once) is once and spread(once.withColumn("more", F.lit(1))).rdd.getNumPartitions() == once.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(
    "name",
    ["python_literals", "verbatim_orders", "structural_map", "truncated_tail", "correction_counts", "template_orders", "double_encoded", "scalar_to_string", "concat_refused", "schema_cases",
     "raw_arguments", "one_shot", "shape_errors", "struct_schema", "sql_functions", "stream_completed"],
)
def test_rows_are_dealt_as_stored(spark, name):
    """Damage is made in the tasks that repair it, not in the one that reads a row group."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Repartition", 1)
    assert re.search("json_repair|run|helper|replay", above) and "Relation" in below
    assert not re.search("concat|replace|substring|to_json|invoke|CASE", below)


@pytest.mark.parametrize("name", ["correction_counts", "template_orders", "double_encoded", "scalar_to_string", "concat_refused"])
def test_orders_are_dealt_by_key_without_a_sort(spark, name):
    """Spark sorts what it deals round by round, which spills in the task that reads a large row group."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in plan and re.search(r"hashpartitioning\(o_orderkey#\d+L, \d+\), REPARTITION_BY_NUM", plan)


def test_keys_are_dealt_evenly_and_once(spark, tmp_path):
    path = str(tmp_path / "keys")
    spark.range(0, 40_000, 1, 4).selectExpr("id", "concat('{k:', id, '}') AS payload").write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        once = spread(spark.read.parquet(path), "id")
        dealt = repair_df(once, "payload").select("id", F.spark_partition_id().alias("part"))
        counts = [r["count"] for r in dealt.groupBy("part").count().collect()]
        assert sum(counts) == 40_000 and len(counts) == once.rdd.getNumPartitions() >= 4 * 16 and max(counts) <= 2 * 40_000 / len(counts)
        assert spread(once, "id") is once and dealt.select("id").distinct().count() == 40_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_streams_share_groups_but_not_states(spark, tmp_path):
    """Hundreds of streams in three state rows, null and completed ones included; the second run brings the missing chunks."""
    source = tmp_path / "in"
    source.mkdir()
    names = [None, *(f"s{n}" for n in range(299))]
    text = lambda n: f'{{"n": {n}, "note": "a tail that is long enough", "more": [1, 2'
    pieces = lambda n: [text(n)[:20], text(n)[20:40], text(n)[40:]]
    for late in (False, True):
        rows = [{"stream_id": s, "seq": k, "chunk": c, "is_last": k == 2} for n, s in enumerate(names) for k, c in enumerate(pieces(n)) if (k == 1 and n % 2 == 0) == late]
        (source / f"{late}.json").write_text("\n".join(map(json.dumps, rows)))
        chunks = spark.readStream.schema("stream_id string, seq long, chunk string, is_last boolean").json(str(source))
        query = repair_stream(chunks, timeout_ms=None, buckets=3).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 3
        told = spark.read.parquet(str(tmp_path / "out")).collect()
        done = {r.stream_id: r for r in told if r.kind == "completed"}
        assert len(done) == sum(r.kind == "completed" for r in told) == (300 if late else 150)
    for n, s in enumerate(names):
        assert done[s].text == repair_text(text(n)).repaired_text and done[s].missing_seq is None
        deltas = sorted((r.offset, r.text) for r in told if r.kind == "delta" and r.stream_id == s)
        assert deltas and text(n).startswith("".join(t for _, t in deltas)) and [at for at, _ in deltas] == [sum(len(t) for _, t in deltas[:k]) for k in range(len(deltas))]


def test_streams_of_one_group_time_out_each_for_itself(spark, tmp_path):
    source, write = tmp_path / "in", lambda n, rows: (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
    source.mkdir()
    write(0, [{"stream_id": "quiet", "seq": 0, "chunk": '{"a": [1', "is_last": False}, {"stream_id": "busy", "seq": 0, "chunk": '{"b": [0', "is_last": False}])
    chunks = spark.readStream.schema("stream_id string, seq long, chunk string, is_last boolean").json(str(source))
    query = repair_stream(chunks, timeout_ms=4_000, buckets=1).writeStream.format("memory").queryName("each").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    completed = lambda: [r for r in spark.table("each").collect() if r.kind == "completed"]
    for n in range(1, 80):
        write(n, [{"stream_id": "busy", "seq": n, "chunk": f",{n}", "is_last": False}])
        time.sleep(0.5)
        if any(r.stream_id == "quiet" for r in completed()):
            break
    told = completed()
    query.stop()
    assert [(r.stream_id, r.text) for r in told] == [("quiet", '{"a":[1]}')]


@pytest.mark.parametrize("damage", ["missing_colon", "missing_comma", "verbatim", "template", "unquoted_keys", "single_quoted", "trailing_comma", "missing_closer", "fenced", "xml", "prose", "comments", "unicode"])
def test_the_gate_parses_no_such_damage(spark, damage):
    """A parse of damaged text costs an exception; one pattern refuses it before."""
    from jsonmend.functions.repair import in_sequence

    df = spark.createDataFrame([('{"k":1,"s":"O","p":"1-URGENT"}',)], "j string")
    assert df.select(in_sequence(F.col("j")), in_sequence(DAMAGE[damage](F.col("j")))).first()[:] == (True, False)


def test_the_pattern_before_the_gate_lets_all_json_pass(spark):
    from jsonmend.functions.repair import in_sequence

    whole = ['{}', '[]', ' [ [ ] , { } ]\n', '{"a":[],"b":{"c":-1.5E+3}}', '[true,false,null,"\\"]\\\\"]', '{"":"\\u0041","x y":[{"z":[1]}]}\r\n\t']
    whole += ["[" + "1," * 300_000 + "1]", '["' + '\\"' * 300_000 + '"]', "[" * 60 + "{}" + "]" * 60]
    rows = spark.createDataFrame([(t,) for t in whole], "t string").select("t", in_sequence(F.col("t")).alias("s"), passes_gate(F.col("t")).alias("g")).collect()
    assert all(r.s and r.g for r in rows if not r.t.startswith("[[[")) and all(r.s for r in rows)


@pytest.mark.parametrize("text", ["{'k': 1, ok: True, x: None}", "{\"k\": 1, \"ok\": True}", '{"k":NaN}'])
def test_the_gate_parses_no_foreign_literals(spark, text):
    from jsonmend.functions.repair import in_sequence

    assert not spark.createDataFrame([(text,)], "t string").select(in_sequence(F.col("t"))).first()[0]


def test_the_gate_parses_no_concatenation(spark):
    from jsonmend.functions.repair import in_sequence

    df = spark.createDataFrame([('{"k":1}{"z":1}',), ('{"k":1} x',), ('{"k":1}"z"',)], "t string")
    assert not any(r[0] for r in df.select(in_sequence(F.col("t"))).collect())
