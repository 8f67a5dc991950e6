"""Registered queries: damage, repair, read back; with DuckDB oracles over the undamaged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonmend.functions.repair import json_repair, json_shape_errors, passes_gate, plain_delimiters, unwrap_simple_fence
from jsonmend.functions.codec import arguments_from_json, arguments_to_json, schema_text
from jsonmend.functions.result import confidence, is_confident
from jsonmend.functions.sql import register
from jsonmend.operators import audit, chat
from jsonmend.operators.frame import repair_df, spread
from jsonmend.kernel.engine import Limits, Options, repair_text
from jsonmend.plans import cases
from jsonmend.sources.damage import DAMAGE
from jsonmend.streaming.deltas import feed, repair_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_PLAIN = "SELECT o_orderkey::BIGINT AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders"


def _register(name: str, oracle: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_json(orders: DataFrame, *more: Column) -> DataFrame:
    j = F.to_json(F.struct(F.col("o_orderkey").cast("long").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")))
    return orders.select("o_orderkey", "o_custkey", j.alias("j"), *more)


def _orders(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Orders with their JSON in ``j``."""
    return _with_json(_table(spark, sf_dir, "orders"), *more)


def _dealt(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """The same, dealt out as they are stored: the one task that reads a row group does not make JSON and damage for all of its rows."""
    stored = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return _with_json(spread(stored, "o_orderkey"), *more)


def _fields(text: Column) -> list[Column]:
    read = lambda n: F.get_json_object(text, f"$.{n}")
    return [read("k").cast("long").alias("k"), read("s").alias("s"), read("p").alias("p")]


def _repaired(df: DataFrame, text: Column, schema: str | None = None, options: Options | None = None) -> DataFrame:
    return repair_df(df.withColumn("payload", text), "payload", schema, options)


def _damaged(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _repaired(_dealt(spark, sf_dir), DAMAGE[name](F.col("j")))
        return out.select(*_fields(F.col("repair.repaired_text")))

    return query


#: A closer too many ends the document for the extraction steps: what follows is dropped.
_CUT = "SELECT o_orderkey::BIGINT AS k, o_orderstatus AS s, NULL::VARCHAR AS p FROM orders"
for _name in DAMAGE:
    _register(f"{_name}_orders", _CUT if _name == "stray_closer" else _PLAIN)(_damaged(_name))


@_register("valid_passthrough", "SELECT regexp_extract(props, '\"k\": ([0-9]+)', 1)::BIGINT AS k, true AS same, 1.0::DOUBLE AS confidence FROM events")
def valid_passthrough(spark, sf_dir):
    out = repair_df(_table(spark, sf_dir, "events").select("props"), "props")
    return out.select(F.get_json_object("repair.repaired_text", "$.k").cast("long").alias("k"), (F.col("repair.repaired_text") == F.col("props")).alias("same"), F.col("repair.confidence").alias("confidence"))


@_register("gate_agrees", "SELECT count(*)::BIGINT AS rows, 0::BIGINT AS wrongly_passed FROM orders")
def gate_agrees(spark, sf_dir):
    """The native gate passes nothing that the kernel would change."""
    df = _dealt(spark, sf_dir)
    damaged = F.when(F.col("o_orderkey") % 2 == 0, F.col("j")).otherwise(F.concat("j", F.lit(",")))
    out = df.select(passes_gate(damaged).alias("gate"), json_repair(damaged).alias("r"))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("gate") & F.col("r.was_repaired")).cast("long")).alias("wrongly_passed"))


@_register("native_fence", _PLAIN)
def native_fence(spark, sf_dir):
    return _orders(spark, sf_dir).select(*_fields(unwrap_simple_fence(DAMAGE["fenced"](F.col("j")))))


@_register("native_delimiters", _PLAIN)
def native_delimiters(spark, sf_dir):
    return _orders(spark, sf_dir).select(*_fields(plain_delimiters(DAMAGE["unicode"](F.col("j")))))


@_register("concat_refused", "SELECT o_orderkey::BIGINT AS k, 'Failed' AS status, '{\"z\":1}' AS text, 0.665::DOUBLE AS confidence FROM orders")
def concat_refused(spark, sf_dir):
    """Two values are refused as a concatenation; the extraction from prose then takes the last."""
    out = _repaired(_dealt(spark, sf_dir), F.concat("j", F.lit('{"z":1}')))
    status = F.filter("repair.text_repairs", lambda r: r["name"] == "concatenated-json")[0]["status"]
    return out.select(F.col("o_orderkey").cast("long").alias("k"), status.alias("status"), F.col("repair.repaired_text").alias("text"), F.round("repair.confidence", 6).alias("confidence"))


@_register("python_literals", "SELECT o_orderkey::BIGINT AS k, 'true' AS ok, true AS x_is_null, round(0.57, 4)::DOUBLE AS confidence FROM orders")
def python_literals(spark, sf_dir):
    text = F.concat(F.lit("{'k': "), F.col("o_orderkey").cast("string"), F.lit(", ok: True, x: None}"))
    out = _repaired(_dealt(spark, sf_dir), text)
    t = F.col("repair.repaired_text")
    return out.select(F.get_json_object(t, "$.k").cast("long").alias("k"), F.get_json_object(t, "$.ok").alias("ok"), t.contains('"x":null').alias("x_is_null"), F.round("repair.confidence", 4).alias("confidence"))


@_register("truncated_tail", "SELECT o_orderkey::BIGINT AS k, o_orderstatus AS s, NULL::VARCHAR AS p, 1::INTEGER AS corrections FROM orders")
def truncated_tail(spark, sf_dir):
    cut = F.substring_index("j", ":", 3)
    out = _repaired(_dealt(spark, sf_dir), F.concat(cut, F.lit(":")))
    return out.select(*_fields(F.col("repair.repaired_text")), F.col("repair.tolerant.correction_count").alias("corrections"))


@_register("embedded_quotes", "SELECT o_orderkey::BIGINT AS k, 'say \"' || o_orderstatus || '\" now' AS s FROM orders")
def embedded_quotes(spark, sf_dir):
    text = F.concat(F.lit('{"k":'), F.col("o_orderkey").cast("string"), F.lit(',"s":"say "'), F.get_json_object("j", "$.s"), F.lit('" now"}'))
    t = F.col("repair.repaired_text")
    return _repaired(_dealt(spark, sf_dir), text).select(F.get_json_object(t, "$.k").cast("long").alias("k"), F.get_json_object(t, "$.s").alias("s"))


#: Damage of each class in the mixed queries, with its corrections and confidence.
_CLASSES = (("fenced", 0, 0.95), ("xml", 0, 0.665), ("unquoted_keys", 2, 0.96), ("missing_closer", 1, 0.98), ("trailing_comma", 0, 1.0))


def _mixed(spark, sf_dir) -> DataFrame:
    which = F.col("o_orderkey") % len(_CLASSES)
    text, label = F.col("j"), F.lit("")
    for n, (name, _, _) in enumerate(_CLASSES):
        text = F.when(which == n, DAMAGE[name](F.col("j"))).otherwise(text)
        label = F.when(which == n, name).otherwise(label)
    return _repaired(_dealt(spark, sf_dir, label.alias("damage")), text)


def _cases(values: list) -> str:
    return "CASE o_orderkey % 5 " + " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(values)) + " END"


_NAMES = _cases([f"'{c[0]}'" for c in _CLASSES])


@_register("correction_counts", f"SELECT {_NAMES} AS damage, sum({_cases([c[1] for c in _CLASSES])})::BIGINT AS corrections FROM orders GROUP BY 1")
def correction_counts(spark, sf_dir):
    return _mixed(spark, sf_dir).groupBy("damage").agg(F.sum(F.coalesce("repair.tolerant.correction_count", F.lit(0))).alias("corrections"))


@_register("confidence_by_class", f"SELECT {_NAMES} AS damage, {_cases([c[2] for c in _CLASSES])}::DOUBLE AS lowest, {_cases([c[2] for c in _CLASSES])}::DOUBLE AS highest, true AS native_agrees FROM orders GROUP BY 1, 2, 3")
def confidence_by_class(spark, sf_dir):
    own, native = F.round("repair.confidence", 6), F.round(confidence(F.col("repair")), 6)
    return _mixed(spark, sf_dir).groupBy("damage").agg(F.min(own).alias("lowest"), F.max(own).alias("highest"), F.bool_and(own == native).alias("native_agrees"))


@_register("strategy_histogram", "SELECT 'markdown-json-fence' AS name, 'Succeeded' AS status, sum((o_orderkey % 5 = 0)::INTEGER)::BIGINT AS rows FROM orders UNION ALL SELECT 'xml-wrapped-extraction', 'Succeeded', sum((o_orderkey % 5 = 1)::INTEGER)::BIGINT FROM orders")
def strategy_histogram(spark, sf_dir):
    return audit.histogram(_mixed(spark, sf_dir)).filter("status = 'Succeeded'")


@_register("acceptance_by_segment", f"SELECT c_mktsegment AS segment, {_NAMES} AS damage, count(*)::BIGINT AS rows, count(*)::BIGINT AS accepted FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (1, 2)")
def acceptance_by_segment(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return audit.acceptance(_mixed(spark, sf_dir).join(customers, "o_custkey"), ["segment", "damage"]).select("segment", "damage", "rows", "accepted")


@_register("least_confident_orders", f"SELECT damage, k FROM (SELECT {_NAMES} AS damage, o_orderkey::BIGINT AS k, row_number() OVER (PARTITION BY {_NAMES} ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3")
def least_confident_orders(spark, sf_dir):
    return audit.least_confident(_mixed(spark, sf_dir), "damage", 3, "o_orderkey").select("damage", F.col("o_orderkey").cast("long").alias("k"))


# ---- schema-guided

_S = '{"type":"string"}'


def _schema(k: str = '{"type":"integer"}', s: str = _S, p: str = _S, more: str = "") -> str:
    return f'{{"type":"object","properties":{{"k":{k},"s":{s},"p":{p}}},"required":["k","s"]{more}}}'


def _shaped(name: str, text: Callable[[Column], Column], schema: str, options: Options | None = None, oracle: str = _PLAIN) -> None:
    @_register(name, oracle)
    def query(spark, sf_dir):
        out = _repaired(_dealt(spark, sf_dir), text(F.col("j")), schema, options)
        return out.filter("repair.is_repair_accepted").select(*_fields(F.col("repair.repaired_text")))


_sub = lambda j, old, new: F.regexp_replace(j, old, new)
_COERCE, _RENAME, _SHAPES = Options().with_coercions(), Options().with_required_reconciliation(), Options().with_structural_reconciliation()
_PRIORITIES = '{"type":"string","enum":["1-URGENT","2-HIGH","3-MEDIUM","4-NOT SPECIFIED","5-LOW"]}'
_shaped("optional_null", lambda j: _sub(j, r'"p":"[^"]*"', '"p":null'), _schema(), None, "SELECT o_orderkey::BIGINT AS k, o_orderstatus AS s, NULL::VARCHAR AS p FROM orders")
_shaped("scalar_to_string", lambda j: _sub(j, r'"p":"[^"]*"', '"p":42'), _schema(), None, "SELECT o_orderkey::BIGINT AS k, o_orderstatus AS s, '42' AS p FROM orders")
_shaped("array_wrap", lambda j: j, _schema(p='{"type":"array","items":{"type":"string"}}'), _COERCE, "SELECT o_orderkey::BIGINT AS k, o_orderstatus AS s, '[\"' || o_orderpriority || '\"]' AS p FROM orders")
_shaped("string_to_number", lambda j: _sub(j, r'"k":(\d+)', '"k":" $1 "'), _schema(), _COERCE)
_shaped("string_to_boolean", lambda j: _sub(j, r'"p":"[^"]*"', '"p":" TRUE"'), _schema(p='{"type":"boolean"}'), _COERCE, "SELECT o_orderkey::BIGINT AS k, o_orderstatus AS s, 'true' AS p FROM orders")
_shaped("enum_fuzzy", lambda j: _sub(_sub(j, "URGENT", "URGNT"), "MEDIUM", "medium"), _schema(p=_PRIORITIES), _COERCE)
_shaped("prune_unknown", lambda j: _sub(j, r'\{"k"', '{"zz":[1],"k"'), _schema(more=',"additionalProperties":false'), _COERCE)
_shaped("double_encoded", lambda j: _sub(j, r'"p":"([^"]*)"', '"p":"[\\\\"$1\\\\"]"'), _schema(p='{"type":"array","items":{"type":"string"}}'), None, "SELECT o_orderkey::BIGINT AS k, o_orderstatus AS s, '[\"' || o_orderpriority || '\"]' AS p FROM orders")

_LONG = '{"type":"object","properties":{"orderkey":{"type":"integer"},"status":{"type":"string"}},"required":["orderkey","status"]}'


def _long_keys(j: Column, key: str, status: str) -> Column:
    return F.concat(F.lit(f'{{"{key}":'), F.get_json_object(j, "$.k"), F.lit(f',"{status}":"'), F.get_json_object(j, "$.s"), F.lit('"}'))


@_register("rename_required", "SELECT o_orderkey::BIGINT AS k, o_orderstatus AS s FROM orders")
def rename_required(spark, sf_dir):
    """A transposed and a differently cased required key."""
    out = _repaired(_dealt(spark, sf_dir), _long_keys(F.col("j"), "Order_Key", "sttaus"), _LONG, _RENAME)
    t = F.col("repair.repaired_text")
    return out.filter("repair.is_repair_accepted").select(F.get_json_object(t, "$.orderkey").cast("long").alias("k"), F.get_json_object(t, "$.status").alias("s"))


@_register("structural_map", "SELECT o_orderkey::BIGINT AS k, o_orderpriority AS p FROM orders")
def structural_map(spark, sf_dir):
    """An unrelated key whose value is a member of the missing property's enum."""
    schema = f'{{"type":"object","properties":{{"k":{{"type":"integer"}},"priority":{_PRIORITIES}}},"required":["k","priority"]}}'
    text = F.concat(F.lit('{"k":'), F.get_json_object("j", "$.k"), F.lit(',"zz":"'), F.get_json_object("j", "$.p"), F.lit('"}'))
    t = F.col("repair.repaired_text")
    out = _repaired(_dealt(spark, sf_dir), text, schema, _SHAPES)
    return out.filter("repair.is_repair_accepted").select(F.get_json_object(t, "$.k").cast("long").alias("k"), F.get_json_object(t, "$.priority").alias("p"))


@_register("shape_errors", "SELECT o_orderkey::BIGINT AS k, CASE o_orderkey % 3 WHEN 0 THEN '$.s is required.' WHEN 1 THEN '$.k expected integer but found string.' ELSE '' END AS errors FROM orders")
def shape_errors(spark, sf_dir):
    df = _dealt(spark, sf_dir)
    text = F.when(F.col("o_orderkey") % 3 == 0, _sub(F.col("j"), '"s":', '"t":')).when(F.col("o_orderkey") % 3 == 1, _sub(F.col("j"), r'"k":(\d+)', '"k":"$1"')).otherwise(F.col("j"))
    return df.select(F.col("o_orderkey").cast("long").alias("k"), F.array_join(json_shape_errors(text, _schema()), "; ").alias("errors"))


@_register("rollback_chain", "SELECT '\"[1, 2]\"' AS text, 'Mismatched' AS shape_status, count(*)::BIGINT AS rows FROM orders")
def rollback_chain(spark, sf_dir):
    """A step that lowers no error is rolled back: the text stays as it was."""
    schema = '{"type":"array","items":{"type":"object","required":["a","b"],"properties":{"a":{"type":"string"},"b":{"type":"string"}}}}'
    out = _repaired(_dealt(spark, sf_dir), F.lit('"[1, 2]"'), schema)
    return out.groupBy(F.col("repair.repaired_text").alias("text"), F.col("repair.shape_status").alias("shape_status")).agg(F.count(F.lit(1)).alias("rows"))


# ---- cases: damage and schemas that the orders alone do not meet


def _case_query(name: str, table: list, options: Options | None = None) -> None:
    """Every order meets one case of the table, by its key."""
    which = f"o_orderkey % {len(table)}"
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    case = lambda at, kind: f"CASE {which} " + " ".join(f"WHEN {n} THEN {quoted(c[at]) if kind == 'VARCHAR' else c[at]}" for n, c in enumerate(table)) + f" END::{kind}"

    @_register(name, f"SELECT o_orderkey::BIGINT AS k, replace({case(1, 'VARCHAR')}, '<K>', o_orderkey::VARCHAR) AS text, {case(2, 'INTEGER')} AS corrections, {case(3, 'DOUBLE')} AS confidence FROM orders")
    def query(spark, sf_dir):
        text, schema = F.lit(None).cast("string"), F.lit(None).cast("string")
        for n, (damaged, _, _, _, wanted) in enumerate(table):
            here = F.col("o_orderkey") % len(table) == n
            text = F.when(here, F.replace(F.lit(damaged), F.lit("<K>"), F.col("o_orderkey").cast("string"))).otherwise(text)
            schema = F.when(here, F.lit(wanted)).otherwise(schema)
        rows = _dealt(spark, sf_dir).withColumns({"payload": text, "wanted": schema})
        out = repair_df(rows, "payload", F.col("wanted"), options)
        corrections = F.coalesce("repair.tolerant.correction_count", F.lit(0))
        return out.select(F.col("o_orderkey").cast("long").alias("k"), F.col("repair.repaired_text").alias("text"), corrections.alias("corrections"), F.round("repair.confidence", 6).alias("confidence"))


_case_query("object_cases", cases.OBJECTS)
_case_query("array_cases", cases.ARRAYS)
_case_query("string_cases", cases.STRINGS)
_case_query("value_cases", cases.VALUES)
_case_query("salvage_cases", cases.SALVAGE)
_case_query("failure_cases", cases.FAILURES, Options().without_salvage())
_case_query("schema_cases", cases.SCHEMAS, _COERCE)
_case_query("union_cases", cases.UNIONS)

#: Options with one limit, a text that exceeds it, and the error.
_LIMITS = (
    (Options(limits=Limits(input=5)), '{"a":1000}', None, "Input length 10 exceeds the configured maximum of 5 characters."),
    (Options(limits=Limits(output=5)), "{a:1000}", None, "Repaired output length 10 exceeds the configured maximum of 5 characters."),
    (Options(limits=Limits(depth=3)), "{a:[[[[1", None, "Tolerant recovery exceeded the maximum nesting depth of 3."),
    (Options(limits=Limits(corrections=2)), "{a:1,b:2,c:3}", None, "Tolerant recovery exceeded the maximum of 2 corrections."),
    (Options(limits=Limits(corrections=2)).with_coercions(), '{"k":"1","s":1,"p":2,}', '{"type":"object","properties":{"k":{"type":"integer"},"s":{"type":"string"},"p":{"type":"string"}}}', "Repair exceeded the maximum of 2 corrections."),
)


@_register("limit_errors", " UNION ALL ".join(f"SELECT 'limit' AS kind, '{m}' AS message, count(*)::BIGINT AS rows FROM orders" for *_, m in _LIMITS))
def limit_errors(spark, sf_dir):
    """Each limit as an error in the row, and the correction budget across phases."""
    out = None
    for options, text, schema, _ in _LIMITS:
        rows = repair_df(_orders(spark, sf_dir).withColumn("payload", F.lit(text)), "payload", schema, options, native_gate=False)
        counts = rows.groupBy(F.col("repair.error.kind").alias("kind"), F.col("repair.error.message").alias("message")).agg(F.count(F.lit(1)).alias("rows"))
        out = counts if out is None else out.unionByName(counts)
    return out


def _without_marks(text: str):
    from jsonmend.kernel.texts import NOT_APPLICABLE, REPAIRED, Attempt

    return Attempt(REPAIRED, text.replace("@@", "")) if "@@" in text else Attempt(NOT_APPLICABLE)


def _faulty(text: str):
    raise RuntimeError("out of order")


@_register("custom_steps", "SELECT o_orderkey::BIGINT AS k, o_orderstatus AS s, o_orderpriority AS p, 'drop-marks' AS winner, 'RuntimeError: out of order' AS note, 4::INTEGER AS steps FROM orders")
def custom_steps(spark, sf_dir):
    """A step of one's own, one that raises and fails alone, and fewer built-in ones."""
    options = Options().clear("text").without_salvage().add("text", "faulty", _faulty).add("text", "drop-marks", _without_marks)
    options = options.insert_after("text", "faulty", "idle", lambda text: ("NotApplicable", None)).add("salvage", "last", _without_marks).remove("node", options.node_steps[0][0])
    out = _repaired(_dealt(spark, sf_dir), F.concat(F.lit("@@"), "j"), None, options)
    r = F.col("repair")
    return out.select(*_fields(r["repaired_text"]), r["succeeded_by"].alias("winner"), r["text_repairs"][0]["note"].alias("note"), F.size(r["text_repairs"]).alias("steps"))


@_register("confident_rows", f"SELECT {_NAMES} AS damage, count(*)::BIGINT AS rows FROM orders WHERE {_cases([c[2] for c in _CLASSES])} >= 0.95 GROUP BY 1")
def confident_rows(spark, sf_dir):
    return _mixed(spark, sf_dir).filter(is_confident(F.col("repair"), 0.95 - 1e-9)).groupBy("damage").agg(F.count(F.lit(1)).alias("rows"))


@_register("bounded_notes", "SELECT o_orderkey::BIGINT AS k, 8::INTEGER AS listed, '4 additional mappings omitted' AS tail FROM orders")
def bounded_notes(spark, sf_dir):
    names = [f"field_{n:02}" for n in range(12)]
    schema = '{"type":"object","properties":{' + ",".join(f'"{n}":{{"type":"integer"}}' for n in names) + '},"required":[' + ",".join(f'"{n}"' for n in names) + "]}"
    given = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n.title()}":'), F.col("o_orderkey").cast("string")) for n in names]), F.lit("}"))
    out = _repaired(_dealt(spark, sf_dir), given, schema, _RENAME)
    note = F.split(F.filter("repair.node_repairs", lambda r: r["status"] == "Succeeded")[0]["note"], "; ")
    return out.select(F.col("o_orderkey").cast("long").alias("k"), (F.size(note) - 1).alias("listed"), F.element_at(note, -1).alias("tail"))


@_register("sql_functions", "SELECT o_orderkey::BIGINT AS k, o_orderstatus AS s, o_orderpriority AS p, 'Succeeded' AS fence FROM orders")
def sql_functions(spark, sf_dir):
    """The SQL function and the table function."""
    register(spark)
    _dealt(spark, sf_dir).select("o_orderkey", DAMAGE["fenced"](F.col("j")).alias("payload")).createOrReplaceTempView("jsonmend_payloads")
    rows = spark.sql("SELECT json_repair(p.payload, NULL) AS r, f.status AS fence FROM jsonmend_payloads p, LATERAL repair_reports(p.payload, CAST(NULL AS STRING)) f WHERE f.name = 'markdown-json-fence'")
    return rows.select(*_fields(F.col("r.repaired_text")), "fence")


@_register("argument_codecs", "SELECT o_orderkey::BIGINT AS k, o_orderstatus AS s, o_orderpriority AS p, true AS refused FROM orders")
def argument_codecs(spark, sf_dir):
    """Arguments to a map of variants and back; anything but an object is refused."""
    back = arguments_to_json(arguments_from_json(F.col("j")))
    return _orders(spark, sf_dir).select(*_fields(back), arguments_from_json(F.concat(F.lit("["), "j", F.lit("]"))).isNull().alias("refused"))


@_register("struct_schema", "SELECT o_orderkey::BIGINT AS k, CASE o_orderkey % 2 WHEN 0 THEN '$.k is required.' ELSE '' END AS errors FROM orders")
def struct_schema(spark, sf_dir):
    """The schema of a Spark type judges the rows."""
    from pyspark.sql import types as T

    kind = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("s", T.StringType()), T.StructField("more", T.MapType(T.StringType(), T.DoubleType()))])
    text = F.when(F.col("o_orderkey") % 2 == 0, _sub(F.col("j"), '"k":', '"z":')).otherwise(F.col("j"))
    return _dealt(spark, sf_dir).select(F.col("o_orderkey").cast("long").alias("k"), F.array_join(json_shape_errors(text, schema_text(kind)), "; ").alias("errors"))


@_register("one_shot", _PLAIN)
def one_shot(spark, sf_dir):
    """The one-call helper with a configured engine, row by row in a vectorised function."""

    @F.pandas_udf("string")
    def helper(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: repair_text(t, None, Options.without_salvage).check().text_or_raise())

    return _dealt(spark, sf_dir).select(*_fields(helper(DAMAGE["trailing_comma"](F.col("j")))))


# ---- chat


def _calls(spark, sf_dir, name: Column) -> DataFrame:
    return _dealt(spark, sf_dir).select(F.col("o_orderkey").cast("long").alias("id"), name.alias("name"), DAMAGE["missing_closer"](F.col("j")).alias("arguments"))


def _tools(spark) -> DataFrame:
    rows = [("get_order", '{"type":"string"}'), ("get_order", _schema()), ("get_order", '{"type":"object"}'), ("put_order", _schema(p='{"type":"integer"}')), ("other", '{"type":"object"}')]
    return spark.createDataFrame(rows, "name string, schema_json string")


_TOOL = "CASE o_orderkey % 3 WHEN 0 THEN 'get_order' WHEN 1 THEN 'put_order' ELSE 'unlisted' END"


@_register("tool_calls", f"SELECT o_orderkey::BIGINT AS k, o_orderstatus AS s, o_orderpriority AS p, {_TOOL} AS name, 'function:' || {_TOOL} AS target, o_orderkey % 3 = 1 AS mismatched FROM orders")
def tool_calls(spark, sf_dir):
    """Calls of a listed tool, of one whose schema the arguments break (they stay damaged), and of an unlisted one."""
    which = F.col("o_orderkey") % 3
    calls = _calls(spark, sf_dir, F.when(which == 0, "get_order").when(which == 1, "put_order").otherwise("unlisted"))
    out = chat.repair_tool_calls(calls, _tools(spark))
    whole = F.when(F.col("arguments").endswith("}"), F.col("arguments")).otherwise(F.concat("arguments", F.lit("}")))
    return out.select(*_fields(whole), "name", F.col("repair_target").alias("target"), (~F.col("arguments").endswith("}")).alias("mismatched"))


@_register("hot_tool_calls", "SELECT 'get_order' AS name, count(*)::BIGINT AS rows, count(*)::BIGINT AS repaired FROM orders")
def hot_tool_calls(spark, sf_dir):
    """All calls name one tool."""
    out = chat.repair_tool_calls(_calls(spark, sf_dir, F.lit("get_order")), _tools(spark))
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("arguments").endswith("}").cast("long")).alias("repaired"))


@_register("raw_arguments", "SELECT o_orderkey::BIGINT AS k, o_orderstatus AS s, o_orderpriority AS p, o_orderkey % 2 = 0 AS informational FROM orders")
def raw_arguments(spark, sf_dir):
    """The provider's text where the arguments are null; informational calls keep their null."""
    calls = _calls(spark, sf_dir, F.lit("get_order")).withColumnRenamed("arguments", "sent").withColumns({"arguments": F.lit(None).cast("string"), "informational": F.col("id") % 2 == 0})
    out = calls.transform(chat.with_repaired_calls(_tools(spark), raw="sent"))
    text = F.when(F.col("informational") & F.col("arguments").isNull(), F.concat("sent", F.lit("}"))).otherwise(F.col("arguments"))
    return out.select(*_fields(text), "informational")


@_register("chat_toggles", "SELECT count(*)::BIGINT AS rows, count(*)::BIGINT AS unchanged, 0::BIGINT AS audit_columns FROM orders")
def chat_toggles(spark, sf_dir):
    calls = _calls(spark, sf_dir, F.lit("get_order"))
    off = chat.ChatOptions(repair_calls=False, keep_audit=False)
    out = chat.repair_tool_calls(calls, _tools(spark), chat=off)
    extra = len(set(out.columns) - set(calls.columns))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.col("arguments").endswith("}")).cast("long")).alias("unchanged"), F.lit(extra).cast("long").alias("audit_columns"))


@_register("response_texts", "SELECT o_orderkey::BIGINT AS k, o_orderkey % 3 <> 2 AS replaced, 'response-text' AS target FROM orders")
def response_texts(spark, sf_dir):
    """Texts with a response schema, texts that look like JSON, and prose that stays."""
    which = F.col("o_orderkey") % 3
    text = F.when(which == 0, F.concat("j", F.lit(","))).when(which == 1, DAMAGE["fenced"](F.col("j"))).otherwise(F.lit("No JSON here."))
    messages = _dealt(spark, sf_dir).select("o_orderkey", text.alias("text"), F.col("j"), F.when(which == 0, _schema()).alias("wanted"))
    out = messages.transform(chat.with_repaired_texts(chat=chat.ChatOptions(texts_without_schema=True), schema=F.col("wanted")))
    return out.select(F.col("o_orderkey").cast("long").alias("k"), (F.col("text") == F.col("j")).alias("replaced"), F.col("repair_target").alias("target"))


@_register("notifications", "SELECT 'function:get_order' AS target, true AS succeeded, 0.98::DOUBLE AS confidence, count(*)::BIGINT AS rows FROM orders")
def notifications(spark, sf_dir):
    told = audit.notifications(chat.repair_tool_calls(_calls(spark, sf_dir, F.lit("get_order")), _tools(spark)))
    return told.groupBy("target", "succeeded", F.round("confidence", 6).alias("confidence")).agg(F.count(F.lit(1)).alias("rows"))


@_register("plausibility_guard", "SELECT count(*)::BIGINT AS rows, count(*)::BIGINT AS unchanged FROM orders")
def plausibility_guard(spark, sf_dir):
    """Prose is not replaced by the string that salvage makes of it."""
    messages = _dealt(spark, sf_dir).select(F.lit("None of this is JSON.").alias("text"))
    out = chat.repair_response_texts(messages, json_format=F.lit(True))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("text") == "None of this is JSON.").cast("long")).alias("unchanged"))


@_register("stream_completed", "SELECT event_id::BIGINT AS event_id, props AS text FROM events")
def stream_completed(spark, sf_dir):
    """The stream kernel over three chunks a payload, out of order, replayed as a batch."""
    third = F.ceil(F.length("props") / 3).cast("int")

    @F.pandas_udf("string")
    def replay(props, size):
        out = []
        for text, n in zip(props, size, strict=True):
            parts = [text[a : a + n] for a in range(0, len(text), n)]
            chunks = [(k, c, k == len(parts) - 1) for k, c in enumerate(parts)]
            state, _, _ = feed(None, chunks[1:], 1 << 22)
            state, _, done = feed(state, chunks[:1], 1 << 22)
            out.append(state.text if done else None)
        return pd.Series(out)

    return spread(_table(spark, sf_dir, "events").select("event_id", "props")).select(F.col("event_id").cast("long").alias("event_id"), replay("props", third).alias("text"))


def _shared(spark) -> str:
    """A new folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/jsonmend-stream-{uuid.uuid4().hex}"


#: Ends of stable text within ``{"k":…,"s":"…","p":"…"}`` whose key has ``d`` digits; the last brace never comes and 16 characters are held back.
_STABLE = "list_max(list_filter([1, 4, 5, 6 + d, 9 + d, 10 + d, 13 + d, 14 + d, 17 + d, 18 + d], lambda x: x <= length(j) - 17))"


@_register("stream_deltas", f"""WITH o AS (SELECT *, length(o_orderkey::VARCHAR) AS d, '{{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '","p":"' || o_orderpriority || '"}}' AS j FROM orders)
SELECT o_orderkey::BIGINT AS k, substr(j, 1, {_STABLE}) AS deltas, j AS text, true AS succeeded, 0.98::DOUBLE AS confidence, NULL::BIGINT AS missing_seq FROM o""")
def stream_deltas(spark, sf_dir):
    """A real stream over the orders' texts without their last brace, in three chunks of which the middle one comes last."""
    folder = _shared(spark)
    text = DAMAGE["missing_closer"](F.col("j"))
    third = F.ceil(F.length(text) / 3).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda n: F.struct(n.cast("long").alias("seq"), F.substring(text, n * third + 1, third).alias("chunk"), (n == 2).alias("is_last")))
    chunks = _dealt(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("stream_id"), F.explode(parts).alias("c")).select("stream_id", "c.*")
    for late in (False, True):  # two runs of the stream, the second with the missing chunk
        chunks.filter((F.col("seq") == 1) == late).write.mode("append").parquet(f"{folder}/chunks")
        source = spark.readStream.schema("stream_id string, seq long, chunk string, is_last boolean").parquet(f"{folder}/chunks")
        events = repair_stream(source, timeout_ms=None).writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/state")
        events.trigger(availableNow=True).start().awaitTermination()
    told = spark.read.parquet(f"{folder}/events")
    deltas = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "delta", F.struct("offset", "text")))), lambda d: d["text"]), "")
    done = F.max(F.when(F.col("kind") == "completed", F.struct("text", "repair", "missing_seq"))).alias("done")
    rows = told.withColumn("repair", F.struct("repair.succeeded", "repair.confidence")).groupBy("stream_id").agg(deltas.alias("deltas"), done)
    return rows.select(F.col("stream_id").cast("long").alias("k"), "deltas", "done.text", "done.repair.succeeded", F.round("done.repair.confidence", 6).alias("confidence"), "done.missing_seq")
