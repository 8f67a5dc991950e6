"""Chat messages and tool calls as tables; every function takes batch and streaming tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jsonmend.functions.repair import json_repair
from jsonmend.kernel.engine import Options
from jsonmend.operators.frame import fresh

#: Characters of names and schemas up to which a tool table is sent to all executors.
SMALL_TOOLS = 8_000_000


@dataclass(frozen=True)
class ChatOptions:
    """What is repaired, and whether the audit columns ``repair`` and ``repair_target`` stay."""

    repair_calls: bool = True
    repair_texts: bool = True
    texts_without_schema: bool = False
    keep_audit: bool = True


def tool_schemas(tools: DataFrame, order: str | None = None) -> DataFrame:
    """(name, schema_json) with one row a name: the first listed, or the first by ``order``; object schemas only."""
    read = lambda path: F.get_json_object("schema_json", path)
    usable = (read("$.type") == "object") | read("$.properties").isNotNull() | read("$.oneOf").isNotNull()
    listed = tools.select("name", "schema_json", (F.col(order) if order else F.monotonically_increasing_id()).alias("listed"))
    first = listed.filter(usable).groupBy("name").agg(F.min(F.struct("listed", "schema_json")).alias("first"))
    return first.select("name", F.col("first.schema_json").alias("schema_json"))


def _audited(df: DataFrame, target: Column, chat: ChatOptions) -> DataFrame:
    return df.withColumn("repair_target", target) if chat.keep_audit else df.drop("repair")


def repair_tool_calls(
    calls: DataFrame, tools: DataFrame, options: Options | None = None, order: str | None = None, resolver: Column | None = None, chat: ChatOptions = ChatOptions(), raw: str | None = None
) -> DataFrame:
    """``calls`` (name, arguments, informational, …) with repaired ``arguments``, ``repair`` and ``repair_target``.

    A schema comes from ``resolver`` (an expression over ``calls``) or else from
    the tool table.  Where ``arguments`` is null, the column named ``raw`` (the
    provider's text) is repaired in its place.  Arguments are replaced only by
    an accepted object that differs; informational calls, or all without
    ``repair_calls``, stay as they are.  The tools' size is checked once: up to
    ``SMALL_TOOLS`` they go to the calls, beyond that both sides are shuffled by
    name.  The calls are never broadcast.
    """
    known = tool_schemas(tools, order)
    own_name, own_schema = fresh(calls, "tool_name"), fresh(calls, "tool_schema")
    known = known.select(F.col("name").alias(own_name), F.col("schema_json").alias(own_schema))
    size = known.agg(F.sum(F.length(own_name) + F.length(own_schema)).alias("n")).first()["n"] or 0
    known = F.broadcast(known) if size <= SMALL_TOOLS else known.hint("shuffle_merge")
    joined = calls.join(known, calls["name"] == known[own_name], "left")
    schema = F.coalesce(resolver, F.col(own_schema)) if resolver is not None else F.col(own_schema)
    given = F.coalesce("arguments", raw) if raw is not None else F.col("arguments")
    active = ~F.coalesce(F.col("informational"), F.lit(False)) if "informational" in calls.columns else F.lit(True)
    wanted = F.when(active & ~given.rlike(r"^\s*$"), given) if chat.repair_calls else F.lit(None).cast("string")
    run = joined.withColumn("repair", json_repair(wanted, schema, options))
    r = F.col("repair")
    take = r["is_repair_accepted"] & (r["was_repaired"] | F.col("arguments").isNull()) & r["repaired_text"].startswith("{")
    out = run.withColumn("arguments", F.when(take, r["repaired_text"]).otherwise(F.col("arguments"))).drop(own_name, own_schema)
    return _audited(out, F.concat(F.lit("function:"), "name"), chat)


def plausible(text: Column) -> Column:
    """Whether a text looks like a JSON container or a fence."""
    return F.ltrim(text).rlike(r"^(?:[{\[]|`{3})")


def repair_response_texts(messages: DataFrame, column: str = "text", schema: Column | None = None, json_format: Column | None = None, chat: ChatOptions = ChatOptions(), options: Options | None = None) -> DataFrame:
    """``messages`` with repaired response texts, ``repair`` and ``repair_target``.

    A text is tried if a schema or JSON format is expected, or, on request, if it
    looks like JSON; without a schema only containers replace it.
    """
    text = F.col(column)
    expected = schema.isNotNull() if schema is not None else F.lit(False)
    asked = expected | (json_format if json_format is not None else F.lit(False))
    if chat.texts_without_schema:
        asked = asked | plausible(text)
    wanted = F.when(asked, text) if chat.repair_texts else F.lit(None).cast("string")
    run = messages.withColumn("repair", json_repair(wanted, schema if schema is not None else None, options))
    r = F.col("repair")
    take = r["is_repair_accepted"] & r["was_repaired"] & (expected | r["repaired_text"].rlike(r"^[{\[]"))
    out = run.withColumn(column, F.when(take, r["repaired_text"]).otherwise(text))
    return _audited(out, F.lit("response-text"), chat)


def with_repaired_calls(tools: DataFrame, options: Options | None = None, chat: ChatOptions = ChatOptions(), **more) -> Callable[[DataFrame], DataFrame]:
    """``repair_tool_calls`` for ``DataFrame.transform``."""
    return lambda calls: repair_tool_calls(calls, tools, options, chat=chat, **more)


def with_repaired_texts(options: Options | None = None, chat: ChatOptions = ChatOptions(), **more) -> Callable[[DataFrame], DataFrame]:
    """``repair_response_texts`` for ``DataFrame.transform``."""
    return lambda messages: repair_response_texts(messages, options=options, chat=chat, **more)
