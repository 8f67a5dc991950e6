"""Repair over DataFrames: whole columns, with the native gate in front."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonmend.functions.repair import json_repair, passes_gate
from jsonmend.functions.result import RESULT_TYPE
from jsonmend.kernel.engine import Options


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def untouched(text: Column, options: Options) -> Column:
    """The result of a text that the strict gate accepts and no schema judges."""
    idle = lambda steps: F.array(*[F.struct(F.lit(n).alias("name"), F.lit("Skipped").alias("status"), F.lit(None).cast("string").alias("note")) for n, _ in steps])
    parts = {
        "succeeded": F.lit(True),
        "is_repair_accepted": F.lit(True),
        "was_repaired": F.lit(False),
        "repaired_text": text,
        "shape_status": F.lit("NotEvaluated"),
        "shape_errors": F.array().cast("array<string>"),
        "text_repairs": idle((*options.text_steps, *options.salvage_steps)),
        "node_repairs": idle(options.node_steps),
        "tolerant": F.lit(None),
        "succeeded_by": F.lit(None),
        "confidence": F.lit(1.0),
        "error": F.lit(None),
    }
    return F.struct(*[c.alias(n) for n, c in parts.items()]).cast(RESULT_TYPE)


#: Tasks that inputs of several partitions get for each of them, or for each core if there are more of those.
TASKS = 16


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out evenly, row by row, once.

    The kernel is bound by rows, not by bytes: Spark packs small files into one
    partition, and cuts a large file into pieces of which only those that hold
    the middle of a row group get rows.  So a task a core for a single
    partition, and for more ``TASKS`` times as many as there are partitions
    or cores: their number grows with the input, and no file layout, however
    few its row groups, gives one task many of its rows.

    Spark sorts what it deals round by round, so that a task that runs again
    deals alike; in the one task that reads a row group, the sort spills.
    Where ``keys`` differ from row to row, their hash deals as evenly and
    needs no sort.
    """
    if df.isStreaming:
        return df
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        if "Repartition" in df._jdf.queryExecution().optimizedPlan().toString():  # dealt out already
            return df
        have = df.rdd.getNumPartitions()
    except PySparkException:  # a session without partitions to look at
        return df
    return df.repartition(cores if have < 2 else TASKS * max(cores, have), *keys)


def repair_df(df: DataFrame, column: str, schema: str | Column | None = None, options: Options | None = None, out: str = "repair", native_gate: bool = True) -> DataFrame:
    """``df`` with the result struct in ``out`` (replacing a column of that name).

    Without a schema, texts that pass the native gate never reach Python: the
    kernel gets null for them and their result is built in place.
    """
    options = options or Options()
    df = spread(df)
    text = F.col(column).cast("string")
    if schema is not None or not native_gate:
        return df.withColumn(out, json_repair(text, schema, options))
    gate, kernel = fresh(df, "__gate"), fresh(df, "__kernel")
    run = df.withColumn(gate, passes_gate(text)).withColumn(kernel, json_repair(F.when(~F.col(gate), text), None, options))
    result = F.when(text.isNotNull(), F.when(F.col(gate), untouched(text, options)).otherwise(F.col(kernel)))
    return run.withColumn(out, result).drop(gate, kernel)
