"""Relational analytics over repair results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reports(df: DataFrame, result: str = "repair", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a step: ``keys``, phase, place, name, status, note."""
    each = lambda phase, field: df.select(*keys, F.lit(phase).alias("phase"), F.posexplode(f"{result}.{field}").alias("place", "r"))
    both = each("text", "text_repairs").unionByName(each("node", "node_repairs"))
    return both.select(*keys, "phase", "place", "r.name", "r.status", "r.note")


def histogram(df: DataFrame, result: str = "repair") -> DataFrame:
    """Rows by step and status."""
    return reports(df, result).groupBy("name", "status").agg(F.count(F.lit(1)).alias("rows"))


def acceptance(df: DataFrame, by: list[Column | str], result: str = "repair") -> DataFrame:
    """Rows, accepted rows and mean confidence of each group, with subtotals (rollup)."""
    r = F.col(result)
    return df.rollup(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum(r["is_repair_accepted"].cast("long")).alias("accepted"), F.avg(r["confidence"]).alias("mean_confidence"))


def least_confident(df: DataFrame, by: str, k: int, order: str, result: str = "repair") -> DataFrame:
    """The ``k`` least confident rows of each group, ties by ``order``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col(result)["confidence"], order))
    return df.withColumn("place", place).filter(F.col("place") <= k)


def notifications(df: DataFrame, result: str = "repair", target: str | Column | None = "repair_target", keys: tuple[str, ...] = ()) -> DataFrame:
    """One payload-free row a repair that was tried: ``keys``, target, outcome, shape errors, steps, tolerant recovery, confidence.

    ``target`` is what was repaired: a column such as ``function:<name>`` or
    ``response-text``; None leaves it null.
    """
    r = F.col(result)
    named = F.lit(None).cast("string") if target is None else F.col(target) if isinstance(target, str) else target
    fields = ("succeeded", "was_repaired", "shape_status", "shape_errors", "text_repairs", "node_repairs", "tolerant", "succeeded_by", "confidence", "error")
    return df.filter(r.isNotNull()).select(*keys, named.alias("target"), *[r[n].alias(n) for n in fields])


def write_audit(df: DataFrame, path: str, result: str = "repair", keys: tuple[str, ...] = (), target: str | Column | None = None) -> None:
    """Append the notifications to a Parquet table."""
    notifications(df, result, target, keys).write.mode("append").parquet(path)


def audit_sink(path: str, result: str = "repair", keys: tuple[str, ...] = (), target: str | Column | None = "repair_target") -> Callable[[DataFrame, int], None]:
    """The same for ``writeStream.foreachBatch``; a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        notifications(batch, result, target, keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def observed(df: DataFrame, name="repair_metrics", result: str = "repair") -> DataFrame:
    """``df`` with outcome counters (``name``: a name or an ``Observation``) that Spark collects while another action runs."""
    r = F.col(result)
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return df.observe(
        name,
        F.count(F.lit(1)).alias("rows"),
        count(~r["succeeded"]).alias("failed"),
        count(r["shape_status"] == "Mismatched").alias("mismatched"),
        count(r["was_repaired"] & r["is_repair_accepted"]).alias("repaired"),
        count(r["succeeded"] & ~r["was_repaired"]).alias("unchanged"),
    )
