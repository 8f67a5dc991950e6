"""Deterministic damage to valid JSON, as Column expressions, and readers of text payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def _swap(j: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        j = F.replace(j, F.lit(old), F.lit(new))
    return j


def _around(before: str, after: str = "") -> Callable[[Column], Column]:
    return lambda j: F.concat(F.lit(before), j, F.lit(after))


#: Damage by name, for objects {"k": number, "s": string, "p": string}.
DAMAGE: dict[str, Callable[[Column], Column]] = {
    "fenced": _around("```json\n", "\n```\nThat is all."),
    "unicode": lambda j: F.translate(j, '"{}:', "“｛｝："),
    "xml": _around("<answer>\n", "\n</answer>"),
    "cdata": _around("<answer><![CDATA[", "]]></answer>"),
    "trailing_junk": _around("", "]"),
    "prose": _around("Here is the JSON: "),
    "verbatim": lambda j: _swap(j, ('"s":"', '"s":@"')),
    "template": lambda j: F.regexp_replace(j, r'"s":"([^"]*)"', '"s":`$1`'),
    "missing_closer": lambda j: F.substring(j, F.lit(1), F.length(j) - 1),
    "missing_comma": lambda j: _swap(j, (',"s"', ' "s"')),
    "missing_colon": lambda j: _swap(j, ('"s":', '"s" ')),
    "unquoted_keys": lambda j: _swap(j, ('"k":', "k:"), ('"s":', "s:")),
    "single_quoted": lambda j: F.regexp_replace(j, r'"s":"([^"]*)"', "\"s\":'$1'"),
    "trailing_comma": lambda j: _swap(j, ("}", ",}")),
    "comments": lambda j: _swap(j, (',"s"', ', /* status */ "s"'), ("{", "{ // order\n")),
    "stray_closer": lambda j: _swap(j, (',"p"', '},"p"')),
}


def read_payloads(spark: SparkSession, path: str, kind: str = "text", column: str = "payload") -> DataFrame:
    """Payload texts from text files (one a line, or one a file), JSON lines or Parquet."""
    if kind == "text":
        return spark.read.text(path).withColumnRenamed("value", column)
    if kind == "whole":
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", column)
    if kind in ("json", "parquet"):
        return spark.read.format(kind).load(path)
    raise ValueError(f"unknown kind {kind}")
