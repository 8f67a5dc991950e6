"""Column functions: repair, shape errors, the native gate and native text steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from jsonmend.functions.result import RESULT_TYPE, as_array
from jsonmend.kernel import texts
from jsonmend.kernel.engine import Options, engine_for
from jsonmend.kernel.schema import compile_schema
from jsonmend.kernel.values import parse

_MARK = "~gate~"


#: Scalars and brackets of JSON with the white space after them; closed runs of such between separators.  Possessive: Java then neither backtracks nor recurses.
_GAP = r"[ \t\r\n]*+"
_ATOM = rf'(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][-+.eE0-9]*+|true|false|null){_GAP}'
_PART = rf"(?:(?:[{{\[]{_GAP})*+{_ATOM}(?:[}}\]]{_GAP})*+|(?:[{{\[]{_GAP})++(?:[}}\]]{_GAP})++)"
_SEQUENCE = rf"(?s)^{_GAP}{_PART}(?:[:,]{_GAP}{_PART})*+\z"


def in_sequence(text: Column) -> Column:
    """Whether the tokens of a text could follow each other so in JSON: true for all JSON, false for most damage, at the cost of one pattern."""
    return text.rlike(_SEQUENCE) & text.rlike(r"[}\]][ \t\r\n]*+\z")


def passes_gate(text: Column) -> Column:
    """A native sufficient test for strict JSON: true only for texts that the kernel's gate accepts.

    The text is put into an array before a sentinel; the sentinel is found second
    exactly if the text is one value.  Texts that hold the sentinel, a bare null
    or many openers are left to the kernel.  Only texts that pass the cheap tests
    are parsed, once: to parse a damaged text costs an exception.
    """
    openers = F.length(text) - F.length(F.translate(text, "{[", ""))
    container = F.substring(F.ltrim(text), 1, 1).isin("{", "[")
    plain = ~F.contains(text, F.lit(_MARK)) & (openers <= 60) & container & ~text.rlike(r"[^\t\n\r\x20-\x{10FFFF}]|\x{FEFF}")
    tried = F.when(plain & in_sequence(text), text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), tried, F.lit(f',"{_MARK}"]')))
    second = F.try_variant_get(wrapped, "$[1]", "string") == _MARK
    third = F.try_variant_get(wrapped, "$[2]", "variant").isNull()
    return F.coalesce(second & third, F.lit(False))


def repaired(texts: list[str | None], schemas: list[str | None], options: Options) -> pa.Array:
    """The results of a batch; a text and schema that it repeats are repaired once."""
    engine = engine_for(options)
    places: dict = {}
    at = [places.setdefault(pair, len(places)) for pair in zip(texts, schemas, strict=True)]
    found = as_array([None if t is None else engine.repair(t, compile_schema(s)) for t, s in places])
    return found if len(places) == len(at) else found.take(pa.array(at, pa.int64()))


def json_repair(text: Column, schema: str | Column | None = None, options: Options | None = None) -> Column:
    """The result struct of repairing a text; null in, null out.

    ``schema`` is a JSON Schema text or a column of such.  An Arrow-batched UDF;
    each worker compiles a schema once.
    """
    options = options or Options()

    def results(batch: pa.Array, schemas) -> pa.Array:
        return repaired(batch.to_pylist(), schemas, options)

    if isinstance(schema, Column):

        @F.arrow_udf(RESULT_TYPE)
        def run_each(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for batch, schemas in parts:
                yield results(batch, schemas.to_pylist())

        return run_each.asNondeterministic()(text, schema)

    @F.arrow_udf(RESULT_TYPE)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in parts:
            yield results(batch, [schema] * len(batch))

    return run.asNondeterministic()(text)


def json_shape_errors(text: Column, schema: str) -> Column:
    """Shape errors of a JSON text; null for null or invalid JSON."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        compiled = compile_schema(schema)
        out = []
        for t in batch:
            try:
                value = parse(t) if t is not None else None
                out.append(compiled.errors(value) if t is not None and compiled is not None else None)
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(text)


# ---- text steps that need no Python


def plain_delimiters(text: Column) -> Column:
    """Unicode delimiter normalisation as one ``translate``."""
    return F.translate(text, texts.LOOK_ALIKES + texts.DELETED, texts.STAND_FOR)


def unwrap_simple_fence(text: Column) -> Column:
    """The body of a fence labelled json (or nothing) that starts the text; null where the kernel must look."""
    body = F.regexp_extract(text, r"(?is)^\x{FEFF}?\s*(`{3,}|~{3,})(?:json)?[ \t]*\r?\n(.*?)\r?\n[ \t]*\1[ \t]*(?:[\r\n].*)?$", 2)
    return F.when(F.trim(body) != "", F.trim(body))
