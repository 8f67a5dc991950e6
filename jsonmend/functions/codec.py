"""Argument codecs and schemas of Spark types."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)


def arguments_to_json(column: Column) -> Column:
    """A struct, map or variant of call arguments as JSON; binary fields become base64."""
    return F.to_json(column)


def arguments_from_json(text: Column) -> Column:
    """Call arguments as map<string,variant>; null unless the text is an object."""
    value = F.try_parse_json(text)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), F.from_json(text, "map<string,variant>"))


def _of(kind: T.DataType, nullable: bool) -> dict:
    if isinstance(kind, T.StructType):
        out = schema_of_struct(kind)
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": _of(kind.elementType, kind.containsNull)}
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": _of(kind.valueType, kind.valueContainsNull)}
    elif isinstance(kind, T.BooleanType):
        out = {"type": "boolean"}
    elif isinstance(kind, _NUMBERS):
        out = {"type": "integer"}
    elif isinstance(kind, _FLOATS):
        out = {"type": "number"}
    elif isinstance(kind, T.VariantType):
        return {}
    else:
        out = {"type": "string"}
    return out | ({"nullable": True} if nullable else {})


def schema_of_struct(struct: T.StructType) -> dict:
    """JSON Schema of a StructType; fields that are not nullable are required."""
    needed = [f.name for f in struct.fields if not f.nullable]
    fields = {f.name: _of(f.dataType, f.nullable) for f in struct.fields}
    return {"type": "object", "properties": fields} | ({"required": needed} if needed else {})


def schema_text(struct: T.StructType) -> str:
    """``schema_of_struct`` as the text that ``json_repair`` takes."""
    return json.dumps(schema_of_struct(struct))
