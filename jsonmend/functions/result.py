"""The result struct and native expressions over it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from jsonmend.kernel.engine import EXTRACTIONS, Result
from jsonmend.kernel.nodes import STRUCTURAL_STEP

_REPORTS = "array<struct<name:string,status:string,note:string>>"
RESULT_TYPE = (
    "struct<succeeded:boolean,is_repair_accepted:boolean,was_repaired:boolean,repaired_text:string,shape_status:string,"
    f"shape_errors:array<string>,text_repairs:{_REPORTS},node_repairs:{_REPORTS},"
    "tolerant:struct<succeeded:boolean,outcome:string,correction_count:int,schema_string_correction_count:int,corrections:array<string>>,"
    "succeeded_by:string,confidence:double,error:struct<kind:string,message:string>>"
)

_TEXTS = pa.list_(pa.string())
_ARROW_REPORTS = pa.list_(pa.struct([("name", pa.string()), ("status", pa.string()), ("note", pa.string())]))
_ARROW_TOLERANT = pa.struct([("succeeded", pa.bool_()), ("outcome", pa.string()), ("correction_count", pa.int32()), ("schema_string_correction_count", pa.int32()), ("corrections", _TEXTS)])
#: The same type for Arrow.
ARROW_TYPE = pa.struct(
    [
        ("succeeded", pa.bool_()), ("is_repair_accepted", pa.bool_()), ("was_repaired", pa.bool_()), ("repaired_text", pa.string()), ("shape_status", pa.string()),
        ("shape_errors", _TEXTS), ("text_repairs", _ARROW_REPORTS), ("node_repairs", _ARROW_REPORTS), ("tolerant", _ARROW_TOLERANT),
        ("succeeded_by", pa.string()), ("confidence", pa.float64()), ("error", pa.struct([("kind", pa.string()), ("message", pa.string())])),
    ]
)


def _shared(values: list, kind: pa.DataType, spell=lambda v: v) -> pa.Array:
    """Hashable values as an Arrow array; each different one is converted once."""
    places: dict = {}
    at = [places.setdefault(v, len(places)) for v in values]
    found = pa.array([spell(v) for v in places], kind)
    return found if len(places) == len(values) else found.take(pa.array(at, pa.int64()))


def _dicts(reports: tuple) -> list[dict]:
    return [x._asdict() for x in reports]


def as_array(results: list[Result | None]) -> pa.Array:
    """Results as one Arrow array; None becomes a null struct.

    Rows differ in their texts but share most of their audit, so each different
    part of it is converted once.
    """
    rows = [r if r is not None else _NOTHING for r in results]
    named = lambda t: None if t is None else {"succeeded": t[0], "outcome": t[1], "correction_count": t[2], "schema_string_correction_count": t[3], "corrections": t[4]}
    parts = {
        "succeeded": pa.array([r.succeeded for r in rows], pa.bool_()),
        "is_repair_accepted": pa.array([r.is_repair_accepted for r in rows], pa.bool_()),
        "was_repaired": pa.array([r.was_repaired for r in rows], pa.bool_()),
        "repaired_text": pa.array([r.repaired_text for r in rows], pa.string()),
        "shape_status": pa.array([r.shape_status for r in rows], pa.string()),
        "shape_errors": _shared([tuple(r.shape_errors) for r in rows], _TEXTS),
        "text_repairs": _shared([tuple(r.text_repairs) for r in rows], _ARROW_REPORTS, _dicts),
        "node_repairs": _shared([tuple(r.node_repairs) for r in rows], _ARROW_REPORTS, _dicts),
        "tolerant": _shared([(*r.tolerant[:4], tuple(r.tolerant[4])) if r.tolerant else None for r in rows], _ARROW_TOLERANT, named),
        "succeeded_by": pa.array([r.succeeded_by for r in rows], pa.string()),
        "confidence": pa.array([r.confidence for r in rows], pa.float64()),
        "error": _shared([r.error for r in rows], ARROW_TYPE.field("error").type, lambda e: {"kind": e[0], "message": e[1]} if e else None),
    }
    absent = pa.array([r is None for r in results], pa.bool_())
    return pa.StructArray.from_arrays([parts[f.name] for f in ARROW_TYPE], fields=list(ARROW_TYPE), mask=absent)


_NOTHING = Result(False)


def as_row(r: Result | None) -> dict | None:
    """A kernel result as the struct's fields."""
    if r is None:
        return None
    return {
        "succeeded": r.succeeded,
        "is_repair_accepted": r.is_repair_accepted,
        "was_repaired": r.was_repaired,
        "repaired_text": r.repaired_text,
        "shape_status": r.shape_status,
        "shape_errors": r.shape_errors,
        "text_repairs": [x._asdict() for x in r.text_repairs],
        "node_repairs": [x._asdict() for x in r.node_repairs],
        "tolerant": r.tolerant._asdict() if r.tolerant else None,
        "succeeded_by": r.succeeded_by,
        "confidence": r.confidence,
        "error": {"kind": r.error[0], "message": r.error[1]} if r.error else None,
    }


def _done(reports: Column, names=None) -> Column:
    hit = lambda x: (x["status"] == "Succeeded") & (x["name"].isin(*names) if names else F.lit(True))
    return F.size(F.filter(reports, hit))


def confidence(result: Column) -> Column:
    """The confidence of a result struct, from its audit alone; stays inside generated code."""
    count = lambda name: F.coalesce(result["tolerant"][name], F.lit(0))
    score = F.lit(1.0) - 0.05 * _done(result["text_repairs"])
    score = score - F.least(F.lit(0.30), 0.02 * count("correction_count")) - F.least(F.lit(0.15), 0.03 * count("schema_string_correction_count"))
    score = score - 0.08 * _done(result["node_repairs"]) - 0.07 * _done(result["node_repairs"], [STRUCTURAL_STEP[0]])
    score = score * F.when(_done(result["text_repairs"], ["salvage"]) > 0, 0.6).otherwise(1.0)
    score = score * F.when(_done(result["text_repairs"], sorted(EXTRACTIONS)) > 0, 0.7).otherwise(1.0)
    score = score * F.when(result["shape_status"] == "Mismatched", 0.5).otherwise(1.0)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(~result["succeeded"], 0.0).when(~result["was_repaired"], 1.0).otherwise(clamped)


def is_confident(result: Column, least: float) -> Column:
    return confidence(result) >= least
