"""The SQL surface: scalar functions and a table function."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from jsonmend.functions.repair import repaired
from jsonmend.functions.result import RESULT_TYPE
from jsonmend.kernel.engine import Options, engine_for
from jsonmend.kernel.schema import compile_schema


def register(spark: SparkSession, options: Options | None = None) -> None:
    """Register ``json_repair(text, schema)`` and the table function ``repair_reports(text, schema)``.

    A null or blank schema means none.
    """
    options = options or Options()

    @F.arrow_udf(RESULT_TYPE)
    def json_repair(batch: pa.Array, schemas: pa.Array) -> pa.Array:
        return repaired(batch.to_pylist(), schemas.to_pylist(), options)

    class RepairReports:
        """One row a step, in order."""

        def eval(self, text: str, schema: str):
            if text is None:
                return
            result = engine_for(options).repair(text, compile_schema(schema))
            for phase, reports in (("text", result.text_repairs), ("node", result.node_repairs)):
                for place, r in enumerate(reports):
                    yield phase, place, r.name, r.status, r.note

    spark.udf.register("json_repair", json_repair)
    spark.udtf.register("repair_reports", F.udtf(RepairReports, returnType="phase string, place int, name string, status string, note string"))
