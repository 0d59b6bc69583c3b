"""Functions for SQL: ``register`` makes them known to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from siftline.functions.numbers import fnv1a64, line_hash_feature
from siftline.functions.parsing import FIELD, json_sql


def register(spark: SparkSession) -> None:
    """``json_fields(line)``: a JSON object's fields as an array, null for other lines. ``LATERAL inline`` or ``posexplode`` make
    rows of it, from a subquery's column, since Spark takes no SQL function inside a generator. It is a SQL function, without Python, and takes escaped halves of surrogate pairs as they are. ``fnv1a64(line)`` and
    ``line_hash(line)``: a line's hash, and the hash as a feature, from Arrow batches."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION json_fields(line STRING) RETURNS array<{FIELD}> RETURN {json_sql('line')}")
    spark.udf.register("fnv1a64", fnv1a64)
    spark.udf.register("line_hash", line_hash_feature)
