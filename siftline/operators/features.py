"""Feature vectors: packed numbers of a line, padded to a fixed width.

Columns are positions, not keys: numbers found under the configured keys come first, then the line's numbers from
its start until the vector is full; what is short is padded with the last number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.config import Config
from siftline.functions.numbers import count_marks, freeform_numbers, keyed_number, line_hash_feature
from siftline.functions.parsing import let


def feature_vectors(lines: DataFrame, config: Config = Config()) -> DataFrame:
    """(job_id, row_id, v array<float>) of engine lines (job_id, row_id, line)."""
    dims = config.dims
    keys = [keyed_number(F.col("line"), k, config.case_sensitive) for k in config.numeric_keys[:dims]]
    keyed = F.array_compact(F.array(*keys)) if keys else F.expr("cast(array() as array<double>)")
    free = F.slice(freeform_numbers(F.col("line")), F.lit(1), F.lit(dims) - F.size("keyed"))
    found = lines.withColumn("keyed", keyed).withColumn("found", F.when(F.size("keyed") < dims, F.concat("keyed", free)).otherwise(F.col("keyed")))
    # only lines without numbers are hashed; the others cross to Python as nulls
    hashed = line_hash_feature(F.when(F.size("found") == 0, F.col("line")))
    marked = found.select("job_id", "row_id", "line", "found", hashed.alias("hash"))
    bare = F.slice(F.array("hash", F.octet_length("line").cast("double"), count_marks(F.col("line")).cast("double")), 1, dims)
    packed = marked.select("job_id", "row_id", F.when(F.size("found") > 0, F.col("found")).otherwise(bare).alias("v"))
    return packed.select("job_id", "row_id", let(F.col("v"), lambda v: F.slice(F.concat(v, F.array_repeat(F.element_at(v, -1), dims)), 1, dims)).cast("array<float>").alias("v"))


def features_by_key(lines: DataFrame, config: Config = Config()) -> DataFrame:
    """An extension: one nullable column per configured key."""
    return lines.select("job_id", "row_id", *(keyed_number(F.col("line"), k, config.case_sensitive).alias(k) for k in config.numeric_keys))
