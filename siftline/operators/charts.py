"""Whole series as few marks: what a chart of some pixels can show, counted over all rows.

A line needs four points of each column of pixels: its first, last, least and greatest. A scatter plot needs its occupied
cells, and so does the chart of clusters. Both are one grouping with partial sums; the driver gets what is drawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a line chart; cells of a scatter plot across and down; pixels of a cell of the cluster chart.
COLUMNS, ACROSS, DOWN, CELL = 560, 140, 55, 12


def line_columns(points: DataFrame, width: int = COLUMNS) -> DataFrame:
    """(job_id, key, color, column, line_index, value): the first, last, least and greatest point of each column, each once.

    ``points`` has (job_id, key, color, line_index, value); lines from the least to the greatest line_index of a key fill
    ``width`` columns. Of equal values the earlier point stands. At most four points a column come out, however many go in.
    """
    by = ["job_id", "key", "color"]
    ends = points.groupBy(*by).agg(F.min("line_index").alias("_low"), F.max("line_index").alias("_high"))
    column = F.floor((F.col("line_index") - F.col("_low")) * width / (F.col("_high") - F.col("_low") + 1))
    placed = points.join(F.broadcast(ends), by).select(*by, column.alias("column"), "line_index", "value")
    # numbers only, since the minimum of a struct would sort all points of a task: first the values, then where they stand
    held = placed.groupBy(*by, "column").agg(F.min("value").alias("_least"), F.max("value").alias("_most"))
    at = lambda c: F.min(F.when(F.col("value") == F.col(c), F.col("line_index")))
    places = placed.join(F.broadcast(held), [*by, "column"]).groupBy(*by, "column").agg(
        F.min("line_index").alias("_a"), F.min_by("value", "line_index").alias("_va"), F.max("line_index").alias("_b"), F.max_by("value", "line_index").alias("_vb"),
        at("_least").alias("_c"), F.min("_least").alias("_vc"), at("_most").alias("_d"), F.max("_most").alias("_vd"),
    )
    point = lambda c: F.struct(F.col(f"_{c}").alias("line_index"), F.col(f"_v{c}").alias("value"))
    found = places.select(*by, "column", F.array_distinct(F.array(*map(point, "abcd"))).alias("points"))
    return found.select(*by, "column", F.explode("points").alias("p")).select(*by, "column", "p.line_index", "p.value")


def density_cells(points: DataFrame, across: int = ACROSS, down: int = DOWN) -> DataFrame:
    """(job_id, key, color, cx, cy, n): how many of the points (job_id, key, color, x, y) are in each cell that has any.

    Cells are counted from the least x and y; where all x, or all y, are equal they are in cell 0.
    """
    by = ["job_id", "key", "color"]
    ends = points.groupBy(*by).agg(*(f(c).alias(f"_{n}{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))))

    def cell(c: str, many: int) -> F.Column:
        span = F.col(f"_high{c}") - F.col(f"_low{c}")
        return F.when(span > 0, F.least(F.lit(many - 1), F.floor((F.col(c) - F.col(f"_low{c}")) * many / span))).otherwise(0).cast("int")

    return points.join(ends, by).groupBy(*by, cell("x", across).alias("cx"), cell("y", down).alias("cy")).agg(F.count("*").alias("n"))


def cluster_cells(drawn: DataFrame, cell: int = CELL) -> DataFrame:
    """(job_id, row_id, cx, cy, r, color): of the points of a colour in one cell of ``cell`` pixels the first row's, as large as the largest."""
    place = [F.floor(F.col(c) / cell).alias(f"_{c}") for c in ("cx", "cy")]
    first = F.min_by(F.struct("row_id", "cx", "cy"), "row_id").alias("p")
    found = drawn.groupBy("job_id", "color", *place).agg(first, F.max("r").alias("r"))
    return found.select("job_id", "p.row_id", "p.cx", "p.cy", "r", "color")
