"""Charts and pages: point geometry as columns, assembly of SVG and HTML on the driver from what ``charts`` leaves to be drawn."""

from __future__ import annotations

import html
import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.config import Config
from siftline.operators.charts import ACROSS, DOWN, cluster_cells, density_cells, line_columns
from siftline.operators.profile import PALETTE

# Plot margins of the cluster chart; fixed values.
SIDE, EDGE = 72, 56
INK, PALE, NIGHT, GRID = "#d6edf8", "#8fb5c8", "#07111a", "#86a7b9"
FONT = "IBM Plex Sans, sans-serif"
#: Bars of a histogram, keys of a heat map and keys with boolean bars; a page says how many more there are.
BARS, HEAT_KEYS, FLAGS = 64, 32, 64


def compact_number(value: float) -> str:
    """1234 as 1.2K, and so on."""
    for size, mark in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(value) >= size:
            return f"{value / size:.1f}".rstrip("0").rstrip(".") + mark
    return f"{value:.2f}".rstrip("0").rstrip(".")


def svg_points(features: DataFrame, labels: DataFrame, summaries: DataFrame, density: DataFrame, config: Config = Config()) -> DataFrame:
    """(job_id, row_id, label, cx, cy, r, color): the first two dimensions scaled to the canvas."""
    w, h, colors = config.canvas_width - 2 * SIDE, config.canvas_height - 2 * EDGE, config.color_palette or ("#00FF41",)
    at = lambda v, d: F.coalesce(F.get(v, d), F.get(v, 0)).cast("double")
    span = lambda d: F.when(at("max", d) - at("min", d) > 1e-4, at("max", d) - at("min", d)).otherwise(1.0)
    slot = F.when(F.col("label") < 0, F.col("cluster_count")).otherwise(F.col("label")).cast("int")
    row = features.join(labels, ["job_id", "row_id"]).join(summaries.select("job_id", "min", "max"), "job_id").withColumn("slot", slot).join(density.select("job_id", "slot", "density"), ["job_id", "slot"])
    return row.select(
        "job_id", "row_id", "label",
        (SIDE + (at("v", 0) - at("min", 0)) / span(0) * w).alias("cx"), (config.canvas_height - EDGE - (at("v", 1) - at("min", 1)) / span(1) * h).alias("cy"),
        F.greatest(F.lit(2.5), F.least(F.lit(7.0), 3.0 + (1.0 - F.col("density")) * 3.5)).alias("r"),
        F.element_at(F.array(*map(F.lit, colors)), (F.pmod("slot", F.lit(len(colors))) + 1).cast("int")).alias("color"),
    )


def _text(x, y, body: str, size: int, fill: str = PALE, more: str = "") -> str:
    return f"<text x='{x}' y='{y}' fill='{fill}' font-size='{size}' font-family='{FONT}'{more}>{html.escape(body)}</text>"


def _frame(w: int, h: int, body: str) -> str:
    return f"<svg viewBox='0 0 {w} {h}' xmlns='http://www.w3.org/2000/svg'><rect width='{w}' height='{h}' fill='{NIGHT}' rx='28'/>{body}</svg>"


def cluster_svg(points: list, result: dict, config: Config = Config()) -> str:
    """The cluster chart of points (cx, cy, r, color); every tag is closed whatever their number."""
    w, h = config.canvas_width, config.canvas_height
    if not points:
        return _frame(w, h, _text(w // 2, h // 2, "No data", 20, more=" text-anchor='middle'"))
    wide, tall = w - 2 * SIDE, h - 2 * EDGE
    grid = "".join(f"<path d='M{SIDE + wide * k / 10:.1f} {EDGE}v{tall}'/>" for k in range(11)) + "".join(f"<path d='M{SIDE} {EDGE + tall * k / 6:.1f}h{wide}'/>" for k in range(7))
    names = _text(SIDE + wide, h - EDGE + 22, "first dimension", 12, more=" text-anchor='end'") + _text(SIDE, EDGE - 10, "second dimension", 12)
    dots = "".join(f"<circle cx='{p['cx']:.2f}' cy='{p['cy']:.2f}' r='{p['r']:.2f}' fill='{p['color']}' opacity='0.88'/>" for p in points)
    bands = range(min(result["clusters"], len(config.color_palette)))
    legend = "".join(f"<circle cx='{SIDE + 90 * c}' cy='{h - 20}' r='5' fill='{config.color_palette[c]}'/>" + _text(SIDE + 10 + 90 * c, h - 16, f"band {c}", 12, INK) for c in bands)
    title = _text(SIDE, 28, f"{result['rows']} rows in {result['clusters']} bands by {result['algorithm']}, {result['outlierRatio'] * 100:.1f} % outliers", 16, INK)
    return _frame(w, h, f"<g stroke='{GRID}' opacity='0.15'>{grid}</g>{title}{names}<g>{dots}</g><g>{legend}</g>")


def report_fragment(result: dict, insights: list, svg: str) -> str:
    """A job's numbers, chart and insights; all text but the chart is escaped."""
    e = lambda x: html.escape(str(x))
    numbers = (("Rows", result["rows"]), ("Clusters", result["clusters"]), ("Dimensions", result["dimensions"]), ("Entropy", f"{result['entropy']:.3f}"), ("Trend", f"{result['trend']} ({result['trendSlope']:.4f})"), ("Outliers", f"{result['outlierRatio'] * 100:.2f}%"))
    cards = "".join(f"<article><span>{e(a)}</span><strong>{e(b)}</strong></article>" for a, b in numbers)
    notes = "".join(f"<section class='insight {e(i['tone'])}'><h3>{e(i['title'])}</h3><p>{e(i['detail'])}</p></section>" for i in insights)
    error = f"<section class='error'>{e(result['error'])}</section>" if result.get("error") else ""
    return f"<section class='report'><header><h1>Job {e(result['jobId'])} · {e(result['algorithm'])}</h1></header><section class='metrics'>{cards}</section><div class='canvas'>{svg}</div>{notes}{error}</section>"


def report_page(result: dict, insights: list, svg: str) -> str:
    return f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>Job {html.escape(str(result['jobId']))}</title></head><body><p>status: {html.escape(result['status'])}</p>{report_fragment(result, insights, svg)}</body></html>"


def rendered(results: DataFrame, told: DataFrame, drawn: DataFrame, config: Config = Config()) -> DataFrame:
    """(job_id, body, svg, html): each job's chart and report fragment, made in the tasks from the chart's occupied cells.

    results: rows of ``analyze``; told: its insights; drawn: rows of ``svg_points``. body is the result as JSON.
    """
    shown = cluster_cells(drawn).groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("row_id", "cx", "cy", "r", "color"))).alias("points"))
    notes = told.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("pos", "title", "detail", "tone"))).alias("notes"))
    columns = ("job_id", "algorithm", "status", "error", "row_count", "cluster_count", "dimensions", "entropy", "slope", "trend", "outlier_ratio")
    jobs = results.select(*columns).join(shown, "job_id", "left").join(notes, "job_id", "left")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                body = {"jobId": str(r["job_id"]), "status": r["status"], "algorithm": r["algorithm"], "rows": r["row_count"] or 0, "clusters": r["cluster_count"] or 0, "dimensions": r["dimensions"] or 0, "entropy": r["entropy"] or 0.0, "trendSlope": r["slope"] or 0.0, "trend": r["trend"] or "Stable", "outlierRatio": r["outlier_ratio"] or 0.0, "error": r["error"] or "", "insights": r["notes"] or []}
                svg = cluster_svg(r["points"] or [], body, config)
                out.append((r["job_id"], json.dumps(body), svg, report_fragment(body, body["insights"], svg)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 3), strict=True)], names=["job_id", "body", "svg", "html"])

    return jobs.mapInArrow(run, "job_id long, body string, svg string, html string")


def bars_svg(title: str, bars: list, w: int = 640, h: int = 320) -> str:
    """A histogram of (label, value) bars."""
    most, wide = max([v for _, v in bars], default=0) or 1, (w - 80) / max(1, len(bars))
    body = _text(24, 32, title, 18, INK)
    for i, (label, value) in enumerate(bars):
        tall = (h - 110) * value / most
        body += f"<rect x='{40 + i * wide:.2f}' y='{h - 50 - tall:.2f}' width='{wide * 0.7:.2f}' height='{tall:.2f}' fill='{PALETTE[i % len(PALETTE)]}'/>" + _text(f"{40 + i * wide:.2f}", h - 28, f"{label} {compact_number(value)}", 11)
    return _frame(w, h, body)


def boolean_svg(key: str, true_count: int, false_count: int) -> str:
    return bars_svg(key, [("true", true_count), ("false", false_count)])


def _scaled(values: list[float], low: float, high: float) -> list[float]:
    least, span = min(values), max(values) - min(values)
    return [low + (v - least) / (span or 1.0) * (high - low) for v in values]


def line_svg(title: str, values: list[float], color: str, at: list[int] | None = None, w: int = 640, h: int = 320) -> str:
    """A line through values, at the places ``at`` or one after another."""
    x, y = _scaled(list(range(len(values))) if at is None else at, 40, w - 40), _scaled(values, h - 50, 60)
    path = " ".join(f"{a:.2f},{b:.2f}" for a, b in zip(x, y, strict=True))
    return _frame(w, h, _text(24, 32, f"{title} {compact_number(min(values))} to {compact_number(max(values))}", 18, INK) + f"<polyline points='{path}' fill='none' stroke='{color}' stroke-width='2'/>")


def density_svg(title: str, cells: list[tuple[int, int, int]], color: str, w: int = 640, h: int = 320) -> str:
    """A scatter plot's occupied cells (cx, cy, n); fuller ones are more opaque."""
    most = math.log1p(max((n for _, _, n in cells), default=1))
    dot = lambda x, y, n: f"<circle cx='{40 + (x + 0.5) * (w - 80) / ACROSS:.2f}' cy='{h - 50 - (y + 0.5) * (h - 110) / DOWN:.2f}' r='4' fill='{color}' opacity='{0.3 + 0.7 * math.log1p(n) / most:.2f}'/>"
    return _frame(w, h, _text(24, 32, f"{title}, {compact_number(sum(n for _, _, n in cells))} points", 18, INK) + "".join(dot(*c) for c in cells))


def scatter_svg(title: str, xs: list[float], ys: list[float], color: str, w: int = 640, h: int = 320) -> str:
    dots = "".join(f"<circle cx='{a:.2f}' cy='{b:.2f}' r='4' fill='{color}'/>" for a, b in zip(_scaled(xs, 40, w - 40), _scaled(ys, h - 50, 60), strict=True))
    return _frame(w, h, _text(24, 32, title, 18, INK) + dots)


def heat_cells(correlated: DataFrame, keys: DataFrame) -> DataFrame:
    """(job_id, x, y, value) for every pair of keys: 1 on the diagonal, 0 where a pair has no correlation."""
    names = keys.select("job_id", "key")
    grid = names.withColumnRenamed("key", "x").join(names.withColumnRenamed("key", "y"), "job_id")
    both = correlated.select("job_id", "x", "y", "value").union(correlated.select("job_id", F.col("y"), F.col("x"), "value"))
    return grid.join(both, ["job_id", "x", "y"], "left").select("job_id", "x", "y", F.when(F.col("x") == F.col("y"), 1.0).otherwise(F.coalesce("value", F.lit(0.0))).alias("value"))


def heat_svg(cells: list, size: int = 60) -> str:
    names = sorted({c["x"] for c in cells})
    body, w = "", 160 + size * len(names)
    for c in cells:
        v = max(-1.0, min(1.0, c["value"]))
        shade = f"rgb({int(40 + 215 * max(0, v))},{int(60 + 60 * (1 - abs(v)))},{int(40 + 215 * max(0, -v))})"
        x, y = 140 + size * names.index(c["x"]), 40 + size * names.index(c["y"])
        body += f"<rect x='{x}' y='{y}' width='{size - 2}' height='{size - 2}' fill='{shade}'/>" + _text(x + 8, y + size // 2, f"{v:.2f}", 12, INK)
    body += "".join(_text(10, 40 + size * i + size // 2, n, 12) + _text(140 + size * i, 28, n, 12) for i, n in enumerate(names))
    return _frame(w, 60 + size * len(names), body)


def donut_angles(bars: DataFrame) -> DataFrame:
    """(job_id, key, pos, label, value, start, end): a ring's arcs in radians, most frequent first."""
    one = Window.partitionBy("job_id", "key")
    order = one.orderBy(F.desc("value"), "label")
    run, total = F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("value").over(one)
    return bars.select("job_id", "key", F.row_number().over(order).alias("pos"), "label", "value", ((run - F.col("value")) / total * 2 * math.pi).alias("start"), (run / total * 2 * math.pi).alias("end"))


def donut_svg(title: str, arcs: list, size: int = 320) -> str:
    c, r = size / 2, size / 2 - 60
    body = _text(24, 32, title, 18, INK)
    for i, a in enumerate(arcs):
        start, end = a["start"], min(a["end"], a["start"] + 2 * math.pi - 1e-4)
        x1, y1, x2, y2 = c + r * math.sin(start), c - r * math.cos(start), c + r * math.sin(end), c - r * math.cos(end)
        body += f"<path d='M {x1:.2f} {y1:.2f} A {r:.2f} {r:.2f} 0 {int(end - start > math.pi)} 1 {x2:.2f} {y2:.2f}' fill='none' stroke='{PALETTE[i % len(PALETTE)]}' stroke-width='28'><title>{html.escape(str(a['label']))}</title></path>"
    return _frame(size, size, body)


def dashboard_page(profile, job_id: int = 1) -> str:
    """A job's profile as one page: counters, coverages, charts and statistics.

    Charts show all rows: lines by their extremes in each column, scatter plots by their cells. Of a histogram the first
    BARS bars stand alone and the others are one; a heat map has the first HEAT_KEYS keys, and says so.
    """
    job = lambda df: df.where(F.col("job_id") == job_id)
    own = lambda df, *order: [r.asDict() for r in (job(df).orderBy(*order) if order else job(df)).collect()]

    def bars(df: DataFrame) -> list[tuple]:
        shown = [(r["label"], r["value"]) for r in job(df).where(F.col("pos") <= BARS).orderBy("pos").collect()]
        more = job(df).where(F.col("pos") > BARS).agg(F.count("*").alias("n"), F.sum("value").alias("value")).first()
        return [*shown, (f"{more['n']} others", more["value"])] if more["n"] else shown

    head = own(profile.counters)
    parts = [f"<p>{html.escape(' · '.join(f'{k} {v}' for k, v in (head[0] if head else {}).items() if k != 'job_id'))}</p>"]
    parts += [bars_svg(title, bars(df)) for title, df in (("Categories", profile.severity), ("Fields", profile.field_coverage), ("Shapes", profile.shape_coverage), ("Formats", profile.format_coverage), ("Null rate", profile.null_ratios))]
    for what in (profile.series, profile.text_lengths):
        groups: dict = {}
        for r in own(line_columns(job(what)), "key", "line_index"):
            groups.setdefault((r["key"], r["color"]), []).append((r["line_index"], r["value"]))
        parts += [line_svg(key, [v for _, v in some], color, [i for i, _ in some]) for (key, color), some in groups.items() if len(some) > 1]
    pairs: dict = {}
    for r in own(density_cells(job(profile.scatter)), "key", "cx", "cy"):
        pairs.setdefault((r["key"], r["color"]), []).append((r["cx"], r["cy"], r["n"]))
    parts += [density_svg(key, cells, color) for (key, color), cells in pairs.items()]
    keys = job(profile.numeric_keys)
    cells, many = own(heat_cells(job(profile.correlations), keys.where(F.col("rank") < HEAT_KEYS)), "x", "y"), keys.count()
    parts += [heat_svg(cells)] if len({c["x"] for c in cells}) > 1 else []
    parts += [f"<p>The heat map has the first {HEAT_KEYS} of {many} numeric keys.</p>"] if many > HEAT_KEYS else []
    arcs: dict = {}
    for r in own(donut_angles(profile.donuts), "key", "pos"):
        arcs.setdefault(r["key"], []).append(r)
    parts += [donut_svg(key, a) for key, a in arcs.items()]
    flags = own(profile.booleans, "key")
    parts += [boolean_svg(r["key"], r["true_count"], r["false_count"]) for r in flags[:FLAGS]]
    parts += [f"<p>{len(flags) - FLAGS} more boolean keys.</p>"] if len(flags) > FLAGS else []
    for r in own(profile.stats_grid, "pos"):
        range_ = f"{r['min']:.2f} / {r['max']:.2f} / {r['mean']:.2f}" if r["min"] is not None else f"{compact_number(r['distinct_strings'])} different"
        parts.append(f"<article><code>{html.escape(r['key'])}</code> {r['dominant_type']} {range_} null {r['null_rate']:.1f}%</article>")
    return f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>Profile {job_id}</title></head><body>{''.join(parts)}</body></html>"
