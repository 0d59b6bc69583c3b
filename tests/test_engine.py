import math

import numpy as np
import pytest

from siftline.config import Config, algorithm, load
from siftline.operators.clustering import assign, closest_pair, cluster, density_bands, spread_kmeans
from siftline.operators.features import feature_vectors, features_by_key
from siftline.operators.report import bars_svg, boolean_svg, compact_number, dashboard_page, donut_angles, donut_svg, heat_cells, heat_svg, line_svg, scatter_svg
from siftline.operators.summary import summary
from siftline.plans.analysis import Profile, analyze, result_json, status_json
from siftline.sources.lines import SAMPLE, engine_lines, jobs
from siftline.streaming.jobs import Engine, payload_source, results_of, stream, windowed_counts

from plain import parse_object

TOY = np.array([(0, 0), (0.1, 0), (0, 0.1), (0.4, 0), (0.8, 0), (3, 3), (3.1, 3), (3, 3.1), (6, 0), (3.2, 3.2)], np.float32)
WANT = {
    "kmeans++": ([0, 0, 0, 0, 0, 2, 2, 2, 1, 2], 3), "dbscan": ([0, 0, 0, 0, -1, 1, 1, 1, -1, 1], 2), "birch": ([0, 0, 0, 0, 1, 2, 2, 2, 3, 2], 4),
    "mean_shift": ([0, 0, 0, 0, 0, 1, 1, 1, 2, 1], 3), "optics": ([1, 0, 0, 0, 2, 1, 1, 2, 3, 2], 4), "gmm": ([0, 0, 0, 0, 0, 2, 2, 2, 1, 2], 3), "agglomerative": ([0, 1, 2, 3, 4, 5, 5, 6, 7, 8], 9),
}
SAMPLE_LABELS = {"kmeans++": ([0, 2, 2, 0, 1], 3), "dbscan": ([-1] * 5, 0), "birch": ([0, 1, 2, 3, 4], 5), "mean_shift": ([0, 1, 2, 3, 4], 5), "optics": ([0] * 5, 1), "gmm": ([0, 1, 2, 0, 0], 3), "agglomerative": ([0, 1, 1, 2, 3], 4)}


@pytest.mark.parametrize("name", WANT)
def test_toy_clusters(name):
    label, n = assign(TOY, name, Config(dbscan_min_samples=3))
    assert (label.tolist(), n) == WANT[name]


def test_dbscan_by_seeds():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.normal(size=(60, 2)).astype(np.float32)
        label, _ = assign(x, "dbscan", Config(dbscan_min_samples=4))
        near = ((x[:, None].astype(float) - x[None]) ** 2).sum(2) <= 0.45**2
        core, seeds = near.sum(1) >= 4, []
        for i in np.flatnonzero(core):
            if not any(near[i, s] for s in seeds):
                seeds.append(i)
        want = [next((k for k, s in enumerate(seeds) if near[s, j] and s <= j), next((k for k, s in enumerate(seeds) if near[s, j] and not core[j] and False), -1)) for j in range(60)]
        assert label.tolist() == want


def test_features_of_the_sample(spark):
    lines = engine_lines(jobs(spark, [SAMPLE]))
    got = [list(r["v"]) for r in feature_vectors(lines, Config().effective_keys()).orderBy("row_id").collect()]
    assert got == [[9421, *[12] * 5], [425, *[18] * 5], [73, *[503] * 5], [15400, *[1200] * 5], [3, *[4500] * 5]]
    got = [list(r["v"]) for r in feature_vectors(lines).orderBy("row_id").collect()]
    assert got[2] == [503, 73, 503, 503, 503, 503] and got[3] == [1200, 15400, 1200, 1200, 1200, 1200]
    bare = feature_vectors(engine_lines(jobs(spark, ["hello world\nplain text: with = marks"])), Config(numeric_keys=())).orderBy("row_id").collect()
    assert [round(x, 3) for x in bare[0]["v"]] == [810.041, 11, *[0] * 6] and [round(x, 3) for x in bare[1]["v"]] == [4.971, 24, *[2] * 6]
    assert features_by_key(lines).where("status_code = 503").count() == 1


def test_summary_and_labels_of_the_sample(spark):
    config = Config().effective_keys()
    features = feature_vectors(engine_lines(jobs(spark, [SAMPLE])), config)
    s = summary(features, config.dims).first()
    assert [round(x, 1) for x in s["mean"]] == [5064.4, *[1246.6] * 5] and round(s["stddev"][0], 4) == 6290.6354
    assert (round(s["entropy"], 6), round(s["slope"], 1), s["outlier_ratio"], s["trend"]) == (0.721928, -386.1, 0.2, "Falling")
    for name, (label, n) in SAMPLE_LABELS.items():
        got = cluster(features, name, config).orderBy("row_id").collect()
        assert ([r["label"] for r in got], got[0]["cluster_count"]) == (label, n)
    assert [r["label"] for r in spread_kmeans(features).orderBy("row_id").collect()] == SAMPLE_LABELS["kmeans++"][0]
    assert tuple(closest_pair(features).first())[1:] == (1, 2)


def test_bands_in_columns(spark):
    df = spark.createDataFrame([(1, i, [float(a), float(b)]) for i, (a, b) in enumerate(TOY)], "job_id long, row_id long, v array<float>")
    assert [r["label"] for r in density_bands(df, 0.54, 3).orderBy("row_id").collect()] == [0, 0, 1, 0, 2, 1, 1, 2, 3, 2]


def test_analysis_and_json(spark):
    work = spark.createDataFrame([(1, "dbscan", SAMPLE), (2, "gmm", "\n\n")], "job_id long, algorithm string, payload string")
    got = analyze(work, Config().effective_keys())
    told = [(r["title"], r["tone"]) for r in got.insights.where("job_id = 1").orderBy("pos").collect()]
    assert told == [("Segmentation", "calm"), ("Distribution", "calm"), ("Trend", "warm"), ("Anomaly pressure", "hot"), ("Projection", "calm"), ("Noise signal", "hot")]
    state = {r["job_id"]: (r["status"], r["error"]) for r in got.results.collect()}
    assert state == {1: ("ready", None), 2: ("failed", "no analyzable rows found")}
    assert '"jobId":"2","status":"failed"' in status_json(got.results).where("job_id = 2").first()["json"]
    assert '"rows":5' in result_json(got.results).where("job_id = 1").first()["json"]


def test_engine(spark):
    e = Engine(spark, Config().effective_keys())
    a, b = e.submit(SAMPLE, "KMEANS"), e.submit("\n", "dbscan")
    assert e.status(a)["status"] == "queued"
    with pytest.raises(ValueError):
        e.submit("")
    with pytest.raises(KeyError):
        e.status("7x")
    e.run()
    assert e.status(a)["status"] == "ready" and e.status(b)["error"] == "no analyzable rows found"
    r = e.result(a)
    assert list(r) == ["jobId", "status", "algorithm", "rows", "clusters", "entropy", "trendSlope", "outlierRatio", "html", "svg", "error"]
    assert r["svg"].count("<circle") == 8 and r["svg"].endswith("</svg>") and "Balance" in r["html"]
    assert e.report(a).startswith("<!DOCTYPE html>") and [s["status"] for s in e.feed(b)] == ["failed"]
    for wrong in ("²", "-1", "99", str(1 << 64), "1" * 30):
        with pytest.raises(KeyError):
            e.status(wrong)
    assert "2 jobs" in e.info()


def test_engine_limits_and_states(spark, monkeypatch):
    from siftline.streaming import jobs as module

    monkeypatch.setattr(module, "MAX_WAITING", 3)
    monkeypatch.setattr(module, "MAX_JOBS", 5)
    e = Engine(spark, Config(min_batch_size_kb=1))
    seen = []
    monkeypatch.setattr(e, "_set", lambda job, status, error="", set_=e._set: (seen.append((job, status)), set_(job, status, error))[1])
    ids = [e.submit("a=1 b=2\n" * (150 if i == 0 else 1)) for i in range(4)]
    assert e.status(ids[3])["error"] == "ingress queue is saturated"
    assert [len(b) for b in e._batches()] == [1, 2]
    e.run()
    assert [s for j, s in seen if j == ids[0]] == ["batching", "analyzing", "rendering", "ready"] and e.result(ids[2])["rows"] == 1
    last = [e.submit("x=1") for _ in range(3)]
    with pytest.raises(KeyError):  # the oldest finished ones are forgotten
        e.status(ids[0])
    monkeypatch.setattr(module, "analyze", lambda *a: 1 / 0)
    e.run()
    assert e.status(last[0]) | {"updatedMs": 0} == {"jobId": str(last[0]), "status": "failed", "updatedMs": 0, "error": "failed to schedule analysis task"}
    e.submit("y=1")
    e.close()
    with pytest.raises(RuntimeError):
        e.submit("z=1")


def test_nothing_stays_cached_and_settings_switch_off(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = analyze(jobs(spark, [SAMPLE]), Config(enable_shannon_entropy=False, enable_outlier_detection=False, enable_linear_regression=False)).results.first()
    assert (got["entropy"], got["outlier_ratio"], got["slope"], got["trend"]) == (0.0, 0.0, 0.0, "Stable")
    Profile.of(jobs(spark, [SAMPLE])).correlations.count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_stream_in_batches_of_bytes_with_pages(spark, tmp_path):
    """Two files of over 64 KiB: each a batch of its own; pages are written beside results."""
    import random

    r = random.Random(2)
    work = spark.createDataFrame([(i, "kmeans++", "\n".join(f"v={r.random()} w={r.random()}" for _ in range(4000))) for i in (1, 2)], "job_id long, algorithm string, payload string")
    work.repartition(2, "job_id").write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "in"))
    stream(payload_source(spark, str(tmp_path / "in"), most_bytes=64 << 10), str(tmp_path / "out"), str(tmp_path / "cp"), once=True, pages=str(tmp_path / "pages")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() == 2 and got.agg({"row_count": "sum"}).first()[0] == 8000
    assert spark.read.parquet(str(tmp_path / "pages")).where("svg like '<svg%' and html like '%Balance%'").count() == 2


def test_late_rows_are_left_out_of_closed_windows(spark, tmp_path):
    """An event-time stream: a row later than the watermark allows changes nothing, one within it counts."""
    import os

    schema, source = "ts timestamp, severity string", str(tmp_path / "in")
    rows = [["2024-01-01 00:01:00", "2024-01-01 00:02:00"], ["2024-01-01 01:00:00"], ["2024-01-01 01:01:00"], ["2024-01-01 00:03:00", "2024-01-01 00:55:00"], ["2024-01-01 03:00:00"], ["2024-01-01 05:00:00"]]
    for i, some in enumerate(rows):
        spark.createDataFrame([(t, "INFO") for t in some], "t string, severity string").selectExpr("cast(t as timestamp) ts", "severity").coalesce(1).write.mode("append").parquet(source)
        for name in os.listdir(source):
            os.utime(f"{source}/{name}", (1_700_000_000 + i, 1_700_000_000 + i)) if name.endswith(".parquet") and os.path.getmtime(f"{source}/{name}") > 1_700_100_000 else None
    counted = windowed_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), "5 minutes", "10 minutes")
    found = []
    counted.writeStream.outputMode("append").foreachBatch(lambda df, n: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    counts = {r["start"].strftime("%H:%M"): r["n"] for r in found}
    assert counts["00:00"] == 2 and counts["00:55"] == 1


def test_settings_of_the_environment(monkeypatch, tmp_path):
    from siftline.config import from_environment

    (tmp_path / "a.ini").write_text("dbscan_eps = 0.75\n")
    monkeypatch.setenv("SIFTLINE_CONFIG", str(tmp_path / "a.ini"))
    assert from_environment().dbscan_eps == 0.75
    monkeypatch.setenv("SIFTLINE_CONFIG", str(tmp_path / "none.ini"))
    assert from_environment() == Config()


def test_stream_equals_batch(spark, tmp_path):
    work = spark.createDataFrame([(i, "kmeans++", SAMPLE + f'\n{{"x":{i}}}') for i in range(1, 6)], "job_id long, algorithm string, payload string")
    work.repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream(payload_source(spark, str(tmp_path / "in"), most=2), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    drop = ("batch", "batch_id", "updated_ms")
    got = sorted(spark.read.parquet(str(tmp_path / "out")).drop(*drop).collect(), key=lambda r: r["job_id"])
    assert got == sorted(results_of(work, Config()).drop(*drop).collect(), key=lambda r: r["job_id"])


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "INFO"), ("2024-01-01 00:02:00", "INFO"), ("2024-01-01 00:07:00", "WARN")], "t string, severity string").selectExpr("cast(t as timestamp) ts", "severity")
    assert sorted(r["n"] for r in windowed_counts(rows).collect()) == [1, 2]


def test_many_numeric_keys_correlate_alike(spark):
    """More keys than become columns: pairs are rows, with the same values."""
    from siftline.operators import profile

    rng = np.random.default_rng(8)
    lines = "\n".join("{" + ",".join(f'"k{k}":{v:.4f}' for k, v in enumerate(rng.normal(size=6)) if (i + k) % 5) + "}" for i in range(60))
    got = {}
    for most in (8, 2):
        profile.PAIRED_KEYS = most
        got[most] = {(r["x"], r["y"]): (r["pos"], round(r["value"], 9)) for r in Profile.of(jobs(spark, [lines])).correlations.collect()}
    profile.PAIRED_KEYS = 8
    assert len(got[8]) == 15 and got[8] == got[2]


def test_the_category_histogram_falls_back(spark):
    got = Profile.of(jobs(spark, ["{}"])).category_histogram.collect()
    assert [(r["label"], r["value"]) for r in got] == [("INFO", 1)]


def test_numbers_near_the_largest_double(spark):
    
    assert [f[2] for f in parse_object('{"a":1.5e308,"b":-1.7e308,"c":' + "9" * 400 + "}")] == [1.5e308, -1.7e308, math.inf]


def test_charts(spark):
    for svg in (bars_svg("t", [("a<", 3), ("b", 0)]), bars_svg("t", []), boolean_svg("k", 1, 2), line_svg("l", [1.0, 1.0], "#fff"), scatter_svg("s", [1, 2], [2, 2], "#fff")):
        assert svg.startswith("<svg") and svg.endswith("</svg>") and "a<<" not in svg
    bars = spark.createDataFrame([(1, "k", "a", 3), (1, "k", "b", 1)], "job_id long, key string, label string, value long")
    arcs = donut_angles(bars).orderBy("pos").collect()
    assert arcs[0]["end"] == pytest.approx(1.5 * math.pi) and arcs[1]["end"] == pytest.approx(2 * math.pi)
    assert donut_svg("d", arcs).count("<path") == 2
    corr = spark.createDataFrame([(1, 0, "x", "y", 0.5)], "job_id long, pos int, x string, y string, value double")
    keys = spark.createDataFrame([(1, k) for k in "xyz"], "job_id long, key string")
    cells = heat_cells(corr, keys).collect()
    assert len(cells) == 9 and {(c["x"], c["y"]): c["value"] for c in cells}["y", "x"] == 0.5 and heat_svg(cells).count("<rect") == 10
    assert [compact_number(x) for x in (1234, 2_000_000, 12)] == ["1.2K", "2M", "12"]


def test_dashboard(spark):
    lines = "\n".join(f'{{"level":"L{i % 2}","a":{i},"b":{i * i},"ok":{"true" if i % 3 else "false"},"note":null}}' for i in range(12))
    got = Profile.of(jobs(spark, [lines]))
    page = dashboard_page(got)
    assert page.count("<svg") == page.count("</svg>") >= 9 and "a vs b" in page and "null 100.0%" in page
    got.close()


def test_config():
    c = load('[x]\n; note\ndbscan_eps = 0.5\nnumeric_keys = ["a","b"]\ndefault_algorithm = "GMM"\nenable_shannon_entropy = false\nunknown = 1\n')
    assert (c.dbscan_eps, c.numeric_keys, c.default_algorithm, c.enable_shannon_entropy, c.dims) == (0.5, ("a", "b"), "gmm", False, 2)
    assert Config().effective_keys().numeric_keys == ("latency", "", "", "cpu_usage", "", "")
    assert [algorithm(x) for x in ("KMeans", "optics", None, "zzz")] == ["kmeans++", "optics", "dbscan", "dbscan"]
    with pytest.raises(ValueError):
        Config(dbscan_min_samples=0)


@pytest.mark.parametrize("name", WANT)
def test_large_jobs_are_spread_with_the_same_labels(spark, monkeypatch, name):
    from siftline.operators import clustering, neighbours, spread

    rng, config = np.random.default_rng(5), Config(dbscan_min_samples=4)
    made = {1: rng.normal(size=(150, 3)) * 0.6, 2: rng.normal(size=(110, 3)) * 2, 3: rng.normal(size=(20, 3))}
    made = {j: x.astype(np.float32) for j, x in made.items()}
    made[1][40:60] = made[1][7]
    made[2][5] = np.nan if name in ("dbscan", "mean_shift") else 0
    for module, most in ((spread, {"FOLD_ROWS": 40}), (neighbours, {"LEAF_ROWS": 16, "KEY_ROWS": 8, "LEAF_SAMPLE": 2}), (clustering, {"BAND_ROWS": 64, "PAIR_ROWS": 32})):
        for k, v in most.items():
            monkeypatch.setattr(module, k, v)
    df = spark.createDataFrame([(j, i, [float(a) for a in v]) for j, x in made.items() for i, v in enumerate(x)], "job_id long, row_id long, v array<float>").repartition(3)
    got = {(r["job_id"], r["row_id"]): (r["label"], r["cluster_count"]) for r in cluster(df, name, config, most=64).collect()}
    want = {}
    for j, x in made.items():
        label, n = assign(x, name, config)
        want |= {(j, i): (int(k), n) for i, k in enumerate(label)}
    assert got == want


def test_rows_are_numbered_over_ranges(spark):
    from siftline.operators.spread import numbered

    rows = [(i % 3 if i % 2 else 7, i * 37 % 1000, i) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "part long, at long, x long").repartition(5), "part", ["at"], "n").collect()
    for part in {r[0] for r in rows}:
        own = sorted((r["at"], r["n"]) for r in got if r["part"] == part)
        assert [n for _, n in own] == list(range(len(own))) and len(own) == sum(r[0] == part for r in rows)


def test_rows_beyond_the_bands_have_label_0(spark, monkeypatch):
    from siftline.operators import clustering

    monkeypatch.setattr(clustering, "BAND_ROWS", 7)
    points = [*TOY.tolist(), [float("nan"), 0.0]]
    points[3] = [float("nan"), 1.0]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(points)], "job_id long, row_id long, v array<float>")
    got = [r["label"] for r in density_bands(df, 0.54, 3).orderBy("row_id").collect()]
    assert got == clustering.optics(np.array(points), 0.54, 3, stable=True)[0].tolist() and got[7:] == [0] * 4


def test_a_spike_in_the_last_row_is_drawn(spark):
    from siftline.operators.charts import cluster_cells, density_cells, line_columns

    points = spark.range(200_000).selectExpr("1L AS job_id", "'k' AS key", "'#fff' AS color", "id AS line_index", "if(id = 199999, 1e6, id % 10 + 0.5) AS value")
    got = line_columns(points, 50).collect()
    assert len(got) <= 4 * 50 and max(r["value"] for r in got) == 1e6 and {r["column"] for r in got} == set(range(50))
    assert {0, 199_999} <= {r["line_index"] for r in got} and all(r["line_index"] * 50 // 200_000 == r["column"] for r in got)
    dots = points.selectExpr("job_id", "key", "color", "value AS x", "1.0D AS y")
    cells = {(r["cx"], r["cy"]): r["n"] for r in density_cells(dots).collect()}
    assert cells == {(0, 0): 199_999, (139, 0): 1}
    drawn = points.selectExpr("job_id", "line_index AS row_id", "line_index % 100 + 0.5D AS cx", "0.25D AS cy", "3.0D + line_index / 1e6 AS r", "color")
    some = cluster_cells(drawn).collect()
    assert sorted(r["row_id"] for r in some) == [0, 12, 24, 36, 48, 60, 72, 84, 96] and max(r["r"] for r in some) > 3.19


def test_pages_show_all_rows_and_say_what_is_left_out(spark):
    lines = "\n".join(f'{{"level":"L{i % 70}","v":{10_000 if i == 599 else i % 7},"w":{i % 5}}}' for i in range(600))
    with Profile.of(jobs(spark, [lines])) as got:
        page = dashboard_page(got)
    assert "0 to 10K" in page and "6 others" in page and "v vs w, 600 points" in page


def test_the_settings_switch_correlations_off(spark):
    work = jobs(spark, ["\n".join(f'{{"a":{i},"b":{i * i}}}' for i in range(9))])
    with Profile.of(work, Config(enable_correlation_matrix=False)) as off, Profile.of(work) as on:
        assert off.correlations.count() == 0 and on.correlations.count() == 1
        assert off.counters.first()["correlations"] == 0 and off.scatter_pairs.count() == 1
