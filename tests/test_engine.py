"""Group engine, native operators, windows, decisions, files and streaming on Spark."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from covaria.functions import detectors as det
from covaria.functions import estimators as est
from covaria.functions import expr, sonar_expr
from covaria.operators import adaptive, decide, groups, trials, windows
from covaria.operators import moments as mom
from covaria.plans import entries, montecarlo
from covaria.sources import files
from covaria.sources import generate as gen
from covaria.streaming.online import event_samples, online

OBS = "k string, t int, n int, re array<double>, im array<double>"


def rows(x, key="a"):
    t, n, _ = x.shape
    return [(key, i, j, x[i, j].real.tolist(), x[i, j].imag.tolist() if np.iscomplexobj(x) else None) for i in range(t) for j in range(n)]


def test_groups_of_any_shape_order_and_batch(spark):
    r = np.random.default_rng(0)
    cubes = {f"g{k}": r.standard_normal((2 + k % 3, 6 + k % 2, 3)) for k in range(25)}
    data = [row for k, x in cubes.items() for row in rows(x, k)]
    r.shuffle(data)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    got = {v["k"]: v["stat"] for v in groups.detect(spark.createDataFrame(data, OBS), ["k"], det.gaussian_glrt).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    assert set(got) == set(cubes) and all(np.isclose(got[k], det.gaussian_glrt(x)) for k, x in cubes.items())


def test_ragged_null_and_empty_groups(spark):
    data = rows(np.random.default_rng(0).standard_normal((2, 5, 2)))[:-1] + [(None, 0, 0, [1.0, 2.0], None), (None, 0, 1, [2.0, 1.0], None), (None, 0, 2, [0.0, 1.0], None), ("z", 0, 0, None, None)]
    got = {v["k"]: v["stat"] for v in groups.detect(spark.createDataFrame(data, OBS), ["k"], det.gaussian_glrt).collect()}
    assert got["a"] is None and abs(got[None]) < 1e-12 and "z" not in got
    assert groups.detect(spark.createDataFrame([], OBS), ["k"], det.gaussian_glrt).collect() == []


def test_complex_estimates(spark):
    x = np.random.default_rng(1).standard_normal((1, 30, 3)) + 1j * np.random.default_rng(2).standard_normal((1, 30, 3))
    r = groups.estimate(spark.createDataFrame(rows(x), OBS), ["k"], est.tyler).first()
    assert np.allclose(np.array(r["sigma_re"]) + 1j * np.array(r["sigma_im"]), est.tyler(x[0]).ravel())


def test_native_moments_and_glrt(spark):
    x = np.random.default_rng(3).standard_normal((4, 12, 3))
    flat = spark.createDataFrame([("a", t, *x[t, n].tolist()) for t in range(4) for n in range(12)], "g string, t int, x0 double, x1 double, x2 double")
    cols = ["x0", "x1", "x2"]
    assert np.isclose(mom.glrt(flat, ["g"], "t", cols).first()["stat"], det.gaussian_glrt(x))
    last = mom.glrt_running(flat, ["g"], "t", cols).orderBy(F.desc("t")).first()
    assert np.isclose(last["stat"], det.gaussian_glrt(x)) and last["n_dates"] == 4
    m = mom.moments(flat, ["g"], cols, centre=True).select(mom.flat(3).alias("m")).first()["m"]
    assert np.allclose(np.array(m).reshape(3, 3), np.cov(x.reshape(-1, 3).T, bias=True))


def test_native_plan_has_partial_aggregation_and_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = mom.glrt(df.select((F.col("l_suppkey") % 4).alias("g"), F.year("l_shipdate").alias("t"), F.col("l_quantity").alias("x0"), F.col("l_tax").alias("x1")), ["g"], "t", ["x0", "x1"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan and "Python" not in plan and "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_tax:double,l_shipdate" in plan


def test_reweighting_equals_the_kernel(spark):
    x = np.random.default_rng(4).standard_normal((60, 2)) + [0.2, 0.1]
    flat = spark.createDataFrame([("a", *v) for v in x.tolist()], "g string, x0 double, x1 double")
    for kind, f, norm in (("tyler", lambda: est.tyler(x, "trace", 0, 3), "trace"), ("student", lambda: est.student_t(x, 3, None, 0, 3), "none"), ("huber", lambda: est.huber(x, 1.2, 0.9, "det", 0, 3), "det")):
        r = mom.reweighted(flat, ["g"], 3, kind, norm, **({"limit": 1.2, "beta": 0.9} if kind == "huber" else {})).first()
        assert np.allclose([r["s00"], r["s01"], r["s11"]], f()[[0, 0, 1], [0, 1, 1]])


def test_expressions(spark):
    a = np.array([[2.0, 1.0, 0.3], [1.0, 2.0, 0.1], [0.3, 0.1, 1.5]])
    df = spark.createDataFrame([(a.ravel().tolist(), [1.0, 2.0])], "m array<double>, v array<double>")
    r = df.select(expr.det(F.col("m"), 3).alias("d"), expr.trace(F.col("m"), 3).alias("t"), expr.diag_embed(F.col("v")).alias("e"), expr.transpose(F.col("m"), 3).alias("x"), expr.normalise(F.col("m"), 3, "det").alias("u")).first()
    assert np.isclose(r["d"], np.linalg.det(a)) and np.isclose(r["t"], 5.5) and r["e"] == [1.0, 0.0, 0.0, 2.0] and r["x"] == a.T.ravel().tolist()
    assert np.isclose(np.linalg.det(np.array(r["u"]).reshape(3, 3)), 1)
    with pytest.raises(ValueError):
        expr.normalise(F.col("m"), 3, "other")
    with pytest.raises(AssertionError):
        expr.weight(F.col("m"), "huber", 2, limit=-1.0)


def test_sonar_columns_equal_the_kernel(spark):
    m, r = 4, np.random.default_rng(5)
    cov, s = gen.sonar_covariance(m), det.Sonar(m, gen.steering(m, 20, 50))
    x = r.standard_normal((40, 2 * m)) + 1j * r.standard_normal((40, 2 * m))
    df = spark.createDataFrame([(k, v.real.tolist(), v.imag.tolist()) for k, v in enumerate(x)], "k int, re array<double>, im array<double>")
    got = df.select("k", *(c.alias(n) for n, c in sonar_expr.statistics(F.col("re"), F.col("im"), s, cov).items())).orderBy("k").toPandas()
    for name, want in s.all(x, cov).items():
        assert np.allclose(got[name], want, rtol=1e-6), name


def test_adaptive(spark):
    m = 2
    cov, s = gen.sonar_covariance(m), det.Sonar(m, gen.steering(m, 30, 45))
    primary, secondary = gen.sonar_samples(spark, 12, m, cov, seed=1), gen.sonar_samples(spark, 11, m, cov, 16, seed=2)
    got = adaptive.adaptive(primary, secondary, s, est.scm).toPandas()
    assert sorted(got["trial"]) == list(range(11)) and got.notna().all().all()
    with pytest.raises(ValueError):
        adaptive.adaptive(primary, None, s, est.scm)


def test_first_samples_that_share_an_n(spark):
    """The least of them is primary in any order of rows, the other is secondary."""
    rows = [(0, 0, 5, [3.0], [0.0]), (0, 0, 5, [2.0], [1.0]), (0, 0, None, [1.0], [0.0]), (0, 0, 9, [7.0], [0.0])]
    for order in (rows, rows[::-1]):
        primary, secondary = adaptive.split(spark.createDataFrame(order, "trial long, t int, n int, re array<double>, im array<double>"))
        assert [tuple(r) for r in primary.collect()] == [(0, [2.0], [1.0])]
        assert sorted(r.re[0] for r in secondary.collect()) == [1.0, 3.0, 7.0]


def test_decisions(spark):
    r = np.random.default_rng(6)
    h0 = np.round(r.standard_normal(501), 2)
    df = spark.createDataFrame([(float(v),) for v in h0] + [(None,)], "stat double")
    curve = decide.pfa_curve(df, 37).orderBy("threshold").toPandas()
    grid = h0.min() + np.arange(37) * (h0.max() - h0.min()) / 36
    assert np.allclose(curve["threshold"], grid) and np.allclose(curve["pfa"], [(h0 > v).mean() for v in curve["threshold"]])
    assert np.isclose(decide.threshold_at_pfa(df, 0.1).first()[0], np.quantile(h0, 0.9))
    same = decide.pfa_curve(spark.createDataFrame([(1.0,), (1.0,)], "stat double"), 5).toPandas()
    assert (same["pfa"] == 0).all()


def test_windows_agree_and_tiles_do_not_matter(spark):
    r = np.random.default_rng(7)
    image = r.standard_normal((2, 9, 11))
    df = spark.createDataFrame([(t, i, j, float(image[t, i, j])) for t in range(2) for i in range(9) for j in range(11)], "t int, row int, col int, v double")
    want = np.lib.stride_tricks.sliding_window_view(image, (3, 3), axis=(1, 2)).sum((-1, -2))
    for got in (windows.box_sums(df, 3, 9, 11, ["v"]), windows.unfold(df, 3, 9, 11).groupBy("t", "wrow", "wcol").agg(F.sum("v").alias("v"))):
        rows_ = got.collect()
        assert len(rows_) == want.size and all(np.isclose(v["v"], want[v["t"], v["wrow"], v["wcol"]]) for v in rows_)
    for k, stride in ((3, 2), (4, 3), (2, 5)):
        some = np.lib.stride_tricks.sliding_window_view(image, (k, k), axis=(1, 2))[:, ::stride, ::stride].sum((-1, -2))
        rows_ = windows.unfold(df, k, 9, 11, stride).groupBy("t", "wrow", "wcol").agg(F.sum("v").alias("v")).collect()
        assert len(rows_) == some.size and all(np.isclose(v["v"], some[v["t"], v["wrow"], v["wcol"]]) for v in rows_)


def test_palindrome_and_splits(spark):
    df = spark.createDataFrame([(t, 0, 0, float(t)) for t in range(4)], "t int, row int, col int, v double")
    assert [v["v"] for v in windows.palindrome(df, 4, 3).orderBy("t").collect()] == [0, 1, 2, 3, 2, 1, 0, 1, 2, 3, 2, 1]
    assert windows.palindrome(df.where("t = 0"), 1, 3).count() == 3
    assert windows.auto_splits(9000, 1000) == (6, 8)


def test_npy_files_and_export(spark, tmp_path):
    a = np.random.default_rng(8).standard_normal((3, 4, 5, 2)) + 1j
    np.save(tmp_path / "a.npy", a)
    df = files.read_npy(spark, f"file://{tmp_path}/a.npy")
    r = df.where("t = 1 and row = 2 and col = 3").first()
    assert df.count() == 60 and np.allclose(np.array(r["re"]) + 1j * np.array(r["im"]), a[1, 2, 3])
    assert files.crop(df, 2, 2).count() == 12
    files.write_time_first(df, f"file://{tmp_path}/tf")
    assert spark.read.parquet(f"file://{tmp_path}/tf").where("t = 2").count() == 20
    files.export(df.select("t", "row"), f"file://{tmp_path}/out", window=7)
    assert '"rows": 60' in spark.read.text(f"file://{tmp_path}/out/provenance").first()[0]
    np.save(tmp_path / "b.npy", a[0])
    with pytest.raises(Exception, match="four axes"):
        files.read_npy(spark, f"file://{tmp_path}/b.npy").count()


def test_series_is_the_same_in_any_layout(spark):
    law = {"seed": 1, "law": "compound", "dates": 3, "n": 4, "before": gen.covariance(2, 0)}
    a, b = (sorted((v["trial"], v["t"], v["n"], tuple(v["re"])) for v in df.collect()) for df in (gen.series(spark, 6, **law), gen.series(spark, 6, **law).repartition(5)))
    assert a == b and len(a) == 72


def test_stream_equals_batch(spark, tmp_path):
    """Events in shuffled files, several files a day, replayed as a stream: the same running statistics."""
    source = event_samples(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).where("t < '2024-01-12'")
    # the last date passes the watermark by one late sample
    end = spark.createDataFrame([("end", "2024-03-01")], "key string, t string").select("key", F.col("t").cast("timestamp").alias("t"), F.array(F.lit(0.0), F.lit(0.0)).alias("re"), F.lit(None).cast("array<double>").alias("im"))
    path = f"file://{tmp_path}/in"
    dates = sorted(v[0] for v in source.select("t").distinct().collect())
    for part in (dates[:4], dates[4:], None):
        chunk = end if part is None else source.where(F.col("t").isin(part))
        chunk.repartition(2).write.mode("append").parquet(path)
        stream = spark.readStream.schema(source.schema).parquet(path)
        q = online(stream, det.gaussian_step, "8 days", least=3).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(v["key"], v["t"]): (v["n_dates"], v["stat"]) for v in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    flat = source.select("key", "t", F.get("re", F.lit(0)).alias("x0"), F.get("re", F.lit(1)).alias("x1"))
    want = {(v["key"], v["t"]): (v["n_dates"], v["stat"]) for v in mom.glrt_running(flat, ["key"], "t", ["x0", "x1"]).collect()}
    assert want and set(got) == set(want)
    assert all(got[k][0] == v[0] and np.isclose(got[k][1], v[1], atol=1e-8) for k, v in want.items())


def test_compound_stream_replays_all_events(spark):
    """Every day of every type, each with all its events, as the step gives them without a stream."""
    sf = "/root/testdata/sf0.001"
    days = defaultdict(list)
    for r in event_samples(spark.read.parquet(f"{sf}/events.parquet")).where("key is not null and t is not null").collect():
        days[r["key"], r["t"]].append(r["re"])
    state, want = {}, {}
    for (key, t), x in sorted(days.items()):
        if len(x) >= 3:
            want[key, t], state[key] = det.compound_step(state.get(key), np.array(sorted(x)), iter_max=20)
    got = {(r["key"], r["t"]): r["stat"] for r in entries.queries()["e10_stream_compound"](spark, sf).collect()}
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)
    assert all(s[1].shape[-1] == max(len(x) for (k, _), x in days.items() if k == key) for key, s in state.items())


def test_uneven_dates_equal_even_ones():
    """A list of dates gives what the array gives; a date's missing sample leaves its texture as it was."""
    r = np.random.default_rng(3)
    x = r.normal(size=(2, 5, 9, 4)) + 1j * r.normal(size=(2, 5, 9, 4))
    dates = list(np.moveaxis(x, 1, 0))
    for f in (det.student_glrt, det.tyler_glrt, det.compound_glrt, lambda y: det.kronecker_glrt(y, 2, 2)):
        np.testing.assert_allclose(f(dates), f(x), rtol=1e-9)
        assert np.isfinite(f([dates[0], *(d[:, :8] for d in dates[1:])])).all()
    for step, k in ((det.compound_step, 1), (lambda s, y: det.kronecker_step(s, y, 2, 2), 2)):
        before = step(None, dates[0])[1]
        after = step(before, dates[1][:, :8])[1]
        assert (after[k][:, 8] == before[k][:, 8]).all() and (after[k][:, :8] != before[k][:, :8]).any()


def test_queries_without_sql_take_all_embeddings(spark):
    sf = "/root/testdata/sf0.001"
    labels = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect():
        labels[r["label"]].append(np.array(r["embedding"][:4], float) + 1j * np.array(r["embedding"][32:36], float))
    query = lambda name: {r["g"]: r for r in entries.queries()[name](spark, sf).collect()}
    glrt, forms, factors = query("d04_two_step_tyler"), query("c17_kronecker_forms"), query("c19_kronecker_mm_h1")
    for g, x in labels.items():
        dates = [np.stack([v for k, v in enumerate(x) if k * 5 // len(x) == t])[None] for t in range(5)]
        assert abs(glrt[g]["stat"] - det.tyler_glrt(dates)[0]) < 1e-5
        assert len(forms[g]["v"]) == len(factors[g]["tau"]) == len(x)


def test_scm_with_more_features_than_samples(spark):
    got = {r["d"]: r for r in entries.queries()["j06_scm_few_samples"](spark, "").collect()}
    assert sorted(got) == np.unique(np.logspace(0.5, 3, 30, dtype=int)).tolist() and max(got) == 1000
    x = [1 + np.random.default_rng(10 + 30 + k).standard_normal((10, 30)) for k in range(50)]
    want = [np.linalg.norm(np.cov(v) - np.eye(10)) for v in x]
    assert abs(got[10]["cov_error_mean"] - np.mean(want)) < 1e-9 and abs(got[10]["cov_error_std"] - np.std(want)) < 1e-9
    assert got[1000]["mean_error_mean"] > got[10]["mean_error_mean"] and got[1000]["condition_mean"] > 1e10


def test_thresholds_are_exact_quantiles(spark):
    r = np.random.default_rng(5)
    values = np.concatenate([r.standard_normal(4000), np.full(900, 0.25)])
    df = spark.createDataFrame([(float(v), int(k % 3)) for k, v in enumerate(values)] + [(None, 1), (7.0, None)], "stat double, g int")
    for pfa in (0.001, 0.1, 0.42, 1.0):
        for accuracy in (100, 100_000):  # with the small one, values outside the sketch's range are only counted
            got = {x["g"]: x["threshold"] for x in decide.threshold_at_pfa(df, pfa, ["g"], accuracy=accuracy).collect()}
            assert got.keys() == {0, 1, 2, None} and got[None] == 7.0
            assert all(np.isclose(got[g], np.quantile(values[np.arange(len(values)) % 3 == g], 1 - pfa)) for g in range(3))


def test_exceeding_counts_strictly_and_by_key(spark):
    stats = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (2, 5.0), (1, None)], "g int, stat double")
    limits = spark.createDataFrame([(1, 2.0), (1, 0.0), (2, 5.0), (2, 4.0), (3, 1.0)], "g int, threshold double")
    got = {(x["g"], x["threshold"]): x["pd"] for x in decide.exceeding(stats, limits, ["g"], "pd").collect()}
    assert got == {(1, 2.0): 1 / 3, (1, 0.0): 1.0, (2, 5.0): 0.0, (2, 4.0): 1.0}
    assert {x["threshold"]: x["pd"] for x in decide.exceeding(stats, limits.drop("g"), [], "pd").collect()} == {0.0: 1.0, 1.0: 0.75, 2.0: 0.5, 4.0: 0.25, 5.0: 0.0}


def test_curves_by_key(spark):
    df = spark.createDataFrame([(k % 2, float(k)) for k in range(40)], "g int, stat double")
    got = decide.pfa_curve(df, 5, keys=["g"]).toPandas()
    for g, rows in got.groupby("g"):
        own = np.arange(40)[np.arange(40) % 2 == g]
        assert len(rows) == 5 and all(np.isclose(p, (own > t).mean()) for t, p in zip(rows["threshold"], rows["pfa"], strict=True))


def test_short_dates_are_left_out_or_null(spark):
    r = np.random.default_rng(3)
    rows = [("a", t, *map(float, r.standard_normal(2))) for t in range(3) for _ in range(2 if t == 1 else 6)]
    df = spark.createDataFrame(rows, "g string, t int, x0 double, x1 double")
    out, null = (mom.glrt(df, ["g"], "t", ["x0", "x1"], short).first() for short in ("leave out", "null"))
    assert out["n_dates"] == 2 and out["stat"] is not None and null["n_dates"] == 3 and null["stat"] is None
    run = [x["stat"] for x in mom.glrt_running(df, ["g"], "t", ["x0", "x1"], "null").orderBy("t").collect()]
    assert run[0] is not None and run[1:] == [None, None]


def test_reweighting_keeps_null_keys(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(g, *map(float, r.standard_normal(2))) for g in ("a", None) for _ in range(20)], "g string, x0 double, x1 double")
    assert {x["g"] for x in mom.reweighted(df, ["g"], 2, "tyler", "trace").collect()} == {"a", None}


def test_groups_across_batches_and_beyond_the_bound(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        obs = spark.createDataFrame([(g, 0, k, [float(k), float(g)]) for g in (1, 2, 3) for k in range(10 * g)], "g int, t int, n int, re array<double>")
        count = lambda x: {"v": np.full(len(x), float(x.shape[2]))}
        assert {x["g"]: x["v"] for x in groups.by_group(obs.coalesce(1), ["g"], count, "v double").collect()} == {1: 10.0, 2: 20.0, 3: 30.0}
        with pytest.raises(Exception, match="use moments"):
            groups.by_group(obs, ["g"], count, "v double", most=100).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_silent_arrays_stay_finite():
    r = np.random.default_rng(6)
    x = r.standard_normal((40, 4)) + 1j * r.standard_normal((40, 4))
    x[0, 2:] = 0
    sonar = det.Sonar(2, gen.steering(2, 30.0, 45.0))
    assert np.isfinite(sonar.rao(x, np.eye(4))).all() and np.isfinite(est.two_array_tyler(x[None], 2)).all()


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_streams_take_the_same_dates_in_every_time_zone(spark, tmp_path, zone):
    """Six hourly dates, then time that goes on by four hours; across a clock change where the zone has one."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        r = np.random.default_rng(7)
        rows = [("k", 1_762_059_600 + 3600 * h, [float(v) for v in r.standard_normal(2)]) for h in range(6) for _ in range(5)]
        for part, some in enumerate((rows, [("k", 1_762_059_600 + 3600 * 9, [0.0, 1.0])])):
            df = spark.createDataFrame(some, "key string, s long, re array<double>")
            df.select("key", F.timestamp_seconds("s").alias("t"), "re", F.lit(None).cast("array<double>").alias("im")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
            stream = spark.readStream.schema("key string, t timestamp, re array<double>, im array<double>").parquet(f"file://{tmp_path}/in")
            online(stream, det.gaussian_step, "1 hour", 3).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = [x[0] for x in spark.read.parquet(f"file://{tmp_path}/out").select(F.unix_seconds("t")).orderBy("t").collect()]
        assert got == [1_762_059_600 + 3600 * h for h in range(6)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_simulated_trials_depend_on_their_numbers_alone(spark):
    m = 2
    cov, sonar = gen.sonar_covariance(m), det.Sonar(m, gen.steering(m, 30, 45))
    detectors = {"known": ("glrt", None), "scm": ("rao", est.scm), "one": ("array2", None)}
    signal = lambda c: sonar.steering @ np.full(2, 0.01 * c)
    kernel = trials.sonar_kernel(sonar, cov, detectors, signal, seed=3)
    rows = lambda parts: {(r["case"], r["trial"], r["detector"]): r["stat"] for r in trials.sonar_trials(spark, 3, 7, kernel, detectors, m, parts=parts).collect()}
    got = rows(1)
    assert got.keys() == rows(5).keys() and len(got) == 3 * 7 * 3 and all(np.isclose(v, got[k], rtol=1e-10) for k, v in rows(5).items())
    for case, trial in ((0, 0), (2, 6)):
        x = gen.sonar_trial((3, case, trial), 4 * m + 1, np.linalg.cholesky(cov))
        first = x[0] + signal(case)
        assert np.isclose(got[case, trial, "known"], sonar.glrt(first, cov)) and np.isclose(got[case, trial, "one"], sonar.single(first, cov, 1))
        assert np.isclose(got[case, trial, "scm"], sonar.rao(first, est.scm(x[1:])))
    assert trials.sonar_trials(spark, 3, 0, kernel, detectors, m).count() == 0


def test_change_comes_at_a_share_of_the_dates(spark):
    sizes = montecarlo.Sizes(6, least=5, most=12, points=3)
    none, some = montecarlo._laws("gaussian")
    for law, changes in ((none, False), (some, True)):
        rows = montecarlo.over_dates(spark, law, *montecarlo._METHODS["gaussian"], sizes, changes).collect()
        assert len(rows) == 6 * len(sizes.dates) * 2 and {r["T"] for r in rows} == set(sizes.dates)
        for r in rows:
            length, at = (r["T"], max(2, r["T"] // 2)) if changes else (max(sizes.dates), None)
            x = gen.trial(k=r["trial"], **(law | {"dates": length, "change": at}))[: r["T"]]
            assert np.isclose(r["stat"], det.gaussian_glrt(x))


def test_power_of_a_change_exceeds_its_false_alarms(spark):
    got = montecarlo.detection_power(spark, "gaussian", montecarlo.Sizes(200, most=12, points=3, pfa=0.05)).toPandas()
    assert len(got) == 2 * 3 and (got["power"] > 0.3).all() and got.groupby("T")["power"].std().max() < 1e-9


def test_rates_of_detectors_rise_with_the_signal(spark):
    _, alphas = gen.snr_sweep(montecarlo._M, montecarlo._COV, montecarlo._SONAR.steering, -40.0, 20.0, 2)
    signal = lambda c: montecarlo._SONAR.steering @ np.full(2, alphas[c])
    got = montecarlo.detected(spark, montecarlo.DETECTORS, 0.05, 400, 100, 2, signal).toPandas().pivot(index="detector", columns="case", values="pd")
    assert set(got.index) == set(montecarlo.DETECTORS) and (got[0] < 0.2).all() and (got[1] > 0.8).all()
