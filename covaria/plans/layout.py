"""Queries of the image-layout operators, wavelet functions, generators and image pipelines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from covaria.functions import detectors as det
from covaria.functions import expr, signal
from covaria.operators import moments as mom
from covaria.operators import windows as win
from covaria.operators.groups import by_group, detect, running
from covaria.plans.registry import PIXELS, pixels, query, r6, table
from covaria.sources import generate as gen
from covaria.sources.files import crop

SIDE, K = 12, 3


@query("h01_crop", f"SELECT t, row, col, round(v, 6) + 0.0 AS v FROM {PIXELS} p WHERE row < 5 AND col < 7")
def _(spark, d):
    return crop(pixels(spark, d), 5, 7).select("t", "row", "col", r6("v"))


_FRAMES = "(SELECT k, CASE WHEN k % 12 < 7 THEN k % 12 ELSE 12 - k % 12 END AS f FROM (SELECT unnest(range(0, 21)) AS k) q)"


@query("h03_palindrome", f"SELECT k::INT AS t, row, col, round(v, 6) + 0.0 AS v FROM {PIXELS} p JOIN {_FRAMES} i ON p.t - 1995 = i.f")
def _(spark, d):
    frames = pixels(spark, d).withColumn("t", F.col("t") - 1995)
    return win.palindrome(frames, 7, 3).select("t", "row", "col", r6("v"))


@query("h08_unfold", f"SELECT wrow::INT AS wrow, wcol::INT AS wcol, t, count(*) AS n, round(sum(v * (row * 31 + col)), 4) + 0.0 AS s FROM {PIXELS} p, (SELECT unnest(range(0, 10)) AS wrow) a, (SELECT unnest(range(0, 10)) AS wcol) b WHERE row BETWEEN wrow AND wrow + 2 AND col BETWEEN wcol AND wcol + 2 GROUP BY wrow, wcol, t")
def _(spark, d):
    rows = win.unfold(pixels(spark, d), K, SIDE, SIDE)
    return rows.groupBy("wrow", "wcol", "t").agg(F.count("*").alias("n"), (F.round(F.sum(F.col("v") * (F.col("row") * 31 + F.col("col"))), 4) + 0.0).alias("s"))


@query("h08_unfold_stride", f"SELECT wrow::INT AS wrow, wcol::INT AS wcol, t, count(*) AS n, round(sum(v), 4) + 0.0 AS s FROM {PIXELS} p, (SELECT unnest(range(0, 5)) AS wrow) a, (SELECT unnest(range(0, 5)) AS wcol) b WHERE row BETWEEN 2 * wrow AND 2 * wrow + 2 AND col BETWEEN 2 * wcol AND 2 * wcol + 2 GROUP BY wrow, wcol, t")
def _(spark, d):
    return win.unfold(pixels(spark, d), K, SIDE, SIDE, 2).groupBy("wrow", "wcol", "t").agg(F.count("*").alias("n"), (F.round(F.sum("v"), 4) + 0.0).alias("s"))


_BOX = f"SELECT t, wrow::INT AS wrow, wcol::INT AS wcol, round(sum(v), 4) + 0.0 AS v FROM {PIXELS} p, (SELECT unnest(range(0, 10)) AS wrow) a, (SELECT unnest(range(0, 10)) AS wcol) b WHERE row BETWEEN wrow AND wrow + 2 AND col BETWEEN wcol AND wcol + 2 GROUP BY wrow, wcol, t"


@query("h08_box_sums", _BOX)
def _(spark, d):
    return win.box_sums(win.filled(pixels(spark, d), SIDE, SIDE), K, SIDE, SIDE, ["v"]).select("t", "wrow", "wcol", (F.round("v", 4) + 0.0).alias("v"))


@query("h09_tiles", f"SELECT trow::INT AS trow, tcol::INT AS tcol, t, count(*) AS n, round(sum(v), 4) + 0.0 AS s FROM {PIXELS} p, (SELECT unnest(range(0, 3)) AS trow) a, (SELECT unnest(range(0, 3)) AS tcol) b WHERE row >= 4 * trow AND row < 4 * trow + 6 AND col >= 4 * tcol AND col < 4 * tcol + 6 GROUP BY trow, tcol, t")
def _(spark, d):
    """Each pixel in its tile of side 4, and as halo in those whose 3 x 3 windows reach it."""
    return win.tiled(pixels(spark, d), 4, K).select(F.col("trow").cast("int").alias("trow"), F.col("tcol").cast("int").alias("tcol"), "t", "v").groupBy("trow", "tcol", "t").agg(F.count("*").alias("n"), (F.round(F.sum("v"), 4) + 0.0).alias("s"))


@query("h10_process_all_tiles", _BOX)
def _(spark, d):
    """The box sums of h08, by a kernel that gets whole tiles: independent of the tiling."""
    import pandas as pd

    def kernel(key, frame: pd.DataFrame) -> pd.DataFrame:
        trow, tcol, t = (int(v) for v in key)
        a = np.full((4 + K - 1, 4 + K - 1), np.nan)
        a[frame["row"] - 4 * trow, frame["col"] - 4 * tcol] = frame["v"]
        s = np.nansum(np.lib.stride_tricks.sliding_window_view(a, (K, K)), axis=(2, 3))
        i, j = np.meshgrid(np.arange(4) + 4 * trow, np.arange(4) + 4 * tcol, indexing="ij")
        ok = (i <= SIDE - K) & (j <= SIDE - K)
        return pd.DataFrame({"t": t, "wrow": i[ok], "wcol": j[ok], "v": s[ok]})

    rows = win.tiled(pixels(spark, d), 4, K).groupBy("trow", "tcol", "t").applyInPandas(kernel, "t int, wrow int, wcol int, v double")
    return rows.select("t", "wrow", "wcol", (F.round("v", 4) + 0.0).alias("v"))


@query("h16_splitting_coordinates", "SELECT a.x AS r0, a.y AS r1, b.x AS c0, b.y AS c1 FROM (SELECT greatest(0, i * 20 - 3) AS x, CASE WHEN i = 1 THEN 40 ELSE least(40, (i + 1) * 20 + 3) END AS y FROM (SELECT unnest(range(0, 2)) AS i) q) a, (SELECT greatest(0, i * 14 - 3) AS x, CASE WHEN i = 2 THEN 42 ELSE least(42, (i + 1) * 14 + 3) END AS y FROM (SELECT unnest(range(0, 3)) AS i) q) b")
def _(spark, d):
    return spark.createDataFrame(win.tile_ranges(40, 42, 2, 3, 7), "r0 long, r1 long, c0 long, c1 long")


@query("h17_splits_auto", "SELECT need, floor(sqrt(n))::INT AS rows, ceil(n / floor(sqrt(n)))::INT AS cols FROM (SELECT need, floor(need / (0.2 * 1000))::INT + 1 AS n FROM (SELECT unnest([10, 500, 2500, 9000]) AS need) q) r")
def _(spark, d):
    return spark.createDataFrame([(n, *win.auto_splits(n, 1000)) for n in (10, 500, 2500, 9000)], "need int, rows int, cols int")


@query("h18_bell", "SELECT o_orderkey, round(1.0 / (1.0 + pow(abs((o_totalprice / 1000 - 150) / 40), 6)), 6) + 0.0 AS v FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r6(expr.bell(F.col("o_totalprice") / 1000, F.lit(40.0), F.lit(3.0), F.lit(150.0)), "v"))


_GRID = ("(SELECT i, j, 2 * 1e10 / 3e8 + 2 * 1e9 / 3e8 * (-0.5 + j / 15.0) AS kx, -1 / (2 * 0.5) + i * (1 / (2 * 0.5) - 1 / (2 * 12 * 0.5) + 1 / (2 * 0.5)) / 11.0 AS ky "
         "FROM (SELECT unnest(range(0, 12)) AS i) a, (SELECT unnest(range(0, 16)) AS j) b) q")  # fmt: skip


def grid(spark, rows=12, cols=16, bandwidth=1e9, azimuth=0.5, frequency=1e10):
    """i, j, kappa, theta: the wave-number grid as columns."""
    kx = F.lit(2 * frequency / signal.LIGHT) + 2 * bandwidth / signal.LIGHT * (F.col("j") / (cols - 1) - 0.5)
    top = 1 / (2 * azimuth)
    ky = F.lit(-top) + F.col("i") * (2 * top - top / rows) / (rows - 1)
    cells = spark.range(rows).withColumnRenamed("id", "i").crossJoin(spark.range(cols).withColumnRenamed("id", "j"))
    return cells.select("i", "j", F.sqrt(kx * kx + ky * ky).alias("kappa"), F.atan2(ky, kx).alias("theta"))


@query("h19_frequency_grid", f"SELECT i, j, round(sqrt(kx * kx + ky * ky), 6) + 0.0 AS kappa, round(atan2(ky, kx), 6) + 0.0 AS theta FROM {_GRID}")
def _(spark, d):
    return grid(spark).select("i", "j", r6("kappa"), r6("theta"))


_POLAR = f"(SELECT i, j, sqrt(kx * kx + ky * ky) AS k, atan2(ky, kx) AS t FROM {_GRID}) p"
_ENDS = f"(SELECT min(k) AS k0, max(k) AS k1, min(t) AS t0, max(t) AS t1 FROM {_POLAR}) e"


@query("h20_wavelet_filter", f"SELECT i, j, m, n, round(1 / (1 + pow(abs((k - k0 - (k1 - k0) / 2 * (m + 0.5)) / ((k1 - k0) / 4)), 20)) * 1 / (1 + pow(abs((t - t0 - (t1 - t0) / 3 * (n + 0.5)) / ((t1 - t0) / 6)), 20)), 5) + 0.0 AS v FROM {_POLAR}, {_ENDS}, (SELECT unnest(range(0, 2)) AS m) a, (SELECT unnest(range(0, 3)) AS n) b")
def _(spark, d):
    g = grid(spark)
    e = g.agg(F.min("kappa").alias("k0"), F.max("kappa").alias("k1"), F.min("theta").alias("t0"), F.max("theta").alias("t1"))
    bands = spark.range(2).withColumnRenamed("id", "m").crossJoin(spark.range(3).withColumnRenamed("id", "n"))
    w, u = (F.col("k1") - F.col("k0")) / 2, (F.col("t1") - F.col("t0")) / 3
    v = expr.bell(F.col("kappa"), w / 2, F.lit(10.0), F.col("k0") + w * (F.col("m") + 0.5)) * expr.bell(F.col("theta"), u / 2, F.lit(10.0), F.col("t0") + u * (F.col("n") + 0.5))
    return g.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(bands)).select("i", "j", "m", "n", (F.round(v, 5) + 0.0).alias("v"))


def subbands(frames, r: int = 2, l: int = 2, decimate: bool = True, convention: str = "mixed"):
    """t, row, col, re, im: p * r * l channels of pixels(t, row, col, re, im); channel pol * r * l + m * l + n.

    A transform needs a whole image, so one task holds one date's image; dates are independent.
    """
    import pandas as pd

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        h, w = int(frame["row"].max()) + 1, int(frame["col"].max()) + 1
        x = np.stack([np.asarray(v, float) for v in frame["re"]])
        if frame["im"].notna().all():
            x = x + 1j * np.stack([np.asarray(v, float) for v in frame["im"]])
        image = np.zeros((x.shape[1], h, w), complex)
        image[:, frame["row"], frame["col"]] = x.T
        if decimate and (h % r or w % l):
            raise ValueError("decimation needs rows divisible by r and columns by l")
        kappa, theta = signal.wave_grid(h, w, 1e9, 0.15, 0.5, 1e10)
        bands = np.moveaxis(signal.decompose(image, signal.filter_bank(kappa, theta, r, l, 10.0, 10.0), convention), 0, 2)
        bands = bands.reshape(h, w, -1)
        bands = bands[::r, ::l] if decimate else bands
        h, w = bands.shape[:2]
        flat = bands.reshape(h * w, -1)
        return pd.DataFrame({"t": frame["t"].iloc[0], "row": np.repeat(np.arange(h), w), "col": np.tile(np.arange(w), h), "re": list(flat.real), "im": list(flat.imag)})

    return frames.groupBy("t").applyInPandas(kernel, "t int, row int, col int, re array<double>, im array<double>")


def scene(spark, d, fill: bool = True):
    """pixels(t, row, col, re, im) of two channels: mean quantity and mean discount, about standardised; absent ones are zero."""
    x = table(spark, d, "lineitem")
    got = x.groupBy((F.year("l_shipdate") - 1995).alias("t"), (F.col("l_orderkey") % SIDE).cast("int").alias("row"), (F.col("l_partkey") % SIDE).cast("int").alias("col"))
    got = got.agg((F.avg("l_quantity") - 25.5).alias("a"), ((F.avg("l_discount") - 0.05) * 500).alias("b"))
    got = win.filled(got, SIDE, SIDE) if fill else got
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return got.select("t", "row", "col", F.array(zero("a"), zero("b")).alias("re"), F.lit(None).cast("array<double>").alias("im"))


_SCENE = f"(SELECT year(l_shipdate) - 1995 AS t, (l_orderkey % {SIDE})::INT AS row, (l_partkey % {SIDE})::INT AS col, avg(l_quantity) - 25.5 AS a, (avg(l_discount) - 0.05) * 500 AS b FROM lineitem GROUP BY 1, 2, 3)"


@query("h21_decompose_wavelet")
def _(spark, d):
    return subbands(scene(spark, d), decimate=False).select("t", "row", "col", F.posexplode("re").alias("k", "v")).select("t", "row", "col", "k", r6("v"))


@query("h22_wavelet_series")
def _(spark, d):
    return subbands(scene(spark, d)).select("t", "row", "col", F.posexplode("re").alias("k", "v")).select("t", "row", "col", "k", r6("v"))


@query("h23_pauli", "SELECT n, round(sqrt((a - e) * (a - e) + (b - f) * (b - f)), 6) + 0.0 AS r, round(sqrt(c * c + d * d), 6) + 0.0 AS g, round(sqrt((a + e) * (a + e) + (b + f) * (b + f)), 6) + 0.0 AS b FROM (SELECT vec_id AS n, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS {c}" for k, c in enumerate("abcdef")) + " FROM embeddings) q")
def _(spark, d):
    e = [F.get("embedding", F.lit(k)).cast("double") for k in range(6)]
    colours = expr.pauli((e[0], e[1]), (e[2], e[3]), (e[4], e[5]))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), *(r6(c, n) for c, n in zip(colours, "rgb", strict=True)))


# Maps: each window position is a pixel with K * K samples a date.


def windowed(frames, k: int = K, height: int = SIDE, width: int = SIDE):
    """obs(wrow, wcol, t, n, re, im)."""
    rows = win.unfold(frames, k, height, width)
    return rows.select("wrow", "wcol", "t", ((F.col("row") - F.col("wrow")) * k + F.col("col") - F.col("wcol")).alias("n"), "re", "im")


def box_moments(frames, k: int = K, height: int = SIDE, width: int = SIDE):
    """t, wrow, wcol, s00, s01, s11 of two real channels by box sums: no window is materialised."""
    x = frames.select("t", "row", "col", F.get("re", F.lit(0)).alias("a"), F.get("re", F.lit(1)).alias("b"))
    x = x.select("t", "row", "col", (F.col("a") * F.col("a")).alias("s00"), (F.col("a") * F.col("b")).alias("s01"), (F.col("b") * F.col("b")).alias("s11"))
    sums = win.box_sums(x, k, height, width, ["s00", "s01", "s11"])
    return sums.select("t", "wrow", "wcol", *((F.col(c) / (k * k)).alias(c) for c in ("s00", "s01", "s11")))


_WIN = f"(SELECT wrow::INT AS wrow, wcol::INT AS wcol, t, sum(a * a) / 9 AS s00, sum(a * b) / 9 AS s01, sum(b * b) / 9 AS s11 FROM {_SCENE} p, (SELECT unnest(range(0, 10)) AS wrow) x, (SELECT unnest(range(0, 10)) AS wcol) y WHERE row BETWEEN wrow AND wrow + 2 AND col BETWEEN wcol AND wcol + 2 GROUP BY wrow, wcol, t)"
_LD = "ln(s00 * s11 - s01 * s01)"
_MAP = f"SELECT wrow, wcol, round(count(*) * ln(avg(s00) * avg(s11) - avg(s01) * avg(s01)) - sum({_LD}), 4) + 0.0 AS stat FROM {_WIN} q GROUP BY wrow, wcol"


@query("i01_offline_gaussian_map", _MAP)
def _(spark, d):
    b = box_moments(scene(spark, d))
    ld = F.log(F.col("s00") * F.col("s11") - F.col("s01") * F.col("s01"))
    got = b.groupBy("wrow", "wcol").agg((F.count("*") * F.log(F.avg("s00") * F.avg("s11") - F.avg("s01") * F.avg("s01")) - F.sum(ld)).alias("stat"))
    return got.select("wrow", "wcol", (F.round("stat", 4) + 0.0).alias("stat"))


query("i01_offline_gaussian_map_kernel", _MAP)(lambda spark, d: detect(windowed(scene(spark, d)), ["wrow", "wcol"], det.gaussian_glrt).select("wrow", "wcol", (F.round("stat", 4) + 0.0).alias("stat")))

_OVER = "OVER (PARTITION BY wrow, wcol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("i04_online_gaussian_map", f"SELECT wrow, wcol, t, round(n * ln(a * c - b * b) - l, 4) + 0.0 AS stat FROM (SELECT wrow, wcol, t, count(*) {_OVER} AS n, avg(s00) {_OVER} AS a, avg(s01) {_OVER} AS b, avg(s11) {_OVER} AS c, sum({_LD}) {_OVER} AS l FROM {_WIN} q) r")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("wrow", "wcol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ld = F.log(F.col("s00") * F.col("s11") - F.col("s01") * F.col("s01"))
    stat = F.count("*").over(w) * F.log(F.avg("s00").over(w) * F.avg("s11").over(w) - F.pow(F.avg("s01").over(w), 2)) - F.sum(ld).over(w)
    return box_moments(scene(spark, d)).select("wrow", "wcol", "t", (F.round(stat, 4) + 0.0).alias("stat"))


def _last(df):
    return df.select("wrow", "wcol", r6(F.element_at("stats", -1), "stat"))


query("i02_offline_compound_map")(lambda spark, d: detect(windowed(scene(spark, d)), ["wrow", "wcol"], lambda x: det.compound_glrt(x, iter_max=10)).select("wrow", "wcol", r6("stat")))
query("i03_offline_kronecker_map")(lambda spark, d: detect(windowed(subbands(scene(spark, d)), 3, SIDE // 2, SIDE // 2), ["wrow", "wcol"], lambda x: det.kronecker_glrt(x, 2, 4, iter_max=5)).select("wrow", "wcol", r6("stat")))
query("i05_online_compound_map")(lambda spark, d: _last(running(windowed(scene(spark, d)), ["wrow", "wcol"], lambda s, x: det.compound_step(s, x, iter_max=5))))
query("i06_online_kronecker_map")(lambda spark, d: _last(running(windowed(subbands(scene(spark, d)), 3, SIDE // 2, SIDE // 2), ["wrow", "wcol"], lambda s, x: det.kronecker_step(s, x, 2, 4, iter_max=5))))
query("h13_online_image", f"SELECT wrow, wcol, stat FROM ({_MAP}) q")(lambda spark, d: running(windowed(scene(spark, d)), ["wrow", "wcol"], det.gaussian_step).select("wrow", "wcol", (F.round(F.element_at("stats", -1), 4) + 0.0).alias("stat")))


@query("i07_time_first", f"SELECT t, count(*) AS n, round(sum(v), 4) + 0.0 AS s FROM {PIXELS} p GROUP BY t")
def _(spark, d):
    """Pixels grouped by date, as write_time_first lays them out."""
    return pixels(spark, d).groupBy("t").agg(F.count("*").alias("n"), (F.round(F.sum("v"), 4) + 0.0).alias("s"))


@query("i08_pauli_frames", f"SELECT t, row, col, round(abs(a - b), 6) + 0.0 AS r, round(abs(b), 6) + 0.0 AS g, round(abs(a + b), 6) + 0.0 AS b FROM {_SCENE} p")
def _(spark, d):
    zero, a, b = F.lit(0.0), F.get("re", F.lit(0)), F.get("re", F.lit(1))
    colours = expr.pauli((a, zero), (b, zero), (b, zero))
    return scene(spark, d, fill=False).select("t", "row", "col", *(r6(c, n) for c, n in zip(colours, "rgb", strict=True)))


# Generators that are closed forms.


@query("g09_sonar_covariance", "SELECT i, j, round(0.0003 * pow(0.4, abs(ix - jx)) * pow(0.9, abs(iy - jy)), 12) + 0.0 AS v FROM (SELECT i, CASE WHEN i < 8 THEN i ELSE 3.5 END AS ix, CASE WHEN i < 8 THEN 3.5 ELSE i - 8 END AS iy FROM (SELECT unnest(range(0, 16)) AS i) q) a, (SELECT j, CASE WHEN j < 8 THEN j ELSE 3.5 END AS jx, CASE WHEN j < 8 THEN 3.5 ELSE j - 8 END AS jy FROM (SELECT unnest(range(0, 16)) AS j) q) b")
def _(spark, d):
    m = 8
    place = lambda k, first: F.when(k < m, k if first else F.lit((m - 1) / 2)).otherwise(F.lit((m - 1) / 2) if first else k - m).cast("double")
    c = spark.range(2 * m).withColumnRenamed("id", "i").crossJoin(spark.range(2 * m).withColumnRenamed("id", "j"))
    v = 3e-4 * F.pow(F.lit(0.4), F.abs(place(F.col("i"), True) - place(F.col("j"), True))) * F.pow(F.lit(0.9), F.abs(place(F.col("i"), False) - place(F.col("j"), False)))
    return c.select("i", "j", (F.round(v, 12) + 0.0).alias("v"))


@query("g10_steering_matrix", "SELECT i, k, round(CASE WHEN i // 8 = k THEN cos(pi() * sin(radians(CASE k WHEN 0 THEN 30.0 ELSE 45.0 END)) * (i % 8)) ELSE 0.0 END, 6) + 0.0 AS re, round(CASE WHEN i // 8 = k THEN sin(pi() * sin(radians(CASE k WHEN 0 THEN 30.0 ELSE 45.0 END)) * (i % 8)) ELSE 0.0 END, 6) + 0.0 AS im FROM (SELECT unnest(range(0, 16)) AS i) a, (SELECT unnest(range(0, 2)) AS k) b")
def _(spark, d):
    p = gen.steering(8, 30.0, 45.0)
    c = spark.range(16).withColumnRenamed("id", "i").crossJoin(spark.range(2).withColumnRenamed("id", "k"))
    phase = F.pi() * F.sin(F.radians(F.when(F.col("k") == 0, F.lit(30.0)).otherwise(45.0))) * (F.col("i") % 8)
    own = F.floor(F.col("i") / 8) == F.col("k")
    assert p.shape == (16, 2)
    return c.select("i", "k", r6(F.when(own, F.cos(phase)).otherwise(0.0), "re"), r6(F.when(own, F.sin(phase)).otherwise(0.0), "im"))


_UNIT = float(-25.0)


@query("g14_snr_sweep", f"SELECT k, round(db, 6) + 0.0 AS db, round(sqrt(pow(10.0, db / 10) / {(10 ** (_UNIT / 10)) / float(gen.snr_sweep(8, gen.sonar_covariance(8), gen.steering(8, 30.0, 45.0))[1][0]) ** 2!r}), 6) + 0.0 AS alpha FROM (SELECT k, -25.0 + k * 30.0 / 149 AS db FROM (SELECT unnest(range(0, 150)) AS k) q) r")
def _(spark, d):
    db, alpha = gen.snr_sweep(8, gen.sonar_covariance(8), gen.steering(8, 30.0, 45.0))
    return spark.createDataFrame([(k, float(x), float(a)) for k, (x, a) in enumerate(zip(db, alpha, strict=True))], "k long, db double, alpha double").select("k", r6("db"), r6("alpha"))
