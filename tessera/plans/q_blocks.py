"""Queries of scans, block aggregates and the date stack."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import blocks as B
from tessera.operators import joins as J
from tessera.operators import robust as R
from tessera.operators import stencil as T

from . import fixtures as X
from .registry import query, r6, rounded


@query("a01_block_sum", f"WITH {X.PAIR} SELECT i // 8 AS i, j // 4 AS j, round(sum(r_re), 6) + 0.0::DOUBLE AS r_re, round(sum(r_im), 6) + 0.0::DOUBLE AS r_im, count(*) AS n FROM pr GROUP BY i // 8, j // 4")
def a01(s, d):
    return rounded(B.block_sum(X.slc_pair(s, d), 8, 4, ["r_re", "r_im"]))


@query("a02_accumulate", f"WITH {X.ACC} SELECT 'A' AS freq, d1, d2, i, j, {r6('z_re', 'z_im', 'p1', 'p2', 'n', digits=10)} FROM acc")
def a02(s, d):
    # sums of products of five-decimal values: rounding short of their last digit could meet ties
    return rounded(B.accumulate(X.stack(s, d), 4, 4), 10)


@query("a03_rebin_split", f"WITH {X.LAT} SELECT i // 5 AS i, j // 5 AS j, round(sum(azimuth), 9) + 0.0::DOUBLE AS total, round(coalesce(sum(azimuth) FILTER (WHERE (i + j) % 2 = 0), 0), 9) + 0.0::DOUBLE AS even, round(coalesce(sum(azimuth) FILTER (WHERE (i + j) % 2 <> 0), 0), 9) + 0.0::DOUBLE AS odd FROM lat WHERE i < 95 AND j < 60 GROUP BY i // 5, j // 5")
def a03(s, d):
    return rounded(B.rebin_split(X.lattice(s, d), 5, *X.LAT_SHAPE, "azimuth"), 9)


@query("a04_coherence", f"WITH {X.ACC} SELECT d1, d2, i, j, valid, {r6('coh')} FROM coh")
def a04(s, d):
    return rounded(B.coherence(B.accumulate(X.stack(s, d), 4, 4)).select("d1", "d2", "row", "col", "valid", "coh"))


_ML = """ml AS (SELECT i // 8 AS i, j // 4 AS j, sum(r_re * s_re + r_im * s_im) AS z_re, sum(r_im * s_re - r_re * s_im) AS z_im, sum(r_re * r_re + r_im * r_im) AS p1, sum(s_re * s_re + s_im * s_im) AS p2 FROM pr GROUP BY 1, 2),
mc AS (SELECT *, sqrt(z_re * z_re + z_im * z_im) / sqrt(greatest(p1 * p2, 1e-30)) AS coh FROM ml)"""


@query("a05_multilook_interferogram", f"WITH {X.PAIR}, {_ML} SELECT i, j, {r6('z_re', 'z_im', 'p1', 'p2', 'coh')} FROM mc")
def a05(s, d):
    return rounded(B.multilook(X.slc_pair(s, d), (8, 4), X.PAIR_SHAPE))


@query("a06_multilook_coherence", f"WITH {X.PAIR}, {_ML} SELECT i, j, {r6('coh')} FROM mc")
def a06(s, d):
    return rounded(B.multilook(X.slc_pair(s, d), (8, 4)).select("row", "col", "coh"))


def _logs(s, d):
    c = B.coherence(B.accumulate(X.stack(s, d), 4, 4))
    return c.select(F.concat_ws("_", "d1", "d2").alias("pair"), "d1", "d2", "row", "col", F.when(F.col("valid"), S.log_floor(F.col("coh"))).alias("l"))


_LOGS = X.ACC + ", lg AS (SELECT d1 || '_' || d2 AS pair, d1, d2, i, j, CASE WHEN valid THEN ln(greatest(coh, 1e-6)) END AS l FROM coh)"


@query("a08_stack_median", f"WITH {_LOGS} SELECT i, j, round(median(l), 6) + 0.0::DOUBLE AS med, count(l) AS n FROM lg GROUP BY i, j")
def a08(s, d):
    return rounded(B.stack_median(_logs(s, d)))


@query("a08_leave_one_out", f"WITH {_LOGS}, o AS (SELECT a.pair, a.i, a.j, median(b.l) AS loo FROM lg a JOIN lg b ON a.i = b.i AND a.j = b.j AND a.pair <> b.pair WHERE a.l IS NOT NULL GROUP BY 1, 2, 3) SELECT lg.pair, lg.i, lg.j, round(loo, 6) + 0.0::DOUBLE AS loo FROM lg LEFT JOIN o ON lg.pair = o.pair AND lg.i = o.i AND lg.j = o.j")
def a08_loo(s, d):
    return rounded(B.leave_one_out_median(_logs(s, d)).select("pair", "row", "col", "loo"))


@query("a09_block_median_mad", f"WITH {X.LAT}, m AS (SELECT i // 8 AS bi, j // 8 AS bj, median(azimuth) AS med FROM lat GROUP BY 1, 2), r AS (SELECT i // 8 AS bi, j // 8 AS bj, median(abs(azimuth - med)) AS mad FROM lat JOIN m ON i // 8 = m.bi AND j // 8 = m.bj GROUP BY 1, 2) SELECT i, j, round(med, 6) + 0.0::DOUBLE AS block_med, round(mad, 6) + 0.0::DOUBLE AS block_mad FROM lat JOIN m ON i // 8 = m.bi AND j // 8 = m.bj JOIN r ON r.bi = m.bi AND r.bj = m.bj")
def a09(s, d):
    return rounded(B.block_median(X.lattice(s, d), 8, "azimuth").select("row", "col", "block_med", "block_mad"))


_MED = ", md AS (SELECT i, j, median(l) AS med FROM lg GROUP BY i, j), rs AS (SELECT pair, d1, d2, lg.i, lg.j, l - med AS r, lg.j * 1.0::DOUBLE AS x FROM lg JOIN md ON lg.i = md.i AND lg.j = md.j WHERE l IS NOT NULL AND med > ln(0.15::DOUBLE))"
_FIT = """, xm AS (SELECT pair, avg(x) AS xm FROM rs GROUP BY pair), rx AS (SELECT rs.*, x - xm AS c FROM rs JOIN xm USING (pair)),
sm AS (SELECT pair, count(*)::DOUBLE AS s0, sum(c) AS s1, sum(c * c) AS s2, sum(c * c * c) AS s3, sum(c * c * c * c) AS s4, sum(r) AS b0, sum(c * r) AS b1, sum(c * c * r) AS b2 FROM rx GROUP BY pair),
dt AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM sm),
cf AS (SELECT pair, (b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - s3 * b2) + s2 * (b1 * s3 - s2 * b2)) / det AS c0,
  (s0 * (b1 * s4 - s3 * b2) - b0 * (s1 * s4 - s3 * s2) + s2 * (s1 * b2 - b1 * s2)) / det AS c1,
  (s0 * (s2 * b2 - b1 * s3) - s1 * (s1 * b2 - b1 * s2) + b0 * (s1 * s3 - s2 * s2)) / det AS c2 FROM dt),
rr AS (SELECT rx.*, r - c0 - c1 * c - c2 * c * c AS e FROM rx JOIN cf USING (pair)), rd AS (SELECT *, e - avg(e) OVER (PARTITION BY pair) AS resid FROM rr)"""


def _residuals(s, d):
    logs = _logs(s, d)
    med = B.stack_median(logs).select("row", "col", "med")
    r = logs.join(med, ["row", "col"]).where(F.col("l").isNotNull() & (F.col("med") > F.ln(F.lit(0.15)))).withColumn("r", F.col("l") - F.col("med")).withColumn("x", F.col("col").cast("double"))
    return R.remove_polynomial(r, "x", "r", ["pair"])


@query("a10_regression_removal", f"WITH {_LOGS}{_MED}{_FIT} SELECT pair, i, j, round(resid, 6) + 0.0::DOUBLE AS resid FROM rd")
def a10(s, d):
    return rounded(_residuals(s, d).select("pair", "row", "col", "resid"))


@query("e01_pair_index", f"WITH {_LOGS}{_MED}{_FIT} SELECT d1, d2, round(avg(greatest(-resid, 0)), 6) + 0.0::DOUBLE AS loss, count(*) AS n_cells, rank() OVER (ORDER BY round(avg(greatest(-resid, 0)), 6) DESC, d1, d2) AS rank FROM rd GROUP BY d1, d2")
def pair_index(s, d):
    """One row for each pair of dates: mean loss of coherence against the stack, and its rank."""
    out = _residuals(s, d).groupBy("d1", "d2").agg(F.avg(S.loss_field(F.col("resid"))).alias("loss"), F.count("*").alias("n_cells"))
    out = rounded(out)
    return out.withColumn("rank", F.rank().over(W.orderBy(F.desc("loss"), "d1", "d2")).cast("long"))


@query("a11_line_fit", f"WITH {X.BANDS} SELECT i, count(*) AS n, round(CASE WHEN count(*) >= 40 THEN regr_slope(phi_b, phi_a) END, 6) + 0.0::DOUBLE AS slope, round(CASE WHEN count(*) >= 40 THEN corr(phi_a, phi_b) END, 6) + 0.0::DOUBLE AS corr FROM bd GROUP BY i")
def a11(s, d):
    return rounded(R.line_fit(X.bands(s, d), "phi_a", "phi_b", 40, ["row"]))


@query("a12_amplitude_gate", f"WITH {X.BANDS}, t AS (SELECT corr(phi_a, phi_b) AS c, covar_pop(phi_a, phi_b) AS sxy, var_pop(phi_a) AS sxx, var_pop(phi_b) AS syy FROM bd), u AS (SELECT c, least(sxy / sxx, syy / sxy) AS lo, greatest(sxy / sxx, syy / sxy) AS hi FROM t) SELECT round(c, 6) + 0.0::DOUBLE AS corr, round(lo, 6) + 0.0::DOUBLE AS low, round(hi, 6) + 0.0::DOUBLE AS high, c >= 0.9 AND lo >= 0.85 AND hi <= 1.15 AS pass FROM u")
def a12(s, d):
    return rounded(R.amplitude_gate(X.bands(s, d), "phi_a", "phi_b"))


_RC = "m AS (SELECT median(azimuth) AS med, count(azimuth) AS n FROM lat), s AS (SELECT greatest(1.4826 * median(abs(azimuth - med)), 1e-6) AS sigma FROM lat, m)"


@query("a13_residual_constant", f"WITH {X.LAT}, {_RC} SELECT round(any_value(med), 6) + 0.0::DOUBLE AS med, round(any_value(sigma), 6) + 0.0::DOUBLE AS sigma, any_value(n) AS n, round(median(azimuth), 6) + 0.0::DOUBLE AS level FROM lat, m, s WHERE abs(azimuth - med) <= 3 * sigma")
def a13(s, d):
    return rounded(B.residual_constant(X.lattice(s, d), "azimuth"))


@query("a14_noise_level", f"WITH {X.LAT}, o AS (SELECT unnest(range(-2, 3)) AS k), nb AS (SELECT a.i + x.k AS i, a.j + y.k AS j, a.range_ AS v FROM lat a, o x, o y), md AS (SELECT i, j, median(v) AS m FROM nb GROUP BY i, j), r AS (SELECT range_ - m AS r FROM lat JOIN md USING (i, j)), c AS (SELECT median(r) AS c FROM r) SELECT round(1.4826 * median(abs(r - c)), 6) + 0.0::DOUBLE AS noise FROM r, c")
def a14(s, d):
    r = T.running_median(X.lattice(s, d).select("row", "col", F.col("range").alias("v")), 5).select((F.col("v") - F.col("med")).alias("r"))
    c = r.agg(F.median("r").alias("c"))
    return rounded(r.crossJoin(F.broadcast(c)).agg((1.4826 * F.median(F.abs(F.col("r") - F.col("c")))).alias("noise")))


@query("a16_structure_function", f"WITH {X.KEPT}, l AS (SELECT unnest([1, 2, 4, 8, 16, 32]) AS lag), p AS (SELECT lag, abs(b.v - a.v) AS e FROM k a JOIN l ON true JOIN k b ON b.i = a.i AND b.j = a.j + lag WHERE a.v IS NOT NULL AND b.v IS NOT NULL) SELECT lag, count(*) AS n, round(CASE WHEN count(*) >= 1000 THEN median(e) END, 6) + 0.0::DOUBLE AS sf FROM p GROUP BY lag")
def a16(s, d):
    return rounded(T.structure_function(X.kept(s, d), (1, 2, 4, 8, 16, 32), 1000))


@query("a18_display_stats", f"WITH {X.KEPT}, p AS (SELECT avg((v IS NOT NULL)::INT::DOUBLE) AS valid, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.99) AS p99 FROM k) SELECT {r6('valid', 'p01', 'p50', 'p99')}, (SELECT round(quantile_cont(abs(v - p50), 0.98), 6) + 0.0::DOUBLE FROM k, p) AS half_width FROM p")
def a18(s, d):
    return rounded(B.stats(X.kept(s, d)))


@query("a20_circular_mean", f"WITH {X.LAT}, c AS (SELECT atan2(avg(sin(azimuth)), avg(cos(azimuth))) AS c FROM lat) SELECT i, j, round(c, 6) + 0.0::DOUBLE AS datum, round(atan2(sin(azimuth - c), cos(azimuth - c)), 6) + 0.0::DOUBLE AS turned FROM lat, c")
def a20(s, d):
    return rounded(B.circular_mean(X.lattice(s, d), "azimuth").select("row", "col", "datum", "turned"))


@query("a21_angular_concentration", f"WITH {X.SPECTRUM}, w AS (SELECT i % 20 AS g, atan2(-(j - 31.5::DOUBLE), i % 7 + 0.5::DOUBLE) AS t, v * v AS p FROM em), z AS (SELECT g, sum(p * cos(2 * t)) / sum(p) AS c, sum(p * sin(2 * t)) / sum(p) AS s FROM w GROUP BY g) SELECT g, round(sqrt(c * c + s * s), 6) + 0.0::DOUBLE AS r, round(degrees(atan2(s, c)) / 2 + 180 - floor((degrees(atan2(s, c)) / 2 + 180) / 180) * 180 - CASE WHEN degrees(atan2(s, c)) / 2 + 180 - floor((degrees(atan2(s, c)) / 2 + 180) / 180) * 180 >= 90 THEN 180 ELSE 0 END, 4) + 0.0::DOUBLE AS theta FROM z")
def a21(s, d):
    w = X.spectrum(s, d).select((F.col("row") % 20).alias("g"), F.atan2(-(F.col("col") - 31.5), F.col("row") % 7 + 0.5).alias("t"), (F.col("v") * F.col("v")).alias("p"))
    mean = lambda f: F.sum(F.col("p") * f(2 * F.col("t"))) / F.sum("p")
    z = w.groupBy("g").agg(mean(F.cos).alias("c"), mean(F.sin).alias("s"))
    half = S.pmod(F.degrees(F.atan2("s", "c")) / 2 + 180, 180)
    return rounded(z.select("g", S.magnitude(F.col("c"), F.col("s")).alias("r"), (half - F.when(half >= 90, 180).otherwise(0)).alias("theta")), theta=4)


@query("a23_plane_trend", f"WITH {X.KEPT}, t AS (SELECT regr_slope(v, i) AS unused FROM k), s AS (SELECT count(*)::DOUBLE AS s0, sum(i)::DOUBLE AS s1, sum(j)::DOUBLE AS s2, sum(i * i)::DOUBLE AS s11, sum(i * j)::DOUBLE AS s12, sum(j * j)::DOUBLE AS s22, sum(v) AS b0, sum(i * v) AS b1, sum(j * v) AS b2 FROM k WHERE v IS NOT NULL), dt AS (SELECT *, s0 * (s11 * s22 - s12 * s12) - s1 * (s1 * s22 - s12 * s2) + s2 * (s1 * s12 - s11 * s2) AS det FROM s), c AS (SELECT (b0 * (s11 * s22 - s12 * s12) - s1 * (b1 * s22 - s12 * b2) + s2 * (b1 * s12 - s11 * b2)) / det AS c0, (s0 * (b1 * s22 - s12 * b2) - b0 * (s1 * s22 - s12 * s2) + s2 * (s1 * b2 - b1 * s2)) / det AS c1, (s0 * (s11 * b2 - b1 * s12) - s1 * (s1 * b2 - b1 * s2) + b0 * (s1 * s12 - s11 * s2)) / det AS c2 FROM dt) SELECT i, j, round(c0 + c1 * i + c2 * j, 6) + 0.0::DOUBLE AS trend FROM k, c")
def a23(s, d):
    return rounded(R.plane(X.kept(s, d)).select("row", "col", "trend"))


@query("a24_slope_periodogram", f"WITH {X.LAT}, b AS (SELECT i // 32 AS p, CAST(floor(range_ * 100) AS INT) AS h, sum(cos(azimuth)) AS c, sum(sin(azimuth)) AS s FROM lat GROUP BY 1, 2), k AS (SELECT unnest(range(-60, 61)) / 10.0::DOUBLE AS k), e AS (SELECT p, k, sqrt(pow(sum(c * cos(k * h / 100.0::DOUBLE) + s * sin(k * h / 100.0::DOUBLE)), 2) + pow(sum(s * cos(k * h / 100.0::DOUBLE) - c * sin(k * h / 100.0::DOUBLE)), 2)) AS m FROM b, k GROUP BY 1, 2) SELECT k, round(sum(m), 4) + 0.0::DOUBLE AS power FROM e GROUP BY k")
def a24(s, d):
    b = X.lattice(s, d).groupBy(F.expr("row div 32").alias("p"), F.floor(F.col("range") * 100).cast("int").alias("h")).agg(F.sum(F.cos("azimuth")).alias("c"), F.sum(F.sin("azimuth")).alias("s"))
    e = b.withColumn("k", F.explode(F.transform(F.sequence(F.lit(-60), F.lit(60)), lambda x: x / F.lit(10.0))))
    a = F.col("k") * F.col("h") / 100.0
    m = e.groupBy("p", "k").agg(S.magnitude(F.sum(F.col("c") * F.cos(a) + F.col("s") * F.sin(a)), F.sum(F.col("s") * F.cos(a) - F.col("c") * F.sin(a))).alias("m"))
    return rounded(m.groupBy("k").agg(F.sum("m").alias("power")), power=4)


@query("a27_calibration_table", f"WITH {X.LAT}, t AS (SELECT i // 16 AS block, j % 8 AS a, avg(snr) AS coh FROM lat GROUP BY 1, 2), z AS (SELECT block, coh AS c0 FROM t WHERE a = 0) SELECT a, round(avg(coh), 6) + 0.0::DOUBLE AS mean, count(*) FILTER (WHERE coh - c0 > 0.005) AS improved FROM t JOIN z USING (block) GROUP BY a")
def a27(s, d):
    t = X.lattice(s, d).groupBy(F.expr("row div 16").alias("block"), (F.col("col") % 8).alias("a")).agg(F.avg("snr").alias("coh"))
    z = t.where("a = 0").select("block", F.col("coh").alias("c0"))
    return rounded(t.join(z, "block").groupBy("a").agg(F.avg("coh").alias("mean"), F.count_if(F.col("coh") - F.col("c0") > 0.005).alias("improved")))


@query("a28_gain_choice", f"WITH {X.LAT}, t AS (SELECT i // 4 AS block, j % 5 AS step, avg(snr) AS coh FROM lat GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY coh DESC, step) AS n FROM t) SELECT block, step FROM r WHERE n = 1")
def a28(s, d):
    t = X.lattice(s, d).groupBy(F.expr("cast(row div 4 as int)").alias("block"), (F.col("col") % 5).alias("step")).agg(F.avg("snr").alias("coh"))
    return R.best_step(t, ["block"], "step", "coh")


@query("a29_mask_fraction", f"WITH {X.LAT} SELECT i, round(avg((snr >= 8)::INT::DOUBLE), 6) + 0.0::DOUBLE AS share FROM lat GROUP BY i")
def a29(s, d):
    return rounded(X.lattice(s, d).groupBy("row").agg(F.avg((F.col("snr") >= 8).cast("double")).alias("share")))


@query("a31_range_looks", "SELECT p_partkey, CAST(greatest(1, round_even(60.0::DOUBLE / (p_size / 2.0::DOUBLE), 0)) AS BIGINT) AS looks FROM part")
def a31(s, d):
    return X.table(s, d, "part").select("p_partkey", S.range_looks(60.0, F.col("p_size") / 2.0).cast("long").alias("looks"))


@query("a32_elongation_reach", f"WITH {X.KEPT}, l AS (SELECT unnest([1, 2, 4, 8, 16, 32]) AS lag), p AS (SELECT a.i % 4 AS g, lag, median(abs(b.v - a.v)) AS sf FROM k a JOIN l ON true JOIN k b ON b.j = a.j AND b.i = a.i + lag WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2), q AS (SELECT *, lag(lag) OVER w AS x0, lag(sf) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY g ORDER BY lag)), h AS (SELECT g, arg_min(CASE WHEN y0 IS NULL THEN lag::DOUBLE ELSE x0 + (1.2 - y0) * (lag - x0) / (sf - y0) END, lag) AS reach FROM q WHERE sf >= 1.2 GROUP BY g) SELECT DISTINCT p.g, round(coalesce(reach, 1e9), 6) + 0.0::DOUBLE AS reach FROM p LEFT JOIN h USING (g)")
def a32(s, d):
    k = X.kept(s, d).where("v is not null")
    sent = k.withColumn("lag", F.explode(F.array(*[F.lit(x) for x in (1, 2, 4, 8, 16, 32)]))).select((F.col("row") % 4).alias("g"), "lag", (F.col("row") + F.col("lag")).alias("row"), "col", F.col("v").alias("w"))
    sf = sent.join(k, ["row", "col"]).groupBy("g", "lag").agg(F.median(F.abs(F.col("w") - F.col("v"))).alias("sf"))
    out = T.first_crossing(sf, "lag", "sf", 1.2, ["g"])
    return rounded(out.withColumn("reach", F.when(F.col("reach") == float("inf"), 1e9).otherwise(F.col("reach"))))


@query("a33_axis_bearing", f"WITH {X.POINTS} SELECT CAST(floor(y) AS INT) AS band, round(median(degrees(atan2(x + 145, y - 62))), 4) + 0.0::DOUBLE AS bearing FROM pt GROUP BY 1")
def a33(s, d):
    p = X.points(s, d).groupBy(F.floor("y").cast("int").alias("band")).agg(F.median(S.bearing(F.col("x") + 145, F.col("y") - 62)).alias("bearing"))
    return rounded(p, bearing=4)


@query("j01_date_pairs", f"WITH {X.STACK}, t AS (SELECT DISTINCT d FROM st) SELECT a.d AS d1, b.d AS d2 FROM t a JOIN t b ON a.d < b.d")
def j01(s, d):
    return B.date_pairs(X.stack(s, d))


@query("j03_interferogram_join", f"WITH {X.PAIR}, {X.LAT} SELECT pr.i, pr.j, round(r_re * s_re + r_im * s_im, 6) + 0.0::DOUBLE AS re, round(r_im * s_re - r_re * s_im, 6) + 0.0::DOUBLE AS im, round(range_, 6) + 0.0::DOUBLE AS off FROM pr JOIN lat ON lat.i = pr.i AND lat.j = pr.j")
def j03(s, d):
    re, im = S.times_conj(*[F.col(c) for c in ("r_re", "r_im", "s_re", "s_im")])
    return rounded(X.slc_pair(s, d).join(X.lattice(s, d), ["row", "col"]).select("row", "col", re.alias("re"), im.alias("im"), F.col("range").alias("off")))


_GRIDS = "gr AS (SELECT CAST(n_nationkey AS VARCHAR) AS d, 100.0::DOUBLE + 30.0 * (n_nationkey % 5) AS x0, 9000.0::DOUBLE - 30.0 * (n_nationkey % 3) AS y0, 200 AS nx, 150 AS ny FROM nation)"


@query("j04_lattice_alignment", f"WITH {_GRIDS}, f AS (SELECT min(x0) AS rx, max(y0) AS ry FROM gr), k AS (SELECT d, CAST((x0 - rx) / 30 AS INT) AS kx, CAST((ry - y0) / 30 AS INT) AS ky, nx, ny FROM gr, f), o AS (SELECT CAST(ceil(max(kx) / 4.0) * 4 AS INT) AS cx, CAST(ceil(max(ky) / 4.0) * 4 AS INT) AS cy, min(kx + nx) AS ex, min(ky + ny) AS ey FROM k) SELECT d, cx - kx AS off_col, cy - ky AS off_row, (ey - cy) // 4 * 4 AS rows, (ex - cx) // 4 * 4 AS cols FROM k, o")
def j04(s, d):
    k = F.col("n_nationkey")
    g = X.table(s, d, "nation").select(k.cast("string").alias("d"), (100.0 + 30.0 * (k % 5)).alias("x0"), (9000.0 - 30.0 * (k % 3)).alias("y0"), F.lit(200).alias("nx"), F.lit(150).alias("ny"))
    return J.aligned(g, 30.0, 30.0, 4, 4)


_AX = "t AS (SELECT id, greatest(0::DOUBLE, least(95::DOUBLE, (y - 59.7::DOUBLE) / 0.06::DOUBLE)) AS a, greatest(0::DOUBLE, least(63::DOUBLE, (x + 150.3::DOUBLE) / 0.17::DOUBLE)) AS b FROM pt), u AS (SELECT *, least(CAST(floor(a) AS INT), 94) AS i0, least(CAST(floor(b) AS INT), 62) AS j0 FROM t), c AS (SELECT id, i0 + di AS i, j0 + dj AS j, (CASE WHEN di = 1 THEN a - i0 ELSE 1 - (a - i0) END) * (CASE WHEN dj = 1 THEN b - j0 ELSE 1 - (b - j0) END) AS w FROM u, (SELECT unnest([0, 0, 1, 1]) AS di, unnest([0, 1, 0, 1]) AS dj))"


def _axes():
    return J.fractional(F.col("y"), 59.7, 0.06, 96), J.fractional(F.col("x"), -150.3, 0.17, 64)


@query("j06_bilinear_lookup", f"WITH {X.LAT}, {X.POINTS}, {_AX} SELECT id, round(sum(w * azimuth), 6) + 0.0::DOUBLE AS azimuth FROM c JOIN lat USING (i, j) GROUP BY id")
def j06(s, d):
    return rounded(J.bilinear(X.points(s, d), X.lattice(s, d), *_axes(), ["id"], "azimuth"))


@query("j08_map_to_lattice", f"WITH {X.KEPT}, {X.POINTS}, {_AX}, g AS (SELECT id, sum(w * v) AS sv, sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END) AS sw FROM c JOIN k USING (i, j) GROUP BY id) SELECT id, round(CASE WHEN sw > 0.5 THEN sv / sw END, 6) + 0.0::DOUBLE AS v FROM g")
def j08(s, d):
    return rounded(J.bilinear(X.points(s, d), X.kept(s, d), *_axes(), ["id"], "v", 0.5))


@query("j07_scatter_average", f"WITH {X.POINTS}, c AS (SELECT CAST(trunc((y - 60.05::DOUBLE) / 0.5::DOUBLE) AS INT) AS i, CAST(trunc((x + 149.95::DOUBLE) / 0.5::DOUBLE) AS INT) AS j, v FROM pt) SELECT i, j, round(avg(v), 4) + 0.0::DOUBLE AS mean, count(*) AS n FROM c WHERE i BETWEEN 0 AND 8 AND j BETWEEN 0 AND 18 GROUP BY i, j")
def j07(s, d):
    return rounded(J.scatter_mean(X.points(s, d), -149.95, 60.05, 0.5, 0.5, 19, 9), 4)


_POLY = "pg AS (SELECT r_regionkey AS id, -150.0::DOUBLE + 2 * r_regionkey AS x0, 60.0::DOUBLE + r_regionkey * 0.5::DOUBLE AS y0 FROM region), vt AS (SELECT id, 0 AS k, x0 + 0.013 AS x, y0 + 0.017 AS y FROM pg UNION ALL SELECT id, 1, x0 + 1.87, y0 + 0.21 FROM pg UNION ALL SELECT id, 2, x0 + 0.91, y0 + 3.03 FROM pg), eg AS (SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM vt a JOIN vt b ON a.id = b.id AND b.k = (a.k + 1) % 3)"


@query("j10_point_in_polygon", f"WITH {X.POINTS}, {_POLY} SELECT pt.id AS point, eg.id AS id FROM pt, eg GROUP BY pt.id, eg.id HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1")
def j10(s, d):
    p = X.points(s, d).withColumnRenamed("id", "point")
    return J.points_in_polygons(p, X.polygons(s, d), ["point"], 1.0)


@query("j11_mask_lookup", f"WITH {X.LAT}, {X.POINTS}, m AS (SELECT i, j FROM lat WHERE snr < 7) SELECT id FROM pt WHERE EXISTS (SELECT 1 FROM m WHERE i = CAST(floor((y - 60) * 19) AS INT) AND j = CAST(floor((x + 150) * 6) AS INT))")
def j11(s, d):
    m = X.lattice(s, d).where("snr < 7").select("row", "col")
    return X.points(s, d).withColumn("row", F.floor((F.col("y") - 60) * 19).cast("int")).withColumn("col", F.floor((F.col("x") + 150) * 6).cast("int")).join(m, ["row", "col"], "left_semi").select("id")


@query("j12_water_cells", f"WITH {X.LAT}, cv AS (SELECT i, j, CAST(floor(snr) AS INT) * 10 % 100 AS class FROM lat WHERE j % 5 <> 0) SELECT lat.i, lat.j, coalesce(class IN (0, 80), true) AS water FROM lat LEFT JOIN cv ON lat.i = cv.i AND lat.j = cv.j")
def j12(s, d):
    lat = X.lattice(s, d)
    cover = lat.where("col % 5 <> 0").select("row", "col", (F.floor("snr").cast("int") * 10 % 100).alias("class"))
    return J.water_cells(lat.select("row", "col"), cover).select(F.col("row").alias("i"), F.col("col").alias("j"), "water")


_BR = "ax AS (SELECT CAST(s_suppkey * s_suppkey AS DOUBLE) / 7 AS x, round(s_acctbal, 2) AS y FROM supplier), sg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM ax)"


@query("j13_bracket_interpolation", f"WITH {_BR}, p AS (SELECT p_partkey AS id, greatest((SELECT min(x) FROM ax), least((SELECT max(x) FROM ax), p_partkey * 0.77::DOUBLE)) AS t FROM part) SELECT id, round(y0 + coalesce((t - x0) * (y1 - y0) / (x1 - x0), 0), 4) + 0.0::DOUBLE AS y FROM p JOIN sg ON t >= x0 AND (t < x1 OR x1 IS NULL)")
def j13(s, d):
    ax = X.table(s, d, "supplier").select((F.col("s_suppkey") * F.col("s_suppkey")).cast("double").alias("k"), F.round("s_acctbal", 2).alias("y")).select((F.col("k") / 7).alias("x"), "y")
    p = X.table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 0.77).alias("t"))
    return rounded(J.bracket(p, ax, "t").select("id", "y"), 4)


@query("j16_missing_nodes", f"WITH {X.LAT} SELECT i, j FROM (SELECT unnest(range(0, 96)) AS i), (SELECT unnest(range(0, 64)) AS j) EXCEPT SELECT i, j FROM lat WHERE snr >= 8")
def j16(s, d):
    from tessera.operators.fixpoint import grid_cells

    return J.missing(grid_cells(s, *X.LAT_SHAPE), X.lattice(s, d).where("snr >= 8"), ["row", "col"]).select(F.col("row").cast("long").alias("i"), F.col("col").cast("long").alias("j"))


@query("j21_bias_lookup", f"WITH {X.LAT}, cv AS (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS x), ax AS (SELECT x, sin(6 * x) AS y FROM cv), sg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM ax), p AS (SELECT i, j, azimuth - floor(azimuth) AS t FROM lat) SELECT i, j, round(y0 + coalesce((t - x0) * (y1 - y0) / (x1 - x0), 0), 6) + 0.0::DOUBLE AS bias FROM p JOIN sg ON t >= x0 AND (t < x1 OR x1 IS NULL)")
def j21(s, d):
    ax = s.range(11).select((F.col("id") / 10.0).alias("x")).select("x", F.sin(6 * F.col("x")).alias("y"))
    p = X.lattice(s, d).select("row", "col", S.pmod(F.col("azimuth"), 1).alias("t"))
    return rounded(J.bracket(p, ax, "t").select("row", "col", F.col("y").alias("bias")))
