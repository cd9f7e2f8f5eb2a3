"""Queries of windows, gates, scalar functions, rankings, sets and fixpoints."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import fixpoint as P
from tessera.operators import joins as J
from tessera.operators import robust as R
from tessera.operators import stencil as T

from . import fixtures as X
from .registry import query, r6, rounded


def _full(s, d):
    return X.lattice(s, d).select("row", "col", F.col("azimuth").alias("v"))


_MIRROR = """pad AS (SELECT i, j, azimuth AS v FROM lat UNION ALL SELECT -1 - i, j, azimuth FROM lat WHERE i < 2 UNION ALL SELECT 191 - i, j, azimuth FROM lat WHERE i >= 94),
p2 AS (SELECT i, j, v FROM pad UNION ALL SELECT i, -1 - j, v FROM pad WHERE j < 2 UNION ALL SELECT i, 127 - j, v FROM pad WHERE j >= 62),
o AS (SELECT unnest(range(-2, 3)) AS k)"""


@query("w01_box_mean", f"WITH {X.LAT}, {_MIRROR} SELECT a.i, a.j, round(avg(b.v), 6) + 0.0::DOUBLE AS v FROM lat a, o x, o y, p2 b WHERE b.i = a.i + x.k AND b.j = a.j + y.k GROUP BY a.i, a.j")
def w01(s, d):
    return rounded(T.box_mean(_full(s, d), X.LAT_SHAPE, 5))


@query("a07_boxcar_coherence", f"WITH {X.PAIR}, o AS (SELECT unnest(range(-1, 2)) AS k), nb AS (SELECT a.i + x.k AS i, a.j + y.k AS j, a.r_re * a.s_re + a.r_im * a.s_im AS re, a.r_im * a.s_re - a.r_re * a.s_im AS im, a.r_re * a.r_re + a.r_im * a.r_im AS p, a.s_re * a.s_re + a.s_im * a.s_im AS q FROM pr a, o x, o y) SELECT i, j, round(sqrt(sum(re) * sum(re) + sum(im) * sum(im)) / sqrt(greatest(sum(p) * sum(q), 1e-30)), 6) + 0.0::DOUBLE AS coh FROM nb WHERE i BETWEEN 0 AND 239 AND j BETWEEN 0 AND 127 GROUP BY i, j")
def a07(s, d):
    p = X.slc_pair(s, d)
    re, im = S.times_conj(*[F.col(c) for c in ("r_re", "r_im", "s_re", "s_im")])
    power = lambda c: F.col(f"{c}_re") * F.col(f"{c}_re") + F.col(f"{c}_im") * F.col(f"{c}_im")
    sent = p.select("row", "col", re.alias("re"), im.alias("im"), power("r").alias("p"), power("s").alias("q"), F.explode(T.offsets(1)).alias("o"))
    sent = sent.select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), "re", "im", "p", "q").where(F.col("row").between(0, 239) & F.col("col").between(0, 127))
    return rounded(sent.groupBy("row", "col").agg((S.magnitude(F.sum("re"), F.sum("im")) / F.sqrt(F.greatest(F.sum("p") * F.sum("q"), F.lit(1e-30)))).alias("coh")))


_NB = "o AS (SELECT unnest(range(-{r}, {r1})) AS k), nb AS (SELECT a.i - x.k AS i, a.j - y.k AS j, a.v FROM k a, o x, o y WHERE a.v IS NOT NULL{c})"


@query("w02_running_median", f"WITH {X.KEPT}, {_NB.format(r=2, r1=3, c='')}, m AS (SELECT i, j, median(v) AS med FROM nb GROUP BY i, j) SELECT k.i, k.j, round(med, 6) + 0.0::DOUBLE AS med FROM k LEFT JOIN m ON m.i = k.i AND m.j = k.j")
def w02(s, d):
    return rounded(T.running_median(X.kept(s, d), 5).select("row", "col", "med"))


@query("w03_spikes", f"WITH {X.KEPT}, {_NB.format(r=3, r1=4, c=' AND (x.k <> 0 OR y.k <> 0)')}, m AS (SELECT i, j, median(v) AS near, count(*) AS c FROM nb GROUP BY i, j) SELECT k.i, k.j, coalesce(c, 0) AS count, round(near, 6) + 0.0::DOUBLE AS near, k.v IS NOT NULL AND (coalesce(c, 0) < 3 OR coalesce(abs(k.v - near) > 0.8, false)) AS spike FROM k LEFT JOIN m ON m.i = k.i AND m.j = k.j")
def w03(s, d):
    return rounded(T.spikes(X.kept(s, d), 0.8).select("row", "col", "count", "near", "spike"))


_G = """kr AS (SELECT unnest(range(-6, 7)) AS k), kw AS (SELECT k, exp(-0.5::DOUBLE * (k / 1.5::DOUBLE) * (k / 1.5::DOUBLE)) / (SELECT sum(exp(-0.5::DOUBLE * (k / 1.5::DOUBLE) * (k / 1.5::DOUBLE))) FROM kr) AS w FROM kr),
g0 AS (SELECT i, j, coalesce(v, 0) AS num, (v IS NOT NULL)::INT::DOUBLE AS den FROM k),
g1 AS (SELECT * FROM g0 UNION ALL SELECT -1 - i, j, num, den FROM g0 WHERE i < 6 UNION ALL SELECT 191 - i, j, num, den FROM g0 WHERE i >= 90),
g2 AS (SELECT i + kw.k AS i, j, sum(num * w) AS num, sum(den * w) AS den FROM g1, kw WHERE i + kw.k BETWEEN 0 AND 95 GROUP BY 1, 2),
g3 AS (SELECT * FROM g2 UNION ALL SELECT i, -1 - j, num, den FROM g2 WHERE j < 6 UNION ALL SELECT i, 127 - j, num, den FROM g2 WHERE j >= 58),
g4 AS (SELECT i, j + kw.k AS j, sum(num * w) AS num, sum(den * w) AS den FROM g3, kw WHERE j + kw.k BETWEEN 0 AND 63 GROUP BY 1, 2)"""


@query("w04_gaussian_lowpass", f"WITH {X.KEPT}, {_G} SELECT i, j, round(CASE WHEN den > 0.05 THEN num / den END, 6) + 0.0::DOUBLE AS low, round(den, 6) + 0.0::DOUBLE AS share FROM g4")
def w04(s, d):
    return rounded(T.gaussian(X.kept(s, d), X.LAT_SHAPE, (1.5, 1.5)))


@query("w05_alongtrack_integral", f"WITH {X.LAT} SELECT i, j, round(sum(azimuth) OVER (PARTITION BY j ORDER BY i), 9) + 0.0::DOUBLE AS total FROM lat")
def w05(s, d):
    return rounded(T.cumulative(_full(s, d)).select("row", "col", "total"), 9)


@query("w06_column_demean", f"WITH {X.LAT} SELECT i, j, round(azimuth - avg(azimuth) OVER (PARTITION BY j), 6) + 0.0::DOUBLE AS v FROM lat")
def w06(s, d):
    return rounded(T.demean(_full(s, d)))


_CARRY = """cp AS (SELECT i, j, v, last_value(v IGNORE NULLS) OVER b AS p, last_value(CASE WHEN v IS NOT NULL THEN j END IGNORE NULLS) OVER b AS pc, first_value(v IGNORE NULLS) OVER f AS n, first_value(CASE WHEN v IS NOT NULL THEN j END IGNORE NULLS) OVER f AS nc
  FROM k WINDOW b AS (PARTITION BY i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY i ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cf AS (SELECT i, j, coalesce(v, p + (n - p) * ((j - pc)::DOUBLE / nullif(nc - pc, 0)), p, n, 0) AS filled FROM cp)"""


@query("w07_carry_across", f"WITH {X.KEPT}, {_CARRY} SELECT i, j, round(filled, 6) + 0.0::DOUBLE AS filled FROM cf")
def w07(s, d):
    return rounded(T.carry_across(X.kept(s, d)).select("row", "col", "filled"))


@query("w08_gradient", f"WITH {X.LAT} SELECT i, j, round(coalesce((lead(azimuth) OVER w - lag(azimuth) OVER w) / 2, lead(azimuth) OVER w - azimuth, azimuth - lag(azimuth) OVER w), 6) + 0.0::DOUBLE AS slope FROM lat WINDOW w AS (PARTITION BY j ORDER BY i)")
def w08(s, d):
    return rounded(T.gradient(_full(s, d)).select("row", "col", "slope"))


@query("w09_wrapped_difference", f"WITH {X.LAT}, l AS (SELECT i, j, 2 * azimuth AS v FROM lat), e AS (SELECT i, j, lead(v) OVER (PARTITION BY j ORDER BY i) - v AS e FROM l) SELECT i, j, round(atan2(sin(e), cos(e)), 6) + 0.0::DOUBLE AS step FROM e")
def w09(s, d):
    return rounded(T.wrapped_difference(_full(s, d).withColumn("v", 2 * F.col("v"))).select("row", "col", "step"))


_H = """kr AS (SELECT unnest(range(-8, 9)) AS k), kw AS (SELECT k, exp(-0.5::DOUBLE * (k / 2.0::DOUBLE) * (k / 2.0::DOUBLE)) / (SELECT sum(exp(-0.5::DOUBLE * (k / 2.0::DOUBLE) * (k / 2.0::DOUBLE))) FROM kr) AS w FROM kr),
lo AS (SELECT a.i, a.j, sum(w * (b.azimuth - b.range_)) AS e FROM lat a, kw JOIN lat b ON true WHERE b.j = a.j AND b.i = greatest(0, least(95, a.i + kw.k)) GROUP BY a.i, a.j)"""


@query("w10_hybrid_scales", f"WITH {X.LAT}, {_H} SELECT i, j, round(range_ + e, 6) + 0.0::DOUBLE AS v FROM lo JOIN lat USING (i, j)")
def w10(s, d):
    lat = X.lattice(s, d)
    return rounded(T.hybrid_scales(_full(s, d), lat.select("row", "col", F.col("range").alias("v")), *X.LAT_SHAPE, 2.0))


@query("w14_trapezoid", f"WITH {X.LAT}, f AS (SELECT j, (i - 40) / 8.0::DOUBLE AS x, azimuth AS y FROM lat), p AS (SELECT j, x, coalesce(0.5 * (y + lag(y) OVER w) * (x - lag(x) OVER w), 0) AS p FROM f WINDOW w AS (PARTITION BY j ORDER BY x)), c AS (SELECT j, x, sum(p) OVER (PARTITION BY j ORDER BY x) AS s FROM p), z AS (SELECT j, s AS z FROM c WHERE x = 0) SELECT c.j, x, round(s - z, 6) + 0.0::DOUBLE AS area FROM c JOIN z USING (j)")
def w14(s, d):
    f = X.lattice(s, d).select("col", ((F.col("row") - 40) / 8.0).alias("x"), F.col("azimuth").alias("y"))
    return rounded(T.trapezoid(f, "x", "y", ["col"]).select("col", "x", "area"))


@query("w18_trust_fade", f"WITH {X.LAT} SELECT i, j, round(CASE WHEN snr <= 8 THEN 1 ELSE exp(-((snr - 8) / 8) * ((snr - 8) / 8)) END, 6) + 0.0::DOUBLE AS w FROM lat")
def w18(s, d):
    t = (F.col("snr") - 8) / 8
    return rounded(X.lattice(s, d).select("row", "col", F.when(F.col("snr") <= 8, 1.0).otherwise(F.exp(-t * t)).alias("w")))


@query("p01_snr_gate", f"WITH {X.LAT} SELECT i, j, {r6('azimuth', 'snr')} FROM lat WHERE snr >= 8")
def p01(s, d):
    return rounded(R.snr_gate(X.lattice(s, d), 8.0).select("row", "col", "azimuth", "snr"))


@query("p02_search_gate", f"WITH {X.LAT} SELECT i, j FROM lat WHERE abs(azimuth) < 0.9 * 3 AND abs(range_) < 0.9 * 0.3")
def p02(s, d):
    return X.lattice(s, d).where(R.search_gate(3.0, 0.3)).select(F.col("row").alias("i"), F.col("col").alias("j"))


@query("p04_coherent_cells", f"WITH {X.ACC} SELECT i, j, count(*) AS pairs FROM coh GROUP BY i, j HAVING bool_and(valid) AND median(ln(greatest(coh, 1e-6))) > ln(0.2::DOUBLE)")
def p04(s, d):
    from tessera.operators import blocks as B

    c = B.coherence(B.accumulate(X.stack(s, d), 4, 4))
    g = c.groupBy("row", "col").agg(F.bool_and("valid").alias("all"), F.median(S.log_floor(F.col("coh"))).alias("m"), F.count("*").alias("pairs"))
    return g.where(F.col("all") & (F.col("m") > math.log(0.2))).select(F.col("row").alias("i"), F.col("col").alias("j"), "pairs")


@query("p05_backscatter_gate", f"WITH {X.PAIR}, b AS (SELECT i, j, 10 * log10(r_re * r_re + r_im * r_im) AS db FROM pr WHERE r_re * r_re + r_im * r_im > 0), t AS (SELECT quantile_cont(db, 0.2) AS t FROM b) SELECT i, j, round(db, 6) + 0.0::DOUBLE AS db FROM b, t WHERE db > t")
def p05(s, d):
    b = X.slc_pair(s, d).select("row", "col", S.decibel(F.col("r_re") * F.col("r_re") + F.col("r_im") * F.col("r_im")).alias("db")).where("db is not null")
    t = b.agg(F.percentile("db", 0.2).alias("t"))
    return rounded(b.crossJoin(F.broadcast(t)).where("db > t").drop("t"))


@query("p08_spectral_annulus", f"WITH {X.SPECTRUM}, f AS (SELECT i, j, (j - 32) / 64.0::DOUBLE AS kx, (i % 64 - 32) / 64.0::DOUBLE AS ky FROM em) SELECT i, j FROM f WHERE sqrt(kx * kx + ky * ky) > 3 / 64.0::DOUBLE AND sqrt(kx * kx + ky * ky) < 0.33::DOUBLE")
def p08(s, d):
    k = F.sqrt(F.pow((F.col("col") - 32) / 64.0, 2) + F.pow((F.col("row") % 64 - 32) / 64.0, 2))
    return X.spectrum(s, d).where((k > 3 / 64.0) & (k < 0.33)).select(F.col("row").alias("i"), F.col("col").alias("j"))


@query("p11_congruence", f"WITH {X.BANDS}, u AS (SELECT i, j, phi_a AS u, atan2(sin(phi_a), cos(phi_a)) + CASE WHEN (i + j) % 7 = 0 THEN 0.01 ELSE 0 END AS w FROM bd) SELECT i, j FROM u WHERE abs(atan2(sin(u - w), cos(u - w))) < 1e-3")
def p11(s, d):
    u = X.bands(s, d).select("row", "col", F.col("phi_a").alias("u"), (S.wrap(F.col("phi_a")) + F.when((F.col("row") + F.col("col")) % 7 == 0, 0.01).otherwise(0.0)).alias("w"))
    return u.where(F.abs(S.wrap(F.col("u") - F.col("w"))) < 1e-3).select(F.col("row").alias("i"), F.col("col").alias("j"))


@query("p13_interior_box", f"WITH {X.KEPT}, b AS (SELECT min(i) AS r0, max(i) AS r1, min(j) AS c0, max(j) AS c1, count(*) AS n FROM k WHERE v IS NOT NULL) SELECT *, round(n::DOUBLE / ((r1 - r0 + 1) * (c1 - c0 + 1)), 6) AS fill FROM b WHERE (r1 - r0 + 1) * (c1 - c0 + 1) >= 4096 AND n::DOUBLE / ((r1 - r0 + 1) * (c1 - c0 + 1)) >= 0.15")
def p13(s, d):
    b = X.kept(s, d).where("v is not null").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("n"))
    size = (F.col("r1") - F.col("r0") + 1) * (F.col("c1") - F.col("c0") + 1)
    return rounded(b.withColumn("fill", F.col("n") / size).where((size >= 4096) & (F.col("fill") >= 0.15)))


@query("p16_steep_blocks", f"WITH {X.LAT} SELECT i // 12 AS block, round(max(abs(azimuth)), 6) + 0.0::DOUBLE AS spread FROM lat GROUP BY 1 HAVING max(abs(azimuth)) >= 3")
def p16(s, d):
    g = X.lattice(s, d).groupBy(F.expr("cast(row div 12 as int)").alias("block")).agg(F.max(F.abs("azimuth")).alias("spread"))
    return rounded(g.where("spread >= 3"))


@query("p17_input_problems", "SELECT 'customer ' || c_custkey AS what, 'no balance' AS problem FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'part ' || p_partkey, 'too large' FROM part WHERE p_size > 45")
def p17(s, d):
    c = X.table(s, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("customer "), F.col("c_custkey")).alias("what"), F.lit("no balance").alias("problem"))
    return c.unionByName(X.table(s, d, "part").where("p_size > 45").select(F.concat(F.lit("part "), F.col("p_partkey")).alias("what"), F.lit("too large").alias("problem")))


@query("t01_rank_pairs", f"WITH {X.ACC}, x AS (SELECT d1, d2, avg(coh) AS r FROM coh GROUP BY d1, d2) SELECT d1, d2, round(r, 6) + 0.0::DOUBLE AS \"R_fft\", round(r - 0.7, 6) + 0.0::DOUBLE AS \"D_RA\", row_number() OVER (ORDER BY round(r, 9) DESC, d1, d2) AS rank, CASE WHEN r - 0.7 >= 0 THEN 'range' ELSE 'azimuth' END AS direction, round(r, 9) < 0.5 AS weak FROM x QUALIFY rank <= 5")
def t01(s, d):
    from tessera.operators import blocks as B

    c = B.coherence(B.accumulate(X.stack(s, d), 4, 4)).groupBy("freq", "d1", "d2").agg(F.round(F.avg("coh"), 9).alias("R_fft"))
    out = R.rank_pairs(c.withColumn("D_RA", F.col("R_fft") - 0.7), "A", 5).drop("freq")
    return rounded(out.withColumn("rank", F.col("rank").cast("long")))


@query("t02_separated_peaks", f"WITH RECURSIVE {X.LAT}, b AS (SELECT i // 6 AS i, j // 8 AS j, max(abs(azimuth)) AS v FROM lat GROUP BY 1, 2), lst AS (SELECT list({{'i': i, 'j': j, 'v': v}} ORDER BY v DESC, i, j) AS l FROM b), rc AS (SELECT 1 AS n, l[1] AS t, list_filter(l, lambda e: NOT (abs(e.i - l[1].i) <= 2 AND abs(e.j - l[1].j) <= 1)) AS l FROM lst UNION ALL SELECT n + 1, l[1], list_filter(l, lambda e: NOT (abs(e.i - l[1].i) <= 2 AND abs(e.j - l[1].j) <= 1)) FROM rc WHERE len(l) > 0 AND n < 6) SELECT CAST(t.i AS INT) AS i, CAST(t.j AS INT) AS j, round(t.v, 6) + 0.0::DOUBLE AS v, n AS rank FROM rc")
def t02(s, d):
    b = X.lattice(s, d).groupBy(F.expr("cast(row div 6 as int)").alias("row"), F.expr("cast(col div 8 as int)").alias("col")).agg(F.max(F.abs("azimuth")).alias("v"))
    return rounded(R.separated_peaks(s, b, 6, 2, 1, F.lit(True)))


@query("t03_argmax", f"WITH {X.LAT} SELECT i, j FROM lat QUALIFY row_number() OVER (PARTITION BY i ORDER BY azimuth DESC, j) = 1")
def t03(s, d):
    return X.lattice(s, d).groupBy(F.col("row").alias("i")).agg(F.min_by("col", F.struct(-F.col("azimuth"), F.col("col"))).alias("j"))


@query("u01_mask_algebra", f"WITH {X.LAT}, a AS (SELECT i, j FROM lat WHERE snr < 7), b AS (SELECT i, j FROM lat WHERE azimuth > 2) SELECT 'or' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'and', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'minus', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def u01(s, d):
    lat = X.lattice(s, d)
    a, b = lat.where("snr < 7").select("row", "col"), lat.where("azimuth > 2").select("row", "col")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return one(a.union(b).distinct(), "or").union(one(a.intersect(b), "and")).union(one(a.exceptAll(b), "minus"))


@query("u02_missing_dates", f"WITH {X.STACK}, f AS (SELECT DISTINCT d FROM st) SELECT CAST(y AS VARCHAR) AS d FROM (SELECT unnest(range(1990, 2004)) AS y) EXCEPT SELECT d FROM f")
def u02(s, d):
    wanted = s.range(1990, 2004).select(F.col("id").cast("string").alias("d"))
    return J.missing(wanted, X.stack(s, d).select("d"), ["d"])


@query("u04_first_of_each", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def u04(s, d):
    w = W.partitionBy("user_id", "event_type").orderBy("event_id")
    return X.table(s, d, "events").select("user_id", "event_type", "event_id", F.row_number().over(w).alias("n")).where("n = 1").drop("n")


@query("f01_wrap", f"WITH {X.LAT} SELECT i, j, round(atan2(sin(3 * azimuth), cos(3 * azimuth)), 6) + 0.0::DOUBLE AS v FROM lat")
def f01(s, d):
    return rounded(X.lattice(s, d).select("row", "col", S.wrap(3 * F.col("azimuth")).alias("v")))


@query("f02_orientation_difference", f"WITH {X.LAT}, e AS (SELECT i, j, 60 * azimuth - 170 * range_ + 90 AS e FROM lat) SELECT i, j, round(e - floor(e / 180) * 180 - 90, 4) + 0.0::DOUBLE AS v FROM e")
def f02(s, d):
    return rounded(X.lattice(s, d).select("row", "col", S.angdiff180(60 * F.col("azimuth"), 170 * F.col("range")).alias("v")), 4)


@query("f04_loss_field", f"WITH {X.KEPT} SELECT i, j, round(CASE WHEN v IS NOT NULL THEN greatest(-v, 0) END, 6) + 0.0::DOUBLE AS v FROM k")
def f04(s, d):
    return rounded(X.kept(s, d).select("row", "col", S.loss_field(F.col("v")).alias("v")))


@query("f05_fold_frequency", "SELECT c_custkey, round(c_acctbal + 760 - floor((c_acctbal + 760) / 1520) * 1520 - 760, 4) + 0.0::DOUBLE AS f FROM customer")
def f05(s, d):
    return rounded(X.table(s, d, "customer").select("c_custkey", S.fold_frequency(F.col("c_acctbal"), F.lit(1520.0)).alias("f")), 4)


@query("f07_pierce_fraction", "WITH p AS (SELECT p_partkey, 750000.0::DOUBLE + 100 * p_partkey AS r, 7118137.0::DOUBLE AS rs, 6371000.0::DOUBLE AS rt FROM part), c AS (SELECT *, r * r AS a, (rs * rs + rt * rt - r * r) / 2 - rs * rs AS b, rs * rs - (rt + 350000) * (rt + 350000) AS c FROM p) SELECT p_partkey, round(CASE WHEN b * b - a * c >= 0 THEN 1 - (-b - sqrt(greatest(b * b - a * c, 0))) / a END, 6) + 0.0::DOUBLE AS kappa FROM c")
def f07(s, d):
    r = F.lit(750000.0) + 100 * F.col("p_partkey")
    return rounded(X.table(s, d, "part").select("p_partkey", S.pierce_fraction(r, F.lit(7118137.0), F.lit(6371000.0), 350000.0).alias("kappa")))


@query("f09_phase_rate", f"WITH {X.LAT} SELECT i, j, round(-4 * pi() * azimuth * 1000 / (0.242::DOUBLE * (800000 + 12 * j)), 6) + 0.0::DOUBLE AS g FROM lat")
def f09(s, d):
    return rounded(X.lattice(s, d).select("row", "col", S.phase_rate(F.col("azimuth") * 1000, 0.242, 800000 + 12 * F.col("col")).alias("g")))


@query("f13_split_solve", f"WITH {X.BANDS} SELECT i, j, round(azimuth, 9) + 0.0::DOUBLE AS disp, round(range_, 9) + 0.0::DOUBLE AS nondisp FROM bd")
def f13(s, d):
    """The planted dispersive and non-dispersive phases come back from the two bands."""
    disp, non = S.split_solve(F.col("phi_a"), F.col("phi_a") - F.col("phi_b"), X.FA, X.FB)
    return rounded(X.bands(s, d).select("row", "col", disp.alias("disp"), non.alias("nondisp")), 9)


@query("f14_attribution", f"WITH {X.BANDS}, t AS (SELECT *, (1239.0::DOUBLE - 1293.5) / 1239.0 - (1293.5::DOUBLE - 1239.0) / 1293.5 AS unused, (1239.0::DOUBLE - 1293.5) / 1239.0 AS a21, (1239.0::DOUBLE - 1293.5) / 1293.5 * -1 AS x FROM bd) SELECT i, j, round((1239.0::DOUBLE - 1293.5) / 1239.0 / unused * phi_a, 4) + 0.0::DOUBLE AS term_a, round(-(phi_a - phi_b) / unused, 4) + 0.0::DOUBLE AS term_d FROM t")
def f14(s, d):
    a, b = S.attribution(X.FA, X.FB)
    return rounded(X.bands(s, d).select("row", "col", (a * F.col("phi_a")).alias("term_a"), (b * (F.col("phi_a") - F.col("phi_b"))).alias("term_d")), 4)


@query("f15_band_phasor", f"WITH {X.BANDS}, b AS (SELECT i // 4 AS i, j // 4 AS j, sum(coh * cos(phi_a - phi_b)) AS c, sum(coh * sin(phi_a - phi_b)) AS s, sum(coh) AS w FROM bd GROUP BY 1, 2) SELECT i, j, round(atan2(s, c), 6) + 0.0::DOUBLE AS diff, round(sqrt(c * c + s * s) / w, 6) + 0.0::DOUBLE AS coh_diff FROM b")
def f15(s, d):
    from tessera.operators.blocks import cell

    e = F.col("phi_a") - F.col("phi_b")
    b = X.bands(s, d).groupBy(cell("row", 4).alias("row"), cell("col", 4).alias("col")).agg(F.sum(F.col("coh") * F.cos(e)).alias("c"), F.sum(F.col("coh") * F.sin(e)).alias("s"), F.sum("coh").alias("w"))
    return rounded(b.select("row", "col", F.atan2("s", "c").alias("diff"), (S.magnitude(F.col("c"), F.col("s")) / F.col("w")).alias("coh_diff")))


@query("f17_apply_screen", f"WITH {X.PAIR}, {X.LAT} SELECT pr.i, pr.j, round(s_re * cos(azimuth) + s_im * sin(azimuth), 6) + 0.0::DOUBLE AS re, round(s_im * cos(azimuth) - s_re * sin(azimuth), 6) + 0.0::DOUBLE AS im FROM pr JOIN lat ON lat.i = pr.i AND lat.j = pr.j")
def f17(s, d):
    re, im = S.rotate(F.col("s_re"), F.col("s_im"), -F.col("azimuth"))
    return rounded(X.slc_pair(s, d).join(X.lattice(s, d), ["row", "col"]).select("row", "col", re.alias("re"), im.alias("im")))


@query("f22_lattice_shape", "SELECT p_partkey, CASE WHEN floor((p_partkey * 10 - 64 - 128) / 16.0) >= 1 THEN CAST(floor((p_partkey * 10 - 64 - 128) / 16.0) AS BIGINT) END AS n FROM part")
def f22(s, d):
    return X.table(s, d, "part").select("p_partkey", S.lattice_shape(F.col("p_partkey") * 10, 64, 64, 16).cast("long").alias("n"))


@query("f23_penalty", "SELECT DISTINCT p_size, round(pow(p_size / (2 * pi()), 4), 4) + 0.0::DOUBLE AS s FROM part")
def f23(s, d):
    return rounded(X.table(s, d, "part").select("p_size", S.penalty(F.col("p_size")).alias("s")).distinct(), 4)


@query("f24_name_tags", "WITH n AS (SELECT 'RSLC_t0' || (o_orderkey % 90) || '_' || strftime(o_orderdate, '%Y-%m-%d') || '.h5' AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE 'x' || strftime(o_orderdate + INTERVAL 12 DAY, '%Y%m%d') END AS b, o_orderkey FROM orders), e AS (SELECT *, regexp_extract(a, '(\\d{4})-?(\\d{2})-?(\\d{2})', 1) || regexp_extract(a, '(\\d{4})-?(\\d{2})-?(\\d{2})', 2) || regexp_extract(a, '(\\d{4})-?(\\d{2})-?(\\d{2})', 3) AS x, regexp_extract(b, '(\\d{4})-?(\\d{2})-?(\\d{2})', 1) || regexp_extract(b, '(\\d{4})-?(\\d{2})-?(\\d{2})', 2) || regexp_extract(b, '(\\d{4})-?(\\d{2})-?(\\d{2})', 3) AS y FROM n) SELECT o_orderkey, CASE WHEN x <> '' AND y <> '' THEN x || '_' || y ELSE 'ref_sec' END AS tag, CAST(regexp_extract(a, '_t0*(\\d+)[_-]', 1) AS INT) AS track FROM e")
def f24(s, d):
    k = F.col("o_orderkey")
    a = F.concat(F.lit("RSLC_t0"), k % 90, F.lit("_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".h5"))
    b = F.when(k % 3 == 0, "other").otherwise(F.concat(F.lit("x"), F.date_format(F.date_add("o_orderdate", 12), "yyyyMMdd")))
    return X.table(s, d, "orders").select("o_orderkey", S.pair_tag(a, b).alias("tag"), S.track_number(a).alias("track"))


@query("f25_day_after", "SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS day, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS next FROM orders")
def f25(s, d):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return X.table(s, d, "orders").select(day.alias("day"), S.day_after(day).alias("next")).distinct()


@query("f26_utm_zone", f"WITH {X.POINTS} SELECT id, CAST(CASE WHEN y - 62 >= 0 THEN 32600 ELSE 32700 END + floor((x + 180) / 6) + 1 AS INT) AS epsg FROM pt")
def f26(s, d):
    return X.points(s, d).select("id", S.utm_epsg(F.col("x"), F.col("y") - 62).alias("epsg"))


@query("f29_style_of_name", "WITH n AS (SELECT p_partkey, list_value('ifg_unw_', 'ifg_phase_', 'coh_', 'mai_screen_sigma', 'screen_', 'phi_diff_unw', 'phi_diff')[p_partkey % 7 + 1] || p_name AS name FROM part) SELECT p_partkey, CASE WHEN name LIKE 'ifg\\_unw%' ESCAPE '\\' OR name LIKE 'phi\\_diff\\_unw%' ESCAPE '\\' THEN 'unwrapped' WHEN name LIKE 'ifg\\_phase%' ESCAPE '\\' OR name LIKE 'phi\\_diff%' ESCAPE '\\' THEN 'wrapped' WHEN name LIKE 'coh\\_%' ESCAPE '\\' THEN 'coherence' WHEN name LIKE 'mai\\_screen\\_sigma%' ESCAPE '\\' THEN 'positive' ELSE 'signed' END AS style FROM n")
def f29(s, d):
    names = F.array(*[F.lit(x) for x in ("ifg_unw_", "ifg_phase_", "coh_", "mai_screen_sigma", "screen_", "phi_diff_unw", "phi_diff")])
    n = F.concat(F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int")), F.col("p_name"))
    return X.table(s, d, "part").select("p_partkey", S.style_of(n).alias("style"))


_RB = """l0 AS (SELECT i, j, azimuth, range_ FROM lat WHERE snr >= 5),
m1 AS (SELECT i // 8 AS bi, j // 8 AS bj, median(azimuth) AS m FROM l0 GROUP BY 1, 2), r1 AS (SELECT l0.*, bi, bj, abs(azimuth - m) AS r FROM l0 JOIN m1 ON bi = i // 8 AND bj = j // 8), s1 AS (SELECT bi, bj, 1.4826 * median(r) AS s FROM r1 GROUP BY 1, 2), f1 AS (SELECT median(s) AS f FROM s1),
l1 AS (SELECT i, j, azimuth, range_ FROM r1 JOIN s1 USING (bi, bj), f1 WHERE r <= 2 * greatest(s, f)),
m2 AS (SELECT i // 8 AS bi, j // 8 AS bj, median(range_) AS m FROM l1 GROUP BY 1, 2), r2 AS (SELECT l1.*, bi, bj, abs(range_ - m) AS r FROM l1 JOIN m2 ON bi = i // 8 AND bj = j // 8), s2 AS (SELECT bi, bj, 1.4826 * median(r) AS s FROM r2 GROUP BY 1, 2), f2 AS (SELECT median(s) AS f FROM s2)"""


@query("r06_block_outliers", f"WITH {X.LAT}, {_RB} SELECT i, j FROM r2 JOIN s2 USING (bi, bj), f2 WHERE r <= 2 * greatest(s, f)")
def r06(s, d):
    return R.reject_block_outliers(X.lattice(s, d).where("snr >= 5"), ["azimuth", "range"], 2.0).select(F.col("row").alias("i"), F.col("col").alias("j"))


@query("r07_median_outliers", f"WITH {X.KEPT}, {_NB.format(r=4, r1=5, c='')}, md AS (SELECT i, j, median(v) AS med FROM nb GROUP BY i, j), c AS (SELECT median(v) AS c FROM k), m AS (SELECT median(abs(v - c)) AS mad FROM k, c) SELECT k.i, k.j FROM k JOIN md ON md.i = k.i AND md.j = k.j, m WHERE v IS NOT NULL AND abs(v - med) < 0.2 * 1.4826 * mad")
def r07(s, d):
    return R.reject_median9(X.kept(s, d), 0.2).select(F.col("row").alias("i"), F.col("col").alias("j"))


def _holes(s, d):
    return X.lattice(s, d).select("row", "col", F.when(F.col("snr") >= 7, F.col("azimuth")).alias("v"))


_HOLES = X.LAT + ", h AS (SELECT i, j, CASE WHEN snr >= 7 THEN azimuth END AS v FROM lat)"


@query("r01_components", f"WITH RECURSIVE {_HOLES}, c AS (SELECT i, j, i * 64 + j AS id FROM h WHERE v IS NULL), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.i - b.i) + abs(a.j - b.j) = 1), rc AS (SELECT id AS src, id AS p FROM c UNION SELECT rc.src, e.b FROM rc JOIN e ON rc.p = e.a) SELECT c.i, c.j, min(p)::BIGINT AS label FROM rc JOIN c ON c.id = rc.src GROUP BY c.i, c.j")
def r01(s, d):
    return P.label_components(_holes(s, d).where("v is null").select("row", "col"), X.LAT_SHAPE[1]).withColumnsRenamed({"row": "i", "col": "j"})


@query("a17_component_report", f"WITH RECURSIVE {_HOLES}, c AS (SELECT i, j, i * 64 + j AS id FROM h WHERE v IS NULL), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.i - b.i) + abs(a.j - b.j) = 1), rc AS (SELECT id AS src, id AS p FROM c UNION SELECT rc.src, e.b FROM rc JOIN e ON rc.p = e.a), lb AS (SELECT src, min(p) AS label FROM rc GROUP BY src) SELECT label::BIGINT AS label, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM lb), 6) AS share FROM lb GROUP BY label")
def a17(s, d):
    from tessera.operators.blocks import largest_share

    return rounded(largest_share(P.label_components(_holes(s, d).where("v is null").select("row", "col"), X.LAT_SHAPE[1])))


_RING = "nb{k} AS (SELECT a.i, a.j, avg(b.v) AS m FROM h{p} a CROSS JOIN o JOIN h{p} b ON b.i = a.i + di AND b.j = a.j + dj WHERE a.v IS NULL AND b.v IS NOT NULL GROUP BY 1, 2), h{k} AS (SELECT h{p}.i, h{p}.j, coalesce(h{p}.v, m) AS v, h{p}.f OR (h{p}.v IS NULL AND m IS NOT NULL) AS f FROM h{p} LEFT JOIN nb{k} ON nb{k}.i = h{p}.i AND nb{k}.j = h{p}.j)"


#: The SQL has 24 rings, more than the holes of the driver's tables are deep.
@query("r03_grow_means", f"WITH {_HOLES}, o AS (SELECT di, dj FROM (SELECT unnest([-1, 0, 1]) AS di), (SELECT unnest([-1, 0, 1]) AS dj)), h0 AS MATERIALIZED (SELECT i, j, v, false AS f FROM h), " + ", ".join(_RING.format(k=k + 1, p=k).replace(f"h{k + 1} AS (", f"h{k + 1} AS MATERIALIZED (") for k in range(24)) + " SELECT i, j, round(v, 6) + 0.0::DOUBLE AS v, f AS filled FROM h24")
def r03(s, d):
    return rounded(P.grow(_holes(s, d)))


@query("r02_fill_interior")
def r02(s, d):
    return rounded(P.fill_interior(X.kept(s, d, 7.0), *X.LAT_SHAPE))


_SPK = """sp{k} AS (SELECT a.i, a.j FROM (SELECT a.i, a.j, any_value(a.v) AS v, median(b.v) AS m, count(b.v) AS n FROM q{p} a LEFT JOIN q{p} b ON abs(a.i - b.i) <= 3 AND abs(a.j - b.j) <= 3 AND (a.i <> b.i OR a.j <> b.j) GROUP BY 1, 2) a WHERE n < 3 OR abs(v - m) > 0.8),
q{k} AS (SELECT * FROM q{p} WHERE (i, j) NOT IN (SELECT (i, j) FROM sp{k}))"""


@query("r05_despike", f"WITH {X.KEPT}, q0 AS (SELECT i, j, v FROM k WHERE v IS NOT NULL), " + ", ".join(_SPK.format(k=k + 1, p=k) for k in range(4)) + " SELECT q0.i, q0.j, q4.v IS NOT NULL AS keep FROM q0 LEFT JOIN q4 ON q4.i = q0.i AND q4.j = q0.j")
def r05(s, d):
    out = P.despike(X.kept(s, d).where("v is not null").withColumnRenamed("v", "a"), ["a"], 0.8)
    return out.select(F.col("row").alias("i"), F.col("col").alias("j"), "keep")


@query("r10_distance", f"WITH {_HOLES}, e AS (SELECT a.i, a.j, min((a.i - b.i) * (a.i - b.i) * 16.0::DOUBLE + (a.j - b.j) * (a.j - b.j) * 9.0::DOUBLE) AS q FROM h a, h b WHERE b.v IS NOT NULL GROUP BY 1, 2) SELECT i, j, round(sqrt(q), 6) AS dist FROM e")
def r10(s, d):
    return rounded(P.nearest(_holes(s, d), 4.0, 3.0).select("row", "col", "dist"))


@query("r14_speckle_close", f"WITH {_HOLES}, e AS (SELECT a.i, a.j, any_value(a.v) AS v, min((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)) AS q, arg_min(b.v, ((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)) * 10000 + b.i * 100 + b.j) AS near FROM h a, h b WHERE b.v IS NOT NULL GROUP BY 1, 2) SELECT i, j, round(CASE WHEN q <= 4 THEN near END, 6) + 0.0::DOUBLE AS v FROM e")
def r14(s, d):
    near = P.nearest(_holes(s, d))
    return rounded(near.select("row", "col", F.when(F.col("dist") <= 2, F.col("near_v")).alias("v")))


@query("p15_gap_test", f"WITH {_HOLES}, e AS (SELECT a.i, a.j, sqrt(min((a.i - b.i) * (a.i - b.i) * 16.0::DOUBLE + (a.j - b.j) * (a.j - b.j) * 9.0::DOUBLE)) AS q FROM h a, h b WHERE b.v IS NOT NULL GROUP BY 1, 2) SELECT i, j, q <= 4 AS valid FROM e")
def p15(s, d):
    return P.nearest(_holes(s, d), 4.0, 3.0).select(F.col("row").alias("i"), F.col("col").alias("j"), (F.col("dist") <= 4).alias("valid"))


@query("a25_distance_bands", f"WITH {_HOLES}, e AS (SELECT a.i, a.j, sqrt(min((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j))) AS q FROM h a, h b WHERE b.v IS NOT NULL GROUP BY 1, 2) SELECT CAST(floor(q) AS INT) AS band, count(*) AS n, round(CASE WHEN count(*) >= 50 THEN median(azimuth) END, 6) + 0.0::DOUBLE AS med FROM e JOIN lat USING (i, j) GROUP BY 1")
def a25(s, d):
    e = P.nearest(_holes(s, d)).select("row", "col", "dist").join(X.lattice(s, d), ["row", "col"])
    g = e.groupBy(F.floor("dist").cast("int").alias("band")).agg(F.count("*").alias("n"), F.median("azimuth").alias("med"))
    return rounded(g.withColumn("med", F.when(F.col("n") >= 50, F.col("med"))))


@query("m09_jacobi_fill")
def m09(s, d):
    g = _holes(s, d).select("row", "col", F.coalesce("v", F.lit(0.0)).alias("v"), F.col("v").isNotNull().alias("fixed"))
    return rounded(P.relax(g).select("row", "col", "v"), 4)


@query("m13_robust_plane")
def m13(s, d):
    return rounded(P.robust_plane(X.kept(s, d, 7.0)).select("row", "col", "filled"))


@query("r08_regional_level")
def r08(s, d):
    return rounded(P.regional_level(X.kept(s, d, 7.0), *X.LAT_SHAPE).select("row", "col", "level"))
