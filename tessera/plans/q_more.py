"""Queries of the remaining readers, gates, joins, reports and kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import blocks as B
from tessera.operators import fixpoint as P
from tessera.operators import joins as J
from tessera.operators import kernels as K
from tessera.operators import patches as PT
from tessera.operators import reference as Q

from . import fixtures as X
from . import routes as Z
from .q_routes import _kernel
from .registry import query, r6, rounded



def _ij():
    return [F.col("row").alias("i"), F.col("col").alias("j")]


@query("s08_mean_of_band", "SELECT event_type, round(1 / avg(0.0006::DOUBLE + event_id % 7 / 1e5::DOUBLE), 6) AS prf, round(avg(value), 4) + 0.0::DOUBLE AS doppler FROM events GROUP BY event_type")
def s08(s, d):
    e = X.table(s, d, "events").groupBy("event_type").agg(F.round(1 / F.avg(F.lit(0.0006) + F.col("event_id") % 7 / 1e5), 6).alias("prf"), S.q(F.avg("value"), 4).alias("doppler"))
    return e


@query("s09_carriers", "SELECT p_brand, bool_or(p_size < 10) AS has_a, bool_or(p_size > 49) AS has_b FROM part GROUP BY p_brand")
def s09(s, d):
    return X.table(s, d, "part").groupBy("p_brand").agg(F.bool_or(F.col("p_size") < 10).alias("has_a"), F.bool_or(F.col("p_size") > 49).alias("has_b"))


@query("s10_nodata", "SELECT c_custkey, CASE WHEN c_nationkey <> 7 THEN c_acctbal END AS v FROM customer")
def s10(s, d):
    v = F.when(F.col("c_nationkey") == 7, -9999.0).otherwise(F.col("c_acctbal"))
    return X.table(s, d, "customer").select("c_custkey", S.nodata_null(v, -9999.0).alias("v"))


@query("s14_strided_scan", f"WITH {X.LAT} SELECT i, j, {r6('azimuth')} FROM lat WHERE i % 8 = 0 AND j % 8 = 0")
def s14(s, d):
    rows, cols = (s.range(0, n, 8).select(F.col("id").cast("int").alias(c)) for n, c in ((96, "row"), (64, "col")))
    return rounded(X.lattice(s, d).join(rows, "row", "left_semi").join(cols, "col", "left_semi").select("row", "col", "azimuth"))


@query("s16_height_stats", "SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(avg(c_acctbal), 4) + 0.0::DOUBLE AS mean FROM customer GROUP BY c_nationkey")
def s16(s, d):
    return X.table(s, d, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), S.q(F.avg("c_acctbal"), 4).alias("mean"))


@query("s17_id_lookup_bounds", f"WITH {X.POINTS}, w AS (SELECT lower(replace(n_name, '_', '-')) AS k, n_nationkey FROM nation WHERE n_nationkey % 2 = 0) SELECT w.k, min(x) - 0.1 AS x0, max(x) + 0.1 AS x1, min(y) - 0.1 AS y0, max(y) + 0.1 AS y1 FROM pt JOIN w ON pt.id % 25 = n_nationkey GROUP BY w.k")
def s17(s, d):
    w = X.table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.lower(F.replace(F.col("n_name"), F.lit("_"), F.lit("-"))).alias("k"), F.col("n_nationkey").cast("long").alias("n"))
    p = X.points(s, d).withColumn("n", F.col("id") % 25).join(J.small(w), "n")
    return p.groupBy("k").agg((F.min("x") - 0.1).alias("x0"), (F.max("x") + 0.1).alias("x1"), (F.min("y") - 0.1).alias("y0"), (F.max("y") + 0.1).alias("y1"))


@query("s18_first_of_day", "SELECT strftime(ts, '%Y%m%d') AS day, min(event_id) AS first FROM events GROUP BY 1")
def s18(s, d):
    return X.table(s, d, "events").groupBy(F.date_format("ts", "yyyyMMdd").alias("day")).agg(F.min("event_id").alias("first"))


_BOX = "a AS (SELECT r_regionkey AS id, 3.0::DOUBLE * r_regionkey AS x0, 10.0::DOUBLE * r_regionkey AS y0, 3.0::DOUBLE * r_regionkey + 4 AS x1, 10.0::DOUBLE * r_regionkey + 12 AS y1 FROM region), b AS (SELECT s_suppkey AS id, s_suppkey % 17 * 1.0::DOUBLE AS x0, s_suppkey % 53 * 1.0::DOUBLE AS y0, s_suppkey % 17 + 0.5::DOUBLE AS x1, s_suppkey % 53 + 0.5::DOUBLE AS y1 FROM supplier)"


@query("s21_box_overlap", f"WITH {_BOX} SELECT a.id AS a_id, b.id AS b_id FROM a, b WHERE a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def s21(s, d):
    k, m = F.col("r_regionkey"), F.col("s_suppkey")
    box = lambda df, i, x, y, w, h: df.select(i.alias("id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + w).cast("double").alias("x1"), (y + h).cast("double").alias("y1"))
    return Q.boxes_overlap(box(X.table(s, d, "region"), k, 3 * k, 10 * k, 4, 12), box(X.table(s, d, "supplier"), m, m % 17, m % 53, 0.5, 0.5), 5.0)


@query("p03_valid_cells", f"WITH {X.ACC} SELECT d1, d2, count(*) AS cells FROM coh WHERE valid GROUP BY d1, d2")
def p03(s, d):
    return B.coherence(B.accumulate(X.stack(s, d), 4, 4)).where("valid").groupBy("d1", "d2").agg(F.count("*").alias("cells"))


@query("p06_two_threshold_gate", f"WITH {X.BANDS} SELECT i, j FROM bd WHERE coh >= 0.4 AND coh * 0.9 >= 0.3")
def p06(s, d):
    return X.bands(s, d).where((F.col("coh") >= 0.4) & (F.col("coh") * 0.9 >= 0.3)).select(*_ij())


@query("p07_excluded_cells", f"WITH {X.LAT} SELECT i // 4 AS i, j // 4 AS j, round(avg(azimuth), 6) + 0.0::DOUBLE AS v FROM lat WHERE NOT (snr < 7) GROUP BY 1, 2")
def p07(s, d):
    lat = X.lattice(s, d)
    left = J.missing(lat, lat.where("snr < 7"), ["row", "col"])
    return rounded(left.groupBy(B.cell("row", 4).alias("row"), B.cell("col", 4).alias("col")).agg(F.avg("azimuth").alias("v")))


@query("p09_overlap_window", "SELECT n_regionkey, max(n_nationkey) + 2 AS lo, min(n_nationkey + 40) - 2 AS hi FROM nation GROUP BY n_regionkey")
def p09(s, d):
    g = X.table(s, d, "nation").groupBy("n_regionkey").agg(F.max("n_nationkey").alias("a"), F.min(F.col("n_nationkey") + 40).alias("b"))
    lo, hi = Q.overlap([F.col("a"), F.lit(0)], [F.col("b"), F.lit(1000)], 2)
    return g.select("n_regionkey", lo.alias("lo"), hi.alias("hi"))


@query("p10_crop_to_footprint", f"WITH {X.LAT}, b AS (SELECT greatest(min(i) // 4 * 4 - 4, 0) AS r0, least((max(i) // 4 + 1) * 4 + 4, 96) AS r1, greatest(min(j) // 4 * 4 - 4, 0) AS c0, least((max(j) // 4 + 1) * 4 + 4, 64) AS c1 FROM lat WHERE azimuth > 3.4) SELECT i, j FROM lat, b WHERE i >= r0 AND i < r1 AND j >= c0 AND j < c1")
def p10(s, d):
    lat = X.lattice(s, d)
    b = lat.where("azimuth > 3.4").agg(F.greatest(F.expr("min(row) div 4 * 4 - 4"), F.lit(0)).alias("r0"), F.least(F.expr("(max(row) div 4 + 1) * 4 + 4"), F.lit(96)).alias("r1"), F.greatest(F.expr("min(col) div 4 * 4 - 4"), F.lit(0)).alias("c0"), F.least(F.expr("(max(col) div 4 + 1) * 4 + 4"), F.lit(64)).alias("c1"))
    return lat.crossJoin(F.broadcast(b)).where("row >= r0 and row < r1 and col >= c0 and col < c1").select(*_ij())


@query("p14_filter_by_frequency", f"WITH {X.ACC} SELECT d1, d2, count(*) AS n FROM (SELECT *, CASE WHEN (i + j) % 2 = 0 THEN 'A' ELSE 'B' END AS f FROM acc) WHERE f = 'A' GROUP BY d1, d2")
def p14(s, d):
    a = B.accumulate(X.stack(s, d), 4, 4).withColumn("f", F.when((F.col("row") + F.col("col")) % 2 == 0, "A").otherwise("B"))
    return a.where("f = 'A'").groupBy("d1", "d2").agg(F.count("*").alias("n"))


@query("j02_pixel_product", f"WITH {X.STACK} SELECT a.i, a.j, round(a.re * b.re + a.im * b.im, 6) + 0.0::DOUBLE AS re, round(a.im * b.re - a.re * b.im, 6) + 0.0::DOUBLE AS im FROM st a JOIN st b ON a.i = b.i AND a.j = b.j AND a.d = '1996' AND b.d = '1999'")
def j02(s, d):
    st = X.stack(s, d)
    a, b = st.where("d = '1996'"), st.where("d = '1999'").select("row", "col", F.col("re").alias("r2"), F.col("im").alias("i2"))
    re, im = S.times_conj(F.col("re"), F.col("im"), F.col("r2"), F.col("i2"))
    return rounded(a.join(b, ["row", "col"]).select("row", "col", re.alias("re"), im.alias("im")))


@query("j05_common_extent", f"WITH {X.STACK} SELECT i, j FROM st WHERE d = '1995' INTERSECT SELECT i, j FROM st WHERE d = '1998'")
def j05(s, d):
    st = X.stack(s, d)
    return st.where("d = '1995'").select(*_ij()).join(st.where("d = '1998'").select(*_ij()), ["i", "j"]).select("i", "j").distinct()


@query("j17_gain_at", "WITH g AS (SELECT unnest(range(0, 5)) AS k), ax AS (SELECT k * 100.0::DOUBLE AS x, (k * k % 3) / 2.0::DOUBLE AS y FROM g), sg AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM ax) SELECT p_partkey, round(y0 + coalesce((least(400, p_partkey / 4.0::DOUBLE) - x0) * (y1 - y0) / (x1 - x0), 0), 6) + 0.0::DOUBLE AS gain FROM part JOIN sg ON least(400, p_partkey / 4.0::DOUBLE) >= x0 AND (least(400, p_partkey / 4.0::DOUBLE) < x1 OR x1 IS NULL)")
def j17(s, d):
    ax = s.range(5).select((F.col("id") * 100.0).alias("x"), ((F.col("id") * F.col("id") % 3) / 2.0).alias("y"))
    p = X.table(s, d, "part").select("p_partkey", (F.col("p_partkey") / 4.0).alias("t"))
    return rounded(J.bracket(p, ax, "t").select("p_partkey", F.col("y").alias("gain")))


@query("j19_extrapolating_lookup", f"WITH {X.LAT}, {X.POINTS}, t AS (SELECT id, (y - 60.5::DOUBLE) / 0.05::DOUBLE AS a, (x + 149.0::DOUBLE) / 0.2::DOUBLE AS b FROM pt), u AS (SELECT *, greatest(0, least(CAST(floor(a) AS INT), 94)) AS i0, greatest(0, least(CAST(floor(b) AS INT), 62)) AS j0 FROM t), c AS (SELECT id, i0 + di AS i, j0 + dj AS j, (CASE WHEN di = 1 THEN a - i0 ELSE 1 - (a - i0) END) * (CASE WHEN dj = 1 THEN b - j0 ELSE 1 - (b - j0) END) AS w FROM u, (SELECT unnest([0, 0, 1, 1]) AS di, unnest([0, 1, 0, 1]) AS dj)) SELECT id, round(sum(w * azimuth), 4) + 0.0::DOUBLE AS azimuth FROM c JOIN lat USING (i, j) GROUP BY id")
def j19(s, d):
    row, col = J.fractional(F.col("y"), 60.5, 0.05, 96, clamp=False), J.fractional(F.col("x"), -149.0, 0.2, 64, clamp=False)
    return rounded(J.bilinear(X.points(s, d), X.lattice(s, d), row, col, ["id"], "azimuth"), 4)


@query("j22_band_by_start", "SELECT o_orderkey, n_name FROM orders JOIN nation ON o_orderkey // 600 = n_nationkey")
def j22(s, d):
    b = X.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    return X.table(s, d, "orders").withColumn("k", F.expr("o_orderkey div 600")).join(b, "k").select("o_orderkey", "n_name")


@query("f06_implied_height", "SELECT p_partkey, round(p_partkey * 10.0::DOUBLE / (0.242::DOUBLE * 850000.0 * 1262.98 / (2 * 7000.0)) * 747.0, 6) AS h FROM part")
def f06(s, d):
    h = S.implied_height(F.col("p_partkey") * 10.0, F.lit(0.242), F.lit(850000.0), F.lit(1262.98), F.lit(7000.0), F.lit(747.0))
    return X.table(s, d, "part").select("p_partkey", F.round(h, 6).alias("h"))


@query("f12_radar_constants", "SELECT p_size, round(299792458.0::DOUBLE / (2 * p_size * 1000000.0::DOUBLE), 6) AS rho, round(5.347::DOUBLE * 1262.98 / (1000.0 + p_size), 6) AS rho_az FROM part GROUP BY p_size")
def f12(s, d):
    p = X.table(s, d, "part").select("p_size").distinct()
    return p.select("p_size", F.round(S.C_LIGHT / (2 * F.col("p_size") * 1e6), 6).alias("rho"), F.round(S.RHO_AZ * S.RADAR["azbw"] / (1000.0 + F.col("p_size")), 6).alias("rho_az"))


@query("f16_flatten_phase", f"WITH {X.PAIR}, {X.LAT}, p AS (SELECT pr.i, pr.j, s_re, s_im, 4 * pi() / 0.242::DOUBLE * (0.01::DOUBLE * range_) AS f FROM pr JOIN lat ON lat.i = pr.i AND lat.j = pr.j) SELECT i, j, round(s_re * cos(f) - s_im * sin(f), 6) + 0.0::DOUBLE AS re, round(s_re * sin(f) + s_im * cos(f), 6) + 0.0::DOUBLE AS im FROM p")
def f16(s, d):
    re, im = S.rotate(F.col("s_re"), F.col("s_im"), F.lit(4 * np.pi / 0.242) * (0.01 * F.col("range")))
    return rounded(X.slc_pair(s, d).join(X.lattice(s, d), ["row", "col"]).select("row", "col", re.alias("re"), im.alias("im")))


@query("f18_logs_and_decibels", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN 10 * log10(c_acctbal) END, 6) AS db, round(ln(greatest(c_acctbal, 1e-6)), 6) + 0.0::DOUBLE AS l FROM customer")
def f18(s, d):
    v = F.col("c_acctbal")
    return X.table(s, d, "customer").select("c_custkey", F.round(S.decibel(v), 6).alias("db"), S.q(S.log_floor(v)).alias("l"))


@query("f20_sliced_origin", "SELECT p_partkey, CAST(100 + p_partkey * 5 AS DOUBLE) AS start, 64 + 32 + 16 * p_partkey AS node FROM part")
def f20(s, d):
    k = F.col("p_partkey")
    return X.table(s, d, "part").select("p_partkey", (100 + k * 5).cast("double").alias("start"), S.node_pixel(k, 64, 64, 16).alias("node"))


@query("f21_gross_offset", "SELECT c_custkey, CAST(round_even(c_acctbal / 100, 0) AS BIGINT) AS gross FROM customer")
def f21(s, d):
    return X.table(s, d, "customer").select("c_custkey", F.rint(F.col("c_acctbal") / 100).cast("long").alias("gross"))


@query("f27_cell_centres", "SELECT p_partkey, 1000.0::DOUBLE - 15 + (p_partkey + 0.5::DOUBLE) * 30 AS x FROM part")
def f27(s, d):
    return X.table(s, d, "part").select("p_partkey", S.cell_centre(F.lit(1000.0), F.col("p_partkey"), 30.0).alias("x"))


@query("f31_layout_json", """SELECT n_nationkey, n_nationkey % 4 AS fy, '{"nx":' || n_nationkey || ',"ny":' || n_regionkey || '}' AS lay FROM nation""")
def f31(s, d):
    n = X.table(s, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("nx"), F.col("n_regionkey").alias("ny"), F.lit(1).alias("offs"), (F.col("n_nationkey") % 4).alias("fy"))).alias("j"))
    lay = F.from_json("j", "nx int, ny int, fy int")
    return n.select("n_nationkey", lay["fy"].alias("fy"), F.to_json(F.struct(lay["nx"].alias("nx"), lay["ny"].alias("ny"))).alias("lay"))


@query("u03_touches_border", "WITH g AS (SELECT o_orderkey % 40 AS i, o_custkey % 40 AS j, o_custkey % 23 AS label FROM orders) SELECT DISTINCT label FROM g WHERE label NOT IN (SELECT label FROM g WHERE i = 0 AND j < 5)")
def u03(s, d):
    g = X.table(s, d, "orders").select((F.col("o_orderkey") % 40).alias("i"), (F.col("o_custkey") % 40).alias("j"), (F.col("o_custkey") % 23).alias("label"))
    return J.missing(g.select("label").distinct(), g.where("i = 0 and j < 5"), ["label"])


@query("u05_joined_bands", f"WITH {X.LAT} SELECT i, j, {r6('azimuth')} FROM lat")
def u05(s, d):
    lat = X.lattice(s, d).select("row", "col", "azimuth")
    return rounded(lat.where("row < 40").unionByName(lat.where("row >= 40")))


@query("u06_any_channel", f"WITH {X.LAT} SELECT i, bool_or(abs(azimuth) > 3) OR bool_or(abs(range_) > 0.4) AS rejected FROM lat GROUP BY i")
def u06(s, d):
    return X.lattice(s, d).groupBy(F.col("row").alias("i")).agg((F.bool_or(F.abs("azimuth") > 3) | F.bool_or(F.abs("range") > 0.4)).alias("rejected"))


@query("t04_components_by_size", "SELECT o_custkey % 31 AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_custkey % 31) AS place FROM orders GROUP BY 1")
def t04(s, d):
    from pyspark.sql import Window as W

    g = X.table(s, d, "orders").groupBy((F.col("o_custkey") % 31).alias("label")).agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "label")).cast("long"))


@query("w11_row_metres", "SELECT p_size, 16 * (p_size / 10.0::DOUBLE) AS row_m FROM part GROUP BY p_size")
def w11(s, d):
    return X.table(s, d, "part").select("p_size", (16 * (F.col("p_size") / 10.0)).alias("row_m")).distinct()


@query("w13_overlap_add", f"WITH {X.PAIR}, b AS (SELECT unnest(range(0, 11)) AS b), o AS (SELECT i, j, b, i - 20 * b AS k, r_re AS v FROM pr JOIN b ON i BETWEEN 20 * b AND 20 * b + 39), w AS (SELECT i, j, v / sqrt(avg(v * v) OVER (PARTITION BY j, b) + 1) AS v, CASE WHEN (b = 0 AND k < 20) OR (b = 10 AND k >= 20) THEN 1 ELSE pow(sin(pi() * (k + 1) / 41.0::DOUBLE), 2) END AS w FROM o) SELECT i, j, round(sum(w * v) / sum(w), 6) + 0.0::DOUBLE AS v FROM w GROUP BY i, j")
def w13(s, d):
    from pyspark.sql import Window as W

    image = X.slc_pair(s, d).select("row", "col", F.col("r_re").alias("v"))
    return rounded(PT.overlap_added(image, X.PAIR_SHAPE[0], 40, 20, lambda b: b.withColumn("v", F.col("v") / F.sqrt(F.avg(F.col("v") * F.col("v")).over(W.partitionBy("col", "block")) + 1))))


@query("w16_grow_medians")
def w16(s, d):
    return rounded(P.grow(X.kept(s, d, 7.0), "median"))


@query("a19_phase_flatness", f"WITH {X.LAT}, b AS (SELECT i // 8 AS i, j // 8 AS j, sqrt(pow(avg(cos(azimuth)), 2) + pow(avg(sin(azimuth)), 2)) AS m FROM lat GROUP BY 1, 2 HAVING count(*) > 0.6 * 64) SELECT round(avg(m), 6) AS flatness FROM b")
def a19(s, d):
    b = X.lattice(s, d).groupBy(B.cell("row", 8).alias("row"), B.cell("col", 8).alias("col")).agg(S.magnitude(F.avg(F.cos("azimuth")), F.avg(F.sin("azimuth"))).alias("m"), F.count("*").alias("n"))
    return b.where("n > 0.6 * 64").agg(F.round(F.avg("m"), 6).alias("flatness"))


@query("a22_edge_orientation", f"WITH {X.POINTS}, e AS (SELECT x + 145 AS vx, y - 62 AS vy FROM pt), l AS (SELECT sqrt(vx * vx + vy * vy) AS len, atan2(vy, vx) AS t FROM e), k AS (SELECT * FROM l WHERE len > 0.05::DOUBLE * (SELECT max(len) FROM l)) SELECT round(degrees(atan2(sum(len * sin(4 * t)), sum(len * cos(4 * t)))) / 4, 4) + 0.0::DOUBLE AS angle FROM k")
def a22(s, d):
    return rounded(Q.orientation4(X.points(s, d).select((F.col("x") + 145).alias("vx"), (F.col("y") - 62).alias("vy"))), 4)


@query("a30_azimuth_spacing", "WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), g AS (SELECT a.user_id, abs(b.value - a.value) AS sep FROM e a JOIN e b ON a.user_id = b.user_id AND b.n = a.n + 1 WHERE a.n <= 3) SELECT user_id, round(median(sep), 4) + 0.0::DOUBLE AS spacing FROM g GROUP BY user_id")
def a30(s, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id")
    e = X.table(s, d, "events").select("user_id", F.abs(F.lead("value").over(w) - F.col("value")).alias("sep"), F.row_number().over(w).alias("n"))
    return rounded(e.where("n <= 3 and sep is not null").groupBy("user_id").agg(F.median("sep").alias("spacing")), 4)


_RR = f"WITH {X.LAT}, g AS (SELECT i, j, i // 12 AS label, azimuth - 2 * pi() * (i // 12 % 3) AS v, azimuth AS ref FROM lat WHERE j < 32 + i // 12), c AS (SELECT label, count(*) AS n, median(ref - v) / (2 * pi()) AS d FROM g GROUP BY label), t AS (SELECT arg_min(label, -n * 1000 + label) AS top FROM c) SELECT i, j, CASE WHEN g.label = top THEN 0 ELSE CAST(round_even(d, 0) AS BIGINT) END AS k, round(v + 2 * pi() * CASE WHEN g.label = top THEN 0 ELSE round_even(d, 0) END, 6) + 0.0::DOUBLE AS fixed FROM g JOIN c ON c.label = g.label, t"


@query("r11_rereference", _RR)
def r11(s, d):
    lab = F.expr("cast(row div 12 as int)")
    g = X.lattice(s, d).where(F.col("col") < 32 + lab).select("row", "col", lab.alias("label"), (F.col("azimuth") - Q.TURN * (lab % 3)).alias("v"), F.col("azimuth").alias("ref"))
    return rounded(Q.rereferenced(g).select("row", "col", "k", "fixed"))


@query("a26_fill_benchmark")
def a26(s, d):
    """Median error by method and depth in a withheld disc."""
    import pandas as pd

    lat = X.lattice(s, d).select(F.lit("az").alias("grid_id"), "row", "col", F.col("azimuth").alias("v"))
    every = lat.crossJoin(s.createDataFrame([(m,) for m in sorted(K.FILLS)], "method string"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        true = K.to_grid(pdf)
        y, x = np.indices(true.shape)
        depth = 12 - np.hypot(y - true.shape[0] / 2, x - 0.3 * true.shape[1])
        hole = depth > 0
        z = K.fill(np.where(hole, np.nan, true), pdf["method"].iloc[0])
        return pd.DataFrame({"method": pdf["method"].iloc[0], "band": np.floor(depth[hole] / 4).astype(np.int32), "err": np.abs(z - true)[hole]})

    e = every.groupBy("method").applyInPandas(run, "method string, band int, err double").where("err is not null")
    return rounded(e.groupBy("method", "band").agg(F.median("err").alias("err"), F.count("*").alias("n")), 4)


@query("m04_goldstein")
def m04(s, d):
    unit = X.lattice(s, d).select("row", "col", F.cos("azimuth").alias("re"), F.sin("azimuth").alias("im"))
    out = PT.patch_filtered(unit, X.LAT_SHAPE, 0.6, tile=32)
    return rounded(out.select("row", "col", F.when(F.col("coh") > 0, F.atan2("im", "re")).alias("v")), 4)


for _n, _f in {
    "m03_band_tilt": lambda g: np.array([[K.band_tilt(g, 4.0)]]),
    "a15_screen_sigma": lambda g: K.screen_sigma(0.1, g.shape, lambda n: K.integrate_rows(K.lowpass(n, (2.0, 2.0)))),
    "r17_steering_slope": lambda g: np.gradient(K.fill(g, "pls", s=2.0), axis=0),
    "f19_window_weights": lambda g: np.outer(K.kaiser(32), np.hanning(32)) * K.triangle_weights(32),
}.items():
    _kernel(_n, _f)


@query("r12_residual_after_update", f"WITH {X.LAT}, m AS (SELECT median(azimuth) AS m FROM lat) SELECT i, j, round(azimuth - m, 6) + 0.0::DOUBLE AS left_ FROM lat, m")
def r12(s, d):
    lat = X.lattice(s, d)
    m = lat.agg(F.median("azimuth").alias("m"))
    return rounded(lat.crossJoin(F.broadcast(m)).select("row", "col", (F.col("azimuth") - F.col("m")).alias("left_")))


@query("k03_product_round_trip", f"WITH {X.KEPT} SELECT i, j, round(v, 6) + 0.0::DOUBLE AS v FROM k")
def k03(s, d):
    return rounded(P.cut(X.kept(s, d)))


@query("k04_index_csv", f"WITH {X.ACC} SELECT 'A' AS freq, d1, d2, round(avg(coh), 4) AS coh_mean, count(*) AS n_cells FROM coh GROUP BY d1, d2")
def k04(s, d):
    from tessera.sources import io as IO

    from .q_routes import _path

    c = B.coherence(B.accumulate(X.stack(s, d), 4, 4)).groupBy("freq", "d1", "d2").agg(F.round(F.avg("coh"), 4).alias("coh_mean"), F.count("*").alias("n_cells"))
    none = F.lit(None).cast("double")
    path = _path(s, "index")
    IO.write_index(c.select("freq", "d1", "d2", none.alias("R_fft"), none.alias("theta_fft"), none.alias("D_RA"), "coh_mean", "n_cells"), path)
    return IO.read_index(s, path).select("freq", "d1", "d2", "coh_mean", "n_cells")


@query("j09_screen_to_looks", f"WITH {X.LAT}, u AS (SELECT id, 1.5::DOUBLE + 4 * (id // 12) AS a, 1.5::DOUBLE + 4 * (id % 12) AS b FROM (SELECT unnest(range(0, 240)) AS id)), t AS (SELECT id, greatest(0::DOUBLE, least(95::DOUBLE, (a - 3) / 1.1::DOUBLE)) AS a, greatest(0::DOUBLE, least(63::DOUBLE, (b - 2) / 0.9::DOUBLE)) AS b FROM u), v AS (SELECT *, least(CAST(floor(a) AS INT), 94) AS i0, least(CAST(floor(b) AS INT), 62) AS j0 FROM t), c AS (SELECT id, i0 + di AS i, j0 + dj AS j, (CASE WHEN di = 1 THEN a - i0 ELSE 1 - (a - i0) END) * (CASE WHEN dj = 1 THEN b - j0 ELSE 1 - (b - j0) END) AS w FROM v, (SELECT unnest([0, 0, 1, 1]) AS di, unnest([0, 1, 0, 1]) AS dj)) SELECT id, round(sum(w * azimuth), 6) + 0.0::DOUBLE AS azimuth FROM c JOIN lat USING (i, j) GROUP BY id")
def j09(s, d):
    p = s.range(240).select("id", (1.5 + 4 * F.expr("id div 12")).alias("a"), (1.5 + 4 * (F.col("id") % 12)).alias("b"))
    return rounded(J.bilinear(p, X.lattice(s, d), J.fractional(F.col("a"), 3.0, 1.1, 96), J.fractional(F.col("b"), 2.0, 0.9, 64), ["id"], "azimuth"))


@query("w12_mean_by_cadence", "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) + 0.0::DOUBLE AS v, event_id FROM events")
def w12(s, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0)
    return X.table(s, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), S.q(F.avg("value").over(w), 4).alias("v"), "event_id")
