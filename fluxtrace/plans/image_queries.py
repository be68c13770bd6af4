"""Queries of movies, label images and spatial assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation as co
from ..operators import labels as lb
from ..operators import movie as mv
from .registry import MOVIE, REGIONS, TRACES, WAVES, movie, q6, query, r6, regions, table, traces, waves
from .storage import settle
from .trace_queries import SAVGOL

KEYS = ["recording", "frame", "y", "x"]


@query(f"WITH {MOVIE} SELECT y, x, {q6('avg(v)')} AS v FROM m WHERE frame < 4 GROUP BY y, x")
def temporal_average(spark, d):
    return mv.mean_image(movie(spark, d), 0, 4).select("y", "x", r6("v").alias("v"))


@query(f"WITH {REGIONS} SELECT label, frame, {q6('avg(m.v)')} AS f FROM m JOIN l ON m.y = l.y AND m.x = l.x GROUP BY label, frame")
def roi_trace_means(spark, d):
    return mv.region_traces(movie(spark, d), regions(spark, d)).select("label", "frame", r6("f").alias("f"))


@query(f"""WITH {REGIONS}, b AS (SELECT label, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM l GROUP BY label)
 SELECT label, frame, {q6('avg(v)')} AS f FROM m JOIN b ON y >= y0 AND y < y1 AND x >= x0 AND x < x1 WHERE frame >= 2 AND frame < 5 GROUP BY label, frame""")
def wave_profiles(spark, d):
    boxes = lb.properties(regions(spark, d)).select("recording", "label", "y0", "y1", "x0", "x1", F.lit(3).alias("start"), F.lit(5).alias("end"))
    return mv.wave_profile(movie(spark, d), boxes, 1).select("label", "frame", r6("f").alias("f"))


@query(f"""WITH {REGIONS}, p AS (SELECT label, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, avg(y) AS cy, avg(x) AS cx, var_pop(y) + 1/12 AS yy, var_pop(x) + 1/12 AS xx, covar_pop(y, x) AS yx FROM l GROUP BY label),
 s AS (SELECT *, (yy + xx) / 2 AS m, sqrt(pow((yy - xx) / 2, 2) + yx * yx) AS s FROM p)
 SELECT label, area, y0, x0, y1, x1, {q6('cy')} AS cy, {q6('cx')} AS cx, {q6('4 * sqrt(m + s)')} AS major, {q6('4 * sqrt(greatest(m - s, 0.0))')} AS minor, CASE WHEN s > 1e-9 THEN {q6('cos(atan2(2 * yx, yy - xx))')} END AS axis_cos, CASE WHEN s > 1e-9 THEN {q6('sin(atan2(2 * yx, yy - xx))')} END AS axis_sin FROM s""")
def region_properties(spark, d):
    # Twice the orientation on the unit circle: equal for both ends of an axis; round regions have none.
    twice, long_ = 2 * F.col("orientation"), F.col("major") ** 2 - F.col("minor") ** 2 > 3.2e-8
    axis = [F.when(long_, r6(f(twice))).alias(n) for f, n in ((F.cos, "axis_cos"), (F.sin, "axis_sin"))]
    return lb.properties(regions(spark, d)).select("label", "area", "y0", "x0", "y1", "x1", *[r6(c).alias(c) for c in ("cy", "cx", "major", "minor")], *axis)


@query(f"WITH {WAVES} SELECT label, min(t) AS start, max(t) + 1 - min(t) AS duration, count(*) AS area FROM w GROUP BY label")
def wave_props(spark, d):
    return lb.waves(waves(spark, d)).drop("recording")


@query(f"""WITH {WAVES}, p AS (SELECT label, min(t) AS start, max(t) + 1 - min(t) AS duration FROM w GROUP BY label)
 SELECT label, start + (duration - 1) / 2 AS middle, lag(label) OVER (ORDER BY start, label) AS previous, lead(label) OVER (ORDER BY start, label) AS next FROM p""")
def wave_neighbours(spark, d):
    return lb.neighbours_in_time(lb.waves(waves(spark, d))).select("label", "middle", "previous", "next")


@query(f"WITH {WAVES}, p AS (SELECT label, row_number() OVER (ORDER BY min(t), label) AS new FROM w GROUP BY label) SELECT t, y, x, cast(new AS INTEGER) AS label FROM w JOIN p USING (label)")
def wave_order(spark, d):
    return lb.by_start(waves(spark, d)).select("t", "y", "x", "label")


@query(f"WITH {WAVES} SELECT t, y, x, label FROM w WHERE NOT (t BETWEEN 2 AND 4)")
def waves_without_frames(spark, d):
    return lb.without_frames(waves(spark, d), 4, 2).select("t", "y", "x", "label")


@query(f"WITH {REGIONS} SELECT y, x, label FROM l WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) >= 40)")
def label_size_filter(spark, d):
    return lb.large(regions(spark, d), 40).select("y", "x", "label")


@query("SELECT l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 600)")
def supplier_size_filter(spark, d):
    df = table(spark, d, "lineitem").select(F.lit(1).alias("recording"), F.col("l_suppkey").alias("label"), "l_linenumber", "l_quantity", "l_extendedprice")
    return lb.large(df, 600).select(F.col("label").alias("l_suppkey"), "l_linenumber", "l_quantity", "l_extendedprice")


@query(f"WITH {REGIONS}, p AS (SELECT label, row_number() OVER (ORDER BY avg(x), label) AS new FROM l GROUP BY label) SELECT y, x, cast(new AS INTEGER) AS label FROM l JOIN p USING (label)")
def label_rank_lr(spark, d):
    return lb.left_to_right(regions(spark, d)).select("y", "x", "label")


@query(f"WITH {REGIONS} SELECT max(label) = count(DISTINCT label) AS ok FROM l")
def labels_contiguous(spark, d):
    return lb.contiguous(regions(spark, d)).select("ok")


@query(f"WITH {REGIONS} SELECT a.y, a.x, a.label FROM l a JOIN l b ON a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x) GROUP BY ALL HAVING count(*) = 8")
def label_erode(spark, d):
    return lb.eroded(regions(spark, d)).select("y", "x", "label")


@query(f"""WITH {REGIONS}, c AS (SELECT label, cast(floor(avg(y)) AS INTEGER) AS cy, cast(floor(avg(x)) AS INTEGER) AS cx FROM l GROUP BY label),
 s AS (SELECT cy + unnest([-2, -1, 0, 1]) AS y, cx, label FROM c), q AS (SELECT y, cx + unnest([-2, -1, 0, 1]) AS x, label FROM s) SELECT y, x, max(label) AS label FROM q WHERE y >= 0 AND x >= 0 GROUP BY y, x""")
def label_squares(spark, d):
    return lb.squares(regions(spark, d), 2).select("y", "x", "label")


@query(f"WITH {REGIONS}, a AS (SELECT y * 2 + unnest([0, 1]) AS y, x, label FROM l) SELECT y, x * 2 + unnest([0, 1]) AS x, label FROM a")
def label_upscale(spark, d):
    return lb.enlarged(regions(spark, d)).select("y", "x", "label")


@query(f"WITH {WAVES} SELECT t, y, x, label FROM w WHERE label IN (SELECT label FROM w WHERE y BETWEEN 10 AND 12 AND x BETWEEN 10 AND 25)")
def labels_in_area(spark, d):
    area = movie(spark, d).where("y between 10 and 12 and x between 10 and 25").select("recording", "y", "x")
    return lb.touching(waves(spark, d), area).select("t", "y", "x", "label")


@query(f"WITH {REGIONS}, a AS (SELECT y, x, v % 5 AS a FROM m WHERE frame = 1 AND v % 5 > 0) SELECT label, median(a.a) AS kind FROM l LEFT JOIN a ON l.y = a.y AND l.x = a.x GROUP BY label")
def annotation_median(spark, d):
    return lb.annotation_median(regions(spark, d), _annotation(spark, d)).select("label", "kind")


def _annotation(spark, d):
    return movie(spark, d).where("frame = 1 and v % 5 > 0").select("recording", "y", "x", (F.col("v") % 5).alias("label"))


@query(f"""WITH {REGIONS}, a AS (SELECT y, x, v % 5 AS a FROM m WHERE frame = 1 AND v % 5 > 0), n AS (SELECT label, a.a, count(*) AS n FROM l JOIN a ON l.y = a.y AND l.x = a.x GROUP BY ALL)
 SELECT label, arg_max(a, (n, -a)) AS kind FROM n GROUP BY label""")
def mode_annotation(spark, d):
    return lb.annotation_mode(regions(spark, d), _annotation(spark, d)).select("label", "kind")


@query(f"""WITH {REGIONS}, a AS (SELECT y, x, v % 5 AS a FROM m WHERE frame = 1 AND v % 5 > 0), k AS (SELECT DISTINCT label, label % 3 AS kind FROM l), md AS (SELECT label, median(a.a) AS m FROM l LEFT JOIN a ON l.y = a.y AND l.x = a.x GROUP BY label),
 p AS (SELECT *, sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) OVER (ORDER BY label) AS place FROM k) SELECT p.label, CASE WHEN kind = 1 THEN coalesce(m, cast(place AS DOUBLE)) END AS matched FROM p JOIN md ON p.label = md.label""")
def matched_numbers(spark, d):
    r = regions(spark, d)
    typed = r.select("recording", "label").distinct().withColumn("kind", F.col("label") % 3)
    return lb.matched_numbers(typed, r, _annotation(spark, d)).select("label", "matched")


@query(f"WITH {REGIONS}, t AS (SELECT *, max(label) OVER () AS top FROM l) SELECT y, x, cast(CASE WHEN label - 3 > 0 THEN label - 3 ELSE top + label - 3 - 1 END AS INTEGER) AS label FROM t")
def shifted_labels(spark, d):
    return lb.shifted_numbers(regions(spark, d), -3).select("y", "x", "label")


_POINTS = """c AS (SELECT label, avg(y) AS cy, avg(x) AS cx FROM l GROUP BY label), b AS (SELECT label, cy, cx FROM c WHERE label % 2 = 0), h AS (SELECT label, cy, cx FROM c WHERE label % 2 = 1)"""


def points_and_cells(spark, d):
    c = lb.properties(regions(spark, d)).select("recording", "label", "cy", "cx")
    return c.where("label % 2 = 0"), c.where("label % 2 = 1")


_NEAR = f"{_POINTS}, e AS (SELECT b.label, h.label AS target, sqrt(pow(b.cy - h.cy, 2) + pow(b.cx - h.cx, 2)) AS d FROM b, h), nr AS (SELECT label, arg_min(target, (round(d, 9), target)) AS target, min(d) AS distance FROM e GROUP BY label)"


@query(f"WITH {REGIONS}, {_NEAR} SELECT label, target, {q6('distance')} AS distance FROM nr")
def nearest_assignment(spark, d):
    points, cells = points_and_cells(spark, d)
    return lb.nearest(points, cells, settle=settle).select("label", "target", r6("distance").alias("distance"))


@query(f"""WITH {REGIONS}, {_NEAR}, a AS (SELECT cy, cx FROM h ORDER BY label LIMIT 1), z AS (SELECT cy, cx FROM h ORDER BY label DESC LIMIT 1),
 g AS (SELECT b.label, distance, (z.cx - a.cx) * (b.cy - a.cy) - (z.cy - a.cy) * (b.cx - a.cx) AS side, sqrt(pow(z.cx - a.cx, 2) + pow(z.cy - a.cy, 2)) AS len FROM b JOIN nr ON b.label = nr.label, a, z)
 SELECT label, CASE WHEN distance < 8.3 THEN CASE WHEN abs(side) / len < 4 THEN 5 WHEN side > 0 THEN 1 ELSE 2 END WHEN side > 0 THEN 3 ELSE 4 END AS class FROM g""")
def bouton_classes(spark, d):
    points, cells = points_and_cells(spark, d)
    return lb.bouton_classes(points, cells, cutoff=8.3, close=4, settle=settle).select("label", "class")


@query(f"""WITH {REGIONS}, b AS (SELECT y, x, label FROM l WHERE label % 2 = 0), h AS (SELECT y, x + 6 AS x, label FROM l WHERE label % 3 = 1),
 o AS (SELECT b.label, h.label AS cell, count(*) AS n FROM b JOIN h ON b.y = h.y AND b.x = h.x GROUP BY ALL), best AS (SELECT label, arg_max(cell, (n, -cell)) AS cell FROM o GROUP BY label),
 near AS (SELECT b.label, max(h.label) AS cell FROM b JOIN h ON pow(b.y - h.y, 2) + pow(b.x - h.x, 2) < 9 GROUP BY b.label) SELECT DISTINCT b.label, coalesce(best.cell, near.cell, 666) AS cell FROM b LEFT JOIN best ON b.label = best.label LEFT JOIN near ON b.label = near.label""")
def overlap_assignment(spark, d):
    r = regions(spark, d)
    cells = r.where("label % 3 = 1").withColumn("x", F.col("x") + 6)
    return lb.overlap_assignment(r.where("label % 2 = 0"), cells).select("label", "cell")


@query(f"""WITH {REGIONS}, b AS (SELECT y, x, label FROM l WHERE label % 2 = 0), h AS (SELECT y, x + 6 AS x, label FROM l WHERE label % 3 = 1),
 o AS (SELECT b.label, h.label AS cell, count(*) AS n FROM b JOIN h ON b.y = h.y AND b.x = h.x GROUP BY ALL), best AS (SELECT label, arg_max(cell, (n, -cell)) AS cell FROM o GROUP BY label),
 near AS (SELECT b.label, max(h.label) AS cell FROM b JOIN h ON pow(b.y - h.y, 2) + pow(b.x - h.x, 2) < 9 GROUP BY b.label),
 k AS (SELECT label, quantile_cont(CASE WHEN (y + x + label) % 4 < label % 5 THEN label // 2 % 6 ELSE 0 END, 0.5) AS kind FROM b GROUP BY label)
 SELECT DISTINCT b.label, CASE WHEN kind = 5 THEN 666 ELSE coalesce(best.cell, near.cell, CASE WHEN kind IN (1, 2) THEN 666 ELSE 0 END) END AS cell FROM b JOIN k ON b.label = k.label LEFT JOIN best ON b.label = best.label LEFT JOIN near ON b.label = near.label""")
def overlap_assignment_types(spark, d):
    r = regions(spark, d)
    marked = r.where("(y + x + label) % 4 < label % 5")  # from no pixel to all pixels of a label
    cells, kinds = r.where("label % 3 = 1").withColumn("x", F.col("x") + 6), marked.withColumn("label", F.expr("label div 2 % 6")).where("label > 0")
    return lb.overlap_assignment(r.where("label % 2 = 0"), cells, annotation=kinds).select("label", "cell")


@query(f"WITH {MOVIE}, b AS (SELECT frame // 2 AS frame, y, x, v FROM m WHERE frame // 2 < 3) SELECT cast(frame AS INTEGER) AS frame, y, x, cast(floor(avg(v)) AS INTEGER) AS v FROM b GROUP BY ALL")
def temporal_bin(spark, d):
    return mv.temporal_bin(movie(spark, d), 2).select("frame", "y", "x", "v")


@query(f"WITH {MOVIE} SELECT frame, cast(y // 3 AS INTEGER) AS y, cast(x // 3 AS INTEGER) AS x, {q6('avg(v)')} AS v FROM m WHERE y // 3 < (SELECT (max(y) + 1) // 3 FROM m) AND x // 3 < (SELECT (max(x) + 1) // 3 FROM m) GROUP BY ALL")
def spatial_bin(spark, d):
    return mv.spatial_bin(movie(spark, d), 3).select("frame", "y", "x", r6("v").alias("v"))


@query(f"WITH {MOVIE} SELECT cast(frame // 2 AS INTEGER) AS frame, y, x, v FROM m WHERE frame % 2 = 0")
def time_decimate(spark, d):
    return mv.every(movie(spark, d)).select("frame", "y", "x", "v")


@query(f"WITH {MOVIE}, b AS (SELECT y, x, avg(v) AS b FROM m WHERE frame < 5 GROUP BY y, x) SELECT frame, y, x, cast(greatest(floor(v - b), 0) AS INTEGER) AS v FROM m JOIN b USING (y, x)")
def bg_subtract(spark, d):
    return mv.minus_background(movie(spark, d), 0, 5).select("frame", "y", "x", "v")


@query(f"WITH {MOVIE} SELECT frame, y, x, greatest(v - 2000, 0) AS v FROM m")
def bg_constant(spark, d):
    return mv.minus_constant(movie(spark, d), 2000).select("frame", "y", "x", "v")


@query(f"""WITH {MOVIE}, k AS (SELECT d, exp(-0.5 * d * d) AS w FROM (SELECT unnest(generate_series(-4, 4)) AS d)), a AS (SELECT frame, m.y + d AS y, x, sum(v * w) / sum(w) AS v FROM m, k GROUP BY frame, m.y + d, x),
 b AS (SELECT a.* FROM a JOIN m USING (frame, y, x)), c AS (SELECT frame, y, b.x + d AS x, sum(b.v * w) / sum(w) AS v FROM b, k GROUP BY frame, y, b.x + d) SELECT frame, cast(c.y AS INTEGER) AS y, cast(c.x AS INTEGER) AS x, round(c.v, 4) + 0.0 AS v FROM c JOIN m USING (frame, y, x)""")
def gaussian_blur(spark, d):
    return mv.blurred(movie(spark, d), 1.0, axes=("y", "x")).select("frame", "y", "x", (F.round("v", 4) + 0.0).alias("v"))


@query(f"""WITH {MOVIE}, k AS (SELECT d, exp(-0.5 * d * d / 0.64) AS w FROM (SELECT unnest(generate_series(-3, 3)) AS d)), t AS (SELECT m.frame + d AS frame, y, x, sum(v * w) / sum(w) AS v FROM m, k GROUP BY m.frame + d, y, x), t2 AS (SELECT t.* FROM t JOIN m USING (frame, y, x)),
 a AS (SELECT frame, t2.y + d AS y, x, sum(v * w) / sum(w) AS v FROM t2, k GROUP BY frame, t2.y + d, x),
 b AS (SELECT a.* FROM a JOIN m USING (frame, y, x)), c AS (SELECT frame, y, b.x + d AS x, sum(b.v * w) / sum(w) AS v FROM b, k GROUP BY frame, y, b.x + d) SELECT cast(c.frame AS INTEGER) AS frame, cast(c.y AS INTEGER) AS y, cast(c.x AS INTEGER) AS x, round(c.v, 4) + 0.0 AS v FROM c JOIN m USING (frame, y, x)""")
def gaussian_blur_time(spark, d):
    return mv.blurred(movie(spark, d), 0.8).select("frame", "y", "x", (F.round("v", 4) + 0.0).alias("v"))


@query(f"WITH {MOVIE} SELECT a.frame // 2 AS frame, a.y, a.x, {q6('b.v / nullif(a.v, 0)')} AS ratio FROM m a JOIN m b ON b.frame = a.frame + 1 AND a.y = b.y AND a.x = b.x WHERE a.frame % 2 = 0")
def channel_ratio(spark, d):
    return mv.ratio(mv.channels(movie(spark, d))).select("frame", "y", "x", r6("ratio").alias("ratio"))


_LEAK = f"""{MOVIE}, g AS (SELECT frame // 2 AS frame, y, x, v FROM m WHERE frame % 2 = 0 AND frame < 6), r AS (SELECT frame // 2 AS frame, y, x, v FROM m WHERE frame % 2 = 1 AND frame < 6),
 q AS (SELECT *, quantile_cont(v, 0.99) OVER (PARTITION BY y, x) AS top FROM g), p AS (SELECT y, x, arg_min(v, frame) AS gv, min(frame) AS frame FROM q WHERE v >= 0.99 * top GROUP BY y, x),
 s AS (SELECT p.y, p.x, CASE WHEN gv >= 2500 THEN least(greatest(r.v / gv, 0), 2) ELSE 0 END AS scale FROM p JOIN r ON p.y = r.y AND p.x = r.x AND p.frame = r.frame)"""


def _leak(spark, d):
    c = mv.channels(movie(spark, d))
    green, red = (c.where(F.col("channel") == k).drop("channel") for k in (0, 1))
    return green, red, mv.leak_scale(green, red, least_green=2500)


@query(f"WITH {_LEAK} SELECT y, x, {q6('scale')} AS scale FROM s")
def channel_leak_scale(spark, d):
    return _leak(spark, d)[2].select("y", "x", r6("scale").alias("scale"))


@query(f"WITH {_LEAK} SELECT cast(r.frame AS INTEGER) AS frame, r.y, r.x, {q6('greatest(r.v - scale * g.v, 0)')} AS v FROM r JOIN g USING (frame, y, x) JOIN s ON r.y = s.y AND r.x = s.x")
def channel_leak_subtract(spark, d):
    return mv.minus_leak(*_leak(spark, d)).select("frame", "y", "x", r6("v").alias("v"))


@query(f"""WITH {MOVIE}, g AS (SELECT frame // 2 AS frame, y, x, v FROM m WHERE frame % 2 = 0 AND frame < 6), r AS (SELECT frame // 2 AS frame, y, x, v FROM m WHERE frame % 2 = 1 AND frame < 6),
 gd AS (SELECT g.frame, g.y, g.x, g.v - b.b AS v FROM g JOIN (SELECT y, x, avg(v) AS b FROM g WHERE frame < 2 GROUP BY ALL) b ON g.y = b.y AND g.x = b.x), rd AS (SELECT r.frame, r.y, r.x, r.v - b.b AS v FROM r JOIN (SELECT y, x, avg(v) AS b FROM r WHERE frame < 2 GROUP BY ALL) b ON r.y = b.y AND r.x = b.x),
 p AS (SELECT y, x, arg_max(frame, (v, -frame)) AS frame, max(v) AS gv FROM gd GROUP BY ALL), s AS (SELECT p.y, p.x, CASE WHEN gv >= 1 THEN greatest(rd.v / gv, 0) ELSE 0.0 END AS scale FROM p JOIN rd ON p.y = rd.y AND p.x = rd.x AND p.frame = rd.frame),
 k AS (SELECT d, exp(-0.5 * d * d) AS w FROM (SELECT unnest(generate_series(-4, 4)) AS d)), a AS (SELECT s.y + d AS y, x, sum(scale * w) / sum(w) AS v FROM s, k GROUP BY s.y + d, x), b2 AS (SELECT a.* FROM a JOIN s USING (y, x)),
 c AS (SELECT y, b2.x + d AS x, sum(b2.v * w) / sum(w) AS v FROM b2, k GROUP BY y, b2.x + d) SELECT cast(y AS INTEGER) AS y, cast(x AS INTEGER) AS x, {q6('v')} AS scale FROM c JOIN s USING (y, x)""")
def channel_leak_background(spark, d):
    c = mv.channels(movie(spark, d))
    green, red = (c.where(F.col("channel") == k).drop("channel") for k in (0, 1))
    return mv.leak_scale(green, red, least_green=1, most=None, quantile=None, background=(0, 2), smoothing=1.0).select("y", "x", r6("scale").alias("scale"))


@query(f"""WITH {MOVIE}, b AS (SELECT frame FROM m GROUP BY frame ORDER BY avg(v) DESC, frame LIMIT 1), s AS (SELECT greatest(0, least(b.frame - 1, (SELECT max(frame) + 1 FROM m) - 3)) AS a FROM b)
 SELECT y, x, {q6('avg(v)')} AS v FROM m, s WHERE frame >= a AND frame < a + 3 GROUP BY y, x""")
def reference_image(spark, d):
    return mv.reference_image(movie(spark, d), 3).select("y", "x", r6("v").alias("v"))


@query(f"""WITH {MOVIE}, n AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM m), c AS (SELECT frame, y, x, v FROM m, n WHERE frame < 3 AND y >= floor(h * 0.2) AND y < h - floor(h * 0.2) AND x >= floor(w * 0.2) AND x < w - floor(w * 0.2))
 SELECT CASE WHEN abs(avg((v % 1000) - v)) >= 1 THEN {q6('avg((v % 1000) - v)')} ELSE 0.0 END AS "offset" FROM c""")
def intensity_offset(spark, d):
    m = movie(spark, d)
    return mv.intensity_offset(m, m.withColumn("v", F.col("v") % 1000), frames=3).select(r6("offset").alias("offset"))


@query(f"""WITH {MOVIE}, n AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM m), c AS (SELECT frame, y, x, v FROM m, n WHERE frame < 100 AND y >= floor(h * 0.2) AND y < h - floor(h * 0.2) AND x >= floor(w * 0.2) AND x < w - floor(w * 0.2)), o AS (SELECT avg((v + 300 + x) - v) AS o FROM c)
 SELECT frame, y, x, cast(floor(greatest(least(v + 300 + x - o, 65535), 0)) AS INTEGER) AS v FROM m, o""")
def intensity_corrected(spark, d):
    m = movie(spark, d)
    off = m.withColumn("v", F.col("v") + 300 + F.col("x"))
    return mv.minus_offset(off, mv.intensity_offset(m, off)).select("frame", "y", "x", "v")


@query("""WITH k AS (SELECT label AS recording, cast(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS bin, embedding AS m FROM embeddings), n AS (SELECT recording, max(bin) + 1 AS n FROM k GROUP BY recording),
 f AS (SELECT recording, n, unnest(generate_series(0, 99)) AS frame FROM n), x AS (SELECT recording, frame, frame * (n - 1) / 99 AS x, n FROM f), e AS (SELECT recording, frame, cast(floor(x) AS INTEGER) AS i, cast(least(floor(x) + 1, n - 1) AS INTEGER) AS j, x - floor(x) AS t FROM x)
 SELECT e.recording, cast(frame AS INTEGER) AS frame, round(list_sum(list_transform(list_zip(a.m, b.m), lambda p: p[1]::DOUBLE + (p[2]::DOUBLE - p[1]::DOUBLE) * t)), 6) + 0.0 AS total FROM e JOIN k a ON a.recording = e.recording AND a.bin = i JOIN k b ON b.recording = e.recording AND b.bin = j""")
def transform_lerp(spark, d):
    from pyspark.sql import Window as W

    e = table(spark, d, "embeddings")
    k = e.select(F.col("label").alias("recording"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("bin"), F.col("embedding").cast("array<double>").alias("m"))
    return mv.interpolated_transforms(k, 100).select("recording", "frame", r6(F.aggregate("m", F.lit(0.0), lambda a, x: a + x)).alias("total"))


_GRID = """z AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM m), gi AS (SELECT h / {n} AS sy, w / {n} AS sx, h, w, k / 2.0::DOUBLE AS part, k, i, unnest(generate_series(0, {n})) AS j FROM (SELECT h, w, k, unnest(generate_series(0, {n})) AS i FROM (SELECT h, w, unnest([0, 1]) AS k FROM z))),
 gb AS (SELECT k, i, j, h, w, cast(floor(part * sy + i * sy) AS INTEGER) AS y0, cast(floor(part * sy + (i + 1) * sy) AS INTEGER) AS y1, cast(floor(part * sx + j * sx) AS INTEGER) AS x0, cast(floor(part * sx + (j + 1) * sx) AS INTEGER) AS x1 FROM gi),
 b AS (SELECT cast(row_number() OVER (ORDER BY k, i, j) - 1 AS INTEGER) AS roi, y0, y1, x0, x1 FROM gb WHERE y1 <= h AND x1 <= w)"""


@query(f"WITH {MOVIE}, {_GRID.format(n=4)} SELECT roi, frame, {q6('avg(v)')} AS mean, {q6('stddev_pop(v)')} AS sd FROM m JOIN b ON y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY ALL")
def grid_reference_traces(spark, d):
    m = movie(spark, d)
    return mv.box_traces(m, mv.grid_rois(m, 4, 0.5)).select("roi", "frame", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query(f"WITH {MOVIE}, k AS (SELECT frame, x AS s, v - quantile_cont(v, 0.05) OVER (PARTITION BY x) AS v FROM m WHERE y = 20) SELECT frame, s, {q6('v')} AS v FROM k")
def kymograph_background(spark, d):
    k = movie(spark, d).where("y = 20").select("recording", "frame", F.col("x").alias("s"), "v")
    return mv.kymo_background(k).select("frame", "s", r6("v").alias("v"))


@query(f"""WITH {MOVIE}, p AS (SELECT frame, x - 5 AS s, avg(v) AS v FROM m WHERE y BETWEEN 18 AND 22 AND x BETWEEN 5 AND 30 GROUP BY ALL) SELECT frame, cast(s AS INTEGER) AS s, {q6('v')} AS v FROM p""")
def kymograph_line(spark, d):
    line = spark.createDataFrame(mv.along_line([(20, 5), (20, 30)], 26), "s int, y double, x double, ny double, nx double")
    return mv.kymograph(movie(spark, d), line, 2).select("frame", "s", r6("v").alias("v"))


@query(f"""WITH {MOVIE}, z AS (SELECT max(y) AS h, max(x) AS w FROM m), p AS (SELECT s, 5 + (h - 10) * s / 30.0::DOUBLE AS y, 4 + (w - 8) * s / 30.0::DOUBLE AS x, -(w - 8) / sqrt(pow(h - 10, 2) + pow(w - 8, 2)) AS ny, (h - 10) / sqrt(pow(h - 10, 2) + pow(w - 8, 2)) AS nx FROM z, (SELECT unnest(generate_series(0, 30)) AS s)),
 k AS (SELECT s, k, y + k * ny AS y, x + k * nx AS x FROM p, (SELECT unnest([-2, -1, 0, 1, 2]) AS k)), c AS (SELECT s, k, floor(y) + j AS cy, floor(x) + i AS cx, (CASE WHEN j = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN i = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w FROM k, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
 e AS (SELECT frame, s, k, sum(v * w) / nullif(sum(w), 0) AS v FROM m JOIN c ON m.y = cy AND m.x = cx GROUP BY ALL) SELECT frame, cast(s AS INTEGER) AS s, round(avg(v), 4) + 0.0 AS v FROM e GROUP BY frame, s""")
def kymograph_oblique(spark, d):
    """Along a line from near one corner of the image to near the other."""
    m = movie(spark, d)
    top = m.agg(F.max("y").alias("h"), F.max("x").alias("w")).first()
    line = spark.createDataFrame(mv.along_line([(5, 4), (top["h"] - 5, top["w"] - 4)], 31), "s int, y double, x double, ny double, nx double")
    return mv.kymograph(m, line, 2).select("frame", "s", (F.round("v", 4) + 0.0).alias("v"))


@query(f"""WITH {MOVIE}, r AS (SELECT frame, v, min(v) OVER (PARTITION BY frame) AS lo, max(v) OVER (PARTITION BY frame) AS hi FROM m), h AS (SELECT frame, least(floor((v - lo) * 64 / (hi - lo)), 63) AS b, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM r GROUP BY ALL),
 c AS (SELECT frame, b, n, lo + (b + 0.5) * (hi - lo) / 64 AS mid FROM h), u AS (SELECT frame, b, mid, sum(n) OVER k AS w, sum(n * mid) OVER k AS s, sum(n) OVER (PARTITION BY frame) AS total, sum(n * mid) OVER (PARTITION BY frame) AS moment FROM c WINDOW k AS (PARTITION BY frame ORDER BY b)),
 v AS (SELECT frame, b, mid, w * (total - w) * pow(s / w - (moment - s) / nullif(total - w, 0), 2) AS between_ FROM u) SELECT frame, {q6('arg_max(mid, (round(coalesce(between_, -1), 3), -b))')} AS threshold FROM v GROUP BY frame""")
def otsu_thresholds(spark, d):
    return mv.otsu_threshold(movie(spark, d), 64).select("frame", r6("threshold").alias("threshold"))


@query(f"""WITH {MOVIE}, k AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) k(dy, dx)), e AS (SELECT frame, m.y + dy AS y, m.x + dx AS x, min(v) AS v FROM m, k GROUP BY ALL), i AS (SELECT e.* FROM e JOIN m USING (frame, y, x)),
 o AS (SELECT frame, i.y + dy AS y, i.x + dx AS x, max(v) AS v FROM i, k GROUP BY ALL) SELECT frame, m.y, m.x, m.v - o.v AS v FROM m JOIN o USING (frame, y, x)""")
def white_top_hat(spark, d):
    return mv.opened_difference(movie(spark, d), 1).select("frame", "y", "x", "v")


@query(f"""WITH {MOVIE}, k AS (SELECT d, exp(-0.5 * d * d) AS w FROM (SELECT unnest(generate_series(-4, 4)) AS d)), a AS (SELECT frame, m.y + d AS y, x, sum(v * w) / sum(w) AS v FROM m, k GROUP BY frame, m.y + d, x),
 b AS (SELECT a.* FROM a JOIN m USING (frame, y, x)), c AS (SELECT frame, y, b.x + d AS x, sum(b.v * w) / sum(w) AS v FROM b, k GROUP BY frame, y, b.x + d), f AS (SELECT frame, cast(c.y AS INTEGER) AS y, cast(c.x AS INTEGER) AS x, c.v FROM c JOIN m USING (frame, y, x)),
 r AS (SELECT frame, v, min(v) OVER (PARTITION BY frame) AS lo, max(v) OVER (PARTITION BY frame) AS hi FROM f), h AS (SELECT frame, least(floor((v - lo) * 256 / (hi - lo)), 255) AS b, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM r GROUP BY ALL),
 hc AS (SELECT frame, b, n, lo + (b + 0.5) * (hi - lo) / 256 AS mid FROM h), u AS (SELECT frame, b, mid, sum(n) OVER k AS w, sum(n * mid) OVER k AS s, sum(n) OVER (PARTITION BY frame) AS total, sum(n * mid) OVER (PARTITION BY frame) AS moment FROM hc WINDOW k AS (PARTITION BY frame ORDER BY b)),
 th AS (SELECT frame, arg_max(mid, (coalesce(w * (total - w) * pow(s / w - (moment - s) / nullif(total - w, 0), 2), -1), -b)) AS threshold FROM u GROUP BY frame), br AS (SELECT f.* FROM f JOIN th USING (frame) WHERE v > threshold),
 sd AS (SELECT br.frame, br.y, br.x FROM br JOIN f o ON o.frame = br.frame AND o.y BETWEEN br.y - 3 AND br.y + 3 AND o.x BETWEEN br.x - 3 AND br.x + 3 GROUP BY br.frame, br.y, br.x, br.v HAVING br.v >= max(o.v)), sn AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY y, x) AS seed FROM sd)
 SELECT br.frame, br.y, br.x, cast(arg_min(seed, (pow(br.y - sn.y, 2) + pow(br.x - sn.x, 2), seed)) AS INTEGER) AS label FROM br JOIN sn ON br.frame = sn.frame GROUP BY ALL""")
def seeded_segmentation(spark, d):
    return mv.seeded_regions(movie(spark, d), sigma=1.0, settle=settle).select("frame", "y", "x", "label")


# No SQL: phase correlation needs a Fourier transform. Tests compare it with sums over all shifts.


@query()
def frame_shifts(spark, d):
    m = movie(spark, d)
    return mv.shifts(m, mv.reference_image(m, 1)).select("frame", "dy", "dx")


@query()
def registered_frames(spark, d):
    m = movie(spark, d)
    return mv.moved_back(m, mv.shifts(m, mv.reference_image(m, 1))).select("frame", "y", "x", "v")


_SPLINE = """sz AS (SELECT max(y) AS h, max(x) AS w, max(frame) AS t FROM m), dense AS (SELECT f.frame, gy.y, gx.x, coalesce(m.v, 0) AS v FROM sz, (SELECT DISTINCT frame FROM m) f, (SELECT unnest(generate_series(0, (SELECT h FROM sz))) AS y) gy, (SELECT unnest(generate_series(0, (SELECT w FROM sz))) AS x) gx
 LEFT JOIN m ON m.frame = f.frame AND m.y = gy.y AND m.x = gx.x), d AS (SELECT unnest(generate_series(-25, 25)) AS d),
 cx AS (SELECT a.frame, a.y, a.x, sqrt(3) * sum(b.v * pow(sqrt(3) - 2, abs(d))) AS v FROM dense a, d, sz JOIN dense b ON b.frame = a.frame AND b.y = a.y AND b.x = w - abs(w - ((a.x + d) % (2 * w) + 2 * w) % (2 * w)) GROUP BY ALL),
 cy AS (SELECT a.frame, a.y, a.x, sqrt(3) * sum(b.v * pow(sqrt(3) - 2, abs(d))) AS v FROM cx a, d, sz JOIN cx b ON b.frame = a.frame AND b.x = a.x AND b.y = h - abs(h - ((a.y + d) % (2 * h) + 2 * h) % (2 * h)) GROUP BY ALL)"""
_WEIGHT = "CASE {j} WHEN -1 THEN pow(1 - {t}, 3) / 6 WHEN 0 THEN 2 / 3.0::DOUBLE - {t} * {t} * (2 - {t}) / 2 WHEN 1 THEN 2 / 3.0::DOUBLE - pow(1 - {t}, 2) * (1 + {t}) / 2 ELSE pow({t}, 3) / 6 END"


@query(f"""WITH m AS (SELECT * FROM (WITH {MOVIE} SELECT * FROM m WHERE y < 12)), {_SPLINE}, p AS (SELECT s, -1.37 + (h + 2.58) * s / 30.0::DOUBLE AS y, 3.1 + (w - 6.2) * s / 30.0::DOUBLE AS x, -(w - 6.2) / sqrt(pow(h + 2.58, 2) + pow(w - 6.2, 2)) AS ny, (h + 2.58) / sqrt(pow(h + 2.58, 2) + pow(w - 6.2, 2)) AS nx FROM (SELECT cast(h AS DOUBLE) AS h, cast(w AS DOUBLE) AS w FROM sz), (SELECT unnest(generate_series(0, 30)) AS s)),
 k AS (SELECT s, k, y + k * ny AS y, x + k * nx AS x FROM p, (SELECT unnest([-1, 0, 1]) AS k)), f AS (SELECT s, k, y, x, y - floor(y) AS fy, x - floor(x) AS fx FROM k, sz WHERE y >= 0 AND x >= 0 AND y <= h AND x <= w),
 taps AS (SELECT s, k, floor(y) + j AS ty, floor(x) + i AS tx, ({_WEIGHT.format(j="j", t="fy")}) * ({_WEIGHT.format(j="i", t="fx")}) AS wt FROM f, (SELECT unnest([-1, 0, 1, 2]) AS i), (SELECT unnest([-1, 0, 1, 2]) AS j)),
 inside AS (SELECT s, k, wt, h - abs(h - (ty + 2 * h) % (2 * h)) AS y, w - abs(w - (tx + 2 * w) % (2 * w)) AS x FROM taps, sz),
 e AS (SELECT frame, s, k, sum(v * wt) AS v FROM cy JOIN inside USING (y, x) GROUP BY ALL) SELECT frame, cast(s AS INTEGER) AS s, {q6('avg(v)')} AS v FROM e GROUP BY frame, s""")
def kymograph_cubic(spark, d):
    """Along a line that leaves the image at both ends, by cubic splines."""
    m = movie(spark, d).where("y < 12")
    top = m.agg(F.max("y").alias("h"), F.max("x").alias("w")).first()
    line = spark.createDataFrame(mv.along_line([(-1.37, 3.1), (top["h"] + 1.21, top["w"] - 3.1)], 31), "s int, y double, x double, ny double, nx double")
    return mv.cubic_kymograph(m, line, 1).select("frame", "s", r6("v").alias("v"))


@query(f"""WITH {MOVIE} SELECT DISTINCT frame, cast(frame * 3 % 7 - 3 AS DOUBLE) AS dy, cast(frame * 5 % 9 - 4 AS DOUBLE) AS dx FROM m""")
def planted_motion(spark, d):
    """The first frame's image on a dark canvas, moved by known shifts, against itself unmoved: the shifts come back."""
    m = movie(spark, d)
    top = m.agg((F.max("y") + 32).alias("h"), (F.max("x") + 32).alias("w")).first()
    corner = spark.createDataFrame([(1, top["h"], top["w"], 0)], "recording int, y int, x int, v int")
    first = m.where("frame = 0").select("recording", (F.col("y") + 16).alias("y"), (F.col("x") + 16).alias("x"), "v")
    y, x = F.col("y") + F.col("frame") * 3 % 7 - 3, F.col("x") + F.col("frame") * 5 % 9 - 4
    frames = m.select("recording", "frame").distinct()
    copies = first.join(frames, "recording").withColumns({"y": y, "x": x}).unionByName(corner.join(frames, "recording"))
    out = mv.rigid_motion(copies, first.unionByName(corner), rotate=False)
    return out.select("frame", (F.round("dy", 1) + 0.0).alias("dy"), (F.round("dx", 1) + 0.0).alias("dx"))


@query(f"""WITH {MOVIE}, s AS (SELECT frame, y, x, (SELECT 1) FROM m) SELECT m.frame, m.y, m.x, cast(floor(round(0.5 * coalesce(a.v, 0) + 0.5 * coalesce(b.v, 0), 6)) AS INTEGER) AS v
 FROM m LEFT JOIN m a ON a.frame = m.frame AND a.y = m.y + 1 AND a.x = m.x LEFT JOIN m b ON b.frame = m.frame AND b.y = m.y + 1 AND b.x = m.x + 1""")
def warped_frames(spark, d):
    m = movie(spark, d)
    t = m.select("recording", "frame").distinct().withColumn("m", F.array(*[F.lit(float(v)) for v in (1, 0, 0.5, 0, 1, 1, 0, 0, 1)]))
    return mv.warped(m, t).select("frame", "y", "x", "v")


@query(f"""WITH RECURSIVE {REGIONS}, b AS (SELECT y, x FROM l), k AS (SELECT unnest([-1, 0, 1]) AS dy), kk AS (SELECT dy, unnest([-1, 0, 1]) AS dx FROM k),
 e AS MATERIALIZED (SELECT a.y, a.x, a.y * 1000 + a.x AS i, c.y * 1000 + c.x AS j FROM b a, kk JOIN b c ON c.y = a.y + dy AND c.x = a.x + dx),
 r AS (SELECT y * 1000 + x AS i, y * 1000 + x AS j FROM b UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i), m2 AS (SELECT i, min(j) AS root FROM r GROUP BY i)
 SELECT cast(i // 1000 AS INTEGER) AS y, cast(i % 1000 AS INTEGER) AS x, cast(dense_rank() OVER (ORDER BY root) AS INTEGER) AS label FROM m2""")
def connected_components(spark, d):
    return lb.merged_touching(regions(spark, d), settle=settle).select("y", "x", "label")


@query(f"""WITH {TRACES}, x AS (SELECT cell % 10 AS roi, cell AS pixel, frame, f FROM t), n AS (SELECT roi, count(DISTINCT pixel) AS pixels, max(frame) + 1 AS n FROM x GROUP BY roi),
 w AS (SELECT x.roi, pixel, frame, f, pixels, unnest(generate_series(greatest(frame - 5, 6), least(frame + 6, n - 7))) AS j FROM x JOIN n ON x.roi = n.roi), c AS (SELECT roi, j, pixel, count(*) AS c FROM w GROUP BY ALL),
 p AS (SELECT a.roi, a.j, any_value(a.pixels) AS pixels, CASE WHEN stddev_pop(a.f) > 0 AND stddev_pop(b.f) > 0 THEN corr(a.f, b.f) END AS r FROM w a JOIN w b ON a.roi = b.roi AND a.j = b.j AND a.frame = b.frame GROUP BY a.roi, a.j, a.pixel, b.pixel),
 g AS (SELECT roi, j, avg(r) AS r, count(r) AS n, any_value(pixels) AS pixels FROM p GROUP BY ALL), k AS (SELECT roi, j, min(c) AS c, count(*) AS there FROM c GROUP BY ALL)
 SELECT g.roi, cast(g.j AS INTEGER) AS frame, CASE WHEN k.c = 12 AND k.there = pixels AND g.n = pixels * pixels THEN {q6('g.r')} END AS r FROM g JOIN k ON g.roi = k.roi AND g.j = k.j""")
def pixel_rolling_corr(spark, d):
    m = traces(spark, d).select((F.col("cell") % 10).alias("roi"), F.col("cell").alias("pixel"), "frame", F.col("f").alias("v"))
    return co.pixel_rolling(m, 6).select("roi", "frame", r6("r").alias("r"))


@query(f"""WITH {MOVIE}, {_GRID.format(n=4)}, bt AS (SELECT roi AS cell, frame, avg(m.v) AS mean, stddev_pop(m.v) AS sd FROM m JOIN b ON y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY ALL), {SAVGOL.format(src='bt', v='mean', w=3, h=1)},
 wt AS (SELECT cell, frame, y, 1.0 - 0.5 * frame / (count(*) OVER (PARTITION BY cell) - 1) AS w FROM sm), mn AS (SELECT cell, sum(w * y) / sum(w) AS m FROM wt GROUP BY cell), sc AS (SELECT wt.cell, sqrt(sum(w * (y - m) * (y - m)) / sum(w)) AS score FROM wt JOIN mn ON wt.cell = mn.cell GROUP BY wt.cell),
 best AS (SELECT arg_max(cell, (round(score, 9), -cell)) AS cell FROM sc), bs AS (SELECT cell, frame, sd FROM bt), {SAVGOL.format(src='bs', v='sd', w=3, h=1).replace('s AS (', 's2 AS (', 1).replace('FROM s ', 'FROM s2 s ').replace('ea AS', 'ea2 AS').replace('eb AS', 'eb2 AS').replace('JOIN ea ON', 'JOIN ea2 ea ON').replace('JOIN eb ON', 'JOIN eb2 eb ON').replace('sm AS', 'sn AS')}
 SELECT 1 AS recording, sm.frame + 1 AS slice, sm.frame, {q6('sm.y')} AS mean, {q6('sn.y')} AS sd FROM sm JOIN best ON sm.cell = best.cell JOIN sn ON sn.cell = sm.cell AND sn.frame = sm.frame""")
def reference_plan(spark, d):
    from .reference import reference_traces

    return reference_traces(movie(spark, d), grid=4, smooth=3)["trace"].select("recording", "slice", "frame", r6("mean").alias("mean"), r6("sd").alias("sd"))
