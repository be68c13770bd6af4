"""The study end to end as queries: recordings, traces, regions and their types in; cells with peaks, events and cell tables out.

Recordings are the users' last digits, regions the rest of their numbers. One recording is marked to be left out, and one
has a trace more than regions. Every tenth frame is held in all traces. Scores have flat tops where a smoothing window
loses and takes a zero; the SQL takes scores within 1e-12 for equal, since it sums windows in another order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import TRACES, q6, query, r6, traces
from .study import build_cells, study_tables
from .trace_queries import MAD, SAVGOL

_LEFT_OUT, _ODD = 3, 7

_FILLED = f"""{TRACES}, src AS (SELECT cell % 10 AS recording, cell // 10 + 1 AS roi, (cell % 10) || '_' || (cell // 10 + 1) AS cell, cell AS user, frame, CASE WHEN frame % 10 = 9 THEN lag(f) OVER (PARTITION BY t.cell ORDER BY frame) ELSE f END AS f FROM t WHERE t.cell % 10 NOT IN ({_LEFT_OUT}, {_ODD})),
 one AS (SELECT recording, min(cell) AS cell FROM src GROUP BY recording), dz AS (SELECT src.recording, frame, lead(f) OVER w - f AS dz FROM src JOIN one ON src.cell = one.cell WINDOW w AS (PARTITION BY src.recording ORDER BY frame)),
 gd AS (SELECT recording, frame AS lo, lead(frame) OVER w AS hi, lead(frame, 5) OVER w AS far FROM dz WHERE dz <> 0 WINDOW w AS (PARTITION BY recording ORDER BY frame)),
 gap AS (SELECT g.lo, g.hi, c.cell, c.f AS y0, y.f AS y1 FROM gd g JOIN src c ON c.recording = g.recording AND c.frame = g.lo LEFT JOIN src y ON y.cell = c.cell AND y.frame = g.hi WHERE g.hi - g.lo > 1 AND g.far IS NOT NULL),
 fi AS (SELECT src.recording, roi, src.cell, user, frame, coalesce(y0 + (y1 - y0) * (frame - lo + 1) / (hi - lo + 1), f) AS f FROM src LEFT JOIN gap ON gap.cell = src.cell AND frame >= lo AND frame < hi),
 fh AS (SELECT cell, quantile_cont(f, 0.3) AS f0 FROM (SELECT *, count(*) OVER (PARTITION BY cell) AS n FROM fi) WHERE frame < n // 2 GROUP BY cell), d AS MATERIALIZED (SELECT fi.*, (fi.f - f0) / f0 AS dff0 FROM fi JOIN fh USING (cell))"""

_FOUND = f"""{_FILLED}, h AS (SELECT cell, frame, dff0 - quantile_cont(dff0, 0.5) OVER (PARTITION BY cell ORDER BY frame ROWS 19 PRECEDING) AS f FROM d), {MAD},
 z AS (SELECT x.cell, frame, CASE WHEN safe THEN (f - med) / (CASE WHEN mad < 1e-10 THEN sd + 1e-10 ELSE mad END) ELSE 0.0 END AS z FROM x JOIN a ON x.cell = a.cell), {SAVGOL.format(src='z', v='z', w=11, h=5)},
 y AS MATERIALIZED (SELECT cell, frame, round(y, 12) AS y FROM sm), ry AS (SELECT *, sum(new) OVER (PARTITION BY cell ORDER BY frame) AS run FROM (SELECT *, CASE WHEN y = lag(y) OVER (PARTITION BY cell ORDER BY frame) THEN 0 ELSE 1 END AS new FROM y)),
 top AS (SELECT *, lag(y) OVER w AS before, lead(y) OVER w AS next FROM (SELECT cell, run, any_value(y) AS y, cast((min(frame) + max(frame)) // 2 AS INTEGER) AS peak FROM ry GROUP BY ALL) WINDOW w AS (PARTITION BY cell ORDER BY run)),
 cand AS (SELECT cell, peak, y FROM top WHERE y > before AND y > next AND y >= 0),
 fold AS (SELECT cell, list_reduce(list_transform(list(peak ORDER BY y DESC, peak DESC), lambda p: [p]), lambda kept, p: CASE WHEN list_min(list_transform(kept, lambda k: abs(k - p[1]))) < 8 THEN kept ELSE list_concat(kept, p) END) AS kept FROM cand GROUP BY cell),
 sp AS (SELECT cell, unnest(kept) AS peak FROM fold), lim AS (SELECT sp.cell, peak, p.y, coalesce(max(q.frame) FILTER (WHERE q.frame < peak AND q.y > p.y), -1) AS lo, coalesce(min(q.frame) FILTER (WHERE q.frame > peak AND q.y > p.y), 1000000) AS hi
  FROM sp JOIN y p ON p.cell = sp.cell AND p.frame = peak JOIN y q ON q.cell = sp.cell GROUP BY ALL),
 pks AS MATERIALIZED (SELECT lim.cell, peak FROM lim JOIN y q ON q.cell = lim.cell AND q.frame > lo AND q.frame < hi GROUP BY lim.cell, peak HAVING any_value(lim.y) - greatest(min(q.y) FILTER (WHERE q.frame <= peak), min(q.y) FILTER (WHERE q.frame >= peak)) >= 1)"""

#: Cells of type 1 only, in order of their regions.
_TYPED = f"""{_FOUND}, cl AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY roi) - 1 AS seq FROM (SELECT DISTINCT recording, roi, cell, user FROM src WHERE user % 3 <> 0)),
 pk AS MATERIALIZED (SELECT cl.recording, cl.cell, seq, peak FROM pks JOIN cl USING (cell)), lf AS (SELECT recording, list_sort(list(DISTINCT peak)) AS l FROM pk GROUP BY recording),
 ld AS (SELECT recording, unnest(list_reduce(list_transform(l, lambda p: [p]), lambda got, p: CASE WHEN p[1] - got[len(got)] > 4 THEN list_concat(got, p) ELSE got END)) AS leader FROM lf),
 rs AS (SELECT pk.recording, leader, pk.cell, seq, min(peak) AS peak FROM pk JOIN ld ON ld.recording = pk.recording AND peak >= leader AND peak < leader + 4 GROUP BY ALL)"""


def _cells(spark, d) -> dict[str, DataFrame]:
    held = F.when(F.col("frame") % 10 == 9, F.lag("f").over(W.partitionBy("cell").orderBy("frame"))).otherwise(F.col("f"))
    df = traces(spark, d).select((F.col("cell") % 10).alias("recording"), (F.expr("cell div 10") + 1).alias("roi"), "frame", held.alias("f"), F.col("cell").alias("user"))
    regions = df.select("recording", "roi", "user").distinct()
    recordings = df.select("recording").distinct().select("recording", F.when(F.col("recording") == _LEFT_OUT, 1).alias("discard"), F.lit(8.0).alias("age"))
    pixels = regions.withColumn("x", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("y", 3 * F.col("roi"))
    # One region of recording 7 has no pixels.
    missing = regions.where(F.col("recording") == _ODD).groupBy("recording").agg(F.min("roi").alias("roi"))
    labels = pixels.join(missing, ["recording", "roi"], "left_anti").select("recording", "y", "x", F.col("roi").alias("label"))
    kinds = pixels.select("recording", "y", "x", F.when(F.col("user") % 3 == 0, 2).otherwise(1).alias("label"))
    return build_cells(recordings, df.drop("user"), labels, kinds, median_window=20, smooth=11, prominence=1, distance=8)


def _tables(spark, d) -> dict[str, DataFrame]:
    made = _cells(spark, d)
    return study_tables(made["cells"], made["traces"], fps=2.0, window=20, median_window=20, smooth=11)


@query(f"""WITH {_FOUND} SELECT recording, roi, cell, n_frames, cell_type, cy, cx, coalesce(peaks, '') AS peaks FROM (SELECT recording, roi, cell, count(*) AS n_frames, CASE WHEN any_value(user) % 3 = 0 THEN 2.0 ELSE 1.0 END AS cell_type, 3.0 * roi AS cy, 1.0 AS cx FROM src GROUP BY recording, roi, cell)
 LEFT JOIN (SELECT cell, array_to_string(list(cast(peak AS VARCHAR) ORDER BY peak), ',') AS peaks FROM pks GROUP BY cell) USING (cell)""")
def study_cells(spark, d):
    """Cells with their types, places and peaks: held frames filled, dF/F0, detrended z-scores, prominence and distance."""
    peaks = F.array_join(F.transform("peaks", lambda p: p.cast("string")), ",").alias("peaks")
    return _cells(spark, d)["cells"].select("recording", "roi", "cell", "n_frames", F.col("cell_type").cast("double").alias("cell_type"), r6("cy").alias("cy"), r6("cx").alias("cx"), peaks)


@query(f"""WITH {_TYPED}, am AS (SELECT rs.recording, leader, rs.cell, rs.peak, CASE WHEN rs.peak >= 10 THEN avg(d.dff0) END AS amplitude FROM rs JOIN d ON d.cell = rs.cell AND d.frame >= rs.peak - 10 AND d.frame < rs.peak + 10 GROUP BY rs.recording, leader, rs.cell, rs.peak),
 nc AS (SELECT recording, count(*) AS total_cells FROM cl GROUP BY recording), f AS (SELECT recording, leader, arg_min(seq, (peak, seq)) AS first_seq FROM rs GROUP BY ALL)
 SELECT recording, leader, n_responding, first_seq, total_cells, max_amplitude FROM (SELECT recording, leader, count(*) AS n_responding, {q6('max(amplitude)')} AS max_amplitude FROM am GROUP BY ALL) JOIN nc USING (recording) JOIN f USING (recording, leader)""")
def study_events(spark, d):
    """Events of the study's cells of one type, with the amplitudes of those that respond."""
    return _tables(spark, d)["whole_events"].select("recording", "leader", "n_responding", "first_seq", "total_cells", r6("max_amplitude").alias("max_amplitude"))


@query(f"""WITH {_TYPED}, sz AS (SELECT *, sum(CASE WHEN seq - before > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY recording, leader ORDER BY seq) AS part FROM (SELECT *, lag(seq) OVER (PARTITION BY recording, leader ORDER BY seq) AS before FROM rs)),
 ct AS (SELECT cell, count(*) FILTER (WHERE size = 1) AS single, count(*) FILTER (WHERE size >= 3) AS multiple FROM (SELECT *, count(*) OVER (PARTITION BY recording, leader, part) AS size FROM sz) GROUP BY cell),
 mx AS (SELECT pk.cell, count(*) AS n_peaks, {q6('max(dff0)')} AS max_amplitude FROM pk JOIN d ON d.cell = pk.cell AND d.frame = pk.peak GROUP BY pk.cell)
 SELECT cl.recording, cl.cell, coalesce(single, 0) AS single, coalesce(multiple, 0) AS multiple, n_peaks - coalesce(single, 0) - coalesce(multiple, 0) AS orphan, max_amplitude FROM cl JOIN mx USING (cell) LEFT JOIN ct USING (cell)""")
def study_participation(spark, d):
    """The study's cells that have peaks: events of their own and of several cells, other peaks, and the largest amplitude."""
    cells = _tables(spark, d)["cells"].where("max_amplitude IS NOT NULL")
    return cells.select("recording", "cell", "single", "multiple", "orphan", r6("max_amplitude").alias("max_amplitude"))
