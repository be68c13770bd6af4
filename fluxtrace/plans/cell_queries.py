"""Queries of events, rollups, correlation, joins and scalar expressions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import correlation as co
from ..operators import events as ev
from ..operators import peaks as pk
from ..operators import rollups as ro
from .registry import TRACES, VECTORS, q6, query, r6, r6_plain, table, traces, vectors
from .trace_queries import _PEAKS, event_peaks

# Events: peaks of a tenth of the users are a recording; a user's place among them is its sequence number.

THRESHOLD = 3


def recorded_peaks(spark, d):
    """recording, cell, seq, peak."""
    df = event_peaks(traces(spark, d)).withColumn("recording", F.col("cell") % 10).withColumn("seq", F.expr("cell div 10"))
    return df.select("recording", "cell", "seq", "peak")


_EV = f"{TRACES}, {_PEAKS}, e AS (SELECT cell % 10 AS recording, cell, cell // 10 AS seq, peak FROM p)"
_LEAD = f"""{_EV}, ll AS (SELECT recording, list_sort(list(DISTINCT peak)) AS l FROM e GROUP BY recording),
 lf AS (SELECT recording, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[len(a)] > {THRESHOLD} THEN list_concat(a, x) ELSE a END) AS l FROM ll),
 ld AS (SELECT recording, unnest(l) AS leader FROM lf),
 rs AS (SELECT e.recording, leader, cell, seq, min(peak) AS peak FROM e JOIN ld ON e.recording = ld.recording AND peak >= leader AND peak < leader + {THRESHOLD} GROUP BY ALL)"""
_SPLIT = f"""{_LEAD}, sx AS (SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY recording, leader ORDER BY seq) > 4 THEN 1 ELSE 0 END AS far FROM rs),
 sp AS (SELECT *, sum(far) OVER (PARTITION BY recording, leader ORDER BY seq) AS part FROM sx)"""
_CLASS = f"""{_SPLIT}, st AS (SELECT *, seq - lag(seq) OVER (PARTITION BY recording, leader, part ORDER BY seq) AS step FROM sp),
 cl AS (SELECT recording, leader, part, count(*) AS n_cells, CASE WHEN count(*) = 1 THEN 'Single' ELSE 'Multiple' END AS event_type,
 count(*) >= 3 AND coalesce(bool_or(abs(step) <> 1 AND abs(step) <= 4), false) AS skipping FROM st GROUP BY ALL)"""


def _responses(spark, d):
    p = recorded_peaks(spark, d)
    return ev.responses(p, ev.leaders(p, THRESHOLD), THRESHOLD, 2.0)


@query(f"WITH {_LEAD} SELECT * FROM ld")
def event_leaders(spark, d):
    return ev.leaders(recorded_peaks(spark, d), THRESHOLD)


@query(f"""WITH {_LEAD}, o AS (SELECT *, (peak - leader) / 2.0::DOUBLE AS offset_s FROM rs), f AS (SELECT recording, leader, count(*) AS n_responding, arg_min(seq, (offset_s, seq)) AS first_seq FROM o GROUP BY ALL),
 n AS (SELECT recording, count(DISTINCT cell) AS total_cells FROM (SELECT DISTINCT cell, cell % 10 AS recording FROM t) GROUP BY recording)
 SELECT o.recording, o.leader, cell, seq, peak, offset_s, n_responding, first_seq, abs(seq - first_seq) AS distance, total_cells, {q6('100.0 * n_responding / total_cells')} AS percent
 FROM o JOIN f ON o.recording = f.recording AND o.leader = f.leader JOIN n ON o.recording = n.recording""")
def event_responses(spark, d):
    cells = traces(spark, d).select("cell", (F.col("cell") % 10).alias("recording")).distinct()
    found = _responses(spark, d)
    rows = ev.events(found, cells)
    each = rows.select("recording", "leader", "n_responding", "first_seq", "total_cells", "percent_responding", F.explode(F.arrays_zip("cells", "distances")).alias("_e"))
    each = each.select("recording", "leader", F.col("_e.cells").alias("cell"), "n_responding", "first_seq", F.col("_e.distances").alias("distance"), "total_cells", r6("percent_responding").alias("percent"))
    return found.join(each, ["recording", "leader", "cell"]).select("recording", "leader", "cell", "seq", "peak", "offset_s", "n_responding", "first_seq", "distance", "total_cells", "percent")


@query(f"""WITH {_LEAD}, o AS (SELECT *, (peak - leader) / 2.0::DOUBLE AS offset_s FROM rs),
 a AS (SELECT o.recording, o.leader, o.cell, o.seq, o.peak, CASE WHEN any_value(o.peak) >= 3 THEN avg(t.f) END AS amplitude FROM o JOIN t ON t.cell = o.cell AND t.frame >= o.peak - 3 AND t.frame < o.peak + 3 GROUP BY o.recording, o.leader, o.cell, o.seq, o.peak),
 n AS (SELECT recording, count(DISTINCT cell) AS total_cells FROM (SELECT DISTINCT cell, cell % 10 AS recording FROM t) GROUP BY recording)
 SELECT a.recording, leader, {q6('max(amplitude)')} AS max_amplitude, {q6('avg(amplitude)')} AS mean_amplitude, {q6('count(*) / any_value(total_cells)')} AS share,
 array_to_string(list(cast(cast(coalesce(round(amplitude * 97.3), -1) AS BIGINT) AS VARCHAR) ORDER BY seq), ',') AS amplitudes FROM a JOIN n ON a.recording = n.recording GROUP BY a.recording, leader""")
def event_amplitudes(spark, d):
    df, found = traces(spark, d), _responses(spark, d)
    cells = df.select("cell", (F.col("cell") % 10).alias("recording")).distinct()
    rows = ev.events(found, cells, amplitudes=pk.mean_around(found, df, 3))
    text = F.array_join(F.transform("amplitudes", lambda a: F.coalesce(F.round(a * 97.3), F.lit(-1)).cast("long").cast("string")), ",")
    return rows.select("recording", "leader", r6("max_amplitude").alias("max_amplitude"), r6("mean_amplitude").alias("mean_amplitude"), r6("share_responding").alias("share"), text.alias("amplitudes"))


@query(f"WITH {_SPLIT} SELECT recording, leader, cell, seq, cast(part AS BIGINT) AS part FROM sp")
def event_split(spark, d):
    return ev.split(_responses(spark, d)).select("recording", "leader", "cell", "seq", "part")


@query(f"WITH {_CLASS} SELECT recording, leader, cast(part AS BIGINT) AS part, n_cells, event_type, skipping FROM cl")
def event_types(spark, d):
    return ev.classified(ev.split(_responses(spark, d)))


@query(f"WITH {_CLASS} SELECT recording, count(*) AS n_events, {q6('avg(CASE WHEN skipping THEN 1.0 ELSE 0.0 END)')} AS share FROM cl GROUP BY recording HAVING count(*) > 3")
def skipping_fraction(spark, d):
    out = ev.skipping_share(ev.classified(ev.split(_responses(spark, d))), more_than=3)
    return out.select("recording", "n_events", r6("share").alias("share"))


@query(f"""WITH {_SPLIT}, n AS (SELECT *, count(*) OVER (PARTITION BY recording, leader, part) AS n FROM sp), c AS (SELECT cell, count(*) FILTER (WHERE n = 1) AS single, count(*) FILTER (WHERE n >= 3) AS multiple FROM n GROUP BY cell)
 SELECT recording, e.cell, count(*) AS n_peaks, coalesce(any_value(single), 0) AS single, coalesce(any_value(multiple), 0) AS multiple, count(*) - coalesce(any_value(single), 0) - coalesce(any_value(multiple), 0) AS orphan
 FROM e LEFT JOIN c ON e.cell = c.cell GROUP BY ALL""")
def single_multiple_orphan(spark, d):
    return ev.participation(recorded_peaks(spark, d), ev.split(_responses(spark, d)))


# Rollups: events of a user are a cell's peaks; orders -> customer -> nation -> region are recording -> cell -> animal -> strain.


@query(f"""WITH {TRACES}, {_PEAKS}, c AS (SELECT cell, cell % 10 AS recording, count(*) AS n_frames FROM t GROUP BY ALL), i AS (SELECT *, (peak - lag(peak) OVER (PARTITION BY cell ORDER BY peak)) / 2.0::DOUBLE AS isi FROM p WHERE f > 100),
 s AS (SELECT cell, count(*) AS n, avg(isi) AS m, stddev_pop(isi) / avg(isi) AS cv FROM i GROUP BY cell)
 SELECT c.cell, coalesce(n, 0) AS n_events, n_frames / 2.0::DOUBLE AS duration_s, {q6('60.0 * coalesce(n, 0) / (n_frames / 2.0)')} AS frequency, {q6('m')} AS mean_isi, {q6('cv')} AS cv, count(*) OVER (PARTITION BY recording) AS cells_in_recording FROM c LEFT JOIN s ON c.cell = s.cell""")
def cell_frequency(spark, d):
    df = traces(spark, d)
    cells = df.groupBy("cell", (F.col("cell") % 10).alias("recording")).agg(F.count("*").alias("n_frames"))
    out = ro.cell_peaks(cells, event_peaks(df).where("f > 100"), fps=2.0)
    return out.select("cell", "n_events", "duration_s", r6("frequency").alias("frequency"), r6("mean_isi").alias("mean_isi"), r6("cv").alias("cv"), "cells_in_recording")


@query(f"""WITH {TRACES}, {_PEAKS}, n AS (SELECT cell, stddev_pop(f) AS s FROM t WHERE frame < 20 GROUP BY cell), g AS (SELECT p.cell, coalesce(f / nullif(s, 0) >= 2 AND peak % 5 / 5.0 >= 0.2, false) AS good FROM p LEFT JOIN n ON p.cell = n.cell)
 SELECT cell, count(*) FILTER (WHERE good) AS kept, {q6('100.0 * avg(CASE WHEN good THEN 1.0 ELSE 0.0 END)')} AS percent_kept FROM g GROUP BY cell""")
def peak_quality(spark, d):
    df = traces(spark, d)
    noise = df.where("frame < 20").groupBy("cell").agg(F.stddev_pop("f").alias("noise_sd"))
    peaks = event_peaks(df).withColumn("amplitude", F.col("f")).withColumn("half_width_s", (F.col("peak") % 5) / 5.0)
    return ro.kept_peaks(ro.quality(peaks, noise, rule="snr_width")).select("cell", "kept", r6("percent_kept").alias("percent_kept"))


@query(f"WITH {TRACES}, l AS (SELECT cell, list(frame ORDER BY frame) AS pos, list(f ORDER BY frame) AS amp FROM t WHERE f > 100 GROUP BY cell) SELECT cell, cast(unnest(generate_series(0, len(pos) - 1)) AS INTEGER) AS i, unnest(pos) AS pos, unnest(amp) AS amp FROM l")
def master_peak_explode(spark, d):
    lists = traces(spark, d).where("f > 100").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("frame", "f"))).alias("_l"))
    cells = lists.select("cell", F.col("_l.frame").alias("pos"), F.col("_l.f").alias("amp"))
    return ro.peak_table(cells, ["pos", "amp"], keep=["cell"])


_CELLS = """c AS (SELECT o_orderkey AS ord, CASE WHEN o_custkey % 50 <> 0 THEN o_custkey END AS unique_cell, o_totalprice AS duration_s, cast(o_orderkey % 7 AS BIGINT) AS n_events, cast(o_orderkey % 5 AS BIGINT) AS kept, cast(o_orderkey % 3 AS BIGINT) AS single,
 cast(o_orderkey % 2 AS BIGINT) AS multiple, cast(0 AS BIGINT) AS orphan, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS percent_active, n_nationkey AS age,
 CASE WHEN n_nationkey >= 12 THEN 'Posthearing' WHEN n_nationkey >= 7 THEN 'Second week' ELSE 'First week' END AS age_group, n_name AS mouse, r_name AS strain, o_orderpriority[1] AS folder
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def order_cells(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    df = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    key = F.col("o_orderkey")
    return df.select(
        key.alias("ord"), F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("unique_cell"), F.col("o_totalprice").alias("duration_s"), (key % 7).alias("n_events"), (key % 5).alias("kept"),
        (key % 3).alias("single"), (key % 2).alias("multiple"), F.lit(0).cast("long").alias("orphan"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("percent_active"),
        F.col("n_nationkey").alias("age"), sc.age_group("n_nationkey").alias("age_group"), F.col("n_name").alias("mouse"), F.col("r_name").alias("strain"), F.substring("o_orderpriority", 1, 1).alias("folder"),
    )


_FIRST = "arg_min({0}, ord) FILTER (WHERE {0} IS NOT NULL) AS {0}"
_UNIQUE = f"""u AS (SELECT unique_cell, cast(sum(n_events) AS BIGINT) AS n_events, cast(sum(kept) AS BIGINT) AS kept, cast(sum(single) AS BIGINT) AS single, cast(sum(multiple) AS BIGINT) AS multiple, sum(duration_s) AS duration_s, avg(percent_active) AS percent_active,
 {', '.join(_FIRST.format(x) for x in ('age', 'age_group', 'mouse', 'strain'))}, string_agg(folder, '' ORDER BY ord) AS folder FROM c WHERE unique_cell IS NOT NULL GROUP BY unique_cell)"""


@query(f"""WITH {_CELLS}, {_UNIQUE} SELECT unique_cell, n_events, kept, {q6('duration_s')} AS duration_s, {q6('percent_active')} AS percent_active, age, age_group, mouse, strain, folder,
 {q6('60.0 * n_events / duration_s')} AS n_events_per_min, {q6('60.0 * kept / duration_s')} AS kept_per_min, {q6('100.0 * single / nullif(kept, 0)')} AS percent_single FROM u""")
def unique_cell_rollup(spark, d):
    out = ro.matched_cells(order_cells(spark, d), order="ord")
    return out.select("unique_cell", "n_events", "kept", *[r6(c).alias(c) for c in ("duration_s", "percent_active")], "age", "age_group", "mouse", "strain", "folder", *[r6(c).alias(c) for c in ("n_events_per_min", "kept_per_min", "percent_single")])


@query(f"""WITH {_CELLS}, {_UNIQUE} SELECT mouse, {q6('avg(60.0 * n_events / duration_s)')} AS n_events_per_min, {q6('avg(n_events)')} AS n_events, {q6('avg(duration_s)')} AS duration_s,
 arg_min(age, unique_cell) AS age, arg_min(age_group, unique_cell) AS age_group, arg_min(strain, unique_cell) AS strain FROM u WHERE duration_s > 300000 GROUP BY mouse""")
def mouse_rollup(spark, d):
    out = ro.animals(ro.matched_cells(order_cells(spark, d), order="ord"), order="unique_cell", least_s=300000)
    return out.select("mouse", *[r6(c).alias(c) for c in ("n_events_per_min", "n_events", "duration_s")], "age", "age_group", "strain")


@query(f'WITH n AS (SELECT event_type AS "group", user_id % 4 AS level, count(*) AS n FROM events GROUP BY ALL) SELECT *, {q6("100.0 * n / sum(n) OVER (PARTITION BY \"group\")")} AS percent FROM n')
def group_shares(spark, d):
    df = table(spark, d, "events").select(F.col("event_type").alias("group"), (F.col("user_id") % 4).alias("level"))
    return ro.shares(df, "group", "level").withColumn("percent", r6("percent"))


@query(f"SELECT event_type AS \"group\", count(*) AS n, {q6('avg(value)')} AS mean, {q6('stddev_samp(value)')} AS sd FROM events GROUP BY 1")
def group_mean_sd(spark, d):
    df = table(spark, d, "events").withColumnRenamed("event_type", "group")
    return ro.mean_sd(df, "group", "value").select("group", "n", r6("mean").alias("mean"), r6("sd").alias("sd"))


@query(f"SELECT event_type AS \"group\", count(*) AS n, {q6('avg(value)')} AS mean, {q6('stddev_samp(value)')} AS sd, min(value) AS low, {q6('quantile_cont(value, 0.25)')} AS q25, {q6('median(value)')} AS q50, {q6('quantile_cont(value, 0.75)')} AS q75, max(value) AS high FROM events GROUP BY 1")
def group_describe(spark, d):
    out = ro.described(table(spark, d, "events").withColumnRenamed("event_type", "group"), "group", "value")
    return out.select("group", "n", "low", "high", *[r6(c).alias(c) for c in ("mean", "sd", "q25", "q50", "q75")])


@query(f"""WITH b AS (SELECT event_type AS "group", CASE WHEN value < 0 THEN 0 WHEN value >= 300 THEN 13 ELSE cast(floor(value / 25) AS BIGINT) + 1 END AS bin FROM events),
 n AS (SELECT "group", bin, count(*) AS n FROM b GROUP BY ALL) SELECT *, {q6('n / sum(n) OVER (PARTITION BY "group")')} AS share FROM n""")
def amplitude_histogram(spark, d):
    df = table(spark, d, "events").withColumnRenamed("event_type", "group")
    return ro.histogram(df, "value", 0.0, 300.0, 12, "group").withColumn("share", r6("share"))


@query(f'WITH n AS (SELECT event_type AS "group", value, count(*) AS n FROM events GROUP BY ALL) SELECT "group", value, {q6("sum(n) OVER (PARTITION BY \"group\" ORDER BY value) / sum(n) OVER (PARTITION BY \"group\")")} AS share FROM n')
def amplitude_ecdf(spark, d):
    df = table(spark, d, "events").withColumnRenamed("event_type", "group")
    return ro.ecdf(df, "value", "group").withColumn("share", r6("share"))


@query(f"WITH {TRACES} SELECT kind, {q6('regr_slope(f, frame)')} AS slope, {q6('regr_intercept(f, frame)')} AS intercept, {q6('regr_r2(f, frame)')} AS r2 FROM t GROUP BY kind")
def regression_lines(spark, d):
    return ro.lines(traces(spark, d), "kind", "frame", "f").select("kind", *[r6(c).alias(c) for c in ("slope", "intercept", "r2")])


@query(f"""WITH s AS (SELECT event_type AS "group", stddev_samp(value) * pow(count(*), -0.2) AS h FROM events GROUP BY 1), x AS (SELECT unnest([0.0::DOUBLE, 25, 50, 100, 200]) AS x)
 SELECT "group", x, {q6('avg(exp(-0.5 * pow((x - value) / h, 2)) / (h * sqrt(2 * pi()))) * 1000')} AS density FROM events JOIN s ON event_type = "group", x GROUP BY ALL""")
def amplitude_density(spark, d):
    df = table(spark, d, "events").withColumnRenamed("event_type", "group")
    return ro.density(df, "value", [0.0, 25.0, 50.0, 100.0, 200.0], "group").withColumn("density", r6(F.col("density") * 1000))


# Correlation: vectors with a label are the traces of a recording.

_PAIRS = f"{VECTORS}, pr AS (SELECT x.recording, x.cell AS a, y.cell AS b, count(*) AS n, corr(x.f, y.f) AS r FROM v x JOIN v y ON x.recording = y.recording AND x.frame = y.frame AND x.cell > y.cell GROUP BY ALL)"


def _pairs(spark, d):
    return co.pairs(vectors(spark, d))


@query(f"WITH {_PAIRS} SELECT recording, a, b, n, {q6('r')} AS r FROM pr")
def pair_correlation(spark, d):
    return _pairs(spark, d).withColumn("r", r6_plain("r"))


@query(f"""WITH {VECTORS}, k AS (SELECT * FROM v WHERE frame >= cell % 50), x AS (SELECT x.recording, x.cell AS a, y.cell AS b, count(*) AS n, corr(x.f, y.f) AS r FROM k x JOIN k y ON x.recording = y.recording AND x.frame = y.frame AND x.cell > y.cell GROUP BY ALL)
 SELECT recording, a, b, n, CASE WHEN n >= 30 THEN {q6('r')} END AS r FROM x""")
def pair_correlation_minperiods(spark, d):
    df = vectors(spark, d).where(F.col("frame") >= F.col("cell") % 50)
    return co.pairs(co.large_recordings(df), least=30).withColumn("r", r6_plain("r"))


@query(f"""WITH {VECTORS}, q AS (SELECT recording, cell, frame, floor(f * 10000) AS f FROM v), z AS (SELECT *, f = lead(f) OVER (PARTITION BY cell ORDER BY frame) AS flat FROM q),
 k AS (SELECT * FROM z WHERE (recording, frame) NOT IN (SELECT (recording, frame) FROM z WHERE flat)), x AS (SELECT x.recording, x.cell AS a, y.cell AS b, count(*) AS n, CASE WHEN stddev_pop(x.f) > 0 AND stddev_pop(y.f) > 0 THEN corr(x.f, y.f) END AS r FROM k x JOIN k y ON x.recording = y.recording AND x.frame = y.frame AND x.cell > y.cell GROUP BY ALL)
 SELECT recording, a, b, n, {q6('r')} AS r FROM x""")
def pair_correlation_moving(spark, d):
    df = vectors(spark, d).withColumn("f", F.floor(F.col("f") * 10000).cast("double"))
    return co.pairs(co.without_held(df)).withColumn("r", r6_plain(F.when(~F.isnan("r"), F.col("r"))))


@query(f"""WITH {VECTORS}, k AS (SELECT recording, cell, frame, f - quantile_cont(f, 0.5) OVER (PARTITION BY cell ORDER BY frame ROWS 9 PRECEDING) AS f FROM v), z AS (SELECT *, f = lead(f) OVER (PARTITION BY cell ORDER BY frame) AS flat FROM k),
 y AS (SELECT * FROM z WHERE (recording, frame) NOT IN (SELECT (recording, frame) FROM z WHERE flat)), x AS (SELECT x.recording, x.cell AS a, y.cell AS b, count(*) AS n, corr(x.f, y.f) AS r FROM y x JOIN y ON x.recording = y.recording AND x.frame = y.frame AND x.cell > y.cell GROUP BY ALL)
 SELECT recording, a, b, n, CASE WHEN n >= 5 THEN {q6('r')} END AS r FROM x""")
def pair_correlation_detrended(spark, d):
    return co.correlations(vectors(spark, d), least=5, preprocessing="rolling_median", median_window=10).withColumn("r", r6_plain("r"))


@query(f"""WITH {VECTORS}, g AS (SELECT *, avg(f) OVER (PARTITION BY recording, frame) AS g FROM v), s AS (SELECT cell, regr_slope(f, g) AS s, regr_intercept(f, g) AS c FROM g GROUP BY cell)
 SELECT g.cell, frame, {q6('f - s * g - c')} AS residual FROM g JOIN s ON g.cell = s.cell""")
def global_mean_residual(spark, d):
    return co.less_global_mean(vectors(spark, d)).select("cell", "frame", r6("residual").alias("residual"))


_AT = "spot AS (SELECT vec_id AS cell, label AS recording, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq, embedding[1] * 1000.0::DOUBLE AS x, embedding[2] * 1000.0::DOUBLE AS y FROM embeddings)"
_DIST = f"{_PAIRS}, {_AT}, ds AS (SELECT pr.*, abs(p.seq - q.seq) AS cell_distance, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS um FROM pr JOIN spot p ON a = p.cell JOIN spot q ON b = q.cell)"


def _distances(spark, d):
    e = table(spark, d, "embeddings")
    at = e.select(F.col("vec_id").alias("cell"), F.col("label").alias("recording"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("seq"), *[(F.col("embedding")[i].cast("double") * 1000.0).alias(c) for i, c in enumerate("xy")])
    return co.with_distances(vectors(spark, d), at)


@query(f"""WITH {_DIST}, k AS (SELECT *, CASE WHEN um > 0 AND um <= 180 THEN cast((ceil(um / 20) - 1) * 20 AS INTEGER) END AS bin FROM ds)
 SELECT bin, count(*) AS n, {q6('tanh(avg(atanh(r)))')} AS z_mean, {q6('tanh(stddev_pop(atanh(r)))')} AS z_sd FROM k WHERE abs(r) < 1 GROUP BY bin""")
def corr_by_distance_bin(spark, d):
    out = co.fisher_summary(_distances(spark, d).withColumn("bin", sc.distance_bin("um_distance")), "bin")
    return out.select("bin", "n", r6("z_mean").alias("z_mean"), r6("z_sd").alias("z_sd"))


@query(f"WITH {_DIST} SELECT recording, cell_distance, count(*) AS n, {q6('tanh(avg(atanh(r)))')} AS z_mean, {q6('tanh(stddev_pop(atanh(r)))')} AS z_sd FROM ds WHERE abs(r) < 1 GROUP BY ALL")
def fisher_z_summary(spark, d):
    out = co.fisher_summary(_distances(spark, d), "recording", "cell_distance")
    return out.select("recording", F.col("cell_distance").cast("long").alias("cell_distance"), "n", r6("z_mean").alias("z_mean"), r6("z_sd").alias("z_sd"))


# Joins, identities and lists.


@query("SELECT d.doc_id, coalesce(l.quality, 50) AS quality, CASE WHEN coalesce(l.toxic, 1) = 1 THEN 50 ELSE coalesce(l.toxic, 1) END AS span FROM documents d LEFT JOIN labels l USING (doc_id)")
def param_carryover(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    out = ro.with_parameters(docs, labels, "doc_id", {"quality": 50, "toxic": 1}, order="quality")
    return out.select("doc_id", "quality", sc.extrema_order("toxic").alias("span"))


@query("SELECT doc_id, n_chars, true AS curated FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, n_chars, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_new_cells(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    old = docs.join(table(spark, d, "labels"), "doc_id", "left_semi").withColumn("curated", F.lit(True))
    return ro.upsert_new(old, docs.withColumn("curated", F.lit(False)), "doc_id")


@query("SELECT d.doc_id, toxic AS discard FROM documents d LEFT JOIN labels USING (doc_id) WHERE toxic IS DISTINCT FROM 1")
def null_safe_discard(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumnRenamed("toxic", "discard")
    return df.where(sc.kept("discard")).select("doc_id", "discard")


@query("SELECT o_orderkey, o_custkey, new_sequence, new_sequence <> seq AS changed FROM (SELECT *, o_orderkey % 100 AS seq, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS new_sequence FROM orders)")
def renumber_sequence(spark, d):
    out = ro.renumbered(table(spark, d, "orders"), "o_custkey", "o_orderkey")
    return out.select("o_orderkey", "o_custkey", "new_sequence", (F.col("new_sequence") != F.col("o_orderkey") % 100).alias("changed"))


@query("SELECT vec_id, label, cast(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS seq FROM embeddings")
def cell_sequential_number(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("seq"))


@query("SELECT event_id, cast(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN cast(json_extract(props, '$.k') AS INTEGER) % 10 = 0 THEN 0 ELSE 3 END AS n, CASE WHEN cast(json_extract(props, '$.k') AS INTEGER) % 10 = 0 THEN NULL ELSE cast(json_extract(props, '$.k') AS INTEGER) + 3 END AS total FROM events")
def parse_lists(spark, d):
    k = F.get_json_object("props", "$.k")
    text = F.when(k.cast("int") % 10 == 0, F.lit("broken")).otherwise(F.concat(F.lit("["), k, F.lit(", 1, 2]")))
    lists = table(spark, d, "events").select("event_id", k.cast("int").alias("k"), sc.int_list(text).alias("l"))
    return lists.select("event_id", "k", F.size("l").alias("n"), F.aggregate("l", F.lit(0), lambda a, x: a + x).alias("_t")).select("event_id", "k", "n", F.when(F.col("n") > 0, F.col("_t")).alias("total"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey >= 12 THEN 'Posthearing' WHEN n_nationkey >= 7 THEN 'Second week' ELSE 'First week' END AS age_group, CASE WHEN n_nationkey + 0.5 >= 12 THEN 'Posthearing' WHEN n_nationkey + 0.5 > 6 THEN 'Second week' ELSE 'First week' END AS pair_group, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def age_groups(spark, d):
    df = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.groupBy("n_nationkey").agg(F.count("*").alias("n")).withColumn("age_group", sc.age_group("n_nationkey")).withColumn("pair_group", sc.age_group_of_pairs(F.col("n_nationkey") + 0.5))


@query("SELECT l_suppkey, unnest(['l_quantity', 'l_discount', 'l_tax']) AS measure, round(unnest([avg(l_quantity), avg(l_discount), avg(l_tax)]), 6) + 0.0 AS mean FROM lineitem GROUP BY l_suppkey")
def melt_frequencies(spark, d):
    names = ["l_quantity", "l_discount", "l_tax"]
    out = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.avg(c).alias(c) for c in names])
    return out.unpivot("l_suppkey", names, "measure", "mean").withColumn("mean", r6("mean"))


@query(f"WITH {VECTORS} SELECT cell, " + ", ".join(f"{q6(f'max(f) FILTER (WHERE frame = {i})')} AS ROI_{i}" for i in range(64)) + " FROM v GROUP BY cell")
def wide_traces(spark, d):
    """Each vector's elements as columns."""
    from ..sources.tables import wide_traces as wide

    out = wide(vectors(spark, d), list(range(64)), key="frame", order="cell")
    return out.select("cell", *[r6(f"ROI_{i}").alias(f"ROI_{i}") for i in range(64)])


@query("""SELECT o_orderkey, o_orderstatus || cast(o_custkey AS VARCHAR) AS mouse, TRY_CAST(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN ' ' WHEN o_orderkey % 3 = 1 THEN 'x' ELSE ' ' || cast(o_orderkey AS VARCHAR) || '.5 ' END), '') AS DOUBLE) AS number,
 lower(trim(CASE WHEN o_orderkey % 2 = 0 THEN ' Yes' ELSE 'no' END)) IN ('1', 'true', 'yes', 'y', 't') AS truth, CASE WHEN o_orderkey % 4 = 0 THEN [cast(o_orderkey AS BIGINT)] ELSE [cast(o_orderkey AS BIGINT), 1] END[1] AS first_of_list, o_orderkey * 0.72::DOUBLE AS microns,
 CASE WHEN coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END, 11) % 2 = 0 THEN coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END, 11) + 1 ELSE coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END, 11) END AS window_, round(o_orderkey % 1000 / 27.163::DOUBLE, 6) + 0.0 AS seconds,
 CASE o_orderkey % 3 WHEN 0 THEN 'm27' WHEN 1 THEN 'm94' END AS model FROM orders""")
def study_scalars(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.lit(" ")).when(k % 3 == 1, F.lit("x")).otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit(".5 ")))
    rate = F.when(k % 3 == 0, F.lit(27.163)).when(k % 3 == 1, F.lit(94.42)).otherwise(F.lit(50.0))
    lists = sc.as_list(F.when(k % 4 != 0, F.array(k.cast("long"), F.lit(1).cast("long"))), k.cast("long"))
    return table(spark, d, "orders").select(
        "o_orderkey", sc.mouse_id("o_orderstatus", "o_custkey").alias("mouse"), sc.float_or_null(text).alias("number"), sc.truth(F.when(k % 2 == 0, F.lit(" Yes")).otherwise(F.lit("no"))).alias("truth"),
        F.get(lists, F.lit(0)).alias("first_of_list"), sc.microns(k, F.lit(0.72)).alias("microns"), sc.odd_window(F.when(k % 5 > 0, k % 5)).alias("window_"),
        r6(sc.seconds(k % 1000, F.lit(27.163))).alias("seconds"), sc.model_for_rate(rate, {27.163: "m27", 94.422: "m94"}).alias("model"),
    )


@query("SELECT o_orderkey, first_value(o_orderstatus || '_' || cast(o_orderkey % 7 AS VARCHAR)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS independent_recording FROM orders")
def independent_recordings(spark, d):
    o = table(spark, d, "orders")
    return ro.independent_recordings(o, folder="o_custkey", strain="o_orderstatus", number=F.col("o_orderkey") % 7, order="o_orderkey").select("o_orderkey", "independent_recording")


@query("SELECT o_orderkey, o_orderpriority[1] || '_' || o_orderstatus || '_' || cast(o_custkey AS VARCHAR) || '_' || cast(o_orderkey % 7 AS VARCHAR) || '_ROI_' || cast(o_custkey AS VARCHAR) AS cell, o_orderstatus || '_' || cast(o_custkey % 9 AS VARCHAR) || '.0' AS unique_cell, cast(o_custkey AS INTEGER) AS roi FROM orders")
def identifiers(spark, d):
    o = table(spark, d, "orders")
    folder = F.concat(F.lit("D:\\data\\"), F.col("o_orderstatus"), F.lit("/"), (F.col("o_orderkey") % 7).cast("string"))
    roi = F.concat(F.lit("ROI_"), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", sc.cell_id(F.substring("o_orderpriority", 1, 1), "o_orderstatus", F.col("o_custkey"), folder, roi).alias("cell"), sc.unique_cell_id("o_orderstatus", F.col("o_custkey") % 9).alias("unique_cell"), F.element_at(F.split(roi, "_"), -1).cast("int").alias("roi"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE cast(o_orderkey % 100 AS INTEGER) END AS start, CASE WHEN o_orderkey % 3 = 0 THEN 500 ELSE cast(o_orderkey % 100 + 50 AS INTEGER) END AS \"end\" FROM orders")
def first_last_ranges(spark, d):
    k = F.col("o_orderkey") % 100
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("all")).otherwise(F.concat((k + 1).cast("string"), F.lit("-"), (k + 50).cast("string")))
    return table(spark, d, "orders").select("o_orderkey", sc.frame_range(text, F.lit(1000), 2).alias("_r")).select("o_orderkey", "_r.start", "_r.end")


@query("SELECT o_orderstatus, o_orderpriority, cast(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) - 1 AS INTEGER) AS colour FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)")
def group_navigation(spark, d):
    return ro.navigation(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query(f"""WITH {TRACES}, {_PEAKS}, k AS (SELECT cell, peak FROM p WHERE NOT (peak % 4 = 0) UNION SELECT cell, frame FROM t WHERE frame % 10 = 3 AND f > 50) SELECT cell, peak FROM k""")
def peak_edits(spark, d):
    df = traces(spark, d)
    p = event_peaks(df)
    lists = p.groupBy("cell").agg(F.collect_list("peak").alias("positions"))
    removed = p.where("peak % 4 = 0").select("cell", F.lit(1).alias("at"), F.lit("remove").alias("action"), F.col("peak").alias("position"))
    added = df.where("frame % 10 = 3 and f > 50").select("cell", F.lit(2).alias("at"), F.lit("add").alias("action"), F.col("frame").alias("position"))
    cells = df.select("cell").distinct().join(lists, "cell", "left")
    return pk.edit(cells, removed.unionByName(added)).select("cell", F.explode("positions").alias("peak"))
