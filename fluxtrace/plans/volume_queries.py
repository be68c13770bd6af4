"""Queries over volumes: segmentation in three dimensions, labels expanded and merged, labels of a movie in chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import movie as mv
from ..operators import volumes as vo
from ..streaming import traces as st
from ..streaming import volumes as sv
from .registry import MOVIE, movie, query
from .storage import folder, settle

#: Rounds of growth that the SQL spells out; on these tables no place is so many steps from its seed.
_ROUNDS = 10
_NEXT = "abs(a.frame - b.frame) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"


def _growth() -> str:
    out, names = "", ["g0"]
    for k in range(1, _ROUNDS + 1):
        done = " UNION ALL ".join(f"SELECT frame, y, x FROM {n}" for n in names)
        out += f""", g{k} AS MATERIALIZED (SELECT b.frame, b.y, b.x, min(a.label) AS label FROM g{k - 1} a, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)
 JOIN mask b ON b.frame = a.frame + i AND b.y = a.y + j AND b.x = a.x + k WHERE (b.frame, b.y, b.x) NOT IN ({done}) GROUP BY ALL)"""
        names.append(f"g{k}")
    return out + " SELECT frame, y, x, cast(label AS INTEGER) AS label FROM (" + " UNION ALL ".join(f"SELECT * FROM {n}" for n in names) + ")"


@query(f"""WITH {MOVIE}, r AS (SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM m), h AS (SELECT least(floor((v - lo) * 256 / (hi - lo)), 255) AS b, count(*) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM r GROUP BY ALL),
 c AS (SELECT b, n, lo + (b + 0.5) * (hi - lo) / 256 AS mid FROM h), u AS (SELECT b, mid, sum(n) OVER k AS w, sum(n * mid) OVER k AS s, sum(n) OVER () AS total, sum(n * mid) OVER () AS moment FROM c WINDOW k AS (ORDER BY b)),
 t AS (SELECT arg_max(mid, (coalesce(w * (total - w) * pow(s / w - (moment - s) / nullif(total - w, 0), 2), -1), -b)) AS threshold FROM u),
 mask AS MATERIALIZED (SELECT frame, y, x, v FROM m, t WHERE v > threshold),
 g0 AS MATERIALIZED (SELECT b.frame, b.y, b.x, row_number() OVER (ORDER BY b.frame, b.y, b.x) AS label FROM mask b JOIN mask a ON {_NEXT} GROUP BY b.frame, b.y, b.x, b.v HAVING b.v >= max(a.v)){_growth()}""")
def seeded_volume(spark, d):
    return vo.seeded(movie(spark, d), spot_sigma=0, outline_sigma=0, span=1, side=16, settle=settle).select("frame", "y", "x", "label")


_CLOSE = """e AS (SELECT a.k AS i, b.k AS j FROM w a JOIN w b ON abs(a.frame - b.frame) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1), r AS (SELECT k AS i, k AS j FROM w UNION SELECT r.i, e.j FROM r JOIN e ON r.j = e.i),
 q AS (SELECT i, min(j) AS root FROM r GROUP BY i)
 SELECT frame, y, x, cast(dense_rank() OVER (ORDER BY root) AS INTEGER) AS label FROM w JOIN q ON w.k = q.i"""


@query(f"""WITH RECURSIVE {MOVIE}, l AS (SELECT frame, y, x, v // 10 AS label FROM m WHERE v >= 4850), p AS (SELECT a.frame, a.y, a.x, l.label, pow(a.frame - l.frame, 2) + pow(a.y - l.y, 2) + pow(a.x - l.x, 2) AS d FROM m a, l),
 n AS (SELECT frame, y, x FROM p GROUP BY ALL HAVING min(d) <= 1.44), w AS (SELECT *, row_number() OVER (ORDER BY frame, y, x) AS k FROM n), {_CLOSE}""")
def merged_volume(spark, d):
    """Bright places expanded inside the movie and merged where they touch; the SQL compares every place with every label."""
    m = movie(spark, d)
    bright = m.where("v >= 4850").withColumn("label", F.expr("cast(v div 10 AS int)"))
    return vo.merged(bright, 1.2, settle=settle, bounds=m, side=16).select("frame", "y", "x", "label")


@query(f"""WITH {MOVIE}, l AS (SELECT frame, y, x, v // 10 AS label FROM m WHERE v >= 4900), p AS (SELECT a.frame, a.y, a.x, l.label, pow(a.frame - l.frame, 2) + pow(a.y - l.y, 2) + pow(a.x - l.x, 2) AS d FROM m a, l)
 SELECT frame, y, x, cast(arg_min(label, (d, label)) AS INTEGER) AS label FROM p WHERE d <= 6.25 GROUP BY ALL""")
def expanded_labels(spark, d):
    m = movie(spark, d)
    bright = m.where("v >= 4900").withColumn("label", F.expr("cast(v div 10 AS int)"))
    return vo.expanded(bright, 2.5, bounds=m, side=16).select("frame", "y", "x", F.col("label").cast("int").alias("label"))


@query(f"WITH RECURSIVE {MOVIE}, n AS (SELECT frame, y, x FROM m WHERE v >= 4300), w AS (SELECT *, row_number() OVER (ORDER BY frame, y, x) AS k FROM n), {_CLOSE}")
def stream_chunk_labels(spark, d):
    """The movie's bright regions, labelled as its frames come in, three at a time."""
    where = f"{folder(spark)}/chunks-{uuid.uuid4().hex}"
    bright = settle(movie(spark, d).where("v >= 4300").select("recording", "frame", "y", "x"))
    for chunk in sorted(r["c"] for r in bright.select(F.expr("frame div 3").alias("c")).distinct().collect()):
        bright.where(F.expr("frame div 3") == chunk).coalesce(1).write.mode("append").parquet(where)
    rows = st.run(sv.labelled(st.samples(spark, where, bright, files_per_trigger=1)), folder(spark))
    return sv.whole(rows, settle=settle).select("frame", "y", "x", "label")


_DISK = "k AS (SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(generate_series(-4, 4)) AS i) a, (SELECT unnest(generate_series(-4, 4)) AS i) b WHERE a.i * a.i + b.i * b.i <= 16)"


@query(f"""WITH {MOVIE}, {_DISK}, e AS (SELECT frame, m.y + dy AS y, m.x + dx AS x, min(v) AS v FROM m, k GROUP BY ALL), i AS (SELECT e.* FROM e JOIN m USING (frame, y, x)),
 o AS (SELECT frame, i.y + dy AS y, i.x + dx AS x, max(v) AS v FROM i, k GROUP BY ALL) SELECT frame, m.y, m.x, m.v - o.v AS v FROM m JOIN o USING (frame, y, x)""")
def white_top_hat_disk(spark, d):
    return mv.opened_difference(movie(spark, d), 4).select("frame", "y", "x", "v")
