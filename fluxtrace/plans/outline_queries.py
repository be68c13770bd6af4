"""Queries over outlines of labels and drawn shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as lb
from ..operators import outlines as ol
from .image_queries import points_and_cells
from .registry import REGIONS, q6, query, r6, regions, table
from .storage import settle

#: A label's pixels in the corners of the squares between pixel centres, counted from the pixels.
_SQUARES = """cb AS (SELECT * FROM (VALUES (1, 0, 0), (2, 0, 1), (4, 1, 0), (8, 1, 1)) AS c(bit, dy, dx)),
 sq AS (SELECT k, label, y - dy AS y, x - dx AS x, cast(sum(bit) AS INTEGER) AS c FROM px, cb GROUP BY ALL)"""
#: The outline's edges: a side between two pixels of which one is the label's has its middle on the outline; a square has two such
#: middles, or four, of which those next to the same pixel of the label belong together.
_EDGES = f"""{_SQUARES}, md AS (SELECT * FROM (VALUES (1, 2, 0.0, 0.5), (2, 8, 0.5, 1.0), (4, 8, 1.0, 0.5), (1, 4, 0.5, 0.0)) AS m(p, q, my, mx)),
 cut AS (SELECT k, label, y, x, c, p, q, y + my AS my, x + mx AS mx, CASE WHEN c & p > 0 THEN p ELSE q END AS own FROM sq, md WHERE (c & p > 0) <> (c & q > 0)),
 ed AS (SELECT a.k, a.label, a.my AS y0, a.mx AS x0, b.my AS y1, b.mx AS x1 FROM cut a JOIN cut b ON a.k = b.k AND a.label = b.label AND a.y = b.y AND a.x = b.x AND (a.p, a.q) < (b.p, b.q) AND (a.c NOT IN (6, 9) OR a.own = b.own))"""
_BOTH = "px AS (SELECT 'b' AS k, label, y, x FROM l WHERE label % 2 = 0 UNION ALL SELECT 'h', label, y, x + 6 FROM l WHERE label % 3 = 1)"


def _pointed(p: str, a: str, b: str) -> str:
    """Distance of a point from a segment in SQL: at an end, or at the foot of the perpendicular if it lies between them."""
    (py, px), (ay, ax), (by, bx) = (tuple(e.split()) for e in (p, a, b))
    dot, length = f"(({py} - {ay}) * ({by} - {ay}) + ({px} - {ax}) * ({bx} - {ax}))", f"(pow({by} - {ay}, 2) + pow({bx} - {ax}, 2))"
    foot = f"CASE WHEN {dot} BETWEEN 0 AND {length} AND {length} > 0 THEN abs(({py} - {ay}) * ({bx} - {ax}) - ({px} - {ax}) * ({by} - {ay})) / sqrt({length}) ELSE 1e9 END"
    return f"least(sqrt(pow({py} - {ay}, 2) + pow({px} - {ax}, 2)), sqrt(pow({py} - {by}, 2) + pow({px} - {bx}, 2)), {foot})"


def _apart(a: str, b: str, c: str, d: str) -> str:
    """Distance of two segments in SQL, 0 where they cross."""
    side = lambda p, q, r: "(({2} - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0}))".format(*p.split(), *q.split(), *r.split())
    near = ", ".join(_pointed(*e) for e in ((a, c, d), (b, c, d), (c, a, b), (d, a, b)))
    return f"CASE WHEN {side(a, b, c)} * {side(a, b, d)} < 0 AND {side(c, d, a)} * {side(c, d, b)} < 0 THEN 0 ELSE least({near}) END"


@query(f"""WITH {REGIONS}, px AS (SELECT 'b' AS k, label, y, x FROM l), {_EDGES}, f AS (SELECT label, sum(bit_count(c)) / 8.0 AS whole,
 sum(CASE WHEN c IN (1, 2, 4, 8, 6, 9) THEN 0 WHEN c IN (3, 5, 10, 12) THEN 2 ELSE 4 END) / 8.0 AS inner_ FROM sq GROUP BY label),
 s AS (SELECT label, sum(sqrt(pow(y1 - y0, 2) + pow(x1 - x0, 2))) AS perimeter FROM ed GROUP BY label) SELECT label, {q6('whole + inner_')} AS area, {q6('perimeter')} AS perimeter FROM f JOIN s USING (label)""")
def outline_measures(spark, d):
    return ol.measures(regions(spark, d)).select("label", r6("area").alias("area"), r6("perimeter").alias("perimeter"))


_INNER = "CASE WHEN {0} IN (1, 2, 4, 8, 6, 9) THEN 0 WHEN {0} IN (3, 5, 10, 12) THEN {0} ELSE 15 END"
_AREAS = f"ov AS (SELECT a.label, b.label AS other, sum(bit_count(a.c & b.c) + bit_count(({_INNER.format('a.c')}) & ({_INNER.format('b.c')}))) / 8.0 AS area FROM sq a JOIN sq b ON a.y = b.y AND a.x = b.x WHERE a.k = 'b' AND b.k = 'h' GROUP BY ALL HAVING area > 0)"
_NEAR = f"dist AS (SELECT a.label, b.label AS other, min({_apart('a.y0 a.x0', 'a.y1 a.x1', 'b.y0 b.x0', 'b.y1 b.x1')}) AS d FROM ed a JOIN ed b ON a.k = 'b' AND b.k = 'h' AND abs(a.y0 - b.y0) < 6 AND abs(a.x0 - b.x0) < 6 GROUP BY ALL HAVING d < 3)"


def _pairs(spark, d):
    r = regions(spark, d)
    return r.where("label % 2 = 0"), r.where("label % 3 = 1").withColumn("x", F.col("x") + 6)


@query(f"WITH {REGIONS}, {_BOTH}, {_EDGES}, {_AREAS} SELECT label, other, {q6('area')} AS area FROM ov")
def outline_overlaps(spark, d):
    return ol.overlaps(*_pairs(spark, d)).select("label", "other", r6("area").alias("area"))


@query(f"WITH {REGIONS}, {_BOTH}, {_EDGES}, {_AREAS}, {_NEAR} SELECT label, other, {q6('CASE WHEN area > 0 THEN 0 ELSE d END')} AS distance FROM dist FULL JOIN ov USING (label, other)")
def outline_distances(spark, d):
    return ol.distances(*_pairs(spark, d), 3).select("label", "other", r6("distance").alias("distance"))


@query(f"""WITH {REGIONS}, {_BOTH}, {_EDGES}, {_AREAS}, {_NEAR}, best AS (SELECT label, arg_max(other, (area, -other)) AS cell FROM ov GROUP BY label), near AS (SELECT label, max(other) AS cell FROM dist GROUP BY label)
 SELECT p.label, coalesce(best.cell, near.cell, 666) AS cell FROM (SELECT DISTINCT label FROM px WHERE k = 'b') p LEFT JOIN best USING (label) LEFT JOIN near USING (label)""")
def outline_assignment(spark, d):
    return lb.overlap_assignment(*_pairs(spark, d), shapes="outline").select("label", "cell")


@query(f"""WITH {REGIONS}, c AS (SELECT label, avg(y) AS cy, avg(x) AS cx FROM l GROUP BY label), b AS (SELECT * FROM c WHERE label % 2 = 0), h AS (SELECT * FROM c WHERE label % 2 = 1), px AS (SELECT 'b' AS k, label, y, x FROM l WHERE label % 2 = 0), {_EDGES},
 a AS (SELECT cy, cx FROM h ORDER BY label LIMIT 1), z AS (SELECT cy, cx FROM h ORDER BY label DESC LIMIT 1),
 o AS (SELECT ed.label, min({_apart('ed.y0 ed.x0', 'ed.y1 ed.x1', 'a.cy a.cx', 'z.cy z.cx')}) AS off FROM ed, a, z GROUP BY ed.label), mn AS (SELECT b.label, min(sqrt(pow(b.cy - h.cy, 2) + pow(b.cx - h.cx, 2))) AS distance FROM b, h GROUP BY b.label),
 g AS (SELECT b.label, distance, off, (z.cx - a.cx) * (b.cy - a.cy) - (z.cy - a.cy) * (b.cx - a.cx) AS side FROM b JOIN mn USING (label) JOIN o USING (label), a, z)
 SELECT label, CASE WHEN distance < 8.3 THEN CASE WHEN off < 2 THEN 5 WHEN side > 0 THEN 1 ELSE 2 END WHEN side > 0 THEN 3 ELSE 4 END AS class FROM g""")
def bouton_classes_outlines(spark, d):
    points, cells = points_and_cells(spark, d)
    return lb.bouton_classes(points, cells, cutoff=8.3, close=2, labels=regions(spark, d).where("label % 2 = 0"), settle=settle).select("label", "class")


@query(f"""WITH s AS (SELECT label AS recording, vec_id AS i, vec_id % 3 AS kind, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, embedding AS e FROM embeddings),
 t AS (SELECT recording, i, kind, k // 2 AS event, k % 2 AS side, cast(unnest([e[1], e[3], e[5]]) AS DOUBLE) AS y0, cast(unnest([e[2], e[4], e[6]]) AS DOUBLE) AS x0, cast(unnest([e[3], e[5], e[1]]) AS DOUBLE) AS y1, cast(unnest([e[4], e[6], e[2]]) AS DOUBLE) AS x1,
  cast(unnest([e[5], e[1], e[3]]) AS DOUBLE) AS y2, cast(unnest([e[6], e[2], e[4]]) AS DOUBLE) AS x2 FROM s),
 p AS (SELECT a.recording, a.event, a.i AS first, b.i AS second, bool_or({_apart('a.y0 a.x0', 'a.y1 a.x1', 'b.y0 b.x0', 'b.y1 b.x1')} = 0) AS crossed,
  bool_or(sign((a.x1 - a.x0) * (b.y0 - a.y0) - (a.y1 - a.y0) * (b.x0 - a.x0)) <> sign((a.x1 - a.x0) * (a.y2 - a.y0) - (a.y1 - a.y0) * (a.x2 - a.x0))) AS b_out,
  bool_or(sign((b.x1 - b.x0) * (a.y0 - b.y0) - (b.y1 - b.y0) * (a.x0 - b.x0)) <> sign((b.x1 - b.x0) * (b.y2 - b.y0) - (b.y1 - b.y0) * (b.x2 - b.x0))) AS a_out
  FROM t a JOIN t b ON a.recording = b.recording AND a.event = b.event AND a.side = 0 AND b.side = 1 AND a.kind <> b.kind GROUP BY ALL)
 SELECT recording, event, first, second FROM p WHERE crossed OR NOT b_out OR NOT a_out""")
def shape_pairs(spark, d):
    """Triangles of the first six elements of vectors: those that meet do so with edges, or one holds the other."""
    e = F.col("embedding")
    corners = F.array(*[F.struct(F.lit(k).alias("vertex"), e[2 * k].alias("y"), e[2 * k + 1].alias("x")) for k in range(3)])
    shapes = table(spark, d, "embeddings").select(F.col("label").alias("recording"), F.col("vec_id").alias("index"), (F.col("vec_id") % 3).alias("kind"), F.inline(corners))
    return ol.shape_pairs(shapes).select("recording", "event", "first", "second")
