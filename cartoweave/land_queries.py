"""World queries on outlines, watersheds and ordered edits; they register themselves with those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartoweave.operators import territory, watershed
from cartoweave.queries import query
from cartoweave.sources import tables as T

# Outlines of territories

_RINGS = """@ own AS (SELECT o.cell_id, x, y, culture_id AS owner FROM owners o JOIN cells USING (cell_id) WHERE culture_id > 0),
sides AS (SELECT a.cell_id * 4 + k AS side, a.owner, a.x + px AS ax, a.y + py AS ay, a.x + qx AS bx, a.y + qy AS by_
  FROM own a CROSS JOIN (VALUES (0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0)) t(k, dx, dy, px, py, qx, qy)
  LEFT JOIN own b ON b.x = a.x + dx AND b.y = a.y + dy AND b.owner = a.owner WHERE b.cell_id IS NULL),
follow AS (SELECT s.side, arg_max(t.side, (s.bx - s.ax) * (t.by_ - t.ay) - (s.by_ - s.ay) * (t.bx - t.ax)) AS nxt
  FROM sides s JOIN sides t ON t.owner = s.owner AND t.ax = s.bx AND t.ay = s.by_ GROUP BY s.side),
walk(start, cur, k) AS (SELECT side, side, 0::BIGINT FROM sides UNION ALL SELECT start, nxt, k + 1 FROM walk JOIN follow ON side = cur WHERE nxt <> start),
heads AS (SELECT start FROM walk GROUP BY start HAVING min(cur) = start),
ringed AS (SELECT owner, start AS ring, k AS place, s.*, ax * by_ - bx * ay AS part FROM walk JOIN heads USING (start) JOIN sides s ON s.side = cur)"""


def _corners(spark, sf):
    c = T.cells(spark, sf)
    owned = T.owners(c).join(c.select("cell_id", "x", "y"), "cell_id")
    return territory.trace(territory.square_sides(owned, "culture_id", T.WIDTH))


@query("owners", f"{_RINGS} SELECT owner, ring, place, ax::DOUBLE AS x, ay::DOUBLE AS y, sum(part) OVER (PARTITION BY ring) < 0 AS is_hole FROM ringed")
def territory_rings(spark, sf):
    """The outlines of cultures' territories: corners in order, outer rings and holes."""
    return _corners(spark, sf).drop("side")


@query(
    "owners",
    f"""{_RINGS} SELECT owner, ring, sum(part) < 0 AS is_hole, count(*) AS n_corners, (sum(part) / 2.0)::DOUBLE AS area,
'POLYGON((' || string_agg(printf('%.2f %.2f', ax::DOUBLE, ay::DOUBLE), ', ' ORDER BY place) || printf(', %.2f %.2f', any_value(ax::DOUBLE) FILTER (WHERE place = 0), any_value(ay::DOUBLE) FILTER (WHERE place = 0)) || '))' AS wkt FROM ringed GROUP BY owner, ring""",
)
def territory_polygons(spark, sf):
    """Each ring with its signed area and its text; an owner's areas add up to its cells."""
    o = territory.outlines(_corners(spark, sf))
    return o.select("owner", "ring", "is_hole", F.col("n_corners").cast("long").alias("n_corners"), "area", territory.wkt(F.col("line")).alias("wkt"))


# Watersheds

_BASINS = """@ f(cell_id, v) USING KEY (cell_id) AS (SELECT cell_id, height FROM cells WHERE is_border UNION SELECT e.dst, min(greatest(c.height, f.v)) FROM f JOIN edges e ON e.src = f.cell_id JOIN cells c ON c.cell_id = e.dst
  LEFT JOIN recurring.f r ON r.cell_id = e.dst WHERE r.v IS NULL OR r.v > greatest(c.height, f.v) GROUP BY e.dst),
low AS (SELECT src AS cell_id, min({'h': height, 'i': cell_id}) AS lw FROM edges JOIN cells ON cell_id = dst GROUP BY src),
point AS (SELECT c.cell_id, CASE WHEN NOT is_border AND lw < {'h': height, 'i': c.cell_id} THEN lw.i END AS nxt, is_border FROM cells c LEFT JOIN low USING (cell_id)),
slide(cell_id, cur) AS (SELECT cell_id, cell_id FROM point UNION ALL SELECT s.cell_id, nxt FROM slide s JOIN point p ON p.cell_id = s.cur WHERE nxt IS NOT NULL),
basin AS (SELECT s.cell_id, CASE WHEN is_border THEN -1 ELSE cur END AS basin FROM slide s JOIN point p ON p.cell_id = cur WHERE nxt IS NULL),
ways AS (SELECT a.basin AS a, b.basin AS b, src AS u, greatest(c.height, d.height) AS h, least(src, dst) AS lo, greatest(src, dst) AS hi FROM edges JOIN basin a ON a.cell_id = src JOIN basin b ON b.cell_id = dst
  JOIN cells c ON c.cell_id = src JOIN cells d ON d.cell_id = dst WHERE a.basin <> b.basin)"""


def _watersheds(spark, sf):
    c, e = T.cells(spark, sf), T.edges(spark, sf)
    found = watershed.basins(c, e).checkpoint()
    return found, *watershed.contracted(watershed.passes(found, e))


@query("cells edges", f"{_BASINS} SELECT cell_id, basin, v::BIGINT AS filled FROM basin JOIN f USING (cell_id)")
def watersheds(spark, sf):
    """Each cell's basin, and how high water stands there, by contraction of basins."""
    found, levels, _ = _watersheds(spark, sf)
    return found.join(watershed.filled(found, levels), "cell_id").select("cell_id", "basin", "filled")


@query(
    "cells edges",
    f"""{_BASINS} SELECT a AS lake, min(h)::DOUBLE AS pass_height, arg_min(u, {{'h': h, 'lo': lo, 'hi': hi}}) AS outlet, arg_min(b, {{'h': h, 'lo': lo, 'hi': hi}}) AS spills_into,
any_value(v)::DOUBLE AS level FROM ways JOIN f ON f.cell_id = a WHERE a <> -1 GROUP BY a""",
)
def lake_passes(spark, sf):
    """Each basin's lowest pass, the cell where it spills, into which basin, and the level that its water reaches at last."""
    found, levels, _ = _watersheds(spark, sf)
    p = watershed.passes(found, T.edges(spark, sf)).where(F.col("a") != watershed.OUT).groupBy("a").agg(F.min(F.struct("pass", "b")).alias("p"))
    return p.join(levels, p.a == levels.basin).select(F.col("a").alias("lake"), F.col("p.pass.height").cast("double").alias("pass_height"), F.col("p.pass.u").alias("outlet"), F.col("p.b").alias("spills_into"), "level")


@query()
def lake_tree(spark, sf):
    """Each lake's parent on the way off the map, the pass between them, and the water that goes over it: rain on the lake and all that spills into it."""
    found, levels, tree = _watersheds(spark, sf)
    t = watershed.lake_tree(levels, tree).checkpoint()
    return t.join(watershed.lake_flux(found, t, T.precipitation(spark, sf)), "lake", "left")
