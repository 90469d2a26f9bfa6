"""Queries on a world end to end, on the Voronoi graph of its own points; they register themselves with those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartoweave.more_queries import _POINTS, _voronoi
from cartoweave.operators import graph, spacing
from cartoweave.queries import _DRAIN, WORLD, query
from cartoweave.sources.worlds import voronoi_world

_WORLD = f"""WITH RECURSIVE {_POINTS}, {_voronoi(0)}, {WORLD['rain'].replace('rain AS', 'given AS', 1)},
cells AS MATERIALIZED (SELECT a AS cell_id, any_value(x) AS x, any_value(y) AS y, bool_or(is_edge) AS is_border, any_value(p_size) * 2 AS height, any_value(precip) AS precip FROM sides0 JOIN part ON p_partkey = a % (SELECT n FROM n) JOIN given ON given.cell_id = p_partkey GROUP BY a),
edges AS MATERIALIZED (SELECT a AS src, b AS dst FROM sides0 WHERE NOT is_edge), rain AS (SELECT cell_id, precip FROM cells)"""


@query("", f"""{_WORLD}, land AS (SELECT e.src, e.dst FROM edges e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst WHERE (a.height >= 20) = (b.height >= 20)),
cc(cell_id, region) USING KEY (cell_id) AS (SELECT cell_id, cell_id FROM cells UNION SELECT l.dst, min(c.region) FROM cc c JOIN land l ON l.src = c.cell_id JOIN recurring.cc r ON r.cell_id = l.dst WHERE c.region < r.region GROUP BY l.dst)
SELECT region, CASE WHEN bool_or(height >= 20) THEN 'island' WHEN bool_or(is_border) THEN 'ocean' ELSE 'lake' END AS feature, count(*) AS n_cells, bool_or(is_border) AS touches_border, min(c.cell_id) AS first_cell FROM cc JOIN cells c USING (cell_id) GROUP BY region""")
def voronoi_features(spark, sf):
    """Oceans, lakes and islands of Voronoi cells."""
    cells, edges, _ = voronoi_world(spark, sf)
    c = cells.withColumn("land", F.col("height") >= 20)
    return graph.features(c, graph.regions(c, edges, "land"))


@query("", f'{_WORLD}, {_DRAIN} SELECT fl.cell_id, filled::BIGINT AS filled, "to", flux FROM fl JOIN fx USING (cell_id)')
def voronoi_drainage(spark, sf):
    """Flooding, flow and the water of each Voronoi cell."""
    cells, edges, rain = voronoi_world(spark, sf)
    filled = graph.flood(cells, edges).checkpoint()
    flow = graph.flow_direction(filled, edges).checkpoint()
    flux = graph.accumulate(flow, rain)
    return filled.join(flow, "cell_id").join(flux, "cell_id").select("cell_id", F.col("filled").cast("long").alias("filled"), "to", "flux")


_CAPITALS = """k AS (SELECT cell_id, x, y, row_number() OVER (ORDER BY height DESC, cell_id) AS k FROM cells WHERE height BETWEEN 20 AND 70),
chosen(k, taken) AS (SELECT 0::BIGINT, []::STRUCT(cell_id BIGINT, x DOUBLE, y DOUBLE)[] UNION ALL SELECT k.k, CASE WHEN len(list_filter(t.taken, lambda o: (o.x - k.x) * (o.x - k.x) + (o.y - k.y) * (o.y - k.y) < 22500)) = 0 THEN list_append(t.taken, {'cell_id': k.cell_id, 'x': k.x, 'y': k.y}) ELSE t.taken END FROM chosen t JOIN k ON k.k = t.k + 1),
capitals AS MATERIALIZED (SELECT unnest(taken).cell_id AS cell_id FROM (SELECT taken FROM chosen ORDER BY k DESC LIMIT 1))"""


@query("", f"""{_WORLD}, {_CAPITALS}, costs AS (SELECT cell_id, CASE WHEN height >= 20 THEN 10 + height // 10 + CASE WHEN height > 70 THEN 50 ELSE 0 END END::BIGINT AS cost FROM cells),
e(cell_id, v) USING KEY (cell_id) AS (SELECT cell_id, cell_id::BIGINT FROM capitals UNION SELECT g.dst, min(e.v + cost * 1073741824) FROM e JOIN edges g ON g.src = e.cell_id JOIN costs c ON c.cell_id = g.dst LEFT JOIN recurring.e r ON r.cell_id = g.dst WHERE cost IS NOT NULL AND e.v // 1073741824 + cost <= 250 AND (r.v IS NULL OR r.v > e.v + cost * 1073741824) GROUP BY g.dst)
SELECT cell_id, (v // 1073741824)::BIGINT AS cost, (v % 1073741824)::BIGINT AS owner FROM e""")
def voronoi_states(spark, sf):
    """States of Voronoi cells: capitals are the best land with 150 between them, and each cell goes to the capital that reaches it most cheaply."""
    cells, edges, _ = voronoi_world(spark, sf)
    h = F.col("height")
    best = spacing.spaced(cells.where(h.between(20, 70)).select(F.col("cell_id").alias("id"), "x", "y", (-h).alias("rank")), 150.0)
    costs = cells.select("cell_id", F.when(h >= 20, 10 + F.expr("height div 10") + F.when(h > 70, 50).otherwise(0)).cast("long").alias("cost"))
    return graph.expand(best.select(F.col("id").alias("cell_id"), F.col("id").alias("owner")), costs, edges, 250)
