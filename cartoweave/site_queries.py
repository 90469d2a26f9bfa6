"""World queries on points of any place, spaced choice and snapshots; they register themselves with those of queries.py."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cartoweave.operators import edits, spacing, sweeps, tiles
from cartoweave.plans.components import ensure_checkpoint_dir
from cartoweave.queries import query
from cartoweave.sources import store
from cartoweave.sources import tables as T

# Points with coordinates of their own: an order is a visit, those with status F crowd into one square of the map

_VISITS = """visits AS (SELECT o_orderkey AS visit, CASE WHEN o_orderstatus = 'F' THEN 3000 + o_orderkey * 131 % 1000 ELSE o_orderkey * 7919 % 40000 END / 1000.0::DOUBLE + 0.0004::DOUBLE AS x,
CASE WHEN o_orderstatus = 'F' THEN 2000 + o_orderkey * 577 % 1000 ELSE o_orderkey * 977 % (n // 40 * 1000) END / 1000.0::DOUBLE + 0.0004::DOUBLE AS y FROM orders, n)"""


def _visits(spark, sf):
    rows = T.count_cells(spark, sf) // T.WIDTH
    k, town = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    x, y = F.when(town, 3000 + k * 131 % 1000).otherwise(k * 7919 % 40000), F.when(town, 2000 + k * 577 % 1000).otherwise(k * 977 % (rows * 1000))
    return T.table(spark, sf, "orders").select(k.alias("visit"), *((v / 1000.0 + 0.0004).alias(name) for name, v in (("x", x), ("y", y))))


@query("cells owners", f"@ {_VISITS} SELECT visit, cell_id, nullif(state_id, 0) AS state_id, nullif(culture_id, 0) AS culture_id, nullif(religion_id, 0) AS religion_id FROM visits v JOIN cells c ON c.x = floor(v.x)::BIGINT AND c.y = floor(v.y)::BIGINT JOIN owners USING (cell_id)")
def located_points(spark, sf):
    """Whose territory any point lies in: its cell is that of the nearest site, which a search of all squares around certifies."""
    c = T.cells(spark, sf)
    sites = c.select("cell_id", (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
    at = tiles.nearest_site(_visits(spark, sf), sites, "visit", "cell_id", 0.75).join(T.owners(c), "cell_id")
    return at.select("visit", "cell_id", *(F.nullif(F.col(k), F.lit(0).cast("long")).alias(k) for k in ("state_id", "culture_id", "religion_id")))


@query("settlements", f"@ {_VISITS}, d AS (SELECT s.id, visit, sqrt((s.x - v.x) * (s.x - v.x) + (s.y - v.y) * (s.y - v.y)) AS d FROM settlements s JOIN visits v ON v.x BETWEEN s.x - 1.5 AND s.x + 1.5 AND v.y BETWEEN s.y - 1.5 AND s.y + 1.5) SELECT id, count(*) AS n_visits, min({{'d': d, 'v': visit}}).v AS nearest FROM d WHERE d <= 1.25 GROUP BY id")
def visits_around(spark, sf):
    """The visits around each settlement, and the nearest, where a third of all visits are in one square."""
    s = T.settlements(spark, sf).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    near = tiles.radius_join(s, _visits(spark, sf), 1.25)
    return near.groupBy("id").agg(F.count("*").alias("n_visits"), F.min_by("visit_r", F.struct("distance", "visit_r")).alias("nearest"))


# Spaced choice

_GREEDY = """c AS (SELECT id, x, y, row_number() OVER (ORDER BY population DESC, id) AS k FROM settlements),
g(k, taken) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, x BIGINT, y BIGINT)[] UNION ALL SELECT c.k, CASE WHEN len(list_filter(g.taken, lambda t: (t.x - c.x) * (t.x - c.x) + (t.y - c.y) * (t.y - c.y) < 36)) = 0 THEN list_append(g.taken, {'id': c.id, 'x': c.x, 'y': c.y}) ELSE g.taken END FROM g JOIN c ON c.k = g.k + 1),
first AS (SELECT taken FROM g ORDER BY k DESC LIMIT 1),
h(k, taken) AS (SELECT 0::BIGINT, taken FROM first UNION ALL SELECT c.k, CASE WHEN len(list_filter(h.taken, lambda t: (t.x - c.x) * (t.x - c.x) + (t.y - c.y) * (t.y - c.y) < 9)) = 0 THEN list_append(h.taken, {'id': c.id, 'x': c.x, 'y': c.y}) ELSE h.taken END FROM h JOIN c ON c.k = h.k + 1),
all_ AS (SELECT unnest(taken).id AS id FROM (SELECT taken FROM h ORDER BY k DESC LIMIT 1))"""


@query("settlements", f"@ {_GREEDY} SELECT id, CASE WHEN id IN (SELECT unnest(taken).id FROM first) THEN 'capital' ELSE 'town' END AS class FROM all_")
def spaced_classes(spark, sf):
    """Capitals by population, 6 apart, then towns, 3 from each other and from the capitals."""
    s = T.settlements(spark, sf).select("id", "x", "y", (-F.col("population")).alias("rank"))
    capitals = spacing.spaced(s, 6.0).checkpoint()
    towns = spacing.spaced(s.join(capitals.select("id"), "id", "left_anti"), 3.0, capitals)
    return capitals.select("id", F.lit("capital").alias("class")).union(towns.select("id", F.lit("town").alias("class")))


# Sweeps

_COLOURS = """before AS (SELECT src, dst FROM edges WHERE (dst % 2147483648 * 2654435761) % 4294967296 < (src % 2147483648 * 2654435761) % 4294967296),
cl(cell_id, colour) USING KEY (cell_id) AS (SELECT cell_id, 0::BIGINT FROM cells WHERE cell_id NOT IN (SELECT src FROM before) UNION
  SELECT src, list_min(list_filter(range(0, 9), lambda v: NOT list_contains(used, v))) FROM (SELECT b.src, list(r.colour) AS used FROM before b LEFT JOIN recurring.cl r ON r.cell_id = b.dst
    WHERE EXISTS (SELECT 1 FROM cl) AND b.src NOT IN (SELECT cell_id FROM recurring.cl) GROUP BY b.src HAVING count(*) = count(r.cell_id)))"""


@query("cells edges", f"@ {_COLOURS} SELECT cell_id, colour FROM cl")
def cell_colours(spark, sf):
    """A colour for each cell, by rounds of independent sets: neighbours never share one."""
    c = T.cells(spark, sf)
    return sweeps.colours(c, T.edges(spark, sf)).select("cell_id", F.col("colour").cast("long").alias("colour"))


@query("owners edges settlements", f"""@ {_COLOURS}, s(k, cell_id, st) AS (SELECT 0::BIGINT, cell_id, state_id FROM owners UNION ALL
SELECT s.k + 1, s.cell_id, CASE WHEN colour = s.k AND s.st > 0 AND coalesce(near.mine, 0) < 2 AND near.n >= 2 AND s.cell_id NOT IN (SELECT cell_id FROM settlements) THEN near.top ELSE s.st END
FROM s JOIN cl USING (cell_id) LEFT JOIN (SELECT src, arg_max(st, m * 1000 - st) AS top, max(m) AS n, max(m) FILTER (WHERE st = own) AS mine FROM
  (SELECT e.src, o.st, a.st AS own, count(*) AS m FROM edges e JOIN s o ON o.cell_id = e.dst JOIN s a ON a.cell_id = e.src WHERE o.st > 0 GROUP BY ALL) GROUP BY src) near ON near.src = s.cell_id
WHERE s.k <= (SELECT max(colour) FROM cl)) SELECT cell_id, st AS state_id FROM s WHERE k = (SELECT max(colour) + 1 FROM cl)""")
def swept_states(spark, sf):
    """Boundary normalisation in which later cells see earlier ones, by sweeps over colours; cells with settlements keep their state."""
    c, e = T.cells(spark, sf), T.edges(spark, sf)
    towns = T.settlements(spark, sf).select("cell_id", F.lit(True).alias("_town")).distinct()
    own = T.owners(c).select("cell_id", "state_id").join(towns, "cell_id", "left").select("cell_id", "state_id", F.coalesce("_town", F.lit(False)).alias("fixed"))
    return sweeps.swept(own, e, "state_id", sweeps.colours(c, e))


# Edits in order


@query("cells edges edits", """@ log AS (SELECT *, row_number() OVER (ORDER BY edit_id) AS k FROM edits WHERE op IN ('set_height', 'adjust_height', 'smooth')),
st(cell_id, h, k) USING KEY (cell_id) AS (SELECT cell_id, height::DOUBLE, 0::BIGINT FROM cells UNION
  SELECT l.cell_id, CASE l.op WHEN 'set_height' THEN greatest(l.delta, 0)::DOUBLE WHEN 'adjust_height' THEN greatest(o.h + l.delta, 0) ELSE greatest(0, least(100, (o.h + (o.h + coalesce(sum(n.h), 0)) / (1 + count(n.h))) / 2)) END, l.k
  FROM (SELECT max(k) AS k FROM st) now JOIN log l ON l.k = now.k + 1 JOIN recurring.st o ON o.cell_id = l.cell_id LEFT JOIN edges e ON e.src = l.cell_id LEFT JOIN recurring.st n ON n.cell_id = e.dst GROUP BY l.cell_id, l.op, l.delta, o.h, l.k)
SELECT cell_id, round(h, 4) AS height FROM st""")
def ordered_edits(spark, sf):
    """All edits of heights in their order, smooth ones in their place: each sees what its cell and the neighbours are at that moment."""
    h = edits.fold_ordered(T.cells(spark, sf), T.edits(spark, sf), T.edges(spark, sf))
    return h.select("cell_id", F.round("height", 4).alias("height"))


# Snapshots


@query("cells owners settlements rivers rain maps", """SELECT 'maps' AS name, count(*) AS n, sum(map_id)::BIGINT AS ids FROM maps UNION ALL SELECT 'cultures', count(*), sum(r_regionkey + 1)::BIGINT FROM region UNION ALL SELECT 'religions', 3, 6 UNION ALL SELECT 'states', count(*), sum(n_nationkey + 1)::BIGINT FROM nation
UNION ALL SELECT 'settlements', count(*), sum(id)::BIGINT FROM settlements UNION ALL SELECT 'rivers', count(*), sum(river_id)::BIGINT FROM rivers UNION ALL SELECT 'climate', count(*), sum(precip)::BIGINT FROM rain UNION ALL SELECT 'cells', count(*), sum(height)::BIGINT FROM cells
UNION ALL SELECT 'biomes', count(DISTINCT height // 10), sum(DISTINCT height // 10)::BIGINT FROM cells""")
def stored_world(spark, sf):
    """A whole world, saved with its keys checked, pinned by a reader, saved again over it, and read: what the reader pinned is what it gets."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/world-{uuid.uuid4().hex}"
    c, one = T.cells(spark, sf), F.lit(1).cast("long").alias("map_id")
    named = lambda rows, key, ident: store.conform(f"{ident}s", rows.select((F.col(key) + 1).cast("long").alias(f"{ident}_id"), F.lit(None).cast("string").alias("name")), f"{ident}_id").select(one, "*")
    religions = T.owners(c).where("religion_id > 0").select("religion_id").distinct()
    world = {
        "maps": T.maps(spark, sf).select(F.col("map_id").cast("long").alias("map_id"), "name"),
        "cultures": named(T.table(spark, sf, "region"), "r_regionkey", "culture"),
        "religions": store.conform("religions", religions, "religion_id").select(one, "*"),
        "states": named(T.table(spark, sf, "nation"), "n_nationkey", "state"),
        "settlements": T.settlements(spark, sf).select(one, "id", "cell_id", (F.col("state_id") + 1).alias("state_id"), (F.col("culture_id") + 1).alias("culture_id"), F.lit(0).alias("version")),
        "rivers": T.river_cells(spark, sf).select(one, "river_id", "seq", "cell_id"),
        "biomes": store.conform("biomes", c.select(F.expr("cast(height div 10 as long)").alias("biome_id")).distinct(), "biome_id").select(one, "*"),
        "climate": T.precipitation(spark, sf).select(one, "cell_id", "precip"),
        "cells": c.join(T.owners(c), "cell_id").select(one, "cell_id", "x", "y", "height", "state_id", "culture_id", "religion_id"),
    }
    store.save_world(world, path, "v1")
    pinned = store.pin(spark, path)
    store.save_world({k: v.limit(0) for k, v in world.items()}, path, "v1")
    what = {"maps": "map_id", "cultures": "culture_id", "religions": "religion_id", "states": "state_id", "settlements": "id", "rivers": "river_id", "biomes": "biome_id", "climate": "precip", "cells": "height"}
    each = [store.read(spark, path, t, pinned).agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.sum(k).cast("long").alias("ids")) for t, k in what.items()]
    out = each[0]
    for e in each[1:]:
        out = out.union(e)
    return out
