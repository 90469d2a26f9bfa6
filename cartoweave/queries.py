"""The registry of world queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartoweave.functions import environment as E
from cartoweave.functions import geometry as G
from cartoweave.functions import society as S
from cartoweave.operators import edits as D
from cartoweave.operators import graph as N
from cartoweave.operators import names, spacing, spatial
from cartoweave.plans.fixpoint import settle, stems
from cartoweave.plans.ranks import ranked
from cartoweave.session import broadcast_by_measure
from cartoweave.sources import generator
from cartoweave.sources import tables as T

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The world's tables as SQL; each may use those before it.
WORLD = {
    "n": "n AS (SELECT count(*) AS n FROM part)",
    "cells": "cells AS (SELECT p_partkey AS cell_id, p_partkey % 40 AS x, p_partkey // 40 AS y, p_size * 2 AS height, (p_partkey % 40 IN (0, 39) OR p_partkey < 40 OR p_partkey + 40 >= n OR p_partkey + 1 >= n) AS is_border FROM part, n)",
    "edges": "edges AS (SELECT a.cell_id AS src, b.cell_id AS dst FROM cells a JOIN cells b ON b.x = a.x + 1 AND b.y = a.y UNION ALL SELECT a.cell_id, b.cell_id FROM cells a JOIN cells b ON b.x = a.x - 1 AND b.y = a.y UNION ALL SELECT a.cell_id, b.cell_id FROM cells a JOIN cells b ON b.x = a.x AND b.y = a.y + 1 UNION ALL SELECT a.cell_id, b.cell_id FROM cells a JOIN cells b ON b.x = a.x AND b.y = a.y - 1)",
    "rain": "rain AS (SELECT p_partkey AS cell_id, least(255, coalesce(sum(l_quantity)::BIGINT, 0) // 5)::BIGINT AS precip FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1)",
    "settlements": "settlements AS (SELECT c_custkey AS id, (c_custkey * 7) % n AS cell_id, (c_custkey * 7) % n % 40 AS x, (c_custkey * 7) % n // 40 AS y, floor(c_acctbal)::BIGINT + 1000 AS population, c_nationkey AS state_id, n_regionkey AS culture_id, c_custkey = min(c_custkey) OVER (PARTITION BY c_nationkey) AS is_capital, CASE WHEN floor(c_acctbal) + 1000 > 8000 THEN 'city' WHEN floor(c_acctbal) + 1000 > 4000 THEN 'town' ELSE 'village' END AS kind, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey, n)",
    "owners": "owners AS (SELECT cell_id, CASE WHEN height >= 20 THEN cell_id % 25 + 1 ELSE 0 END::BIGINT AS state_id, CASE WHEN height >= 20 THEN (cell_id // 7) % 5 + 1 ELSE 0 END::BIGINT AS culture_id, CASE WHEN height >= 20 THEN (cell_id // 3) % 4 ELSE 0 END::BIGINT AS religion_id FROM cells)",
    "rivers": "rivers AS (SELECT r.*, x, y, height FROM (SELECT l_orderkey AS river_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq, l_partkey AS cell_id FROM lineitem) r JOIN cells USING (cell_id))",
    "edits": "edits AS (SELECT event_id AS edit_id, ts, user_id AS editor, CASE event_type WHEN 'click' THEN 'adjust_height' WHEN 'view' THEN 'set_height' WHEN 'purchase' THEN 'smooth' WHEN 'signup' THEN 'set_biome' ELSE 'noop' END AS op, event_id % n AS cell_id, floor(value)::BIGINT AS delta FROM events, n)",
    "maps": "maps AS (SELECT r_regionkey AS map_id, r_name AS name, coalesce(c, 0)::BIGINT AS n_nations FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY 1) ON r_regionkey = n_regionkey)",
    "lat": "lat AS (SELECT cell_id, x, y, height, 90 - (y * 180) // (n // 40) AS lat FROM cells, n)",
}
NEEDS = {"cells": "n", "edges": "cells", "settlements": "n", "owners": "cells", "rivers": "cells", "edits": "n", "lat": "cells"}


def query(tables: str = "", sql: str | None = None):
    """Register a query under its function's name, with its SQL over the named world tables."""

    def put(f):
        @wraps(f)
        def measured(spark, sf):
            broadcast_by_measure(spark)
            return f(spark, sf)

        QUERIES[f.__name__] = measured
        if sql:
            want: set = set()
            todo = tables.split()
            while todo:
                t = todo.pop()
                want.add(t)
                todo.extend(NEEDS[t].split() if t in NEEDS and not NEEDS[t] in want else [])
            ctes = [WORLD[t] for t in WORLD if t in want]
            SQL[f.__name__] = (f"WITH RECURSIVE {', '.join(ctes)}" + (", " if sql.lstrip().startswith("@") else " ") if ctes else "") + sql.lstrip().removeprefix("@")
        return f

    return put


def _lat(spark, sf):
    n = T.count_cells(spark, sf)
    return T.cells(spark, sf).withColumn("lat", 90 - F.floor(F.col("y") * 180 / (n // T.WIDTH)))


def _regions(spark, sf, cells, kind):
    return N.regions(cells, T.edges(spark, sf), kind)


def _distance(spark, sf):
    return N.distance_field(T.cells(spark, sf), T.edges(spark, sf))


# Sources and lookups


@query("settlements", "SELECT id, cell_id, population, state_id, x, y FROM settlements WHERE x BETWEEN 5 AND 30 AND y BETWEEN 2 AND 400 AND population >= 1500 AND kind IN ('town', 'city') ORDER BY population DESC, id LIMIT 100")
def settlements_in_region(spark, sf):
    s = spatial.in_region(T.settlements(spark, sf), (5, 2, 30, 400), F.col("population") >= 1500, F.col("kind").isin("town", "city"))
    return s.orderBy(F.desc("population"), "id").limit(100).select("id", "cell_id", "population", "state_id", "x", "y")


@query("maps", "SELECT map_id, name, n_nations FROM maps WHERE name = 'ASIA' OR map_id = 3")
def map_by_id_or_name(spark, sf):
    return T.maps(spark, sf).where((F.col("name") == "ASIA") | (F.col("map_id") == 3))


@query("maps", "SELECT map_id, name, n_nations FROM maps ORDER BY map_id DESC LIMIT 50")
def newest_maps(spark, sf):
    return T.maps(spark, sf).orderBy(F.desc("map_id")).limit(50)


@query("maps", "SELECT map_id, name FROM maps ORDER BY map_id DESC LIMIT 1")
def latest_map(spark, sf):
    return T.maps(spark, sf).orderBy(F.desc("map_id")).limit(1).select("map_id", "name")


@query("cells", "SELECT cell_id, 'POINT(' || x || ' ' || y || ')' AS wkt, height FROM cells WHERE x BETWEEN 3 AND 9 AND y BETWEEN 0 AND 100")
def spatial_scan(spark, sf):
    c = spatial.in_region(T.cells(spark, sf), (3, 0, 9, 100))
    return c.select("cell_id", G.wkt_point(F.col("x"), F.col("y")).alias("wkt"), "height")


@query("rivers", "SELECT river_id, 'LINESTRING(' || string_agg(x || ' ' || y, ',' ORDER BY seq) || ')' AS wkt FROM rivers GROUP BY river_id HAVING count(*) >= 2")
def viewer_rivers(spark, sf):
    return D.ordered_path(T.river_cells(spark, sf), "river_id").select("river_id", G.wkt_line(F.col("path")).alias("wkt"))


_PITCH = 25  # of the grid of jittered places, one for each cell

_JITTER = "((((cell_id * 48271 + {}) % 2147483647 * 16807 % 2147483647) // 7 % 65536) / 65535.0::DOUBLE * 2 - 1) * 25 * 0.45::DOUBLE"


@query("cells n", f"""SELECT cell_id, height, round(least(1000.0, greatest(0.0, 12.5 + x * 25 + {_JITTER.format(7)})), 2) AS x, round(least(n // 40 * 25.0, greatest(0.0, 12.5 + y * 25 + {_JITTER.format(984)})), 2) AS y FROM cells, n""")
def jittered_grid(spark, sf):
    """Each cell of the world with a place of its own on a jittered grid."""
    rows = T.count_cells(spark, sf) // T.WIDTH
    return generator.jittered(T.cells(spark, sf).select("cell_id", "height"), T.WIDTH * _PITCH, rows * _PITCH, _PITCH, 7)


@query("cells", """@ s AS (SELECT (max(x) + 1) * 25 AS w, (max(y) + 1) * 25 AS h FROM cells), p AS (SELECT w, h, ceil((w + 50) / 50.0)::BIGINT - 1 AS nx, ceil((h + 50) / 50.0)::BIGINT - 1 AS ny FROM s)
SELECT ceil((w + 50) * (i + 0.5::DOUBLE) / nx - 25)::BIGINT AS x, CASE WHEN k = 0 THEN -25 ELSE h + 25 END::BIGINT AS y FROM (SELECT *, unnest(range(nx)) AS i FROM p), range(2) t(k) UNION ALL
SELECT CASE WHEN k = 0 THEN -25 ELSE w + 25 END::BIGINT, ceil((h + 50) * (i + 0.5::DOUBLE) / ny - 25)::BIGINT FROM (SELECT *, unnest(range(ny)) AS i FROM p), range(2) t(k)""")
def boundary_points(spark, sf):
    """The points around the world's cells, from their extent."""
    most = T.cells(spark, sf).agg(F.max("x"), F.max("y")).first()
    return generator.boundary_points(spark, (most[0] + 1) * _PITCH, (most[1] + 1) * _PITCH, _PITCH).select("x", "y")


@query("edges", "SELECT src, dst FROM edges")
def cell_edges(spark, sf):
    return T.edges(spark, sf)


_LINES = ", ".join(f"({k}, '{n}', {i}, '{line.split()[0]}', '{' '.join(line.split()[1:])}')" for k, (n, p) in enumerate(generator.TEMPLATES.items()) for i, line in enumerate(p))


@query("maps", f"SELECT map_id, t.name, seq, command, args FROM maps JOIN (VALUES {_LINES}) t(k, name, seq, command, args) ON k = map_id % {len(generator.TEMPLATES)}")
def template_commands(spark, sf):
    """The program of each map, split into commands."""
    name = F.element_at(F.array(*[F.lit(t) for t in generator.TEMPLATES]), (F.col("map_id") % len(generator.TEMPLATES) + 1).cast("int"))
    return T.maps(spark, sf).select("map_id", name.alias("name")).join(generator.templates(spark), "name").select("map_id", "name", "seq", "command", F.array_join("args", " ").alias("args"))


@query()
def heightmap_worlds(spark, sf):
    """One heightmap for each map; random, so there is no SQL."""
    seeds = T.maps(spark, sf).select(F.col("map_id").cast("long").alias("map_id"), F.element_at(F.array(*[F.lit(t) for t in generator.TEMPLATES]), F.col("map_id") % len(generator.TEMPLATES) + 1).alias("template"), (F.col("map_id") + 17).alias("seed"))
    return generator.heightmaps(seeds, 40, 30)


@query("cells edges", """@ coast AS (SELECT DISTINCT a.cell_id AS node, a.height >= 20 AS land FROM cells a JOIN edges e ON e.src = a.cell_id JOIN cells b ON b.cell_id = e.dst WHERE (a.height >= 20) <> (b.height >= 20)),
inside AS (SELECT e.src, e.dst, a.height >= 20 AS land FROM edges e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst WHERE (a.height >= 20) = (b.height >= 20)),
bfs(node, d) USING KEY (node) AS (SELECT node, 1 FROM coast UNION SELECT i.dst, min(b.d + 1) FROM bfs b JOIN inside i ON i.src = b.node LEFT JOIN recurring.bfs r ON r.node = i.dst WHERE r.node IS NULL AND (i.land OR b.d < 10) GROUP BY i.dst),
f AS (SELECT c.*, coalesce(CASE WHEN c.height >= 20 THEN d ELSE -d END, 0) AS distance FROM cells c LEFT JOIN bfs ON node = cell_id),
kept AS (SELECT * FROM f WHERE (height >= 20 OR distance IN (-1, -2)) AND (distance <> -2 OR cell_id % 4 <> 0))
SELECT cell_id AS grid_id, x::DOUBLE AS x, y::DOUBLE AS y, height FROM kept UNION ALL
SELECT a.cell_id, round((a.x + b.x) / 2.0::DOUBLE, 1), round((a.y + b.y) / 2.0::DOUBLE, 1), a.height FROM edges e JOIN kept a ON a.cell_id = e.src JOIN kept b ON b.cell_id = e.dst WHERE e.src < e.dst AND abs(a.distance) = 1 AND a.distance = b.distance""")
def packed_cells(spark, sf):
    c, e = T.cells(spark, sf), T.edges(spark, sf)
    return generator.packed(c, _distance(spark, sf), e, 1.0)


@query("", "SELECT p_size AS base, trim(s) AS name FROM (SELECT p_size, unnest(string_split(p_name, ' ')) AS s FROM part) WHERE trim(s) <> ''")
def name_lists(spark, sf):
    return names.split_names(T.table(spark, sf, "part").select(F.col("p_size").alias("base"), F.col("p_name").alias("names")), " ")


# Projections


@query("lat rain", f"""@ t AS (SELECT lat.*, precip, trunc(least(greatest(CASE WHEN lat BETWEEN -20 AND 16 THEN 25 - abs(lat) * 0.15::DOUBLE WHEN lat > 0 THEN 22.6::DOUBLE - (lat - 16) * ((22.6::DOUBLE + 30) / 74) ELSE 22.0::DOUBLE + (lat + 20) * ((22.0::DOUBLE + 30) / 70) END
  - CASE WHEN height < 20 THEN 0.0::DOUBLE ELSE round_even(power((height - 18)::DOUBLE, 1.5::DOUBLE) / 1000 * 6.5::DOUBLE, 1) END, -128.0::DOUBLE), 127.0::DOUBLE))::INT AS temperature FROM lat JOIN rain USING (cell_id))
SELECT cell_id, lat::BIGINT AS lat, height, temperature, precip, CASE WHEN height < 20 THEN 0 WHEN height >= 70 THEN 17 WHEN temperature <= -10 THEN 4 ELSE
  ([{", ".join(str(list(r)) for r in E.MATRIX)}])[(temperature >= -10)::INT + (temperature >= 5)::INT + (temperature >= 15)::INT + (temperature >= 25)::INT + (temperature >= 35)::INT + 1][(precip >= 20)::INT + (precip >= 50)::INT + (precip >= 100)::INT + (precip >= 180)::INT + 1] END::INT AS biome FROM t""")
def climate_and_biomes(spark, sf):
    c = _lat(spark, sf).join(T.precipitation(spark, sf), "cell_id").withColumn("temperature", E.temperature(F.col("lat"), F.col("height")))
    return c.select("cell_id", "lat", "height", "temperature", "precip", E.biome(F.col("height"), F.col("temperature"), F.col("precip")).alias("biome"))


@query("lat", """SELECT cell_id, ([225, 135, 225, 225, 135, 225])[least(abs(lat - 89) // 30, 5) + 1] AS wind, ([4.0, 2.0, 2.0, 1.0, 1.0, 2.0, 2.0, 2.0, 2.0, 3.0, 3.0, 2.0, 2.0, 1.0, 1.0, 1.0, 0.5])[greatest(least(floor((abs(lat) - 1) / 5.0)::INT, 16), 0) + 1]::DOUBLE AS rain_factor,
 ([225, 135, 225, 225, 135, 225])[least(abs(lat - 89) // 30, 5) + 1] BETWEEN 41 AND 139 AS is_west, ([225, 135, 225, 225, 135, 225])[least(abs(lat - 89) // 30, 5) + 1] BETWEEN 101 AND 259 AS is_north FROM lat""")
def winds(spark, sf):
    c = _lat(spark, sf).withColumn("tier", E.wind_tier(F.col("lat")))
    d = E.wind_directions(F.col("tier"))
    return c.select("cell_id", E.pick(E.WINDS, F.col("tier")).alias("wind"), E.latitude_rain(F.col("lat")).alias("rain_factor"), d["is_west"].alias("is_west"), d["is_north"].alias("is_north"))


_TERRAIN = "CASE WHEN height < 20 THEN 'water' WHEN height > 100 THEN 'mountain' WHEN height > 50 THEN 'hill' ELSE 'lowland' END"


@query("cells", f"SELECT cell_id, greatest(coalesce(height, 0) * 5, 1) AS z, {_TERRAIN} AS terrain_type, CASE WHEN height < 20 THEN '#4169E1' WHEN height > 100 THEN '#8B4513' WHEN height > 50 THEN '#228B22' ELSE '#90EE90' END AS color FROM cells")
def terrain_layer(spark, sf):
    h = F.col("height")
    kind = F.when(h < 20, "water").when(h > 100, "mountain").when(h > 50, "hill").otherwise("lowland")
    color = F.when(h < 20, "#4169E1").when(h > 100, "#8B4513").when(h > 50, "#228B22").otherwise("#90EE90")
    return T.cells(spark, sf).select("cell_id", F.greatest(F.coalesce(h, F.lit(0)) * 5, F.lit(1)).alias("z"), kind.alias("terrain_type"), color.alias("color"))


@query("settlements", "SELECT id, name, CASE WHEN is_capital THEN 500 WHEN kind = 'city' THEN 300 WHEN kind = 'town' THEN 200 ELSE 100 END AS radius, CASE WHEN is_capital THEN 100 WHEN kind = 'city' THEN 60 WHEN kind = 'town' THEN 40 ELSE 20 END AS z, CASE WHEN is_capital THEN '#FF0000' WHEN kind = 'city' THEN '#FFA500' WHEN kind = 'town' THEN '#FFD700' ELSE '#8B4513' END AS color, CASE WHEN is_capital THEN 'capital' ELSE kind END AS settlement_class FROM settlements")
def settlement_layer(spark, sf):
    by = lambda a, b, c, d: F.when(F.col("is_capital"), a).when(F.col("kind") == "city", b).when(F.col("kind") == "town", c).otherwise(d)
    return T.settlements(spark, sf).select("id", "name", by(500, 300, 200, 100).alias("radius"), by(100, 60, 40, 20).alias("z"), by("#FF0000", "#FFA500", "#FFD700", "#8B4513").alias("color"), by("capital", "city", "town", "village").alias("settlement_class"))


def _discharge(spark, sf):
    r = T.river_cells(spark, sf).join(T.precipitation(spark, sf), "cell_id")
    return r.groupBy("river_id").agg(F.sum("precip").alias("discharge"), F.count("*").alias("n_cells"))


_DISCHARGE = "q AS (SELECT river_id, sum(precip)::BIGINT AS discharge, count(*) AS n_cells FROM rivers JOIN rain USING (cell_id) GROUP BY river_id)"


@query("rivers rain", f"@ {_DISCHARGE} SELECT river_id, discharge, greatest(discharge / 50.0::DOUBLE, 5.0::DOUBLE) AS width, CASE WHEN discharge > 1000 THEN 'major' WHEN discharge > 100 THEN 'medium' ELSE 'minor' END AS river_class FROM q WHERE discharge > 5")
def river_layer(spark, sf):
    q = F.col("discharge")
    return _discharge(spark, sf).where(q > 5).select("river_id", "discharge", F.greatest(q / 50.0, F.lit(5.0)).alias("width"), F.when(q > 1000, "major").when(q > 100, "medium").otherwise("minor").alias("river_class"))


@query("owners edges", "SELECT e.src, e.dst, a.culture_id AS owner, b.culture_id AS other FROM edges e JOIN owners a ON a.cell_id = e.src JOIN owners b ON b.cell_id = e.dst WHERE a.culture_id <> 0 AND a.culture_id <> b.culture_id")
def culture_borders(spark, sf):
    return spatial.boundary(T.owners(T.cells(spark, sf)), T.edges(spark, sf), "culture_id")


@query("cells", "SELECT cell_id, height, height >= 20 AS is_land FROM cells")
def all_land_and_water(spark, sf):
    """Every cell is land or water."""
    return T.cells(spark, sf).select("cell_id", "height", (F.col("height") >= T.SEA).alias("is_land"))


@query("", "SELECT p_partkey AS cell_id, p_type FROM part WHERE p_type NOT LIKE '%STEEL%' AND p_size BETWEEN 10 AND 20")
def pattern_filter(spark, sf):
    p = T.table(spark, sf, "part").where(~F.col("p_type").like("%STEEL%") & F.col("p_size").between(10, 20))
    return p.select(F.col("p_partkey").alias("cell_id"), "p_type")


@query("cells", "SELECT cell_id, CASE WHEN height BETWEEN 20 AND 100 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, (height + 5.0::DOUBLE - 20) * 0.8::DOUBLE + 20)) ELSE height::DOUBLE END AS height FROM cells")
def modified_heights(spark, sf):
    return T.cells(spark, sf).select("cell_id", D.modify(F.col("height"), 20, 100, add=5, multiply=0.8, pivot=20).alias("height"))


@query("cells n", "@ m AS (SELECT cell_id, height, (1 - power(2 * x / 40.0::DOUBLE - 1, 2)) * (1 - power(2 * y / (n // 40)::DOUBLE - 1, 2)) AS d FROM cells, n) SELECT cell_id, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (height * 2 + height * d) / 3)), 6) AS height FROM m")
def masked_heights(spark, sf):
    n = T.count_cells(spark, sf)
    part = lambda c, size: 1 - F.pow(2 * F.col(c) / float(size) - 1, F.lit(2))
    h = F.col("height")
    new = (h * 2 + h * (part("x", T.WIDTH) * part("y", n // T.WIDTH))) / 3
    return T.cells(spark, sf).select("cell_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), new)), 6).alias("height"))


@query("cells", "SELECT a.cell_id, b.height FROM cells a JOIN cells b ON b.x = 39 - a.x AND b.y = a.y")
def mirrored_heights(spark, sf):
    c = T.cells(spark, sf)
    return c.select("cell_id", (F.col("y") * T.WIDTH + T.WIDTH - 1 - F.col("x")).alias("m")).join(c.select(F.col("cell_id").alias("m"), "height"), "m").select("cell_id", "height")


# Joins


@query("", f"WITH {', '.join(WORLD[t] for t in ('n', 'cells', 'settlements', 'owners'))}, b AS (@CLIMATE@) SELECT s.id, nullif(o.culture_id, 0) AS culture_id, r_name AS culture_name, nullif(o.religion_id, 0) AS religion_id, nullif(o.state_id, 0) AS state_id, n_name AS state_name, b.biome AS biome_id, ({list(E.BIOMES)})[b.biome + 1] AS biome_name FROM settlements s LEFT JOIN owners o USING (cell_id) LEFT JOIN region ON r_regionkey = o.culture_id - 1 AND o.culture_id > 0 LEFT JOIN nation ON n_nationkey = o.state_id - 1 AND o.state_id > 0 LEFT JOIN b USING (cell_id)".replace("@CLIMATE@", SQL["climate_and_biomes"]))
def territories_at_points(spark, sf):
    """The culture, religion, state and biome at each point, null where there is none."""
    culture = T.table(spark, sf, "region").select((F.col("r_regionkey") + 1).cast("long").alias("culture_id"), F.col("r_name").alias("culture_name"))
    state = T.table(spark, sf, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("state_id"), F.col("n_name").alias("state_name"))
    points = T.settlements(spark, sf).select("id", "cell_id")
    found = spatial.territories(points, T.owners(T.cells(spark, sf)), {"culture": culture, "state": state})
    found = found.join(climate_and_biomes(spark, sf).select("cell_id", F.col("biome").alias("biome_id")), "cell_id", "left")
    return found.select("id", "culture_id", "culture_name", F.nullif("religion_id", F.lit(0)).alias("religion_id"), "state_id", "state_name", "biome_id", E.pick(E.BIOMES, F.col("biome_id")).alias("biome_name"))


@query("settlements", """@ rings AS (SELECT * FROM (VALUES (1, 2.5, 1.5, 20.5, 1.5, 20.5, 30.5, 2.5, 30.5), (2, 10.5, 3.5, 39.5, 3.5, 25.5, 49.5, 12.5, 20.5)) t(ring_id, x1, y1, x2, y2, x3, y3, x4, y4)),
sides AS (SELECT ring_id, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS by_ FROM rings UNION ALL SELECT ring_id, x2, y2, x3, y3 FROM rings UNION ALL SELECT ring_id, x3, y3, x4, y4 FROM rings UNION ALL SELECT ring_id, x4, y4, x1, y1 FROM rings)
SELECT id, ring_id FROM settlements, sides WHERE (ay > y) <> (by_ > y) AND x < (bx - ax)::DOUBLE * (y - ay)::DOUBLE / (by_ - ay)::DOUBLE + ax::DOUBLE GROUP BY id, ring_id HAVING count(*) % 2 = 1""")
def points_in_rings(spark, sf):
    rings = spark.createDataFrame([(1, [(2.5, 1.5), (20.5, 1.5), (20.5, 30.5), (2.5, 30.5)]), (2, [(10.5, 3.5), (39.5, 3.5), (25.5, 49.5), (12.5, 20.5)])], "ring_id int, ring array<struct<x:double,y:double>>")
    return spatial.polygon_join(T.settlements(spark, sf), rings, 16.0).select("id", "ring_id")


@query("settlements owners", "SELECT o.culture_id, count(DISTINCT o.cell_id) AS area, count(s.id) AS n_settlements FROM owners o LEFT JOIN settlements s USING (cell_id) WHERE o.culture_id > 0 GROUP BY o.culture_id")
def settlements_per_culture(spark, sf):
    per_cell = T.settlements(spark, sf).groupBy("cell_id").agg(F.count("*").alias("n"))
    o = T.owners(T.cells(spark, sf)).where("culture_id > 0").join(per_cell, "cell_id", "left")
    return o.groupBy("culture_id").agg(F.count("*").alias("area"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_settlements"))


@query("rivers", """@ g AS (SELECT river_id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM rivers WINDOW w AS (PARTITION BY river_id ORDER BY seq)),
k AS (SELECT *, [(x2 - x) * (c.cy - y) - (y2 - y) * (c.cx - x) FOR c IN [{'cx': 10, 'cy': 5}, {'cx': 10, 'cy': 8}, {'cx': 14, 'cy': 5}, {'cx': 14, 'cy': 8}]] AS side FROM g)
SELECT DISTINCT river_id FROM k WHERE (x BETWEEN 10 AND 14 AND y BETWEEN 5 AND 8) OR (x2 IS NOT NULL AND greatest(x, x2) >= 10 AND least(x, x2) <= 14 AND greatest(y, y2) >= 5 AND least(y, y2) <= 8 AND list_min(side) <= 0 AND list_max(side) >= 0)""")
def rivers_in_box(spark, sf):
    """Rivers that touch the box, also those that cross it between two of their points."""
    return spatial.lines_in_box(T.river_cells(spark, sf), "river_id", (10, 5, 14, 8))


@query("", f"WITH {', '.join(WORLD[t] for t in ('n', 'cells', 'settlements'))}, b AS ({SQL['climate_and_biomes']}), p AS (SELECT id, x, y FROM settlements WHERE is_capital UNION ALL SELECT -1, -100, -100) SELECT p.id, count(b.cell_id) AS sample_count, round(avg(b.temperature), 6) AS temperature_c, round(avg(b.precip), 6) AS precipitation_mm FROM p LEFT JOIN cells c ON abs(c.x - p.x) <= 3 AND abs(c.y - p.y) <= 3 AND (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) <= 9 LEFT JOIN b ON b.cell_id = c.cell_id GROUP BY p.id")
def climate_within_radius(spark, sf):
    """Mean temperature and rain of the samples around each capital, and around a point off the map, which has none."""
    capitals = T.settlements(spark, sf).where("is_capital").select("id", "x", "y")
    points = capitals.unionByName(spark.createDataFrame([(-1, -100, -100)], "id long, x long, y long"))
    c = T.cells(spark, sf).select("cell_id", "x", "y").join(climate_and_biomes(spark, sf).select("cell_id", "temperature", "precip"), "cell_id")
    near = spatial.radius_join(points, c, 3, "left")
    return near.groupBy("id").agg(F.count("cell_id_r").alias("sample_count"), F.round(F.avg("temperature_r"), 6).alias("temperature_c"), F.round(F.avg("precip_r"), 6).alias("precipitation_mm"))


@query("cells", "SELECT a.cell_id, round(avg(b.height), 4) AS mean FROM cells a JOIN cells b ON b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4 GROUP BY a.cell_id")
def mean_within_radius(spark, sf):
    c = T.cells(spark, sf).select("cell_id", "x", "y", "height")
    return spatial.radius_join(c, c, 2).groupBy("cell_id").agg(F.round(F.avg("height_r"), 4).alias("mean"))


@query("cells settlements", "SELECT cell_id FROM cells WHERE height >= 20 AND cell_id NOT IN (SELECT cell_id FROM settlements)")
def empty_land(spark, sf):
    return D.missing(T.cells(spark, sf).where("height >= 20").select("cell_id"), T.settlements(spark, sf))


@query("cells owners", "@ k AS (SELECT c.cell_id, x, y FROM cells c JOIN owners USING (cell_id) WHERE culture_id = 2), m AS (SELECT avg(x) AS mx, avg(y) AS my FROM k) SELECT c.cell_id, round(sqrt(power(x - mx, 2) + power(y - my, 2)), 4) AS distance FROM cells c JOIN owners o USING (cell_id), m WHERE culture_id <> 2 AND EXISTS (SELECT 1 FROM k WHERE (k.x - c.x) * (k.x - c.x) + (k.y - c.y) * (k.y - c.y) <= 9) ORDER BY sqrt(power(x - mx, 2) + power(y - my, 2)), cell_id LIMIT 20")
def expansion_candidates(spark, sf):
    """Cells near a culture that it does not own, nearest its centre first."""
    c = T.cells(spark, sf).join(T.owners(T.cells(spark, sf)), "cell_id").select("cell_id", "x", "y", "culture_id")
    own = c.where("culture_id = 2").select("cell_id", "x", "y")
    centre = own.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    near = spatial.radius_join(c.where("culture_id <> 2"), own, 3, "left_semi").crossJoin(F.broadcast(centre))  # one row
    d = F.sqrt(F.pow(F.col("x") - F.col("mx"), F.lit(2)) + F.pow(F.col("y") - F.col("my"), F.lit(2)))
    return near.withColumn("d", d).orderBy("d", "cell_id").limit(20).select("cell_id", F.round("d", 4).alias("distance"))


@query("settlements", "@ d AS (SELECT a.id, b.id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM settlements a JOIN settlements b ON a.id <> b.id AND abs(a.x - b.x) <= 12 AND abs(a.y - b.y) <= 12 WHERE a.is_capital) SELECT id, other, place, round(sqrt(d2), 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS place FROM d WHERE d2 <= 144) WHERE place <= 3")
def nearest_settlements(spark, sf):
    s = T.settlements(spark, sf)
    pairs = spatial.radius_join(s.where("is_capital").select("id", "x", "y"), s.select("id", "x", "y"), 12).where("id <> id_r")
    w = Window.partitionBy("id").orderBy("distance", "id_r")
    return pairs.withColumn("place", F.row_number().over(w)).where("place <= 3").select("id", F.col("id_r").alias("other"), "place", F.round("distance", 4).alias("distance"))


@query("settlements", "@ d AS (SELECT a.id, b.id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM settlements a JOIN settlements b ON a.id <> b.id WHERE a.is_capital) SELECT id, other, place, round(sqrt(d2), 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS place FROM d) WHERE place <= 3")
def closest_settlements(spark, sf):
    """The three nearest others of each capital, however far they are."""
    s = T.settlements(spark, sf).select("id", "x", "y")
    capitals = T.settlements(spark, sf).where("is_capital").select("id", "x", "y")
    found = spatial.closest(capitals, s, "id", "id", 3, 12, F.col("id") != F.col("id_r"))
    return found.select("id", F.col("id_r").alias("other"), "place", F.round("distance", 4).alias("distance"))


@query("settlements n", "SELECT id, (least(greatest(floor((x + 0.25) / 2)::BIGINT, 0), 19) + least(greatest(floor((y + 0.25) / 2)::BIGINT, 0), (n // 40 + 1) // 2 - 1) * 20)::BIGINT AS coarse FROM settlements, n")
def coarse_cell(spark, sf):
    high = -(-(T.count_cells(spark, sf) // T.WIDTH) // 2)
    return T.settlements(spark, sf).select("id", spatial.cell_at(F.col("x") + 0.25, F.col("y") + 0.25, 2, T.WIDTH // 2, high).alias("coarse"))


@query("cells edges", "SELECT a.cell_id, min(b.cell_id) AS haven, count(*) AS harbor, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))::DOUBLE AS distance FROM cells a JOIN edges e ON e.src = a.cell_id JOIN cells b ON b.cell_id = e.dst WHERE a.height >= 20 AND b.height < 20 GROUP BY a.cell_id")
def havens(spark, sf):
    """The nearest water next to coastal land, ties to the least cell, its distance, and the number of water sides."""
    c = T.cells(spark, sf)
    wet = N.neighbours(c, T.edges(spark, sf), "x", "y", "height").where("height < 20").select("src", "dst", F.col("x").alias("_x"), F.col("y").alias("_y"))
    land = c.where("height >= 20").select("cell_id", "x", "y").join(wet, F.col("cell_id") == F.col("src"))
    far = G.distance(F.col("x"), F.col("y"), F.col("_x"), F.col("_y"))
    found = land.groupBy("cell_id").agg(F.min(F.struct(far.alias("d"), F.col("dst").alias("c"))).alias("h"), F.count("*").alias("harbor"))
    return found.select("cell_id", F.col("h.c").alias("haven"), "harbor", F.col("h.d").alias("distance"))


@query("cells edges", """@ land AS (SELECT e.src, e.dst FROM edges e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst WHERE (a.height >= 20) = (b.height >= 20)),
cc(cell_id, region) USING KEY (cell_id) AS (SELECT cell_id, cell_id FROM cells UNION SELECT l.dst, min(c.region) FROM cc c JOIN land l ON l.src = c.cell_id JOIN recurring.cc r ON r.cell_id = l.dst WHERE c.region < r.region GROUP BY l.dst)
SELECT cell_id, region, CASE WHEN bool_or(height >= 20) OVER w THEN 'island' WHEN bool_or(is_border) OVER w THEN 'ocean' ELSE 'lake' END AS feature FROM cc JOIN cells c USING (cell_id) WINDOW w AS (PARTITION BY region)""")
def feature_cells(spark, sf):
    """The feature that each cell belongs to."""
    c = T.cells(spark, sf).withColumn("land", F.col("height") >= 20)
    r = _regions(spark, sf, c, "land").select("cell_id", "region")
    return r.join(N.features(c, r).select("region", "feature"), "region").select("cell_id", "region", "feature")


_RIVERS = "rc AS (SELECT DISTINCT l_partkey AS cell_id, true AS on_river FROM lineitem)"


def _on_river(spark, sf):
    return T.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("cell_id")).distinct().withColumn("on_river", F.lit(True))


@query("", "SELECT a.n_name AS state, r_name AS culture, count(c_custkey) AS n FROM nation a JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def state_dimension(spark, sf):
    n = T.table(spark, sf, "nation").join(T.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = T.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return n.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("state"), F.col("r_name").alias("culture"), F.coalesce("n", F.lit(0)).alias("n"))


# Aggregates


@query("settlements owners rivers cells", "SELECT (SELECT count(*) FROM cells) AS n_cells, (SELECT count(*) FROM settlements) AS n_settlements, (SELECT sum(population)::BIGINT FROM settlements) AS population, (SELECT name FROM settlements ORDER BY population DESC, id LIMIT 1) AS largest, (SELECT count(DISTINCT river_id) FROM rivers) AS n_rivers, (SELECT count(*) FROM cells WHERE height >= 20) AS land_area, (SELECT count(DISTINCT culture_id) FROM owners WHERE culture_id > 0) AS n_cultures")
def map_statistics(spark, sf):
    c = T.cells(spark, sf)
    s = T.settlements(spark, sf).agg(F.count("*").alias("n_settlements"), F.coalesce(F.sum("population"), F.lit(0)).alias("population"), F.max_by("name", F.struct("population", -F.col("id"))).alias("largest"))
    a = c.agg(F.count("*").alias("n_cells"), F.count_if(F.col("height") >= 20).alias("land_area"))
    o = T.owners(c).where("culture_id > 0").agg(F.countDistinct("culture_id").alias("n_cultures"))
    r = T.table(spark, sf, "lineitem").agg(F.countDistinct("l_orderkey").alias("n_rivers"))
    return a.crossJoin(s).crossJoin(o).crossJoin(r)  # one row each


@query("cells settlements rivers", "SELECT 'terrain' AS layer, count(*) AS n, min(x)::BIGINT AS x0, min(y)::BIGINT AS y0, max(x)::BIGINT AS x1, max(y)::BIGINT AS y1 FROM cells UNION ALL SELECT 'settlements', count(*), min(x), min(y), max(x), max(y) FROM settlements UNION ALL SELECT 'rivers', count(DISTINCT river_id), min(x), min(y), max(x), max(y) FROM rivers")
def layer_summary(spark, sf):
    def row(name, d, n):
        return d.agg(n.alias("n"), *[f(k).cast("long").alias(f"{k}{i}") for i, f in enumerate((F.min, F.max)) for k in ("x", "y")]).select(F.lit(name).alias("layer"), "n", "x0", "y0", "x1", "y1")

    return row("terrain", T.cells(spark, sf), F.count("*")).unionByName(row("settlements", T.settlements(spark, sf), F.count("*"))).unionByName(row("rivers", T.river_cells(spark, sf), F.countDistinct("river_id")))


_BIOME_SQL = SQL["climate_and_biomes"]


@query("", f"WITH b AS ({_BIOME_SQL}) SELECT biome, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS percentage, round(avg(temperature), 4) AS temperature, round(avg(precip), 4) AS precip, ([{', '.join(map(str, E.HABITABILITY))}])[biome + 1] AS habitability, ([{', '.join(map(str, E.MOVEMENT))}])[biome + 1] AS movement FROM b GROUP BY biome")
def biome_statistics(spark, sf):
    b = climate_and_biomes(spark, sf).groupBy("biome").agg(F.count("*").alias("n"), F.round(F.avg("temperature"), 4).alias("temperature"), F.round(F.avg("precip"), 4).alias("precip"))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4)  # one row a biome, eighteen at most
    return b.select("biome", "n", share.alias("percentage"), "temperature", "precip", E.pick(E.HABITABILITY, F.col("biome")).alias("habitability"), E.pick(E.MOVEMENT, F.col("biome")).alias("movement"))


@query("", f"""WITH {', '.join(WORLD[t] for t in ('n', 'cells', 'edges', 'settlements', 'owners'))}, fc AS ({SQL['feature_cells']}), h AS ({SQL['havens']}), {_RIVERS}, pp AS (SELECT cell_id, sum(population)::BIGINT AS p FROM settlements GROUP BY 1),
c AS (SELECT o.culture_id, count(*) AS n, count(h.cell_id) AS coastal, count(*) FILTER (WHERE height > 60) AS high, count(*) FILTER (WHERE fc.feature = 'lake') AS lake, count(on_river) AS river, coalesce(sum(p), 0)::BIGINT AS people
 FROM owners o JOIN cells USING (cell_id) LEFT JOIN h USING (cell_id) LEFT JOIN fc ON fc.cell_id = h.haven LEFT JOIN rc ON rc.cell_id = o.cell_id LEFT JOIN pp ON pp.cell_id = o.cell_id WHERE o.culture_id > 0 GROUP BY 1)
SELECT culture_id, n, CASE WHEN coastal > 0.4 * n THEN 'Naval' WHEN high > 0.5 * n THEN 'Highland' WHEN lake > 0.3 * n THEN 'Lake' WHEN river > 0.4 * n THEN 'River' WHEN people < 2000 * n THEN 'Nomadic' ELSE 'Generic' END AS type FROM c""")
def culture_types(spark, sf):
    """The type of each culture by the shares of its cells: coast, highland, lake shore, river, and then its people a cell, in thousands."""
    c = T.cells(spark, sf)
    h = havens(spark, sf).select("cell_id", F.col("haven").alias("_haven"))
    lake = feature_cells(spark, sf).select(F.col("cell_id").alias("_haven"), "feature")
    people = T.settlements(spark, sf).groupBy("cell_id").agg(F.sum("population").alias("p"))
    o = T.owners(c).where("culture_id > 0").select("cell_id", "culture_id").join(c.select("cell_id", "height"), "cell_id")
    o = o.join(h, "cell_id", "left").join(lake, "_haven", "left").join(_on_river(spark, sf), "cell_id", "left").join(people, "cell_id", "left")
    a = o.groupBy("culture_id").agg(F.count("*").alias("n"), F.count("_haven").alias("coastal"), F.count_if(F.col("height") > 60).alias("high"), F.count_if(F.col("feature") == "lake").alias("lake"), F.count("on_river").alias("river"), F.coalesce(F.sum("p"), F.lit(0)).alias("people"))
    n = F.col("n")
    kind = F.when(F.col("coastal") > 0.4 * n, "Naval").when(F.col("high") > 0.5 * n, "Highland").when(F.col("lake") > 0.3 * n, "Lake").when(F.col("river") > 0.4 * n, "River").when(F.col("people") < 2000 * n, "Nomadic").otherwise("Generic")
    return a.select("culture_id", "n", kind.alias("type"))


@query("owners", "@ c AS (SELECT state_id, religion_id, count(*) AS n FROM owners WHERE state_id > 0 AND religion_id > 0 GROUP BY state_id, religion_id) SELECT state_id, religion_id, n FROM (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY n DESC, religion_id) AS k FROM c) WHERE k = 1")
def dominant_religion(spark, sf):
    n = T.owners(T.cells(spark, sf)).where("state_id > 0 AND religion_id > 0").groupBy("state_id", "religion_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("state_id").orderBy(F.desc("n"), "religion_id")
    return n.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


@query("cells edges", "SELECT a.cell_id, round(greatest(0.0, least(100.0, (a.height + (a.height + coalesce(sum(b.height), 0)) / (1 + count(b.cell_id))::DOUBLE) / 2)), 6) AS height FROM cells a LEFT JOIN edges e ON e.src = a.cell_id LEFT JOIN cells b ON b.cell_id = e.dst GROUP BY a.cell_id, a.height")
def smoothed_heights(spark, sf):
    return N.smooth(T.cells(spark, sf), T.edges(spark, sf)).select("cell_id", F.round("height", 6).alias("height"))


@query("", f"""WITH b AS ({_BIOME_SQL}), k AS (SELECT *, precip::DOUBLE AS flux, ([{', '.join(map(str, E.HABITABILITY))}])[biome + 1] AS hab FROM b), m AS (SELECT median(flux) FILTER (WHERE height >= 20 AND flux > 0) AS md, max(flux) AS mx FROM k)
SELECT cell_id, round(CASE WHEN height < 20 OR hab = 0 THEN 0.0 ELSE hab + coalesce(least(1.0, flux / md) * (1 - md / mx) * 250, 0.0) - (height - 50) / 5.0 - 5 END, 4)::DOUBLE AS score FROM k, m""")
def suitability(spark, sf):
    b = climate_and_biomes(spark, sf)
    scale = b.agg(F.median(F.when((F.col("height") >= 20) & (F.col("precip") > 0), F.col("precip").cast("double"))).alias("md"), F.max("precip").alias("mx"))
    k = b.crossJoin(F.broadcast(scale))  # one row
    s = E.suitability(E.pick(E.HABITABILITY, F.col("biome")), F.col("precip").cast("double"), F.col("md"), F.col("mx"), F.col("height"), F.lit(False), F.lit(False), F.lit(None))
    return k.select("cell_id", F.round(s, 4).alias("score"))


@query("", f"""WITH {', '.join(WORLD[t] for t in ('n', 'cells', 'owners'))}, sc AS ({SQL['suitability']}) SELECT religion_id, count(*) AS area, round(coalesce(sum(greatest(score, 0) / 100) FILTER (WHERE t.cell_id IS NOT NULL), 0), 3)::DOUBLE AS urban, round(coalesce(sum(greatest(score, 0) / 100) FILTER (WHERE t.cell_id IS NULL), 0), 3)::DOUBLE AS rural FROM owners o JOIN sc USING (cell_id) LEFT JOIN (SELECT DISTINCT (c_custkey * 7) % n AS cell_id FROM customer, n) t USING (cell_id) WHERE religion_id > 0 GROUP BY religion_id""")
def religion_statistics(spark, sf):
    """Followers of each religion, that is the people its cells can feed, of cells with and without a settlement."""
    towns = T.settlements(spark, sf).select("cell_id").distinct().withColumn("town", F.lit(True))
    o = T.owners(T.cells(spark, sf)).where("religion_id > 0").join(suitability(spark, sf), "cell_id").join(towns, "cell_id", "left")
    people = F.greatest("score", F.lit(0.0)) / 100
    split = lambda c: F.round(F.coalesce(F.sum(F.when(c, people)), F.lit(0.0)), 3)
    return o.groupBy("religion_id").agg(F.count("*").alias("area"), split(F.col("town").isNotNull()).alias("urban"), split(F.col("town").isNull()).alias("rural"))


@query("cells", "SELECT cell_id, height, row_number() OVER (ORDER BY height DESC, cell_id)::BIGINT AS place FROM cells WHERE height >= 20 ORDER BY place")
def ranked_land(spark, sf):
    """All land, highest first."""
    land = T.cells(spark, sf).where("height >= 20").select("cell_id", "height")
    return ranked(land, F.desc("height"), F.col("cell_id")).orderBy("place")


@query("", f"SELECT cell_id, score, row_number() OVER (ORDER BY score DESC, cell_id)::BIGINT AS place FROM ({SQL['suitability']}) ORDER BY place")
def ranked_cells(spark, sf):
    """All cells by suitability, best first."""
    return ranked(suitability(spark, sf), F.desc("score"), F.col("cell_id")).orderBy("place")


# Rivers


_STEPS = "s AS (SELECT *, sqrt(power(lead(x) OVER w - x, 2) + power(lead(y) OVER w - y, 2)) AS run, abs(lead(height) OVER w - height) AS fall FROM rivers WINDOW w AS (PARTITION BY river_id ORDER BY seq))"


@query("rivers", f"@ {_STEPS} SELECT river_id, count(*) AS n_cells, round(coalesce(sum(run), 0) * 1.5, 4)::DOUBLE AS length, round(coalesce(sum(fall) FILTER (WHERE run > 0) / nullif(sum(run), 0), 0.001), 6)::DOUBLE AS slope, round(sqrt(power(arg_max(x, seq) - arg_min(x, seq), 2) + power(arg_max(y, seq) - arg_min(y, seq), 2)), 4) AS source_distance FROM s GROUP BY river_id")
def river_geometry(spark, sf):
    s = D.steps(T.river_cells(spark, sf))
    end = lambda f, c: f(c, "seq")
    a = s.groupBy("river_id").agg(F.count("*").alias("n_cells"), F.coalesce(F.sum("run"), F.lit(0.0)).alias("run"), F.sum(F.when(F.col("run") > 0, F.col("drop"))).alias("fall"), *[end(f, c).alias(f"{c}{i}") for i, f in enumerate((F.min_by, F.max_by)) for c in ("x", "y")])
    slope = F.coalesce(F.col("fall") / F.nullif("run", F.lit(0.0)), F.lit(0.001))
    return a.select("river_id", "n_cells", F.round(F.col("run") * 1.5, 4).alias("length"), F.round(slope, 6).alias("slope"), F.round(G.distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), 4).alias("source_distance"))


@query("rivers rain", f"@ {_DISCHARGE}, {_STEPS}, g AS (SELECT river_id, greatest(coalesce(sum(fall) FILTER (WHERE run > 0) / nullif(sum(run), 0), 0.001), 0.001) AS slope FROM s GROUP BY river_id) SELECT river_id, discharge, round(CASE WHEN discharge <= 0 THEN 0.0 ELSE greatest(2.3 * sqrt(discharge) * power(0.001 / slope, 0.2), 1.0) END, 4)::DOUBLE AS width FROM q JOIN g USING (river_id) ORDER BY discharge DESC, river_id")
def rivers_by_discharge(spark, sf):
    """All rivers, largest first."""
    s = D.steps(T.river_cells(spark, sf)).groupBy("river_id").agg(F.sum("run").alias("run"), F.sum(F.when(F.col("run") > 0, F.col("drop"))).alias("fall"))
    slope = F.greatest(F.coalesce(F.col("fall") / F.nullif("run", F.lit(0.0)), F.lit(0.001)), F.lit(0.001))
    q = F.col("discharge")
    width = F.when(q <= 0, 0.0).otherwise(F.greatest(2.3 * F.sqrt(q) * F.pow(0.001 / slope, F.lit(0.2)), F.lit(1.0)))
    return _discharge(spark, sf).join(s, "river_id").select("river_id", "discharge", F.round(width, 4).alias("width")).orderBy(F.desc("discharge"), "river_id")


@query("rivers", "SELECT a.river_id, min(b.river_id) AS parent_id FROM (SELECT river_id, arg_max(cell_id, seq) AS mouth FROM rivers GROUP BY 1) a LEFT JOIN rivers b ON b.cell_id = a.mouth AND b.river_id < a.river_id GROUP BY a.river_id")
def river_parents(spark, sf):
    """The least river with a smaller id through the cell where a river ends."""
    r = T.river_cells(spark, sf).select("river_id", "seq", "cell_id")
    mouths = r.groupBy("river_id").agg(F.max_by("cell_id", "seq").alias("mouth"))
    # a river's parent is the least river through its mouth, if that is not itself
    first = r.groupBy(F.col("cell_id").alias("mouth")).agg(F.min("river_id").alias("p"))
    return mouths.join(first, "mouth").select("river_id", F.when(F.col("p") < F.col("river_id"), F.col("p")).alias("parent_id"))


# The graph


@query("cells edges", """@ land AS (SELECT e.src, e.dst FROM edges e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst WHERE (a.height >= 20) = (b.height >= 20)),
cc(cell_id, region) USING KEY (cell_id) AS (SELECT cell_id, cell_id FROM cells UNION SELECT l.dst, min(c.region) FROM cc c JOIN land l ON l.src = c.cell_id JOIN recurring.cc r ON r.cell_id = l.dst WHERE c.region < r.region GROUP BY l.dst)
SELECT region, CASE WHEN bool_or(height >= 20) THEN 'island' WHEN bool_or(is_border) THEN 'ocean' ELSE 'lake' END AS feature, count(*) AS n_cells, bool_or(is_border) AS touches_border, min(c.cell_id) AS first_cell FROM cc JOIN cells c USING (cell_id) GROUP BY region""")
def map_features(spark, sf):
    c = T.cells(spark, sf).withColumn("land", F.col("height") >= 20)
    return N.features(c, _regions(spark, sf, c, "land"))


@query("cells edges", """@ coast AS (SELECT DISTINCT a.cell_id AS node FROM cells a JOIN edges e ON e.src = a.cell_id JOIN cells b ON b.cell_id = e.dst WHERE (a.height >= 20) <> (b.height >= 20)),
inside AS (SELECT e.src, e.dst, a.height >= 20 AS land FROM edges e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst WHERE (a.height >= 20) = (b.height >= 20)),
bfs(node, d) USING KEY (node) AS (SELECT node, 1 FROM coast UNION SELECT i.dst, min(b.d + 1) FROM bfs b JOIN inside i ON i.src = b.node LEFT JOIN recurring.bfs r ON r.node = i.dst WHERE r.node IS NULL AND (i.land OR b.d < 10) GROUP BY i.dst)
SELECT cell_id, coalesce(CASE WHEN height >= 20 THEN d ELSE -d END, 0)::BIGINT AS distance FROM cells LEFT JOIN bfs ON node = cell_id""")
def distance_field(spark, sf):
    return _distance(spark, sf)


@query("", f"""WITH RECURSIVE d AS ({SQL['distance_field']}), {', '.join(WORLD[t] for t in ('n', 'cells', 'edges'))}
SELECT c.cell_id, round(c.height + CASE WHEN c.height >= 20 THEN d.distance / 100.0::DOUBLE + coalesce(avg(o.distance), 0) / 10000.0::DOUBLE ELSE 0 END, 8)::DOUBLE AS height FROM cells c JOIN d USING (cell_id) LEFT JOIN edges e ON e.src = c.cell_id LEFT JOIN d o ON o.cell_id = e.dst GROUP BY c.cell_id, c.height, d.distance""")
def altered_heights(spark, sf):
    return N.altered(T.cells(spark, sf), _distance(spark, sf), T.edges(spark, sf)).select("cell_id", F.round("height", 8).alias("height"))


def _drained(spark, sf):
    c = T.cells(spark, sf).join(T.precipitation(spark, sf), "cell_id").select("cell_id", "height", "is_border", "precip").checkpoint()
    return _drains(c, T.edges(spark, sf))


def _drains(c, e):
    """cell_id, filled, to, flux."""
    filled = N.flood(c, e).checkpoint()
    flow = N.flow_direction(filled, e).checkpoint()
    return filled.join(flow, "cell_id").join(N.accumulate(flow, c), "cell_id")


_DRAIN = """f(cell_id, v) USING KEY (cell_id) AS (SELECT cell_id, height FROM cells WHERE is_border UNION SELECT e.dst, min(greatest(c.height, f.v)) FROM f JOIN edges e ON e.src = f.cell_id JOIN cells c ON c.cell_id = e.dst LEFT JOIN recurring.f r ON r.cell_id = e.dst WHERE r.v IS NULL OR r.v > greatest(c.height, f.v) GROUP BY e.dst),
fl AS (SELECT a.cell_id, a.v AS filled, coalesce(arg_min(b.cell_id, b.v * 1000000 + b.cell_id) FILTER (WHERE b.v < a.v), -1) AS "to" FROM f a LEFT JOIN edges e ON e.src = a.cell_id LEFT JOIN f b ON b.cell_id = e.dst GROUP BY ALL),
walk(origin, node) AS (SELECT cell_id, cell_id FROM fl UNION ALL SELECT w.origin, fl."to" FROM walk w JOIN fl ON fl.cell_id = w.node WHERE fl."to" >= 0),
fx AS (SELECT node AS cell_id, sum(precip)::BIGINT AS flux FROM walk JOIN rain ON rain.cell_id = origin GROUP BY node)"""


@query("cells edges rain", f'@ {_DRAIN} SELECT fl.cell_id, filled::BIGINT AS filled, "to", flux FROM fl JOIN fx USING (cell_id)')
def drainage(spark, sf):
    """Priority flood, flow direction and accumulated rain."""
    return _drained(spark, sf)


@query("cells edges rain", f"""@ {_DRAIN}, l AS (SELECT flux FROM fx JOIN cells USING (cell_id) WHERE height >= 20) SELECT (SELECT median(flux) FROM l WHERE flux > 0) AS median, (SELECT max(flux) FROM fx) AS most""")
def flux_scale(spark, sf):
    """The median of the positive flux on land, and the largest flux."""
    r = _drained(spark, sf).select("cell_id", "flux").join(T.cells(spark, sf).select("cell_id", "height"), "cell_id")
    return r.agg(F.median(F.when((F.col("height") >= 20) & (F.col("flux") > 0), F.col("flux"))).alias("median"), F.max("flux").alias("most"))


@query("cells edges rain", f"""@ {_DRAIN}, big AS (SELECT fl.cell_id, "to", flux FROM fl JOIN fx USING (cell_id) WHERE flux >= 400),
main AS (SELECT "to" AS cell_id, arg_min(cell_id, (-flux)::BIGINT * 1000000 + cell_id) AS above FROM big WHERE "to" >= 0 GROUP BY "to"),
nm(cell_id, river_id) AS (SELECT cell_id, cell_id FROM big WHERE cell_id NOT IN (SELECT cell_id FROM main) UNION ALL SELECT m.cell_id, nm.river_id FROM nm JOIN main m ON m.above = nm.cell_id)
SELECT river_id, count(*) AS n_cells, max(flux)::BIGINT AS discharge FROM nm JOIN big USING (cell_id) GROUP BY river_id""")
def drained_rivers(spark, sf):
    d = _drained(spark, sf)
    r = N.rivers(d.select("cell_id", "to"), d.select("cell_id", "flux"), 400)
    return r.join(d, "cell_id").groupBy("river_id").agg(F.count("*").alias("n_cells"), F.max("flux").alias("discharge"))


@query("cells edges rain", f"""@ d AS ({SQL['distance_field']}),
h AS (SELECT c.cell_id, is_border, c.height + CASE WHEN c.height >= 20 THEN any_value(d.distance) / 100.0::DOUBLE + coalesce(avg(o.distance), 0.0::DOUBLE) / 10000.0::DOUBLE ELSE 0.0::DOUBLE END AS height FROM cells c JOIN d USING (cell_id) LEFT JOIN edges e ON e.src = c.cell_id LEFT JOIN d o ON o.cell_id = e.dst GROUP BY c.cell_id, c.height, is_border),
f(cell_id, v) USING KEY (cell_id) AS (SELECT cell_id, height FROM h WHERE is_border UNION SELECT e.dst, min(greatest(h.height, f.v)) FROM f JOIN edges e ON e.src = f.cell_id JOIN h ON h.cell_id = e.dst LEFT JOIN recurring.f r ON r.cell_id = e.dst WHERE r.v IS NULL OR r.v > greatest(h.height, f.v) GROUP BY e.dst),
lo AS (SELECT a.cell_id, b.cell_id AS low, row_number() OVER (PARTITION BY a.cell_id ORDER BY b.v, b.cell_id) AS k FROM f a JOIN edges e ON e.src = a.cell_id JOIN f b ON b.cell_id = e.dst WHERE b.v < a.v),
fl AS (SELECT f.cell_id, coalesce(low, -1) AS "to" FROM f LEFT JOIN lo ON lo.cell_id = f.cell_id AND k = 1),
walk(origin, node) AS (SELECT cell_id, cell_id FROM fl UNION ALL SELECT w.origin, fl."to" FROM walk w JOIN fl ON fl.cell_id = w.node WHERE fl."to" >= 0),
big AS (SELECT fl.cell_id, "to", flux FROM fl JOIN (SELECT node AS cell_id, sum(precip)::BIGINT AS flux FROM walk JOIN rain ON rain.cell_id = origin GROUP BY node) USING (cell_id) WHERE flux >= 400),
main AS (SELECT "to" AS cell_id, arg_min(cell_id, (-flux)::BIGINT * 1000000 + cell_id) AS above FROM big WHERE "to" >= 0 GROUP BY "to"),
nm(cell_id, river_id) AS (SELECT cell_id, cell_id FROM big WHERE cell_id NOT IN (SELECT cell_id FROM main) UNION ALL SELECT m.cell_id, nm.river_id FROM nm JOIN main m ON m.above = nm.cell_id JOIN big ON big.cell_id = m.cell_id),
sz AS (SELECT river_id, count(*) AS n_cells, max(flux)::BIGINT AS discharge FROM nm JOIN big USING (cell_id) GROUP BY river_id HAVING count(*) >= 3),
en AS (SELECT nm.river_id, p.river_id AS parent_id FROM nm JOIN big USING (cell_id) LEFT JOIN main ON main.cell_id = big."to" LEFT JOIN nm p ON p.cell_id = big."to" WHERE main.above IS NULL OR main.above <> big.cell_id OR p.river_id IS NULL)
SELECT sz.river_id, kept.river_id AS parent_id, sz.n_cells, sz.discharge FROM sz LEFT JOIN en ON en.river_id = sz.river_id LEFT JOIN sz kept ON kept.river_id = en.parent_id""")
def long_rivers(spark, sf):
    """Rivers of three cells or more over altered heights."""
    e = T.edges(spark, sf)
    high = N.altered(T.cells(spark, sf), _distance(spark, sf), e).join(T.precipitation(spark, sf), "cell_id").select("cell_id", "height", "is_border", "precip").checkpoint()
    d = _drains(high, e)
    r = N.rivers(d.select("cell_id", "to"), d.select("cell_id", "flux"), 400, 3)
    return r.join(d, "cell_id").groupBy("river_id", "parent_id").agg(F.count("*").alias("n_cells"), F.max("flux").alias("discharge"))


@query("cells edges rain", f"""@ {_DRAIN}, k AS (SELECT c.cell_id, CASE WHEN flux > 0 AND filled > height THEN filled ELSE -1 END AS kind, filled, "to" = -1 AND flux > 15 AND NOT is_border AND filled > height AS sink, height FROM fl JOIN fx USING (cell_id) JOIN cells c USING (cell_id)),
inside AS (SELECT e.src, e.dst FROM edges e JOIN k a ON a.cell_id = e.src JOIN k b ON b.cell_id = e.dst WHERE a.kind = b.kind),
cc(cell_id, region) USING KEY (cell_id) AS (SELECT cell_id, cell_id FROM k UNION SELECT l.dst, min(c.region) FROM cc c JOIN inside l ON l.src = c.cell_id JOIN recurring.cc r ON r.cell_id = l.dst WHERE c.region < r.region GROUP BY l.dst),
m AS (SELECT region, arg_min(k.cell_id, k.height * 1000000 + k.cell_id) AS outlet, min(beyond)::BIGINT AS shore FROM (SELECT a.cell_id, a.region, kb.height AS beyond FROM cc a JOIN edges e ON e.src = a.cell_id JOIN cc b ON b.cell_id = e.dst JOIN k kb ON kb.cell_id = e.dst WHERE a.region <> b.region) z JOIN k ON k.cell_id = z.cell_id GROUP BY region)
SELECT region AS lake, filled::BIGINT AS level, count(*) AS n_cells, outlet, shore FROM cc JOIN k USING (cell_id) LEFT JOIN m USING (region) GROUP BY region, filled, outlet, shore HAVING count(*) >= 3 AND bool_or(sink)""")
def lakes(spark, sf):
    """Each lake with its level, size, outlet, and the least height on its shore."""
    d = _drained(spark, sf).join(T.cells(spark, sf).select("cell_id", "height", "is_border"), "cell_id").withColumn("kind", N.lake_kind())
    return N.lakes(d, _regions(spark, sf, d, "kind"), T.edges(spark, sf))


@query("cells edges", """@ costs AS (SELECT cell_id, CASE WHEN height >= 20 THEN 10 + height // 10 + CASE WHEN height > 70 THEN 50 ELSE 0 END END AS cost FROM cells),
x(cell_id, v) USING KEY (cell_id) AS (SELECT cell_id, min((cell_id // 97) + 1) FROM cells WHERE cell_id % 97 = 13 AND height >= 20 GROUP BY cell_id UNION SELECT e.dst, min(x.v + cost * 1048576) FROM x JOIN edges e ON e.src = x.cell_id JOIN costs c ON c.cell_id = e.dst LEFT JOIN recurring.x r ON r.cell_id = e.dst WHERE cost IS NOT NULL AND x.v // 1048576 + cost <= 120 AND (r.v IS NULL OR r.v > x.v + cost * 1048576) GROUP BY e.dst)
SELECT cell_id, (v // 1048576)::BIGINT AS cost, (v % 1048576)::BIGINT AS owner FROM x""")
def expanded_cultures(spark, sf):
    c = T.cells(spark, sf)
    seeds = c.where("cell_id % 97 = 13 AND height >= 20").select("cell_id", (F.expr("cell_id div 97") + 1).alias("owner"))
    h = F.col("height")
    costs = c.select("cell_id", F.when(h >= 20, 10 + F.expr("height div 10") + F.when(h > 70, 50).otherwise(0)).cast("long").alias("cost"))
    return N.expand(seeds, costs, T.edges(spark, sf), 120)


@query("owners edges", """@ near AS (SELECT e.src, o.state_id, count(*) AS n FROM edges e JOIN owners o ON o.cell_id = e.dst WHERE o.state_id > 0 GROUP BY ALL), top AS (SELECT src, arg_max(state_id, n * 1000 - state_id) AS s, max(n) AS n FROM near GROUP BY src)
SELECT o.cell_id, CASE WHEN o.state_id > 0 AND coalesce(m.n, 0) < 2 AND top.n >= 2 THEN top.s ELSE o.state_id END::BIGINT AS state_id FROM owners o LEFT JOIN top ON top.src = o.cell_id LEFT JOIN near m ON m.src = o.cell_id AND m.state_id = o.state_id""")
def normalised_states(spark, sf):
    return N.vote(T.owners(T.cells(spark, sf)).select("cell_id", "state_id"), T.edges(spark, sf), "state_id")


@query("owners edges", """@ big AS (SELECT state_id FROM owners WHERE state_id > 0 GROUP BY 1 HAVING count(*) >= 7), near AS (SELECT e.src, o.state_id, count(*) AS n FROM edges e JOIN owners o ON o.cell_id = e.dst JOIN big USING (state_id) GROUP BY ALL), top AS (SELECT src, arg_max(state_id, n * 1000 - state_id) AS s FROM near GROUP BY src)
SELECT o.cell_id, CASE WHEN o.state_id = 0 OR o.state_id IN (SELECT state_id FROM big) THEN o.state_id ELSE coalesce(s, 0) END::BIGINT AS state_id FROM owners o LEFT JOIN top ON top.src = o.cell_id""")
def absorbed_states(spark, sf):
    return N.absorb_small(T.owners(T.cells(spark, sf)).select("cell_id", "state_id"), T.edges(spark, sf), "state_id", 7)


@query("owners edges", "SELECT o.cell_id, count(*) FILTER (WHERE p.state_id = o.state_id) AS buddies, count(*) FILTER (WHERE p.state_id NOT IN (0, o.state_id)) AS adversaries, sum(CASE WHEN p.state_id = 0 THEN 0 WHEN p.state_id = o.state_id THEN 3 WHEN p.culture_id = o.culture_id THEN 2 ELSE 1 END)::BIGINT AS alignment FROM owners o JOIN edges e ON e.src = o.cell_id JOIN owners p ON p.cell_id = e.dst WHERE o.state_id > 0 GROUP BY o.cell_id")
def neighbour_counts(spark, sf):
    o = T.owners(T.cells(spark, sf))
    n = T.edges(spark, sf).join(o.select(F.col("cell_id").alias("dst"), F.col("state_id").alias("s2"), F.col("culture_id").alias("c2")), "dst")
    k = n.join(o.where("state_id > 0"), F.col("src") == F.col("cell_id"))
    score = F.when(F.col("s2") == 0, 0).when(F.col("s2") == F.col("state_id"), 3).when(F.col("c2") == F.col("culture_id"), 2).otherwise(1)
    return k.groupBy("cell_id").agg(F.count_if(F.col("s2") == F.col("state_id")).alias("buddies"), F.count_if((F.col("s2") != 0) & (F.col("s2") != F.col("state_id"))).alias("adversaries"), F.sum(score).cast("long").alias("alignment"))


@query("settlements", """@ c AS (SELECT id, x, y, row_number() OVER (ORDER BY population DESC, id) AS k FROM settlements),
g(k, taken) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, x BIGINT, y BIGINT)[] UNION ALL SELECT c.k, CASE WHEN len(list_filter(g.taken, lambda t: (t.x - c.x) * (t.x - c.x) + (t.y - c.y) * (t.y - c.y) < 36)) = 0 THEN list_append(g.taken, {'id': c.id, 'x': c.x, 'y': c.y}) ELSE g.taken END FROM g JOIN c ON c.k = g.k + 1)
SELECT unnest(taken).id AS id FROM (SELECT taken FROM g ORDER BY k DESC LIMIT 1)""")
def spaced_capitals(spark, sf):
    """Greedy choice by population with a least distance."""
    s = T.settlements(spark, sf).select("id", "x", "y", (-F.col("population")).alias("rank"))
    return spacing.spaced(s, 6.0).select("id")


_LINES = f"""b AS ({SQL['climate_and_biomes']}), z AS ({SQL['winds']}), r AS (SELECT c.cell_id, x, y, c.height AS h, temperature, wind, rain_factor, is_west, is_north, wind > 220 AND wind < 320 AS is_east, wind > 280 OR wind < 80 AS is_south FROM cells c JOIN b USING (cell_id) JOIN z USING (cell_id)),
wide AS (SELECT max(x) AS mx, max(y) AS my, bool_or(is_north) AS north, bool_or(is_south) AS south FROM r),
l AS (SELECT 'w' || y AS line, x AS place, cell_id, h, temperature, least(120 * rain_factor, 255.0)::DOUBLE AS most FROM r WHERE is_west UNION ALL SELECT 'e' || y, mx - x, cell_id, h, temperature, least(120 * rain_factor, 255.0)::DOUBLE FROM r, wide WHERE is_east
 UNION ALL SELECT 'n' || x, y, cell_id, h, temperature, 60.0::DOUBLE FROM r, wide WHERE north UNION ALL SELECT 's' || x, my - y, cell_id, h, temperature, 60.0::DOUBLE FROM r, wide WHERE south),
s AS (SELECT *, lead(h) OVER w AS nh, lead(cell_id) OVER w AS nc, row_number() OVER w - 1 AS k FROM l WINDOW w AS (PARTITION BY line ORDER BY place)),
a(line, k, air) AS (SELECT line, k, most - h FROM s WHERE k = 0 AND most - h > 0 UNION ALL SELECT s.line, s.k + 1, CASE WHEN temperature < -5 OR (h < 20 AND (nh IS NULL OR nh >= 20)) THEN air WHEN h < 20 THEN least(air + 5, most) WHEN nh IS NULL THEN 0.0
  WHEN nh > 85 THEN 0.0 ELSE greatest(air - least(greatest(air / 10, 1.0::DOUBLE) + greatest(nh - h, 0)::DOUBLE * ((nh / 70.0::DOUBLE) * (nh / 70.0::DOUBLE)), air) + CASE WHEN least(greatest(air / 10, 1.0::DOUBLE) + greatest(nh - h, 0)::DOUBLE * ((nh / 70.0::DOUBLE) * (nh / 70.0::DOUBLE)), air) > 1.5 THEN 1 ELSE 0 END, 0.0::DOUBLE) END::DOUBLE FROM a JOIN s USING (line, k)),
d AS (SELECT CASE WHEN h < 20 AND nh >= 20 THEN nc ELSE cell_id END AS cell_id, floor(CASE WHEN h < 20 AND nh >= 20 THEN greatest(air / 15, 1.0::DOUBLE) WHEN h < 20 THEN 5.0 WHEN nh IS NULL THEN air WHEN nh > 85 THEN air ELSE least(greatest(air / 10, 1.0::DOUBLE) + greatest(nh - h, 0)::DOUBLE * ((nh / 70.0::DOUBLE) * (nh / 70.0::DOUBLE)), air) END)::BIGINT AS rain
 FROM a JOIN s USING (line, k) WHERE temperature >= -5 AND NOT (h < 20 AND nh IS NULL))"""


@query("cells", f"@ {_LINES} SELECT c.cell_id, least(coalesce(sum(rain), 0), 255)::BIGINT AS rain FROM cells c LEFT JOIN d USING (cell_id) GROUP BY c.cell_id")
def wind_rain(spark, sf):
    """Rain by winds from four sides: by rows from west or east as their latitude has it, by columns if any row has a north or south wind."""
    c = T.cells(spark, sf).select("cell_id", "x", "y", "height").join(climate_and_biomes(spark, sf).select("cell_id", "lat", "temperature"), "cell_id")
    d = E.wind_directions(E.wind_tier(F.col("lat")))
    c = c.select("*", *[d[k].alias(k) for k in d], F.least(120 * E.latitude_rain(F.col("lat")), F.lit(255.0)).alias("strength"))
    last = c.agg(F.max("x").alias("mx"), F.max("y").alias("my"), F.bool_or("is_north").alias("north"), F.bool_or("is_south").alias("south"))
    c = c.crossJoin(F.broadcast(last))  # one row
    line = lambda name, where, by, place, strength: c.where(where).select(F.concat(F.lit(name), F.col(by).cast("string")).alias("line"), place.alias("place"), "cell_id", "height", "temperature", strength.alias("strength"))
    own, sixty = F.col("strength"), F.lit(60.0)
    lines = line("w", "is_west", "y", F.col("x"), own).unionByName(line("e", "is_east", "y", F.col("mx") - F.col("x"), own))
    lines = lines.unionByName(line("n", "north", "x", F.col("y"), sixty)).unionByName(line("s", "south", "x", F.col("my") - F.col("y"), sixty))
    fallen = N.wind(lines).groupBy("cell_id").agg(F.sum("rain").alias("rain"))
    return T.cells(spark, sf).select("cell_id").join(fallen, "cell_id", "left").select("cell_id", F.least(F.coalesce("rain", F.lit(0)), F.lit(255)).cast("long").alias("rain"))


@query("cells edges rain", f"""@ {_DRAIN}, w AS (SELECT fl.cell_id, flux, max(flux) OVER () AS mx FROM fx JOIN fl USING (cell_id)) SELECT cell_id, flux > 0.8 * mx AS wet FROM w""")
def wetlands(spark, sf):
    d = _drained(spark, sf)
    most = d.agg(F.max("flux").alias("mx"))
    return d.crossJoin(F.broadcast(most)).select("cell_id", (F.col("flux") > 0.8 * F.col("mx")).alias("wet"))  # one row


@query("cells edges", """@ r(cell_id, region) USING KEY (cell_id) AS (SELECT cell_id, cell_id FROM cells UNION SELECT l.dst, min(c.region) FROM r c JOIN (SELECT e.src, e.dst FROM edges e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst WHERE a.height // 25 = b.height // 25) l ON l.src = c.cell_id JOIN recurring.r q ON q.cell_id = l.dst WHERE c.region < q.region GROUP BY l.dst),
m AS (SELECT region, height // 25 AS band, count(*) AS n_cells, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM r JOIN cells USING (cell_id) GROUP BY ALL),
k AS (SELECT region, cell_id, row_number() OVER (PARTITION BY region ORDER BY (x * n_cells - sx) * (x * n_cells - sx) + (y * n_cells - sy) * (y * n_cells - sy), cell_id) AS k FROM r JOIN cells USING (cell_id) JOIN m USING (region))
SELECT region, band, n_cells, round(sx / n_cells::DOUBLE, 4) AS cx, round(sy / n_cells::DOUBLE, 4) AS cy, cell_id AS centre FROM m JOIN k USING (region) WHERE k = 1""")
def height_regions(spark, sf):
    """Connected cells of one height band, with their size, middle, and the cell nearest to it."""
    c = T.cells(spark, sf).withColumn("band", F.expr("height div 25"))
    r = _regions(spark, sf, c, "band").join(c.select("cell_id", "x", "y"), "cell_id")
    m = r.groupBy("region", F.col("kind").cast("int").alias("band")).agg(F.count("*").alias("n_cells"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    off = lambda c: (F.col(c) * F.col("n_cells") - F.col(f"s{c}")) * (F.col(c) * F.col("n_cells") - F.col(f"s{c}"))
    centre = r.join(m, "region").groupBy("region").agg(F.min(F.struct((off("x") + off("y")).alias("d"), F.col("cell_id").alias("c"))).alias("k"))
    n = F.col("n_cells").cast("double")
    return m.join(centre, "region").select("region", "band", "n_cells", F.round(F.col("sx") / n, 4).alias("cx"), F.round(F.col("sy") / n, 4).alias("cy"), F.col("k.c").alias("centre"))


# Edits


@query("cells edits", """@ l AS (SELECT cell_id, edit_id, op, delta, row_number() OVER (PARTITION BY cell_id ORDER BY edit_id) AS k FROM edits WHERE op IN ('set_height', 'adjust_height')),
f(cell_id, k, h) AS (SELECT cell_id, 0::BIGINT, height::BIGINT FROM cells UNION ALL SELECT f.cell_id, l.k, CASE WHEN l.op = 'set_height' THEN greatest(l.delta, 0) ELSE greatest(f.h + l.delta, 0) END FROM f JOIN l ON l.cell_id = f.cell_id AND l.k = f.k + 1)
SELECT cell_id, arg_max(h, k) AS height FROM f GROUP BY cell_id""")
def edited_heights(spark, sf):
    return D.fold_heights(T.cells(spark, sf), T.edits(spark, sf))


@query("edits", "SELECT cell_id, edit_id, op, delta FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY edit_id DESC) AS k FROM edits WHERE op <> 'noop') WHERE k = 1")
def latest_edits(spark, sf):
    return D.latest(T.edits(spark, sf).where("op <> 'noop'")).select("cell_id", "edit_id", "op", "delta")


@query("edits", "SELECT op, count(*) AS n, count(DISTINCT cell_id) AS n_cells FROM edits GROUP BY op")
def edits_by_operation(spark, sf):
    return T.edits(spark, sf).groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("cell_id").alias("n_cells"))


@query("edits", "SELECT date_trunc('hour', ts) AS start, op, count(*) AS n, sum(delta)::BIGINT AS delta FROM edits GROUP BY ALL")
def edit_activity(spark, sf):
    w = F.window("ts", "1 hour")
    return T.edits(spark, sf).groupBy(w.alias("w"), "op").agg(F.count("*").alias("n"), F.sum("delta").alias("delta")).select(F.col("w.start").alias("start"), "op", "n", "delta")


@query("settlements edits", "SELECT s.id, coalesce(CASE WHEN e.op = 'set_biome' THEN greatest(e.delta, 0) END, s.population)::BIGINT AS population, CASE WHEN e.op = 'smooth' THEN s.name || '*' ELSE s.name END AS name FROM settlements s LEFT JOIN (SELECT edit_id % (SELECT count(*) FROM customer) AS id, arg_max(op, edit_id) AS op, arg_max(delta, edit_id) AS delta FROM edits GROUP BY 1) e USING (id)")
def edited_settlements(spark, sf):
    """Settlements with population set or renamed by the last edit that names them."""
    s = T.settlements(spark, sf).select("id", "population", "name")
    n = T.table(spark, sf, "customer").count()
    e = D.latest(T.edits(spark, sf).withColumn("id", F.col("edit_id") % n), "id").select("id", "op", "delta")
    changes = e.join(s.select("id", F.col("name").alias("_name")), "id").select("id", F.when(F.col("op") == "set_biome", F.greatest("delta", F.lit(0))).alias("population"), F.when(F.col("op") == "smooth", F.concat("_name", F.lit("*"))).alias("name"))
    return D.upsert(s, changes, "id")


@query("edits", "@ r AS (SELECT * FROM (VALUES ('set_height', 0, 100, 1000000, 0), ('adjust_height', -50, 50, 1000000, 1), ('smooth', 0, 1000000, 20, 2)) t(op, lowest, highest, most_cells, level)) SELECT edit_id, CASE WHEN lowest IS NULL THEN 'unknown operation' WHEN delta NOT BETWEEN lowest AND highest THEN 'value out of range' WHEN count(*) OVER (PARTITION BY editor, edits.op) > most_cells THEN 'too many cells' WHEN editor % 4 < level THEN 'not permitted' END AS reason FROM edits LEFT JOIN r ON r.op = edits.op")
def validated_edits(spark, sf):
    rules = spark.createDataFrame([("set_height", 0, 100, 1000000, 0), ("adjust_height", -50, 50, 1000000, 1), ("smooth", 0, 1000000, 20, 2)], "op string, lowest long, highest long, most_cells long, level int")
    return D.validate(T.edits(spark, sf), rules).select("edit_id", "reason")


@query("owners settlements", "SELECT CASE WHEN state_id IN (3, 4, 5) THEN 2 ELSE state_id END::BIGINT AS state_id, count(*) AS area FROM owners WHERE state_id > 0 GROUP BY 1")
def merged_states(spark, sf):
    return D.merge_owners(T.owners(T.cells(spark, sf)), "state_id", 2, [3, 4, 5]).where("state_id > 0").groupBy("state_id").agg(F.count("*").alias("area"))


@query("cells edits", "SELECT DISTINCT delta AS cell_id FROM edits WHERE delta NOT IN (SELECT cell_id FROM cells)")
def unknown_cells(spark, sf):
    return D.missing(T.edits(spark, sf).select(F.col("delta").alias("cell_id")).distinct(), T.cells(spark, sf))


@query("owners settlements", "SELECT culture_id, count(*) AS n_cells, round(coalesce(any_value(p), 0) / count(*)::DOUBLE, 4) AS per_cell FROM owners LEFT JOIN (SELECT culture_id + 1 AS culture_id, sum(population)::BIGINT AS p FROM settlements GROUP BY 1) USING (culture_id) WHERE culture_id > 0 GROUP BY culture_id")
def population_per_cell(spark, sf):
    people = T.settlements(spark, sf).groupBy((F.col("culture_id") + 1).cast("long").alias("culture_id")).agg(F.sum("population").alias("p"))
    o = T.owners(T.cells(spark, sf)).where("culture_id > 0").groupBy("culture_id").agg(F.count("*").alias("n_cells"))
    return o.join(people, "culture_id", "left").select("culture_id", "n_cells", F.round(F.coalesce("p", F.lit(0)) / F.col("n_cells").cast("double"), 4).alias("per_cell"))


@query("cells", "SELECT cell_id FROM cells WHERE height >= 20 ORDER BY (cell_id * 48271 + 5) % 2147483647 * 16807 % 2147483647 // 7 % 65536, cell_id LIMIT 25")
def sampled_cells(spark, sf):
    return T.cells(spark, sf).where("height >= 20").orderBy(generator.scrambled(5, F.col("cell_id")), "cell_id").limit(25).select("cell_id")


# Names


@query("", r"""WITH s AS (SELECT p_size AS base, regexp_extract_all(lower(w), '[^aeiou]*[aeiou]+|[^aeiou]+$') AS s FROM (SELECT p_size, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> ''),
p AS (SELECT base, list_concat([''], s) AS a, list_concat(s, ['']) AS b FROM s WHERE len(s) > 0), t AS (SELECT base, unnest(a) AS prev, unnest(b) AS next FROM p) SELECT base, prev, next, count(*) AS n FROM t GROUP BY ALL""")
def syllable_chain(spark, sf):
    rows = name_lists(spark, sf)
    s = F.regexp_extract_all(F.lower("name"), F.lit("([^aeiou]*[aeiou]+|[^aeiou]+$)"), F.lit(1))
    return names.transitions(rows, s)


@query("", f"""WITH RECURSIVE ch AS ({SQL['syllable_chain']}), wy AS (SELECT base, prev, next, (sum(n) OVER w)::BIGINT - n AS lo, (sum(n) OVER w)::BIGINT AS hi, (sum(n) OVER (PARTITION BY base, prev))::BIGINT AS total FROM ch WINDOW w AS (PARTITION BY base, prev ORDER BY next)),
tot AS (SELECT DISTINCT base, prev, total FROM wy), who AS (SELECT c_custkey::BIGINT AS id, (c_custkey % 50 + 1)::INT AS base FROM customer),
st(id, base, tries, steps, word, now, draws, name) AS (SELECT id, base, 0, 0, '', '', 0::BIGINT, NULL::VARCHAR FROM who UNION ALL
 SELECT id, base, CASE WHEN over THEN tries + 1 ELSE tries END, CASE WHEN over THEN 0 ELSE steps + 1 END, CASE WHEN over THEN '' ELSE grown END, CASE WHEN over THEN '' ELSE next END, draws, CASE WHEN over AND length(grown) BETWEEN 4 AND 12 THEN grown END
 FROM (SELECT z.*, wy.next, wy.next IS NULL OR wy.next = '' OR length(word) + length(wy.next) > 12 OR steps = 19 AS over, CASE WHEN wy.next IS NULL OR length(word) + length(wy.next) > 12 THEN word ELSE word || wy.next END AS grown
  FROM (SELECT st.id, st.base, tries, steps, word, now, draws + CASE WHEN total IS NULL THEN 0 ELSE 1 END AS draws, ((((st.id * 421 + draws + 1) * 48271 + 1 + st.base) % 2147483647 * 16807 % 2147483647) // 7 % 65536) % total AS pick FROM st LEFT JOIN tot ON tot.base = st.base AND tot.prev = st.now WHERE name IS NULL AND tries < 20) z
  LEFT JOIN wy ON wy.base = z.base AND wy.prev = z.now AND pick >= wy.lo AND pick < wy.hi)),
fb AS (SELECT base, coalesce(min(next) FILTER (WHERE length(next) BETWEEN 4 AND 12), min(next)) AS name FROM wy WHERE prev = '' GROUP BY base)
SELECT who.id, who.base, coalesce(any_value(st.name), any_value(fb.name), '') AS name FROM who JOIN st USING (id) LEFT JOIN fb ON fb.base = who.base GROUP BY who.id, who.base""")
def generated_names(spark, sf):
    """Walks over the chain of syllables, from a seed of each id."""
    rows = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50 + 1).cast("int").alias("base"))
    return names.walk_names(rows, syllable_chain(spark, sf))


@query("", "SELECT n_nationkey AS id, CASE WHEN regexp_matches(lower(right(n_name, 1)), '[aeiou]') THEN substr(n_name, 1, length(n_name) - 1) ELSE n_name END || 'ia' AS land, upper(substr(n_name, 1, 2)) AS code, '#' || lower(printf('%02X', (n_nationkey * 9) // 2 + 128)) || '4080' AS color FROM nation")
def state_names(spark, sf):
    n = T.table(spark, sf, "nation")
    own = F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.col("n_nationkey") * 9).cast("int")), 2, "0")), F.lit("0000"))
    mixed = names.hex_mix(own, F.lit("#ff80ff"), 0.5)
    color = F.concat(F.lit("#"), F.lower(F.lpad(F.hex((F.floor(F.col("n_nationkey") * 9 / 2) + 128).cast("int")), 2, "0")), F.substring(mixed, 4, 2), F.lit("80"))
    return n.select(F.col("n_nationkey").alias("id"), names.with_suffix(F.col("n_name"), F.lit("ia")).alias("land"), F.upper(F.substring("n_name", 1, 2)).alias("code"), color.alias("color"))


# Society


_PORTS = "havens AS (SELECT a.cell_id, min(b.cell_id) AS haven, count(*) AS harbor FROM cells a JOIN edges e ON e.src = a.cell_id JOIN cells b ON b.cell_id = e.dst WHERE a.height >= 20 AND b.height < 20 GROUP BY a.cell_id)"
_NOISE = "least(greatest(2 + 3 * (((id * 48271 + 11) % 2147483647 * 16807 % 2147483647 // 7 % 65536) / 65535.0::DOUBLE - 0.5) * 3, 0.6::DOUBLE), 20.0::DOUBLE) / 3"
_SCORES = f"scores AS ({SQL['suitability']}), land AS ({SQL['climate_and_biomes']})"
_TYPES = "['Generic', 'Naval', 'Highland', 'River', 'Nomadic', 'Hunting']"


def _placed(spark, sf):
    """Settlements with their port, cell, biome, suitability, noise and type of culture."""
    s = T.settlements(spark, sf).join(havens(spark, sf), "cell_id", "left").join(climate_and_biomes(spark, sf).select("cell_id", "height", "biome", "precip"), "cell_id").join(suitability(spark, sf), "cell_id")
    noise = F.least(F.greatest(2 + 3 * (generator.scrambled(11, F.col("id")) / 65535.0 - 0.5) * 3, F.lit(0.6)), F.lit(20.0)) / 3
    culture = F.element_at(F.array(*[F.lit(c) for c in ("Generic", "Naval", "Highland", "River", "Nomadic", "Hunting")]), (F.col("id") % 6 + 1).cast("int"))
    shore = feature_cells(spark, sf).select(F.col("cell_id").alias("haven"), (F.col("feature") == "lake").alias("lake"))
    s = s.join(shore, "haven", "left").join(_distance(spark, sf).select("cell_id", F.col("distance").alias("coast")), "cell_id").join(_on_river(spark, sf), "cell_id", "left")
    s = s.withColumns({"lake": F.coalesce("lake", F.lit(False)), "flux": F.when(F.col("on_river"), F.col("precip")).otherwise(0)})
    return s.withColumn("port", F.coalesce(F.col("harbor") == 1, F.lit(False))).withColumn("noise", noise).withColumn("culture", culture)


_PLACED = f"{_PORTS}, {_SCORES}, placed AS (SELECT s.*, haven, l.height, l.biome, l.precip, score, coalesce(harbor = 1, false) AS port, {_NOISE} AS noise, ({_TYPES})[id % 6 + 1] AS culture FROM settlements s JOIN land l USING (cell_id) JOIN scores USING (cell_id) LEFT JOIN havens USING (cell_id)), people AS (SELECT *, greatest(score / 8 + id / 1000.0::DOUBLE + (cell_id % 100) / 1000.0::DOUBLE, 0.1::DOUBLE) * CASE WHEN is_capital THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN port THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END * noise AS p FROM placed)"


@query("settlements cells edges", f"@ {_PLACED} SELECT id, port, round(p, 2) AS people FROM people")
def settlement_sizes(spark, sf):
    p = _placed(spark, sf)
    base = F.greatest(F.col("score") / 8 + F.col("id") / 1000.0 + (F.col("cell_id") % 100) / 1000.0, F.lit(0.1))
    size = base * F.when(F.col("is_capital"), S.CAPITAL).otherwise(1.0) * F.when(F.col("port"), S.PORT).otherwise(1.0) * F.col("noise")
    return p.select("id", "port", F.round(size, 2).alias("people"))


def _typed(spark, sf):
    p = _placed(spark, sf).withColumn("people", S.population(F.col("score"), F.col("id"), F.col("cell_id"), F.col("is_capital"), F.col("port"), F.col("noise")))
    return p.withColumn("settlement_kind", S.kind(F.col("port"), F.col("lake"), F.col("height"), F.col("flux"), F.col("coast"), F.col("biome"), F.col("culture"), F.col("people")))


_KINDS = """kinds AS (SELECT *, CASE WHEN port THEN 'Port' WHEN lake THEN 'Lake' WHEN height > 60 THEN CASE culture WHEN 'Highland' THEN 'Highland Fortress' ELSE 'Highland' END WHEN on_river AND precip >= 100 THEN CASE culture WHEN 'River' THEN 'River Trade Hub' ELSE 'River' END
 WHEN culture = 'Naval' AND coast <= 2 THEN 'Coastal' WHEN biome IN (11, 12) THEN CASE WHEN culture <> 'Nomadic' THEN 'Desert Outpost' WHEN p < 20 THEN 'Oasis Camp' ELSE 'Desert Town' END
 WHEN biome IN (6, 7, 8, 14, 15) THEN CASE WHEN culture <> 'Hunting' THEN 'Forest' WHEN p < 15 THEN 'Forest Lodge' ELSE 'Woodland Settlement' END WHEN biome IN (9, 13) THEN CASE WHEN culture <> 'Nomadic' THEN 'Farming Village' WHEN p < 10 THEN 'Nomadic Camp' ELSE 'Trading Post' END
 WHEN biome IN (4, 5) THEN CASE WHEN p < 20 THEN 'Northern Outpost' ELSE 'Frontier Town' END ELSE CASE culture WHEN 'Naval' THEN 'Coastal Village' WHEN 'Highland' THEN 'Mountain Village' WHEN 'Lake' THEN 'Lakeside Village' WHEN 'River' THEN 'Riverside Village' WHEN 'Nomadic' THEN 'Settlement' WHEN 'Hunting' THEN 'Hunting Lodge' ELSE 'Village' END END AS settlement_kind
 FROM (SELECT people.* EXCLUDE (p), round(p, 3) AS p, coalesce(feature = 'lake', false) AS lake, coalesce(on_river, false) AS on_river, ds.distance AS coast FROM people LEFT JOIN fc ON fc.cell_id = people.haven JOIN ds ON ds.cell_id = people.cell_id LEFT JOIN rc ON rc.cell_id = people.cell_id))"""
_KINDS = f"fc AS ({SQL['feature_cells']}), ds AS ({SQL['distance_field']}), {_RIVERS}, {_KINDS}"


@query("settlements cells edges", f"@ {_PLACED}, {_KINDS} SELECT id, culture, settlement_kind FROM kinds")
def settlement_kinds(spark, sf):
    return _typed(spark, sf).select("id", "culture", "settlement_kind")


@query("settlements cells edges", f"""@ {_PLACED}, {_KINDS},
a AS (SELECT *, CASE WHEN regexp_matches(settlement_kind, 'Fortress') THEN [0.5, 0.0, 0.3] WHEN regexp_matches(settlement_kind, 'Trade|Hub') THEN [0.0, 0.3, 0.0] WHEN regexp_matches(settlement_kind, 'Camp|Lodge') THEN [-0.2, 0.0, -0.2] WHEN regexp_matches(settlement_kind, 'Port') THEN [0.0, 0.2, -0.1] ELSE [0.0, 0.0, 0.0] END::DOUBLE[] AS k,
 CASE culture WHEN 'Highland' THEN [0.3, 0.0, 0.4] WHEN 'Naval' THEN [0.0, 0.2, -0.1] WHEN 'River' THEN [0.0, 0.25, 0.0] WHEN 'Nomadic' THEN [-0.2, -0.1, -0.3] WHEN 'Hunting' THEN [-0.1, 0.0, -0.2] ELSE [0.0, 0.0, 0.0] END::DOUBLE[] AS c FROM kinds)
SELECT id, round(least(1.0, greatest(0.0, CASE WHEN is_capital THEN 1.0 WHEN p > 50 THEN 0.75 WHEN p > 15 THEN 0.5 ELSE 0.1 END::DOUBLE + (c[1] + k[1]))), 4)::DOUBLE AS citadel, round(least(1.0, greatest(0.0, CASE WHEN p > 20 THEN 1.0 WHEN p > 10 THEN 0.8 WHEN p > 4 THEN 0.7 ELSE 0.6 END::DOUBLE + (c[2] + k[2]))), 4)::DOUBLE AS plaza,
 round(least(1.0, greatest(0.0, CASE WHEN is_capital OR p > 30 THEN 1.0 WHEN p > 20 THEN 0.75 WHEN p > 10 THEN 0.5 ELSE 0.1 END::DOUBLE + (c[3] + k[3]))), 4)::DOUBLE AS walls FROM a""")
def settlement_chances(spark, sf):
    t = _typed(spark, sf)
    c = S.chances(F.col("people"), F.col("is_capital"), F.col("culture"), F.col("settlement_kind"), F.lit(True))
    return t.select("id", *[F.round(c[n], 4).alias(n) for n in ("citadel", "plaza", "walls")])


_DRAW = "((id * 48271 + {0}) % 2147483647 * 16807 % 2147483647 // 7 % 65536) / 65536.0::DOUBLE"
_TEMPLE = "greatest(0.05::DOUBLE, least(0.95::DOUBLE, CASE WHEN p > 50 THEN 0.95 WHEN p > 35 THEN 0.75 WHEN p > 20 THEN 0.5 WHEN p > 10 THEN 0.25 ELSE 0.1 END::DOUBLE + (CASE WHEN state_id % 2 <> 0 THEN -0.15 WHEN p > 30 THEN 0.3 WHEN is_capital THEN 0.4 ELSE 0.2 END::DOUBLE + CASE culture WHEN 'Highland' THEN 0.1 WHEN 'Nomadic' THEN -0.1 ELSE 0.0 END::DOUBLE)))"


@query("settlements cells edges", f"""@ {_PLACED}, {_KINDS}, ch AS ({{chances}}),
f AS (SELECT id, p, culture, {_DRAW.format(0)} < citadel AS citadel, {_DRAW.format(1)} < plaza AS plaza, {_DRAW.format(2)} < walls AS walls, {_DRAW.format(3)} < {_TEMPLE} AS temple FROM kinds JOIN ch USING (id))
SELECT id, citadel, plaza, walls, temple, {_DRAW.format(9)} < greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN p > 60 THEN 1.0 WHEN p > 40 THEN 0.75 WHEN p > 20 AND walls THEN 0.4 ELSE 0.0 END::DOUBLE - CASE WHEN culture IN ('Nomadic', 'Hunting') THEN 0.3 ELSE 0.0 END::DOUBLE)) AS shanty FROM f""".replace("{chances}", SQL["settlement_chances"]))
def settlement_features(spark, sf):
    """Chances against a number drawn for each settlement, by arithmetic."""
    t = _typed(spark, sf)
    c = S.chances(F.col("people"), F.col("is_capital"), F.col("culture"), F.col("settlement_kind"), F.col("state_id") % 2 == 0)
    draw = lambda salt: generator.scrambled(salt, F.col("id")) / 65536.0
    out = t.select("id", "people", "culture", *[(draw(i) < F.round(c[n], 4)).alias(n) for i, n in enumerate(c)])
    return out.select("id", *c, (draw(9) < S.shanty_chance(F.col("people"), F.col("walls"), F.col("culture"))).alias("shanty"))


@query("settlements cells edges", f"@ {_PORTS} SELECT s.id, round(s.x + (h.haven % 40 - s.x) * 0.67::DOUBLE, 2) AS x, round(s.y + (h.haven // 40 - s.y) * 0.67::DOUBLE, 2) AS y FROM settlements s JOIN havens h USING (cell_id) WHERE harbor = 1")
def port_positions(spark, sf):
    s = T.settlements(spark, sf).join(havens(spark, sf).where("harbor = 1"), "cell_id")
    x, y = S.port_position(F.col("x"), F.col("y"), F.col("haven") % T.WIDTH, F.expr(f"haven div {T.WIDTH}"))
    return s.select("id", x.alias("x"), y.alias("y"))


def _state_cost_sql() -> str:
    """state_cost() over columns type, same, height, score, movement, same_biome, on_river, flux, coast and far."""
    by = lambda values, rest, f=str: "CASE type " + " ".join(f"WHEN '{k}' THEN {f(v)}" for k, v in values.items() if k != "Generic") + f" ELSE {f(rest)} END"
    ladder = lambda steps: "CASE " + " ".join(f"WHEN height >= {h} THEN {c}" for h, c in steps) + " END"
    shore = lambda v: f"CASE coast WHEN 1 THEN {v[0]} WHEN 2 THEN {v[1]} ELSE {v[2]} END"
    return f"""greatest((CASE WHEN same THEN CASE WHEN type IN ('Highland', 'Nomadic') THEN -13.5 ELSE -9.0 END ELSE {by(S.FOREIGN, S.OTHER_CULTURE)} END)::DOUBLE
 + (CASE WHEN height < 20 THEN CASE type WHEN 'Naval' THEN 0.0 ELSE 200.0 END WHEN score > 0 THEN greatest(20 - score, 0) * CASE WHEN type = 'River' AND on_river THEN 0.5 ELSE 1.0 END ELSE {by(S.BARREN, S.OTHER_BARREN)} END)::DOUBLE
 + CASE WHEN same_biome THEN 5 WHEN type = 'Nomadic' THEN movement * 2 ELSE movement END + CASE WHEN height < 20 THEN {by(S.WATER, S.SEA_CROSSING)} ELSE {by(S.HEIGHTS, S.HEIGHTS["Generic"], ladder)} END
 + CASE WHEN on_river AND type <> 'River' THEN least(greatest(flux // 10, 20), 100) ELSE 0 END + CASE WHEN coast <= 0 THEN 0 ELSE {by(S.SHORES, S.SHORES["Generic"], shore)} END + far / ({by(S.REACH, S.OTHER_REACH)})::DOUBLE, 0.0::DOUBLE)"""


_STATES = f"""{_SCORES}, ds AS ({SQL['distance_field']}), {_RIVERS}, a AS (SELECT land.cell_id, c.x, c.y, culture_id, land.height, ([{', '.join(map(str, E.MOVEMENT))}])[biome + 1] AS movement, biome, floor(score)::BIGINT AS score, precip AS flux, coalesce(on_river, false) AS on_river, distance AS coast
 FROM owners JOIN land USING (cell_id) JOIN cells c ON c.cell_id = land.cell_id JOIN scores ON scores.cell_id = land.cell_id JOIN ds ON ds.cell_id = land.cell_id LEFT JOIN rc ON rc.cell_id = land.cell_id)"""


def _state_land(spark, sf):
    """Cells with what a state's expansion asks of them."""
    c = climate_and_biomes(spark, sf).select("cell_id", "height", "biome", F.col("precip").alias("flux")).join(suitability(spark, sf), "cell_id").join(T.owners(T.cells(spark, sf)).select("cell_id", "culture_id"), "cell_id")
    c = c.join(T.cells(spark, sf).select("cell_id", "x", "y"), "cell_id").join(_distance(spark, sf).select("cell_id", F.col("distance").alias("coast")), "cell_id").join(_on_river(spark, sf), "cell_id", "left")
    return c.withColumn("on_river", F.coalesce("on_river", F.lit(False)))


def _state_cost(same, same_biome, type_, far):
    return S.state_cost(same, F.col("height"), F.floor("score"), E.pick(E.MOVEMENT, F.col("biome")), same_biome, type_, F.col("on_river"), F.col("flux"), F.col("coast"), far)


@query("owners", f"""@ {_STATES}, t AS (SELECT *, ({_TYPES})[cell_id % 6 + 1] AS type, cell_id % 2 = 0 AS same, biome = 9 AS same_biome, sqrt((x * x + y * y)::DOUBLE) AS far FROM a)
SELECT cell_id, round({_state_cost_sql()}, 4)::DOUBLE AS cost FROM t""")
def state_costs(spark, sf):
    """What each cell would cost a state of some type whose centre is the map's first cell."""
    type_ = F.element_at(F.array(*[F.lit(t) for t in ("Generic", "Naval", "Highland", "River", "Nomadic", "Hunting")]), (F.col("cell_id") % 6 + 1).cast("int"))
    far = F.sqrt((F.col("x") * F.col("x") + F.col("y") * F.col("y")).cast("double"))
    cost = _state_cost(F.col("cell_id") % 2 == 0, F.col("biome") == 9, type_, far)
    return _state_land(spark, sf).select("cell_id", F.round(cost, 4).alias("cost"))


@query("owners edges", f"""@ {_STATES}, who AS (SELECT cell_id // 97 + 1 AS owner, cell_id AS centre, x AS cx, y AS cy, culture_id AS culture, biome AS home, (cell_id // 97 + 1) % 3 + 1 AS expansionism, ({_TYPES})[(cell_id // 97 + 1) % 6 + 1] AS type FROM a WHERE cell_id % 97 = 13 AND height >= 20),
asked AS (SELECT owner, cell_id, expansionism, type, culture_id = culture AS same, height, score, movement, biome = home AS same_biome, on_river, flux, coast, sqrt(((x - cx) * (x - cx) + (y - cy) * (y - cy))::DOUBLE) AS far FROM who, a),
costs AS (SELECT owner, cell_id, 10 + {_state_cost_sql()} / expansionism::DOUBLE AS cost FROM asked),
x(cell_id, owner, v) USING KEY (cell_id, owner) AS (SELECT centre, owner, 0.0::DOUBLE FROM who UNION SELECT e.dst, x.owner, min(x.v + cost) FROM x JOIN edges e ON e.src = x.cell_id JOIN costs c ON c.cell_id = e.dst AND c.owner = x.owner LEFT JOIN recurring.x r ON r.cell_id = e.dst AND r.owner = x.owner WHERE x.v + cost <= 600 AND e.dst NOT IN (SELECT centre FROM who) AND (r.v IS NULL OR r.v > x.v + cost) GROUP BY e.dst, x.owner)
SELECT cell_id, round(v, 4) AS cost, owner::BIGINT AS owner FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY v, owner) AS k FROM x) JOIN a USING (cell_id) WHERE k = 1 AND height >= 20""")
def expanded_states(spark, sf):
    """States with costs of their own, divided by their expansionism, and 10 a step; they cross water but own land."""
    c = _state_land(spark, sf).checkpoint()
    owner = F.expr("cell_id div 97") + 1
    type_ = F.element_at(F.array(*[F.lit(t) for t in ("Generic", "Naval", "Highland", "River", "Nomadic", "Hunting")]), (owner % 6 + 1).cast("int"))
    seeds = c.where("cell_id % 97 = 13 AND height >= 20").select("cell_id", owner.alias("owner"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("culture_id").alias("culture"), F.col("biome").alias("home"), (owner % 3 + 1).alias("expansionism"), type_.alias("type"))
    far = F.sqrt(((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))).cast("double"))
    cost = _state_cost(F.col("culture_id") == F.col("culture"), F.col("biome") == F.col("home"), F.col("type"), far)
    found = N.expand_by_owner(seeds, c, T.edges(spark, sf), 10 + cost / F.col("expansionism"), 600)
    return found.join(c.where("height >= 20").select("cell_id"), "cell_id").select("cell_id", F.round("cost", 4).alias("cost"), "owner")


@query("cells owners", "@ m AS (SELECT culture_id, avg(x) AS mx, avg(y) AS my FROM owners JOIN cells USING (cell_id) WHERE culture_id > 0 GROUP BY 1) SELECT cell_id, round(greatest(CASE WHEN height >= 60 THEN 20.0 ELSE -least((100 - height) / 10.0 * 5, 30.0) END::DOUBLE + CASE WHEN height > 70 THEN 50 WHEN height > 50 THEN 10 ELSE 0 END + sqrt(power(x - mx, 2) + power(y - my, 2)) / 50, 0.0::DOUBLE), 4) AS cost FROM cells JOIN owners USING (cell_id) JOIN m USING (culture_id)")
def culture_costs(spark, sf):
    c = T.cells(spark, sf)
    o = T.owners(c).where("culture_id > 0").select("cell_id", "culture_id").join(c, "cell_id")
    m = o.groupBy("culture_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    people = F.when(F.col("height") >= 60, 0.0).otherwise((100 - F.col("height")) / 10.0)
    far = G.distance(F.col("x"), F.col("y"), F.col("mx"), F.col("my"))
    return o.join(m, "culture_id").select("cell_id", F.round(S.culture_cost(people, F.col("height"), far), 4).alias("cost"))


@query("cells edges rain", f"""@ b AS ({SQL['climate_and_biomes']}), ds AS ({SQL['distance_field']}), {_DRAIN}, w AS (SELECT cell_id, flux, max(flux) OVER () AS mx, flux >= 400 AND flux <= 0.8 * max(flux) OVER () AS river FROM fx),
nr AS (SELECT DISTINCT e.src AS cell_id FROM edges e JOIN w ON w.cell_id = e.dst WHERE river),
s1 AS (SELECT b.*, distance, flux, mx, river, nr.cell_id IS NOT NULL AND NOT river AS beside, CASE WHEN b.height >= 20 AND abs(distance) <= 3 AND temperature > 15 AND temperature < 25 AND biome IN (9, 11) THEN 10 ELSE biome END AS b1 FROM b JOIN ds USING (cell_id) JOIN w USING (cell_id) LEFT JOIN nr USING (cell_id)),
s2 AS (SELECT *, CASE WHEN height >= 20 AND river THEN 2 WHEN height >= 20 AND beside AND b1 = 11 THEN 9 WHEN height >= 20 AND beside AND b1 = 12 THEN 13 ELSE b1 END AS b2 FROM s1),
s3 AS (SELECT *, CASE WHEN height >= 20 AND b2 <> 2 AND flux > mx * 0.8 THEN 3 ELSE b2 END AS b3 FROM s2)
SELECT cell_id, CASE WHEN height >= 20 AND abs(distance) <= 1 AND temperature > 20 THEN 16 ELSE b3 END::INT AS biome FROM s3""")
def influenced_biomes(spark, sf):
    """Biomes after the influence of coasts, rivers, wetlands and mangroves."""
    d = _drained(spark, sf)
    most = d.agg(F.max("flux").alias("mx"))
    w = d.crossJoin(F.broadcast(most)).select("cell_id", "flux", "mx", ((F.col("flux") >= 400) & (F.col("flux") <= 0.8 * F.col("mx"))).alias("river"))  # one row
    near = T.edges(spark, sf).join(w.where("river").select(F.col("cell_id").alias("dst")), "dst").select(F.col("src").alias("cell_id")).distinct().withColumn("by", F.lit(True))
    c = climate_and_biomes(spark, sf).join(distance_field(spark, sf), "cell_id").join(w, "cell_id").join(near, "cell_id", "left")
    beside = F.coalesce("by", F.lit(False)) & ~F.col("river")
    return c.select("cell_id", E.influenced_biome(F.col("biome"), F.col("height"), F.col("temperature"), F.col("distance"), F.col("river"), beside, F.col("flux"), F.col("mx")).cast("int").alias("biome"))


@query("cells owners edges", "SELECT o.culture_id, count(DISTINCT o.cell_id) AS area, (SELECT count(*) FROM edges e JOIN owners a ON a.cell_id = e.src JOIN owners b ON b.cell_id = e.dst WHERE a.culture_id = o.culture_id AND b.culture_id <> o.culture_id) + (SELECT sum(4 - k)::BIGINT FROM (SELECT count(*) AS k FROM edges e JOIN owners a ON a.cell_id = e.src WHERE a.culture_id = o.culture_id GROUP BY e.src)) AS perimeter FROM owners o WHERE culture_id > 0 GROUP BY o.culture_id")
def territory_shape(spark, sf):
    """Area and perimeter of territories: cells, and sides to other owners or off the map; no ring needs to be traced."""
    o, e = T.owners(T.cells(spark, sf)), T.edges(spark, sf)
    area = o.where("culture_id > 0").groupBy("culture_id").agg(F.count("*").alias("area"))
    out = spatial.boundary(o, e, "culture_id").groupBy(F.col("owner").alias("culture_id")).agg(F.count("*").alias("sides"))
    inner = e.join(o.where("culture_id > 0"), F.col("src") == F.col("cell_id")).groupBy("culture_id").agg(F.count("*").alias("all"))
    return area.join(out, "culture_id").join(inner, "culture_id").select("culture_id", "area", (F.col("sides") + 4 * F.col("area") - F.col("all")).alias("perimeter"))


@query("rivers", "@ p AS (SELECT a.river_id, min(b.river_id) AS parent_id FROM (SELECT river_id, arg_max(cell_id, seq) AS mouth FROM rivers GROUP BY 1) a LEFT JOIN rivers b ON b.cell_id = a.mouth AND b.river_id < a.river_id GROUP BY a.river_id), h(river_id, stem, depth) AS (SELECT river_id, river_id, 0 FROM p WHERE parent_id IS NULL UNION ALL SELECT p.river_id, h.stem, h.depth + 1 FROM h JOIN p ON p.parent_id = h.river_id) SELECT river_id, stem, depth::BIGINT AS depth FROM h")
def river_hierarchy(spark, sf):
    """Each river's main stem and depth below it."""
    found = stems(river_parents(spark, sf).select(F.col("river_id").alias("node"), F.col("parent_id").alias("to")))
    return found.select(F.col("node").alias("river_id"), "stem", "depth")


@query("", f"SELECT lake, level::DOUBLE AS level, n_cells * 4.0::DOUBLE AS area, shore - level AS rise FROM ({SQL['lakes']})")
def lake_levels(spark, sf):
    """Level and area (of cells two units wide) of each lake, and how far its shore rises above it at least."""
    found = lakes(spark, sf)
    return found.select("lake", F.col("level").cast("double").alias("level"), (F.col("n_cells") * 4.0).alias("area"), (F.col("shore") - F.col("level")).alias("rise"))


_WORDS = {"Number": ("One", "Three", "Seven"), "Being": ("Elder", "Guardian", "Spirit"), "Adjective": ("Silent", "Golden"), "Color": ("White", "Dark"), "Animal": ("Bear", "Crow", "Serpent"), "Genitive": ("Storms", "Rivers")}


def _deity_sql() -> str:
    pick = lambda kind, salt: f"({list(_WORDS[kind])})[(k * 7 + {salt}) % {len(_WORDS[kind])} + 1]"
    upto, cases = 0, []
    for pattern, weight in S.DEITY_PATTERNS:
        upto += weight
        cases.append(f"WHEN k * 13 % {sum(w for _, w in S.DEITY_PATTERNS)} < {upto} THEN " + " || ' ' || ".join(pick(x, i) if x in _WORDS else f"'{x}'" for i, x in enumerate(pattern.split(" + "))))
    return f"SELECT n_nationkey AS id, CASE {' '.join(cases)} END AS deity FROM (SELECT n_nationkey, n_nationkey::BIGINT AS k FROM nation)"


@query("", _deity_sql())
def deities(spark, sf):
    return T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), S.deity(F.col("n_nationkey").cast("long"), _WORDS).alias("deity"))


@query("maps", """SELECT map_id, '{"map_id":' || map_id || ',"name":"' || name || '","n_nations":' || n_nations || '}' AS config FROM maps""")
def map_configs(spark, sf):
    return T.maps(spark, sf).select("map_id", F.to_json(F.struct("map_id", "name", "n_nations")).alias("config"))


@query("owners cells", "@ c AS (SELECT state_id, religion_id, count(*) AS n FROM owners WHERE state_id > 0 GROUP BY state_id, religion_id), s AS (SELECT *, sum(n) OVER (PARTITION BY state_id) AS total FROM c) SELECT state_id, bool_or(religion_id > 0 AND n > 0.3 * total) AS theocracy FROM s GROUP BY state_id")
def theocracies(spark, sf):
    """States in which one religion has more than three tenths of the cells."""
    n = T.owners(T.cells(spark, sf)).where("state_id > 0").groupBy("state_id", "religion_id").agg(F.count("*").alias("n"))
    total = n.groupBy("state_id").agg(F.sum("n").alias("total"))
    return n.join(total, "state_id").groupBy("state_id").agg(F.bool_or((F.col("religion_id") > 0) & (F.col("n") > 0.3 * F.col("total"))).alias("theocracy"))


@query("settlements", "SELECT state_id, count(*) AS n, sum(population)::BIGINT AS population, max(population) AS largest, round(100.0::DOUBLE * sum(population)::DOUBLE / sum(sum(population)) OVER ()::DOUBLE, 4) AS share FROM settlements GROUP BY state_id")
def population_shares(spark, sf):
    s = T.settlements(spark, sf).groupBy("state_id").agg(F.count("*").alias("n"), F.sum("population").alias("population"), F.max("population").alias("largest"))
    return s.withColumn("share", F.round(100.0 * F.col("population") / F.sum("population").over(Window.partitionBy()), 4))  # one row a state


@query("cells edges", """@ f(cell_id, v) USING KEY (cell_id) AS (SELECT cell_id, height FROM cells WHERE height < 20 UNION SELECT e.dst, min(greatest(c.height, f.v)) FROM f JOIN edges e ON e.src = f.cell_id JOIN cells c ON c.cell_id = e.dst LEFT JOIN recurring.f r ON r.cell_id = e.dst WHERE r.v IS NULL OR r.v > greatest(c.height, f.v) GROUP BY e.dst)
SELECT cell_id, v::BIGINT AS level FROM f JOIN cells USING (cell_id) WHERE height >= 20 AND v - height >= 20""")
def deep_lakes(spark, sf):
    return N.deep_lakes(T.cells(spark, sf), T.edges(spark, sf))


@query("cells edges", f"""@ cc(cell_id, region) USING KEY (cell_id) AS (SELECT cell_id, cell_id FROM cells UNION SELECT l.dst, min(c.region) FROM cc c JOIN (SELECT e.src, e.dst FROM edges e JOIN cells a ON a.cell_id = e.src JOIN cells b ON b.cell_id = e.dst WHERE (a.height >= 20) = (b.height >= 20)) l ON l.src = c.cell_id JOIN recurring.cc r ON r.cell_id = l.dst WHERE c.region < r.region GROUP BY l.dst),
ft AS (SELECT region, CASE WHEN bool_or(height >= 20) THEN 'island' WHEN bool_or(is_border) THEN 'ocean' ELSE 'lake' END AS feature FROM cc JOIN cells USING (cell_id) GROUP BY region),
sd AS (SELECT e.src, ft.region, feature FROM edges e JOIN cells a ON a.cell_id = e.src JOIN cc ON cc.cell_id = e.dst JOIN ft ON ft.region = cc.region WHERE a.height BETWEEN 20 AND 40)
SELECT min(l.src) AS cell_id, l.region AS lake FROM sd l WHERE feature = 'lake' AND src IN (SELECT src FROM sd WHERE feature = 'ocean') GROUP BY l.region""")
def breached_lakes(spark, sf):
    c, e = T.cells(spark, sf).withColumn("land", F.col("height") >= 20), T.edges(spark, sf)
    r = _regions(spark, sf, c, "land")
    return N.breached(c, e, N.features(c, r), r, 40)


@query("settlements n", f"SELECT id, (((x > 20)::INT + 2 * (y > (n // 40) / 2.0)::INT) * 4 + CASE ({_TYPES})[id % 6 + 1] WHEN 'Naval' THEN 1 WHEN 'Nomadic' THEN 2 WHEN 'Highland' THEN 3 ELSE 0 END) % 9 AS base FROM settlements, n WHERE is_capital")
def name_bases(spark, sf):
    s = T.settlements(spark, sf).where("is_capital")
    type_ = F.element_at(F.array(*[F.lit(t) for t in ("Generic", "Naval", "Highland", "River", "Nomadic", "Hunting")]), (F.col("id") % 6 + 1).cast("int"))
    return s.select("id", S.name_base(type_, F.col("x"), F.col("y"), T.WIDTH, T.count_cells(spark, sf) // T.WIDTH, 9).alias("base"))


# what more there is registers itself here
from cartoweave import land_queries, more_queries, site_queries, terrain_queries, world_queries  # noqa: E402, F401
