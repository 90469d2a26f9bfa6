"""World queries that build on those of queries.py; they register themselves there."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartoweave import session
from cartoweave.functions import environment as E
from cartoweave.functions import geometry as G
from cartoweave.functions import society as S
from cartoweave.operators import edits as D
from cartoweave.operators import graph as N
from cartoweave.operators import names, voronoi
from cartoweave.plans.components import ensure_checkpoint_dir
from cartoweave.queries import SQL, WORLD, _distance, _on_river, climate_and_biomes, edited_heights, feature_cells, havens, packed_cells, query, suitability
from cartoweave.sources import generator, store
from cartoweave.sources import tables as T
from cartoweave.streaming import edit_log


def _with(*tables: str, **also: str) -> str:
    return "WITH " + ", ".join([*(WORLD[t] for t in tables), *(f"{k} AS ({v})" for k, v in also.items())])


def _folder(spark, name: str) -> str:
    """A new folder where driver and executors both write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


# Stored worlds


@query("cells", "SELECT cell_id, x::BIGINT AS x, y::BIGINT AS y, height FROM cells WHERE x BETWEEN 3 AND 30 AND y BETWEEN 2 AND 90")
def stored_cells(spark, sf):
    """Cells that were saved, twice, as a version of a world, and read by box from the last one."""
    path = _folder(spark, "world")
    c = T.cells(spark, sf).select(F.lit(1).cast("long").alias("map_id"), "cell_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "height")
    store.save_world({"cells": c.withColumn("height", F.lit(0))}, path, "v9")
    for _ in range(2):
        store.save_world({"cells": c}, path, "v10")
    return store.scan(spark, path, "cells", 1, (3, 2, 30, 90)).select("cell_id", "x", "y", "height")


@query("", "SELECT r_regionkey AS culture_id, CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE 'Culture ' || r_regionkey END AS name, '#808080' AS color, 'Generic' AS type, 1.0::DOUBLE AS expansionism, 0::BIGINT AS center, 0::BIGINT AS name_base, 0::BIGINT AS population FROM region")
def stored_cultures(spark, sf):
    """Cultures as they are stored: what is missing or null takes the column's default."""
    r = T.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("culture_id"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).alias("name"))
    return store.conform("cultures", r, "culture_id")


@query("", "SELECT n_nationkey AS state_id, n_name AS name, '#808080' AS color, NULL::VARCHAR AS government_type, NULL::VARCHAR AS state_type, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey / 10.0 ELSE 1.0 END::DOUBLE AS expansionism, 0::BIGINT AS center, 0::BIGINT AS population FROM nation")
def stored_states(spark, sf):
    n = F.col("n_nationkey")
    r = T.table(spark, sf, "nation").select(n.cast("long").alias("state_id"), F.col("n_name").alias("name"), F.when(n % 3 == 0, n / 10.0).alias("expansionism"))
    return store.conform("states", r, "state_id")


@query("", f"""{_with(b=SQL['climate_and_biomes'])} SELECT i AS biome_id, name, NULL::VARCHAR AS classification, 0::BIGINT AS temperature_band, 0::BIGINT AS moisture_band, CASE WHEN i % 4 = 0 THEN 50 ELSE i END::BIGINT AS habitability, 1::BIGINT AS movement_cost,
round(avg(temperature::DOUBLE), 4) AS avg_temperature, round(avg(precip::DOUBLE), 4) AS avg_precipitation FROM b JOIN (VALUES {', '.join(f'({i}::BIGINT, {name!r})' for i, name in enumerate(E.BIOMES))}) t(i, name) ON i = biome GROUP BY i, name""")
def stored_biomes(spark, sf):
    """The world's biomes as they are stored: what is known of each from its cells, and a default for the other columns."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    found = climate_and_biomes(spark, sf).groupBy(F.col("biome").cast("long").alias("biome_id")).agg(mean("temperature").alias("avg_temperature"), mean("precip").alias("avg_precipitation"))
    name = F.element_at(F.array(*[F.lit(n) for n in E.BIOMES]), (F.col("biome_id") + 1).cast("int"))
    return store.conform("biomes", found.select("biome_id", name.alias("name"), F.when(F.col("biome_id") % 4 != 0, F.col("biome_id")).alias("habitability"), "avg_temperature", "avg_precipitation"), "biome_id")


@query("maps", """SELECT map_id::BIGINT AS map_id, name, 0::BIGINT AS width, 0::BIGINT AS height, 0::BIGINT AS cells_count, '{"n":' || n_nations || '}' AS config_json FROM maps""")
def stored_maps(spark, sf):
    m = T.maps(spark, sf).select(F.col("map_id").cast("long").alias("map_id"), "name", F.to_json(F.struct(F.col("n_nations").alias("n"))).alias("config_json"))
    return store.conform("maps", m, "map_id").select("map_id", "name", "width", "height", "cells_count", "config_json")


@query("settlements cells", "SELECT s.id, coalesce(c.x, -1)::BIGINT AS x, coalesce(c.y, -1)::BIGINT AS y FROM settlements s LEFT JOIN cells c ON c.cell_id = s.cell_id AND c.height >= 20")
def stored_settlements(spark, sf):
    """Settlements at the points of their cells, of land alone, and else where they say themselves."""
    s = T.settlements(spark, sf).select("id", "cell_id", F.lit(-1).cast("long").alias("x"), F.lit(-1).cast("long").alias("y"))
    return store.placed(s, T.cells(spark, sf).where("height >= 20")).select("id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


# Functions and the catalog


@query("cells", "SELECT cell_id, CASE WHEN height > 2 THEN format('POLYGON Z(({0:.1f} {1:.1f} {4:.1f},{2:.1f} {1:.1f} {4:.1f},{2:.1f} {3:.1f} {4:.1f},{0:.1f} {3:.1f} {4:.1f},{0:.1f} {1:.1f} {4:.1f}))', x::DOUBLE, y::DOUBLE, x + 1.0::DOUBLE, y + 1.0::DOUBLE, height * 5.0::DOUBLE) END AS wkt FROM cells")
def extruded_cells(spark, sf):
    """Blocks over cells, by a SQL function; null for those without a side."""
    session.add_functions(spark)
    return T.cells(spark, sf).select("cell_id", F.expr("safe_extrude(x, y, CASE WHEN height > 2 THEN 1 ELSE 0 END, height * 5)").alias("wkt"))


@query("cells settlements", "SELECT 'terrain' AS layer, true AS view_there, count(*) AS n, (SELECT 'POINT(' || x || ' ' || y || ')' FROM cells ORDER BY cell_id LIMIT 1) AS sample FROM cells UNION ALL SELECT 'settlements', true, count(*), (SELECT 'POINT(' || x || ' ' || y || ')' FROM settlements ORDER BY id LIMIT 1) FROM settlements")
def layer_check(spark, sf):
    """What a SQL table function tells of each layer's view."""
    point = G.wkt_point(F.col("x"), F.col("y")).alias("wkt")
    session.add_layer_check(spark, {"terrain": T.cells(spark, sf).select(F.col("cell_id").alias("id"), point), "settlements": T.settlements(spark, sf).select("id", point)})
    return spark.sql("SELECT * FROM layer_check()")


@query("cells", "SELECT 'cartoweave_band_' || k AS name, k IN (SELECT height // 10 FROM cells WHERE NOT is_border) AS there FROM range(13) t(k)")
def catalog_probe(spark, sf):
    """Which bands of height the inland has, each a view of its cells if it has any, as the catalog tells."""
    c = T.cells(spark, sf).where("NOT is_border").withColumn("band", F.expr("height div 10"))
    found = {r.band for r in c.select("band").distinct().collect()}  # at most eleven
    for k in range(13):
        spark.catalog.dropTempView(f"cartoweave_band_{k}")
        if k in found:
            c.where(F.col("band") == k).createOrReplaceTempView(f"cartoweave_band_{k}")
    return session.tables_there(spark, *(f"cartoweave_band_{k}" for k in range(13)))


# Cells


@query("", f"""{_with(b=SQL['climate_and_biomes'])}, a AS (SELECT cell_id, temperature AS t, precip AS r, CASE WHEN height > 80 THEN 10 WHEN height > 60 THEN 35 ELSE 80 END AS v FROM b),
h AS (SELECT *, floor(v * CASE WHEN t < -10 THEN 0.2 WHEN t < -5 THEN 0.4 WHEN t > 35 THEN 0.3 WHEN t > 30 THEN 0.6 ELSE 1.0 END::DOUBLE) AS w FROM a)
SELECT cell_id, least(greatest(floor(w * CASE WHEN r < 5 THEN 0.3 WHEN r < 10 THEN 0.6 WHEN r > 50 THEN 0.7 ELSE 1.0 END::DOUBLE), 0), 100)::INT AS habitability FROM h""")
def plain_habitability(spark, sf):
    """Habitability where no biome is known."""
    return climate_and_biomes(spark, sf).select("cell_id", E.plain_habitability(F.col("height"), F.col("temperature"), F.col("precip")).alias("habitability"))


@query("rain", f"SELECT p.grid_id, p.x, p.y, precip FROM rain JOIN ({SQL['packed_cells']}) p ON p.grid_id = rain.cell_id")
def packed_rain(spark, sf):
    """The grid's rain, handed on to the packed cells, of which several may come from one cell of the grid."""
    return packed_cells(spark, sf).select("grid_id", "x", "y").join(T.precipitation(spark, sf).select(F.col("cell_id").alias("grid_id"), "precip"), "grid_id")


@query("", f"SELECT abs(distance) - 1 AS round, count(*) AS improved FROM ({SQL['distance_field']}) WHERE abs(distance) > 1 GROUP BY 1")
def coast_rounds(spark, sf):
    """How many cells each round of the distance field's fixpoint improved, until none did."""
    seen: list[tuple[int, int]] = []
    N.distance_field(T.cells(spark, sf), T.edges(spark, sf), on_round=lambda number, n: seen.append((number, n)))
    return spark.createDataFrame(seen, "round long, improved long")


@query("cells n", "SELECT a.cell_id, v.height AS height_y, b.height AS height_both FROM cells a JOIN n ON true JOIN cells v ON v.x = a.x AND v.y = n.n // 40 - 1 - a.y JOIN cells b ON b.x = 39 - a.x AND b.y = n.n // 40 - 1 - a.y")
def flipped_heights(spark, sf):
    """Heights mirrored in y, and in both directions."""
    c = T.cells(spark, sf)
    y = T.count_cells(spark, sf) // T.WIDTH - 1 - F.col("y")
    at = lambda x, name: c.select((y * T.WIDTH + x).alias("cell_id"), F.col("height").alias(name))
    return c.select("cell_id").join(at(F.col("x"), "height_y"), "cell_id").join(at(T.WIDTH - 1 - F.col("x"), "height_both"), "cell_id")


@query("", f"""{_with('n', 'cells', b=SQL['climate_and_biomes'], fc=SQL['feature_cells'], h=SQL['havens'])}, rc AS (SELECT DISTINCT l_partkey AS cell_id, true AS on_river FROM lineitem),
k AS (SELECT b.*, precip::DOUBLE AS flux, ([{', '.join(map(str, E.HABITABILITY))}])[biome + 1] AS hab, h.cell_id IS NOT NULL AS coastal, coalesce(on_river, false) AND h.cell_id IS NOT NULL AS estuary, feature FROM b LEFT JOIN h USING (cell_id) LEFT JOIN fc ON fc.cell_id = h.haven LEFT JOIN rc ON rc.cell_id = b.cell_id),
m AS (SELECT median(flux) FILTER (WHERE height >= 20 AND flux > 0) AS md, max(flux) AS mx FROM k)
SELECT cell_id, round(CASE WHEN height < 20 OR hab = 0 THEN 0.0 ELSE hab + coalesce(least(1.0, flux / md) * (1 - md / mx) * 250, 0.0) - (height - 50) / 5.0 + CASE WHEN coastal THEN CASE WHEN estuary THEN 15 ELSE 0 END + CASE feature WHEN 'lake' THEN 10 WHEN 'ocean' THEN 25 ELSE 0 END ELSE -5 END END, 4)::DOUBLE AS score FROM k, m""")
def shore_suitability(spark, sf):
    """Suitability with what coasts, estuaries and the kind of the nearest water add."""
    shore = havens(spark, sf).select("cell_id", F.col("haven").alias("_haven")).join(feature_cells(spark, sf).select(F.col("cell_id").alias("_haven"), F.col("feature").alias("kind")), "_haven")
    b = climate_and_biomes(spark, sf).join(shore, "cell_id", "left").join(_on_river(spark, sf), "cell_id", "left")
    scale = climate_and_biomes(spark, sf).agg(F.median(F.when((F.col("height") >= 20) & (F.col("precip") > 0), F.col("precip").cast("double"))).alias("md"), F.max("precip").alias("mx"))
    k = b.crossJoin(F.broadcast(scale))  # one row
    coastal = F.col("_haven").isNotNull()
    s = E.suitability(E.pick(E.HABITABILITY, F.col("biome")), F.col("precip").cast("double"), F.col("md"), F.col("mx"), F.col("height"), coastal, F.coalesce("on_river", F.lit(False)) & coastal, F.col("kind"))
    return k.select("cell_id", F.round(s, 4).alias("score"))


@query("cells owners edges", "SELECT o.culture_id, count(*) AS shoreline, count(DISTINCT o.cell_id) AS shore_cells FROM owners o JOIN edges e ON e.src = o.cell_id JOIN cells c ON c.cell_id = e.dst WHERE o.culture_id > 0 AND c.height < 20 GROUP BY o.culture_id")
def territory_shores(spark, sf):
    """The length of each culture's shore, in sides of cells, and the number of its cells on it."""
    c = T.cells(spark, sf)
    wet = N.neighbours(c, T.edges(spark, sf), "height").where("height < 20").select(F.col("src").alias("cell_id"))
    o = T.owners(c).where("culture_id > 0").select("cell_id", "culture_id").join(wet, "cell_id")
    return o.groupBy("culture_id").agg(F.count("*").alias("shoreline"), F.countDistinct("cell_id").alias("shore_cells"))


# Edits


@query("edits", f"SELECT b.cell_id, coalesce(e.biome, b.biome)::INT AS biome FROM ({SQL['climate_and_biomes']}) b LEFT JOIN (SELECT cell_id, arg_max(abs(delta) % 18, edit_id) AS biome FROM edits WHERE op = 'set_biome' GROUP BY 1) e USING (cell_id)")
def edited_biomes(spark, sf):
    """Biomes with the last edit of each cell that sets one."""
    last = D.latest(T.edits(spark, sf).where("op = 'set_biome'")).select("cell_id", (F.abs("delta") % len(E.BIOMES)).cast("int").alias("biome"))
    return D.upsert(climate_and_biomes(spark, sf).select("cell_id", "biome"), last.join(T.cells(spark, sf).select("cell_id"), "cell_id", "left_semi"), "cell_id")


@query("cells edges", f"@ h AS ({SQL['edited_heights']}), s AS (SELECT DISTINCT event_id % (SELECT count(*) FROM part) AS cell_id, true AS smooth FROM events WHERE event_type = 'purchase') SELECT h.cell_id, round(CASE WHEN any_value(smooth) THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, (h.height + (h.height + coalesce(sum(o.height), 0)) / (1 + count(o.cell_id))::DOUBLE) / 2)) ELSE h.height::DOUBLE END, 6) AS height FROM h LEFT JOIN s USING (cell_id) LEFT JOIN edges e ON e.src = h.cell_id LEFT JOIN h o ON o.cell_id = e.dst GROUP BY h.cell_id, h.height")
def smoothed_edits(spark, sf):
    """A batch of edits: heights are set and adjusted in order, then the cells that a smooth edit names move towards their neighbours."""
    h = edited_heights(spark, sf)
    named = T.edits(spark, sf).where("op = 'smooth'").select("cell_id").distinct().withColumn("smooth", F.lit(True))
    moved = N.smooth(h, T.edges(spark, sf)).select("cell_id", F.col("height").alias("moved"))
    return h.join(moved, "cell_id").join(named, "cell_id", "left").select("cell_id", F.round(F.when(F.col("smooth"), F.col("moved")).otherwise(F.col("height").cast("double")), 6).alias("height"))


@query("settlements edits n", "@ e AS (SELECT edit_id % (SELECT count(*) FROM customer) AS id, arg_max(op, edit_id) AS op, arg_max(abs(delta), edit_id) AS d FROM edits GROUP BY 1) SELECT s.id, CASE WHEN op = 'set_height' THEN d % 40 ELSE x END::BIGINT AS x, CASE WHEN op = 'set_height' THEN d % (n // 40) ELSE y END::BIGINT AS y, CASE WHEN op = 'adjust_height' THEN (['village', 'town', 'city'])[d % 3 + 1] ELSE kind END AS kind FROM settlements s LEFT JOIN e USING (id), n")
def moved_settlements(spark, sf):
    """Settlements moved, or changed in kind, by the last edit that names them."""
    rows = T.count_cells(spark, sf) // T.WIDTH
    s = T.settlements(spark, sf).select("id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "kind")
    n = T.table(spark, sf, "customer").count()
    e = D.latest(T.edits(spark, sf).withColumn("id", F.col("edit_id") % n), "id").select("id", "op", F.abs("delta").alias("d")).join(s.select("id"), "id", "left_semi")
    moves, kinds = F.col("op") == "set_height", F.col("op") == "adjust_height"
    changes = e.select("id", F.when(moves, F.col("d") % T.WIDTH).alias("x"), F.when(moves, F.col("d") % rows).alias("y"), F.when(kinds, F.element_at(F.array(*[F.lit(k) for k in ("village", "town", "city")]), (F.col("d") % 3 + 1).cast("int"))).alias("kind"))
    return D.upsert(s, changes, "id")


@query("settlements", "SELECT n.n_nationkey AS state_id, n_name || CASE WHEN n_nationkey = 2 THEN ' Union' ELSE '' END AS name, count(s.id) AS n_settlements FROM nation n LEFT JOIN settlements s ON CASE WHEN s.state_id IN (3, 4, 5) THEN 2 ELSE s.state_id END = n.n_nationkey WHERE n_nationkey NOT IN (3, 4, 5) GROUP BY ALL")
def merged_state_settlements(spark, sf):
    """Three states joined to a fourth, which is renamed: settlements are repointed, the merged states' rows go."""
    merged = [3, 4, 5]
    s = D.merge_owners(T.settlements(spark, sf), "state_id", 2, merged).groupBy("state_id").agg(F.count("*").alias("n"))
    states = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("state_id"), F.col("n_name").alias("name"))
    left = D.remove(states, spark.createDataFrame([(i,) for i in merged], "state_id int"), "state_id")
    left = left.withColumn("name", F.when(F.col("state_id") == 2, F.concat("name", F.lit(" Union"))).otherwise(F.col("name")))
    return left.join(s, "state_id", "left").select("state_id", "name", F.coalesce("n", F.lit(0)).alias("n_settlements"))


@query("", "SELECT event_id AS edit_id, true AS stamped FROM events")
def stamped_edits(spark, sf):
    """Edits with the time of their taking up, which is after that of their making."""
    return D.stamped(T.edits(spark, sf)).select("edit_id", (F.col("updated_at") >= F.col("ts")).alias("stamped"))


@query("", SQL["edit_activity"])
def streamed_activity(spark, sf):
    """The activity of the edit log, read as a stream and drained into a table."""
    events = T.table(spark, sf, "events")
    folder = _folder(spark, "events")
    events.repartition(3).write.parquet(folder)
    edits = edit_log.read_edits(spark, folder, T.count_cells(spark, sf))
    return edit_log.drain(edit_log.activity(edits), f"activity_{uuid.uuid4().hex}")


# Society and names


@query("settlements cells edges", f"@ h AS ({SQL['havens']}) SELECT s.id, round(CASE WHEN h.haven IS NULL THEN s.x + 1.0 ELSE s.x + (h.haven % 40 - s.x) * 0.67::DOUBLE END, 2)::DOUBLE AS x, round(CASE WHEN h.haven IS NULL THEN s.y + 1.0 ELSE s.y + (h.haven // 40 - s.y) * 0.67::DOUBLE END, 2)::DOUBLE AS y FROM settlements s LEFT JOIN h USING (cell_id)")
def harbour_positions(spark, sf):
    """Where a port would be for every settlement: towards its nearest water, or a little off where there is none."""
    s = T.settlements(spark, sf).join(havens(spark, sf).select("cell_id", "haven"), "cell_id", "left")
    x, y = S.port_position(F.col("x"), F.col("y"), F.col("haven") % T.WIDTH, F.expr(f"haven div {T.WIDTH}"))
    off = lambda c, moved: F.when(F.col("haven").isNull(), F.round(F.col(c) + 1.0, 2)).otherwise(moved)
    return s.select("id", off("x", x).alias("x"), off("y", y).alias("y"))


_SCOPES = "['culture', 'state', 'global']"


@query("cells edges owners", f"SELECT e.src, e.dst, CASE WHEN b.height >= 20 THEN greatest(1.0 + CASE WHEN o.culture_id = p.culture_id THEN -9.0 ELSE 10.0 END + CASE WHEN o.culture_id <> p.culture_id AND ({_SCOPES})[e.src % 3 + 1] <> 'state' THEN 10.0 ELSE 0.0 END, 0.1) END::DOUBLE AS cost FROM edges e JOIN owners o ON o.cell_id = e.src JOIN owners p ON p.cell_id = e.dst JOIN cells b ON b.cell_id = e.dst")
def religion_costs(spark, sf):
    """What it costs a religion to spread over each side of a cell."""
    o = T.owners(T.cells(spark, sf)).select("cell_id", "culture_id")
    e = T.edges(spark, sf).join(o.select(F.col("cell_id").alias("src"), F.col("culture_id").alias("c1")), "src").join(o.select(F.col("cell_id").alias("dst"), F.col("culture_id").alias("c2")), "dst")
    e = e.join(T.cells(spark, sf).select(F.col("cell_id").alias("dst"), "height"), "dst")
    scope = F.element_at(F.array(*[F.lit(x) for x in ("culture", "state", "global")]), (F.col("src") % 3 + 1).cast("int"))
    return e.select("src", "dst", S.religion_cost(F.col("c1") == F.col("c2"), scope, F.col("height")).alias("cost"))


_FOLK = "['Shamanism', 'Animism', 'Ancestor worship', 'Polytheism']"
_ORGANISED = "['Polytheism', 'Dualism', 'Monotheism', 'Non-theism']"


def _draw(salt, key="k"):
    return f"(({key} * 48271 + {salt}) % 2147483647 * 16807 % 2147483647 // 7 % 65536)"


@query("", f"SELECT r_regionkey AS culture_id, form, r_name || ' ' || word AS name, upper(substr(r_name, 1, 2) || substr(word, 1, 2)) AS code, 'culture' AS scope, 0.0::DOUBLE AS expansionism FROM (SELECT r_regionkey, r_name, form, CASE form WHEN 'Shamanism' THEN 'Spirits' WHEN 'Animism' THEN 'Ways' WHEN 'Ancestor worship' THEN 'Ancestors' ELSE 'Beliefs' END AS word FROM (SELECT *, ({_FOLK})[{_draw(3)} % 4 + 1] AS form FROM (SELECT r_regionkey, r_name, r_regionkey::BIGINT AS k FROM region)))")
def folk_religions(spark, sf):
    """One folk religion for each culture, which does not spread."""
    k = F.col("r_regionkey").cast("long")
    form = F.element_at(F.array(*[F.lit(f) for f in ("Shamanism", "Animism", "Ancestor worship", "Polytheism")]), (generator.scrambled(3, k) % 4 + 1).cast("int"))
    r = T.table(spark, sf, "region").withColumn("form", form)
    name, code = S.folk_religion(F.col("r_name"), F.col("form"))
    return r.select(F.col("r_regionkey").alias("culture_id"), "form", name.alias("name"), code.alias("code"), F.lit("culture").alias("scope"), F.lit(0.0).alias("expansionism"))


_MADE = f"""made AS (SELECT cell_id, k, CASE WHEN {_draw(5)} < 6554 THEN 'Cult' ELSE 'Organized' END AS type, ({_ORGANISED})[{_draw(7)} % 4 + 1] AS form, CASE WHEN {_draw(9)} < 19661 THEN 'culture' WHEN {_draw(9)} < 39322 THEN 'state' ELSE 'global' END AS scope,
 (CASE WHEN {_draw(5)} < 6554 THEN 1 ELSE 4 END + {_draw(11)} % 4)::DOUBLE AS expansionism FROM (SELECT cell_id, cell_id AS k FROM cells WHERE cell_id % 61 = 7 AND height >= 20))"""


def _organised(spark, sf):
    k = F.col("cell_id")
    draw = lambda salt: generator.scrambled(salt, k)
    cult = draw(5) < 6554
    form = F.element_at(F.array(*[F.lit(f) for f in ("Polytheism", "Dualism", "Monotheism", "Non-theism")]), (draw(7) % 4 + 1).cast("int"))
    scope = F.when(draw(9) < 19661, "culture").when(draw(9) < 39322, "state").otherwise("global")
    c = T.cells(spark, sf).where("cell_id % 61 = 7 AND height >= 20")
    return c.select("cell_id", F.when(cult, "Cult").otherwise("Organized").alias("type"), form.alias("form"), scope.alias("scope"), (F.when(cult, 1).otherwise(4) + draw(11) % 4).cast("double").alias("expansionism"))


@query("cells owners", f"@ {_MADE} SELECT made.cell_id AS center, culture_id, type, form, scope, expansionism FROM made JOIN owners USING (cell_id)")
def organised_religions(spark, sf):
    """Organised religions and cults at their centres, with form, scope and expansionism drawn by arithmetic."""
    return _organised(spark, sf).join(T.owners(T.cells(spark, sf)).select("cell_id", "culture_id"), "cell_id").select(F.col("cell_id").alias("center"), "culture_id", "type", "form", "scope", "expansionism")


@query("cells edges owners", f"""@ {_MADE}, who AS (SELECT made.*, made.cell_id AS owner, culture_id AS home FROM made JOIN owners USING (cell_id)),
side AS (SELECT e.src, e.dst, o.culture_id AS c1, p.culture_id AS c2 FROM edges e JOIN owners o ON o.cell_id = e.src JOIN owners p ON p.cell_id = e.dst JOIN cells c ON c.cell_id = e.dst WHERE c.height >= 20 AND e.dst NOT IN (SELECT cell_id FROM who)),
x(cell_id, owner, v) USING KEY (cell_id, owner) AS (SELECT cell_id, owner, 0.0::DOUBLE FROM who UNION SELECT s.dst, x.owner, min(x.v + greatest(1.0::DOUBLE + CASE WHEN c1 = c2 THEN -9.0 ELSE 10.0 END + CASE WHEN c1 <> c2 AND w.scope <> 'state' THEN 10.0 ELSE 0.0 END, 0.1::DOUBLE) / w.expansionism) FROM x JOIN who w USING (owner) JOIN side s ON s.src = x.cell_id LEFT JOIN recurring.x r ON r.cell_id = s.dst AND r.owner = x.owner
 WHERE (w.scope <> 'culture' OR s.c2 = w.home) AND x.v + greatest(1.0::DOUBLE + CASE WHEN c1 = c2 THEN -9.0 ELSE 10.0 END + CASE WHEN c1 <> c2 AND w.scope <> 'state' THEN 10.0 ELSE 0.0 END, 0.1::DOUBLE) / w.expansionism <= 12
 AND (r.v IS NULL OR r.v > x.v + greatest(1.0::DOUBLE + CASE WHEN c1 = c2 THEN -9.0 ELSE 10.0 END + CASE WHEN c1 <> c2 AND w.scope <> 'state' THEN 10.0 ELSE 0.0 END, 0.1::DOUBLE) / w.expansionism) GROUP BY s.dst, x.owner)
SELECT cell_id, round(v, 4) AS cost, owner::BIGINT AS owner FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY v, owner) AS k FROM x) WHERE k = 1""")
def expanded_religions(spark, sf):
    """Religions compete for land: each cell goes to the one that reaches it most cheaply for its expansionism, within its scope."""
    c = T.cells(spark, sf).select("cell_id", "height").join(T.owners(T.cells(spark, sf)).select("cell_id", "culture_id"), "cell_id")
    seeds = _organised(spark, sf).join(c.select("cell_id", F.col("culture_id").alias("home")), "cell_id").select("cell_id", F.col("cell_id").alias("owner"), "home", "scope", "expansionism")
    e = T.edges(spark, sf).join(c.select(F.col("cell_id").alias("src"), F.col("culture_id").alias("from_culture")), "src")
    cost = S.religion_cost(F.col("from_culture") == F.col("culture_id"), F.col("scope"), F.col("height")) / F.col("expansionism")
    allowed = (F.col("scope") != "culture") | (F.col("culture_id") == F.col("home"))
    found = N.expand_by_owner(seeds, c, e, F.when(allowed, cost), 12)
    return found.select("cell_id", F.round("cost", 4).alias("cost"), "owner")


def _colour_sql() -> str:
    """Two colours to HSV, mixed, made brighter, and back, a step a query."""
    hsv = lambda n: (
        f"greatest(r{n}, g{n}, b{n}) AS v{n}, CASE WHEN greatest(r{n}, g{n}, b{n}) = least(r{n}, g{n}, b{n}) THEN 0.0::DOUBLE ELSE (greatest(r{n}, g{n}, b{n}) - least(r{n}, g{n}, b{n})) / greatest(r{n}, g{n}, b{n}) END AS s{n}, "
        f"CASE WHEN greatest(r{n}, g{n}, b{n}) = least(r{n}, g{n}, b{n}) THEN 0.0::DOUBLE WHEN r{n} = greatest(r{n}, g{n}, b{n}) THEN (g{n} - b{n}) / (greatest(r{n}, g{n}, b{n}) - least(r{n}, g{n}, b{n})) / 6 "
        f"WHEN g{n} = greatest(r{n}, g{n}, b{n}) THEN (2 + (b{n} - r{n}) / (greatest(r{n}, g{n}, b{n}) - least(r{n}, g{n}, b{n}))) / 6 ELSE (4 + (r{n} - g{n}) / (greatest(r{n}, g{n}, b{n}) - least(r{n}, g{n}, b{n}))) / 6 END AS w{n}"
    )
    return f"""WITH c AS (SELECT n_nationkey AS id, (n_nationkey * 10 % 256) / 255.0::DOUBLE AS r1, (n_nationkey * 37 % 256) / 255.0::DOUBLE AS g1, (n_nationkey * 91 % 256) / 255.0::DOUBLE AS b1, 128 / 255.0::DOUBLE AS r2, 32 / 255.0::DOUBLE AS g2, 224 / 255.0::DOUBLE AS b2 FROM nation),
h AS (SELECT id, {hsv(1)}, {hsv(2)} FROM c), k AS (SELECT *, w1 - floor(w1) AS h1, w2 - floor(w2) AS h2 FROM h),
t AS (SELECT *, CASE WHEN abs(h1 - h2) > 0.5 AND h1 <= h2 THEN h1 + 1 ELSE h1 END AS a, CASE WHEN abs(h1 - h2) > 0.5 AND h1 > h2 THEN h2 + 1 ELSE h2 END AS b FROM k),
m AS (SELECT id, a * 0.25::DOUBLE + b * (1 - 0.25::DOUBLE) AS u, greatest(0.1::DOUBLE, (s1 * 0.25::DOUBLE + s2 * (1 - 0.25::DOUBLE)) * (1 - 0.4::DOUBLE * 0.2::DOUBLE)) AS s, least(1.0::DOUBLE, (v1 * 0.25::DOUBLE + v2 * (1 - 0.25::DOUBLE)) * (1 + 0.4::DOUBLE)) AS v FROM t),
f AS (SELECT id, s, v, (u - floor(u)) * 6 AS x FROM m), q AS (SELECT id, v, floor(x)::INT % 6 AS i, v * (1 - s) AS p, v * (1 - s * (x - floor(x))) AS q, v * (1 - s * (1 - (x - floor(x)))) AS t FROM f),
o AS (SELECT id, CASE i WHEN 0 THEN [v, t, p] WHEN 1 THEN [q, v, p] WHEN 2 THEN [p, v, t] WHEN 3 THEN [p, q, v] WHEN 4 THEN [t, p, v] ELSE [v, p, q] END AS c FROM q)
SELECT id, '#' || lower(printf('%02X%02X%02X', floor(c[1] * 255)::INT, floor(c[2] * 255)::INT, floor(c[3] * 255)::INT)) AS color FROM o"""


@query("", _colour_sql())
def mixed_colours(spark, sf):
    """A religion's colour: a quarter of its culture's, mixed by hue and made brighter."""
    n = T.table(spark, sf, "nation")
    own = F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex((F.col("n_nationkey") * k % 256).cast("int")), 2, "0")) for k in (10, 37, 91)])
    return n.select(F.col("n_nationkey").alias("id"), names.hsv_mix(own, F.lit("#8020e0"), 0.25, 0.4).alias("color"))


_STEM = "CASE WHEN regexp_matches(lower(right(n, 1)), '[aeiou]') AND regexp_matches('{0}', '^[aeiou]') THEN substr(n, 1, length(n) - 1) ELSE n END || '{0}'"


@query("", f"SELECT id, n AS culture, {_STEM.format('ia')} AS land, {_STEM.format('ton')} AS burg, n || ' River' AS river, 'Mount ' || n AS mountain, CASE id % 3 WHEN 0 THEN 'Kingdom of ' || n WHEN 1 THEN n || ' Republic' ELSE 'Grand Duchy of ' || n END AS title FROM (SELECT n_nationkey AS id, array_to_string([upper(substr(w, 1, 1)) || lower(substr(w, 2)) FOR w IN string_split(n_name, ' ')], ' ') AS n FROM nation)")
def place_names(spark, sf):
    """Names of lands, towns, rivers and mountains, and full titles, made from one name."""
    n = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.initcap("n_name").alias("n"))
    made = names.places(F.col("n"), F.col("id"))
    return n.select("id", F.col("n").alias("culture"), *[v.alias(k) for k, v in made.items()])


@query("settlements", "SELECT culture_id, id, population, rank FROM (SELECT culture_id, id, population, row_number() OVER (PARTITION BY culture_id ORDER BY population DESC, id) AS rank FROM settlements) WHERE rank <= 3")
def largest_by_culture(spark, sf):
    """The three largest settlements of each culture."""
    w = Window.partitionBy("culture_id").orderBy(F.desc("population"), "id")
    s = T.settlements(spark, sf).select("culture_id", "id", "population")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


_SPREAD = "1 + greatest(CASE WHEN height >= 60 THEN 20.0 ELSE -least((100 - height) / 10.0 * 5, 30.0) END::DOUBLE + CASE WHEN height > 70 THEN 50 WHEN height > 50 THEN 10 ELSE 0 END + sqrt(((x - cx) * (x - cx) + (y - cy) * (y - cy))::DOUBLE) / 50, 0.0::DOUBLE)"


@query("cells edges", f"""@ who AS (SELECT cell_id // 97 + 1 AS owner, cell_id AS centre, x AS cx, y AS cy FROM cells WHERE cell_id % 97 = 13 AND height >= 20),
costs AS (SELECT owner, cell_id, {_SPREAD} AS cost FROM who, cells WHERE height >= 20 AND cell_id NOT IN (SELECT centre FROM who)),
x(cell_id, owner, v) USING KEY (cell_id, owner) AS (SELECT centre, owner, 0.0::DOUBLE FROM who UNION SELECT e.dst, x.owner, min(x.v + cost) FROM x JOIN edges e ON e.src = x.cell_id JOIN costs c ON c.cell_id = e.dst AND c.owner = x.owner LEFT JOIN recurring.x r ON r.cell_id = e.dst AND r.owner = x.owner WHERE x.v + cost <= 90 AND (r.v IS NULL OR r.v > x.v + cost) GROUP BY e.dst, x.owner)
SELECT cell_id, round(v, 4) AS cost, owner::BIGINT AS owner FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY v, owner) AS k FROM x) WHERE k = 1""")
def spread_cultures(spark, sf):
    """Cultures with costs of their own: by the people that a cell can feed, its height, and its distance from the culture's centre."""
    c = T.cells(spark, sf).select("cell_id", "x", "y", "height")
    seeds = c.where("cell_id % 97 = 13 AND height >= 20").select("cell_id", (F.expr("cell_id div 97") + 1).alias("owner"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    people = F.when(F.col("height") >= 60, 0.0).otherwise((100 - F.col("height")) / 10.0)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    cost = S.culture_cost(people, F.col("height"), F.sqrt((dx * dx + dy * dy).cast("double")))
    found = N.expand_by_owner(seeds, c, T.edges(spark, sf), F.when(F.col("height") >= 20, 1 + cost), 90)
    return found.select("cell_id", F.round("cost", 4).alias("cost"), "owner")


# The cell graph of jittered points: Voronoi cells of a map of 1000 by 600 with as many points as the world has cells


def _jitter(salt: int) -> str:
    return f"((((id * 48271 + {salt}) % 2147483647 * 16807 % 2147483647) // 7 % 65536) / 65535.0::DOUBLE * 2 - 1) * s * 0.45"


_POINTS = f"""{WORLD['n']}, g AS (SELECT *, ceil((1000 - s / 2) / s)::BIGINT AS nx, ceil((600 - s / 2) / s)::BIGINT AS ny, -round_even(s, 0)::BIGINT AS o FROM (SELECT round(sqrt(600000 / n::DOUBLE), 2) AS s FROM n)),
rim AS (SELECT *, ceil((1000 - 2 * o) / (2 * s))::BIGINT - 1 AS rx, ceil((600 - 2 * o) / (2 * s))::BIGINT - 1 AS ry FROM g),
across AS (SELECT i, ceil((1000 - 2 * o) * (i + 0.5) / rx + o) AS v FROM (SELECT *, unnest(range(rx)) AS i FROM rim)), down AS (SELECT i, ceil((600 - 2 * o) * (i + 0.5) / ry + o) AS v FROM (SELECT *, unnest(range(ry)) AS i FROM rim)),
outer_ AS (SELECT -1 - i AS cell_id, v::DOUBLE AS x, o::DOUBLE AS y FROM across, rim UNION ALL SELECT -1 - i - rx, v::DOUBLE, 600 - o FROM across, rim UNION ALL SELECT -1 - i - 2 * rx, o, v FROM down, rim UNION ALL SELECT -1 - i - 2 * rx - ry, 1000 - o, v FROM down, rim),
own0 AS MATERIALIZED (SELECT id AS cell_id, round(least(1000.0, greatest(0.0, s / 2 + (id % nx) * s + {_jitter(7)})), 2)::DOUBLE AS x, round(least(600.0, greatest(0.0, s / 2 + (id // nx) * s + {_jitter(984)})), 2)::DOUBLE AS y FROM (SELECT *, unnest(range(nx * ny)) AS id FROM g))"""


def _voronoi(k: int) -> str:
    """sides{k}: the edges of the cells of own{k}, each the part of a bisector that all points within four spacings leave."""
    return f"""all{k} AS (SELECT *, false AS is_edge FROM own{k} UNION ALL SELECT *, true FROM outer_),
near{k} AS MATERIALIZED (SELECT a.cell_id AS a, a.x, a.y, b.cell_id AS b, b.is_edge, b.x - a.x AS bx, b.y - a.y AS by_ FROM own{k} a JOIN all{k} b ON a.cell_id <> b.cell_id AND b.x BETWEEN a.x - 4 * (SELECT s FROM g) AND a.x + 4 * (SELECT s FROM g) AND b.y BETWEEN a.y - 4 * (SELECT s FROM g) AND a.y + 4 * (SELECT s FROM g)),
bound{k} AS (SELECT p.*, d.b AS d, p.bx * d.by_ - p.by_ * d.bx AS turn, (d.bx * d.bx + d.by_ * d.by_ - p.bx * d.bx - p.by_ * d.by_) / 2 AS room FROM near{k} p JOIN near{k} d ON d.a = p.a AND d.b <> p.b),
ends{k} AS (SELECT a, b, any_value(is_edge) AS is_edge, any_value(x) AS x, any_value(y) AS y, any_value(bx) AS bx, any_value(by_) AS by_, max(room / turn) FILTER (turn < 0) AS lo, min(room / turn) FILTER (turn > 0) AS hi, arg_max(d, room / turn) FILTER (turn < 0) AS dlo, arg_min(d, room / turn) FILTER (turn > 0) AS dhi FROM bound{k} GROUP BY a, b HAVING NOT bool_or(turn = 0 AND room < 0)),
sides{k} AS MATERIALIZED (SELECT *, bx / 2 - lo * by_ AS px, by_ / 2 + lo * bx AS py, bx / 2 - hi * by_ AS qx, by_ / 2 + hi * bx AS qy FROM ends{k} WHERE hi - lo > 1e-9)"""


def _centred(k: int) -> str:
    """own{k + 1}: the points of own{k} at the centroids of their cells."""
    at = lambda v, n, p, q: f"least({n}.0::DOUBLE, greatest(0.0::DOUBLE, any_value({v}) + sum(({p} + {q}) * (px * qy - py * qx)) / (3 * sum(px * qy - py * qx)))) AS {v}"
    return f"own{k + 1} AS MATERIALIZED (SELECT a AS cell_id, {at('x', 1000, 'px', 'qx')}, {at('y', 600, 'py', 'qy')} FROM sides{k} GROUP BY a)"


_CELLS = f"WITH {_POINTS}, {_voronoi(0)}"


def _grid(spark, sf):
    s = generator.spacing_of(1000, 600, T.count_cells(spark, sf))
    return generator.grid_points(spark, 1000, 600, s, 7), s


@query("", f"""{_CELLS} SELECT a AS cell_id, round(any_value(x), 4) AS x, round(any_value(y), 4) AS y, count(*) AS n_corners, bool_or(is_edge) AS is_border, round(sum(px * qy - py * qx) / 2, 4) AS area,
round(any_value(x) + sum((px + qx) * (px * qy - py * qx)) / (3 * sum(px * qy - py * qx)), 4) AS cx, round(any_value(y) + sum((py + qy) * (px * qy - py * qx)) / (3 * sum(px * qy - py * qx)), 4) AS cy FROM sides0 GROUP BY a""")
def voronoi_cells(spark, sf):
    found = voronoi.cells(*_grid(spark, sf))
    return found.select("cell_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.size("corners").cast("long").alias("n_corners"), "is_border", *[F.round(v, 4).alias(v) for v in ("area", "cx", "cy")])


@query("", f"{_CELLS} SELECT a AS src, b AS dst FROM sides0 WHERE NOT is_edge")
def voronoi_edges(spark, sf):
    return voronoi.edges(voronoi.cells(*_grid(spark, sf)))


@query("", f"{_CELLS} SELECT v[1] AS a, v[2] AS b, v[3] AS c, round(min(x), 4) AS x, round(min(y), 4) AS y, count(*) AS n_cells FROM (SELECT list_sort([a, b, dhi]) AS v, x + qx AS x, y + qy AS y FROM sides0) GROUP BY v")
def voronoi_vertices(spark, sf):
    found = voronoi.vertices(voronoi.cells(*_grid(spark, sf)))
    return found.select("a", "b", "c", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.size("cells").cast("long").alias("n_cells"))


@query("", f"{_CELLS}, e AS (SELECT array_to_string(list_sort([a, b, dlo]), ' ') AS src, array_to_string(list_sort([a, b, dhi]), ' ') AS dst FROM sides0) SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def voronoi_vertex_edges(spark, sf):
    found = voronoi.vertex_edges(voronoi.cells(*_grid(spark, sf)))
    return found.select(F.array_join(F.col("src").cast("array<string>"), " ").alias("src"), F.array_join(F.col("dst").cast("array<string>"), " ").alias("dst"))


@query("", f"WITH {_POINTS}, {', '.join(f'{_voronoi(k)}, {_centred(k)}' for k in range(3))} SELECT cell_id, round(x, 4) AS x, round(y, 4) AS y FROM own3")
def relaxed_points(spark, sf):
    """Three rounds of Lloyd's relaxation."""
    points, s = _grid(spark, sf)
    return voronoi.relaxed(points, s, 1000, 600).where("NOT is_edge").select("cell_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
