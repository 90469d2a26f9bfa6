"""World queries on heightmap programs; they register themselves with those of queries.py."""

from __future__ import annotations

from cartoweave.operators import terrain
from cartoweave.queries import query
from cartoweave.sources import tables as T
from cartoweave.sources.generator import TEMPLATES

SEED, MADE_FOR = 7, 2000


def _noise(seed: str, key: str) -> str:
    return f"((({key}) % 2147483648 * 48271 + {seed}) % 2147483647 * 16807 % 2147483647 // 7 % 65536 / 65536.0::DOUBLE)"


def program_sql(program: list[str], seed: int, made_for: int) -> str:
    """Common table expressions for a program over the lattice, one or more a run, and the select of its result; growth goes ring by ring."""
    commands, blobs = terrain.drawn(program, seed)
    power, line_power = terrain.BLOB_POWER[made_for], terrain.LINE_POWER[made_for]
    number = lambda v: f"{float(v)!r}::DOUBLE"
    kept = lambda e: f"round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, {e})), 6)"
    rows = ", ".join(f"({b.b}::BIGINT, {b.seq}, '{b.kind}', {b.top}::BIGINT, {b.width}, {b.seed}::BIGINT, {', '.join(map(number, (*b.x, *b.y)))}, {b.tries}::BIGINT, {b.reach(line_power) if b.line else 10**9}::BIGINT, [{', '.join(map(number, b.rings(line_power) if b.line else []))}]::DOUBLE[])" for b in blobs)
    out = [
        "box AS (SELECT min(x)::DOUBLE AS x0, max(x)::DOUBLE AS x1, min(y)::DOUBLE AS y0, max(y)::DOUBLE AS y1 FROM cells)",
        f"blobs(b, seq, kind, top, width, seed, xl, xh, yl, yh, tries, reach, rings) AS (VALUES {rows})",
        f"""places AS (SELECT p.*, c.cell_id, c.x, c.y FROM (SELECT b.*, t, x0 + (x1 - x0) * (xl + (xh - xl) * {_noise('seed', 't * 2')}) / 100.0::DOUBLE AS px,
          y0 + (y1 - y0) * (yl + (yh - yl) * {_noise('seed', 't * 2 + 1')}) / 100.0::DOUBLE AS py FROM blobs b JOIN range(0, {terrain.PLACES}) r(t) ON t < tries, box) p JOIN cells c ON c.x = ceil(px - 0.5) AND c.y = ceil(py - 0.5))""",
        "h0 AS (SELECT cell_id, x, y, 0.0::DOUBLE AS h FROM cells)",
    ]
    k = 0
    for run in terrain.runs(commands):
        name, *a = commands[run[0]]
        if name in terrain.GROWING:
            fit = f"CASE WHEN kind = 'Hill' THEN CASE WHEN h + top <= {terrain.TOP} THEN t END WHEN kind IN ('Range', 'Strait') OR h >= {terrain.LAND} THEN t WHEN t = tries - 1 THEN tries END"
            out.append(f"s{k} AS (SELECT unnest(s) FROM (SELECT arg_min(p, r) AS s FROM (SELECT p, {fit} AS r FROM places p JOIN h{k} USING (cell_id) WHERE seq IN ({', '.join(map(str, run))})) WHERE r IS NOT NULL GROUP BY p.b))")
            out.append(f"""e{k} AS (SELECT s.*, CASE WHEN kind <> 'Strait' THEN ex WHEN yh = 0 THEN x0 + (x1 - x0) - (px - x0) - 0.1::DOUBLE * (x1 - x0) + 0.2::DOUBLE * (x1 - x0) * {_noise('seed + 2', '0')} ELSE x1 END AS ex,
              CASE WHEN kind <> 'Strait' THEN ey WHEN yh = 0 THEN y1 ELSE y0 + (y1 - y0) - (py - y0) - 0.1::DOUBLE * (y1 - y0) + 0.2::DOUBLE * (y1 - y0) * {_noise('seed + 2', '0')} END AS ey
              FROM s{k} s JOIN (SELECT b, arg_min(ex, r) AS ex, arg_min(ey, r) AS ey FROM (SELECT b, ex, ey, CASE WHEN abs(ey - py) + abs(ex - px) BETWEEN (x1 - x0) / 8 AND (x1 - x0) / CASE kind WHEN 'Range' THEN 3 ELSE 2 END THEN t2 WHEN t2 = {terrain.PLACES - 1} THEN t2 END AS r
                FROM (SELECT *, x0 + (x1 - x0) * (0.1::DOUBLE + 0.8::DOUBLE * {_noise('seed + 2', 't2 * 2')}) AS ex, y0 + (y1 - y0) * (0.15::DOUBLE + 0.7::DOUBLE * {_noise('seed + 2', 't2 * 2 + 1')}) AS ey FROM s{k}, box, range(0, {terrain.PLACES}) r(t2))) WHERE r IS NOT NULL GROUP BY b) USING (b), box WHERE reach < 1000000000)""")
            out.append(f"""w{k}(b, cell_id, far) AS (SELECT b, cell_id, (x - ex) * (x - ex) + (y - ey) * (y - ey) FROM e{k} UNION ALL SELECT b, n.cell_id, n.d FROM (SELECT b, arg_min({{'cell_id': cell_id, 'd': d}}, {{'judged': judged, 'cell_id': cell_id}}) AS n FROM
              (SELECT w.b, c.cell_id, w.far, (c.x - ex) * (c.x - ex) + (c.y - ey) * (c.y - ey) AS d, d * CASE WHEN {_noise('seed + 1', 'c.cell_id')} > 0.85 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS judged
                FROM w{k} w JOIN e{k} e ON e.b = w.b JOIN edges ON src = w.cell_id JOIN cells c ON c.cell_id = dst) WHERE d < far GROUP BY b))""")
            out.append(f"""g{k}(b, cell_id, d, v) USING KEY (b, cell_id) AS (SELECT * FROM (SELECT b, cell_id, 0::BIGINT, top FROM s{k} WHERE reach = 1000000000 UNION ALL SELECT b, cell_id, 0, 0 FROM w{k}) UNION
              SELECT g.b, dst, g.d + 1, max(CASE WHEN reach = 1000000000 AND g.v > 1 THEN floor(pow(g.v::DOUBLE, {number(power)}) * (0.9::DOUBLE + 0.2::DOUBLE * {_noise('seed', 'dst')}))::BIGINT ELSE 0 END)
              FROM g{k} g JOIN blobs USING (b) JOIN edges ON src = g.cell_id LEFT JOIN recurring.g{k} o ON o.b = g.b AND o.cell_id = dst WHERE g.d < reach AND o.b IS NULL GROUP BY g.b, dst, g.d)""")
            change = f"CASE kind WHEN 'Hill' THEN v WHEN 'Pit' THEN -v WHEN 'Strait' THEN 0.9::DOUBLE - 0.1::DOUBLE / width * (width - greatest(d, 1) + 1) ELSE CASE kind WHEN 'Range' THEN 1 ELSE -1 END * rings[d + 1] * (0.85::DOUBLE + 0.3::DOUBLE * {_noise('seed', 'cell_id')}) END"
            sums = ", ".join(f"coalesce(sum(c) FILTER (WHERE seq = {q}), 0.0::DOUBLE) AS a{q}" for q in run)
            out.append(f"a{k} AS (SELECT cell_id, {sums} FROM (SELECT cell_id, seq, {change} AS c FROM g{k} JOIN blobs USING (b)) GROUP BY cell_id)")
            inner = f"(SELECT * FROM h{k} LEFT JOIN a{k} USING (cell_id))"
            for q in run:
                e = f"CASE WHEN coalesce(a{q}, 0.0::DOUBLE) > 0 THEN pow(h, a{q}) ELSE h END" if commands[q][0] == "Strait" else f"h + coalesce(a{q}, 0.0::DOUBLE)"
                inner = f"(SELECT * REPLACE ({kept(e)} AS h) FROM {inner})"
            out.append(f"h{k + 1} AS (SELECT cell_id, x, y, h FROM {inner})")
        elif name == "Smooth":
            f = number(a[0])
            out.append(f"h{k + 1} AS (SELECT o.cell_id, o.x, o.y, {kept(f'(o.h * ({f} - 1) + (o.h + coalesce(sum(n.h), 0.0::DOUBLE)) / (count(n.h) + 1)) / {f}')} AS h FROM h{k} o LEFT JOIN edges ON src = o.cell_id LEFT JOIN h{k} n ON n.cell_id = dst GROUP BY o.cell_id, o.x, o.y, o.h)")
        elif name == "Mask":
            v = float(a[0])
            edge = "((1 - nx * nx) * (1 - ny * ny))"
            out.append(f"h{k + 1} AS (SELECT cell_id, x, y, {kept(f'(h * {number(abs(v) - 1)} + h * {edge if v > 0 else f'(1 - {edge})'}) / {number(abs(v))}')} AS h FROM (SELECT *, 2.0::DOUBLE * (x - x0) / (x1 - x0) - 1.0::DOUBLE AS nx, 2.0::DOUBLE * (y - y0) / (y1 - y0) - 1.0::DOUBLE AS ny FROM h{k}, box))")
        else:
            low, high = (20.0, 100.0) if a[1] == "land" else (0.0, 100.0) if a[1] == "all" else map(float, a[1].split("-"))
            pivot = number(20.0 if low == 20.0 else 0.0)
            new = f"greatest(h + {number(a[0])}, {pivot})" if name == "Add" else f"(h - {pivot}) * {number(a[0])} + {pivot}"
            out.append(f"h{k + 1} AS (SELECT cell_id, x, y, {kept(f'CASE WHEN h BETWEEN {low} AND {high} THEN {new} ELSE h END')} AS h FROM h{k})")
        k += 1
    return f"@ {', '.join(out)} SELECT cell_id, floor(h)::INT AS height FROM h{k}"


@query("cells edges", program_sql(TEMPLATES["continents"], SEED, MADE_FOR))
def grown_heights(spark, sf):
    """A world's heights by a program of hills, ranges, straits, troughs, pits and masks, grown on the graph of its cells."""
    return terrain.heights(T.cells(spark, sf), T.edges(spark, sf), TEMPLATES["continents"], SEED, MADE_FOR)
