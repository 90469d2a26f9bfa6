"""Sequential algorithms on one map, for tests to hold operators.graph against."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cartoweave.operators.graph import SEA


def per_map(cells: DataFrame, edges: DataFrame, work, schema: str) -> DataFrame:
    """work(cells, neighbours) -> DataFrame for each map_id; cells sorted by cell_id, neighbours as lists of places."""

    def run(c: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("cell_id").reset_index(drop=True)
        place = pd.Series(np.arange(len(c)), index=c["cell_id"].to_numpy())
        near: list[list[int]] = [[] for _ in range(len(c))]
        for a, b in zip(place.reindex(e["src"]).to_numpy(), place.reindex(e["dst"]).to_numpy(), strict=True):
            near[int(a)].append(int(b))
        out = work(c, near)
        out.insert(0, "map_id", c["map_id"].iloc[0])
        return out

    c, e = cells.toPandas(), edges.toPandas()
    return cells.sparkSession.createDataFrame(pd.concat([run(m, e[e["map_id"] == i]) for i, m in c.groupby("map_id")]), schema)


def drainage(c: pd.DataFrame, near: list[list[int]], whole: bool = True) -> pd.DataFrame:
    """filled (priority flood from the border; whole numbers or not), to (lowest neighbour or -1), flux (precip of all above)."""
    h = c["height"].to_numpy(np.float64)
    filled = h.copy()
    seen = c["is_border"].to_numpy(bool).copy()
    heap = [(h[i], i) for i in np.flatnonzero(seen)]
    heapq.heapify(heap)
    while heap:
        level, i = heapq.heappop(heap)
        for j in near[i]:
            if not seen[j]:
                seen[j] = True
                filled[j] = max(h[j], level)
                heapq.heappush(heap, (filled[j], j))
    to = np.full(len(h), -1)
    for i, around in enumerate(near):
        if around:
            low = min(around, key=lambda j: (filled[j], j))
            if filled[low] < filled[i]:
                to[i] = low
    flux = c["precip"].to_numpy(np.float64).copy()
    for i in np.argsort(-filled, kind="stable"):
        if to[i] >= 0:
            flux[to[i]] += flux[i]
    ids = c["cell_id"].to_numpy()
    return pd.DataFrame({"cell_id": ids, "filled": filled.astype(np.int64) if whole else filled, "to": np.where(to >= 0, ids[to], -1), "flux": flux.astype(np.int64)})


DRAINAGE = "map_id long, cell_id long, filled long, `to` long, flux long"


def spread(c: pd.DataFrame, near: list[list[int]], limit: int) -> pd.DataFrame:
    """owner and cost by cheapest path, ties to the lesser owner; columns seed, the owner that starts there or null, and cost, NaN blocks."""
    cost, ids = c["cost"].to_numpy(np.float64), c["cell_id"].to_numpy()
    seed = c["seed"]
    best: dict[int, tuple[float, int]] = {}
    heap = [(0.0, int(seed.iloc[k]), k) for k in np.flatnonzero(seed.notna())]
    heapq.heapify(heap)
    while heap:
        d, owner, i = heapq.heappop(heap)
        if i in best:
            continue
        best[i] = (d, owner)
        for j in near[i]:
            if j not in best and cost[j] == cost[j] and d + cost[j] <= limit:
                heapq.heappush(heap, (d + cost[j], owner, j))
    return pd.DataFrame([(ids[i], int(d), o) for i, (d, o) in best.items()], columns=["cell_id", "cost", "owner"])


def label(c: pd.DataFrame, near: list[list[int]], kind: str) -> pd.DataFrame:
    """kind and region (least cell) of connected cells of one kind."""
    k, ids = c[kind].to_numpy(), c["cell_id"].to_numpy()
    region = np.full(len(c), -1)
    for first in range(len(c)):
        if region[first] >= 0:
            continue
        region[first] = first
        todo = [first]
        while todo:
            for j in near[todo.pop()]:
                if region[j] < 0 and k[j] == k[first]:
                    region[j] = first
                    todo.append(j)
    return pd.DataFrame({"cell_id": ids, "kind": k, "region": ids[region]})


def coast_distance(c: pd.DataFrame, near: list[list[int]], lowest: int = -10) -> pd.DataFrame:
    """1, 2, ... inland from the coast, -1 ... lowest out to sea, 0 beyond."""
    land = c["height"].to_numpy() >= SEA
    d = np.zeros(len(c), np.int64)
    ring = [i for i, around in enumerate(near) if any(land[j] != land[i] for j in around)]
    step = 1
    while ring:
        for i in ring:
            d[i] = step if land[i] else -step
        step += 1
        ring = list({j for i in ring for j in near[i] if land[j] == land[i] and not d[j] and (land[j] or step <= -lowest)})
    return pd.DataFrame({"cell_id": c["cell_id"].to_numpy(), "distance": d})
