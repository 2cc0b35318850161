"""Greedy spacing: in order, drop a point closer than a distance to a kept one.

The rule is order-dependent, so a point's fate rests on earlier points only. Exact
copies go first, in one aggregation. The plane is then tiled. Each (key, tile) is walked
in order by one task, as a stream that holds only kept and undecided points:

* a point near an earlier kept one is dropped;
* a point with an undecided earlier neighbour waits;
* any other is kept.

Points within the distance of a tile's edge are also shown to the tiles beyond it. What
waits there is settled in further rounds, over the tiles that still have open points only.
The earliest open point is settled in every round, and a chain of points that each decide the
next needs a round per tile it crosses, not per point. There is one way for all sizes; a
chain that is one key spreads over its tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkloom.functions import spherefn
from perkloom.functions.fixed_values import DUPLICATE_BRANCH_M, EARTH_RADIUS_M
from perkloom.session import written

TILE_M = 50_000.0
KEPT, OPEN, DROPPED = 1, 0, -1


def _distance_m(a: tuple[float, float], b: tuple[float, float]) -> float:
    x = math.sin(math.radians(b[0] - a[0]) / 2)
    y = math.sin(math.radians(b[1] - a[1]) / 2)
    h = x * x + y * y * math.cos(math.radians(a[0])) * math.cos(math.radians(b[0]))
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


class _Walk:
    """Kept and undecided points of one tile, by cube of the distance's size."""

    def __init__(self, min_m: float):
        self.min_m, self.cubes = min_m, {}

    def _cube(self, point):
        lat, lng = math.radians(point[0]), math.radians(point[1])
        side = self.min_m + spherefn.SLACK_M
        return (
            math.floor(EARTH_RADIUS_M * math.cos(lat) * math.cos(lng) / side),
            math.floor(EARTH_RADIUS_M * math.cos(lat) * math.sin(lng) / side),
            math.floor(EARTH_RADIUS_M * math.sin(lat) / side),
        )

    def settle(self, point, state: int | None) -> int:
        """State of the next point; ``state`` is given for points of other tiles and for those
        settled before."""
        x, y, z = self._cube(point)
        if state is None:
            state = KEPT
            for cube in ((x + i, y + j, z + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)):
                for other, how in self.cubes.get(cube, ()):
                    if _distance_m(other, point) < self.min_m:
                        state = min(state, DROPPED if how == KEPT else OPEN)
                if state == DROPPED:
                    break
        if state != DROPPED:
            self.cubes.setdefault((x, y, z), []).append((point, state))
        return state


def _round(laid: DataFrame, key: str, min_m: float) -> DataFrame:
    """Walk the tiles; the states of each tile's own points."""
    names = [f.name for f in laid.schema.fields if f.name not in ("tile", "own")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tile = None, None
        for batch in batches:
            states = []
            for where, lat, lng, state, own in zip(
                zip(batch["_key"], batch["tile"]), batch["lat"], batch["lng"], batch["state"], batch["own"]
            ):
                if where != at:
                    at, tile = where, _Walk(min_m)
                known = None if own and state == OPEN else state
                states.append(tile.settle((lat, lng), known))
            yield batch.assign(state=states)[batch["own"]][[*names]]

    placed = laid.withColumn("_key", F.to_json(F.struct(key)))
    in_order = placed.repartition("_key", "tile").sortWithinPartitions("_key", "tile", "seq", "lat", "lng")
    schema = laid.select(*names).schema
    return in_order.mapInPandas(walk, schema)


def keep_spaced(
    points: DataFrame, key: str, min_m: float = DUPLICATE_BRANCH_M, tile_m: float = TILE_M
) -> DataFrame:
    """(key, seq, lat, lng) of the points kept; ``seq`` orders them."""
    lat, lng = F.col("lat"), F.col("lng")
    home = spherefn.cell_of(lat, lng, tile_m)
    state = (
        points.where("lat IS NOT NULL AND lng IS NOT NULL")
        .groupBy(key, "lat", "lng").agg(F.min("seq").alias("seq"))
        .select(key, "seq", "lat", "lng", F.lit(OPEN).alias("state"))
    )
    todo, settled = state, None
    while True:
        reach = spherefn.cells_within(lat, lng, F.lit(float(min_m)), tile_m)
        laid = todo.withColumn("tile", F.explode(reach)).withColumn("own", F.col("tile") == home)
        if settled is not None:
            waiting = todo.where(F.col("state") == OPEN).select(key, home.alias("tile")).distinct()
            laid = laid.join(waiting, [key, "tile"], "left_semi")
            settled = todo.withColumn("tile", home).join(waiting, [key, "tile"], "left_anti").drop("tile")
        walked = _round(laid, key, min_m)
        if settled is not None:
            walked = walked.unionByName(settled)
        todo = settled = written(walked.where(F.col("state") != DROPPED), "spacing")
        if todo.where(F.col("state") == OPEN).isEmpty():
            return todo.select(key, "seq", "lat", "lng")
