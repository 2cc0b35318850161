"""The k nearest fences of every position, exactly, without comparing all pairs.

Sites and positions are both kept in a tree of cubes (edges ``FANOUT`` times longer
per level). The walk goes down both trees at once: a frontier row pairs a position
cube with a site cube that may still hold one of its k nearest fences. A site cube
is dropped when its nearest corner is farther than a distance within which k fences
certainly lie, so each position cube keeps a few dozen site cubes whatever the size
of the catalog. Upper levels have few cubes; only *occupied* smallest cubes reach
the bottom, and there positions are measured against a short list of sites. An
isolated position simply walks with longer distances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions import spherefn
from perkloom.operators.skew import hot_splits, skew_join
from perkloom.operators.spots import SPOTS, at_points, places_of, standing
from perkloom.session import ensure_checkpoint_dir

BASE_SIDE_M = 64.0
FANOUT_BITS = 2
# Edge of the top cube exceeds the planet's diameter: 64 m * 4**9 > 2 R.
TOP = 9
VENUE_SLOTS = 32
AXES = spherefn.AXES


def _base(df: DataFrame, prefix: str) -> DataFrame:
    """Adds the smallest-cube index per axis."""
    at = spherefn.axes(F.col("lat"), F.col("lng"))
    return df.withColumns(
        {prefix + a: spherefn.axis_cell(at[a], BASE_SIDE_M) for a in AXES}
    )


def _up(column: str, level: int) -> Column:
    return F.shiftright(F.col(column), FANOUT_BITS * level)


def _cube(prefix: str, level: int) -> Column:
    return spherefn.pack(*(_up(prefix + a, level) for a in AXES))


def _chord(level: int, apart: int) -> Column:
    """Nearest (``apart`` = -1) or farthest (+1) distance of two cubes of a level."""
    side = F.lit(BASE_SIDE_M * (1 << (FANOUT_BITS * level)))
    total = F.lit(0.0)
    for a in AXES:
        steps = F.greatest(F.lit(0), F.abs(F.col("p" + a) - F.col("s" + a)) + apart)
        total = total + F.pow(steps * side, F.lit(2.0))
    return F.sqrt(total)


def fence_sites(venues: DataFrame, merchants: DataFrame, branches: DataFrame) -> DataFrame:
    """Every place a fence can stand: venues, and each branch of each merchant.

    ``first`` marks one site per fence, so sites can be counted as fences.
    """
    malls = venues.select(
        F.col("id").alias("fence_id"), "name", F.lit(0).alias("kind"),
        F.col("seq").cast("bigint").alias("seq"), F.lit(0).alias("branch_no"), "lat", "lng",
        F.col("radius_m").cast("int").alias("radius_m"), F.lit(1).alias("first"),
    )
    primary = branches.groupBy("merchant_id").agg(F.min("branch_no").alias("_first_no"))
    shops = (
        branches.join(primary, "merchant_id")
        .join(merchants.select(F.col("id").alias("merchant_id"), "name", "seq"), "merchant_id")
        .select(
            F.concat(F.lit(V.SHOP_PREFIX), "merchant_id").alias("fence_id"), "name",
            F.lit(1).alias("kind"), F.col("seq").cast("bigint").alias("seq"),
            F.col("branch_no").cast("int").alias("branch_no"), "lat", "lng",
            F.lit(V.SHOP_RADIUS_M).alias("radius_m"),
            (F.col("branch_no") == F.col("_first_no")).cast("int").alias("first"),
        )
    )
    return malls.unionByName(shops)


def _site_cubes(sites: DataFrame, level: int) -> DataFrame:
    """Occupied cubes of one level with their fence count and their parent."""
    at = [_up("b" + a, level).alias("s" + a) for a in AXES]
    return sites.groupBy(*at, _cube("b", level + 1).alias("s_parent")).agg(
        F.sum("first").alias("fences")
    )


def _position_cubes(cells: DataFrame, level: int) -> DataFrame:
    at = [_up("b" + a, level).alias("p" + a) for a in AXES]
    return cells.select(*at, _cube("b", level + 1).alias("p_parent")).distinct()


def _narrow(met: DataFrame, level: int, k: int) -> DataFrame:
    """Drop site cubes that cannot hold one of the k nearest fences.

    The bound of the parent cube holds for its children, so most pairs go before
    the window.
    """
    close = met.select(
        spherefn.pack(*(F.col("p" + a) for a in AXES)).alias("p_cube"),
        spherefn.pack(*(F.col("s" + a) for a in AXES)).alias("s_cube"),
        _chord(level, -1).alias("near"),
        _chord(level, +1).alias("far"),
        "fences",
        "bound",
    ).where("near <= bound")
    own = Window.partitionBy("p_cube")
    by_far = own.orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = close.withColumn("_sum", F.sum("fences").over(by_far))
    certain = F.min(F.when(F.col("_sum") >= k, F.col("far") + spherefn.SLACK_M)).over(own)
    return (
        summed.withColumn("bound", F.least("bound", certain))
        .where("near <= bound")
        .select(F.col("p_cube").alias("p_parent"), F.col("s_cube").alias("s_parent"), "bound")
    )


def candidate_sites(cells: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """(cell, site...) that can matter to any position in the cell.

    ``cells``: distinct smallest cubes of the positions; ``placed``: the sites with
    theirs. Each level's frontier is written out: it is small beside the positions,
    and the plan of a level does not drag all levels above it along.
    """
    ensure_checkpoint_dir(cells.sparkSession)
    cells, placed = cells.checkpoint(), placed.checkpoint()
    frontier = None
    for level in range(TOP - 1, -1, -1):
        p, s = _position_cubes(cells, level), _site_cubes(placed, level)
        if frontier is None:
            # All of these lie in the one top cube, which has at most 4**3 children.
            met = p.join(s, F.col("p_parent") == F.col("s_parent")).withColumn(
                "bound", F.lit(float("inf"))
            )
        else:
            met = frontier.join(p, "p_parent").join(s, "s_parent")
        frontier = _narrow(met, level, k).checkpoint()
    leaf = placed.withColumn("s_parent", _cube("b", 0)).drop("bx", "by", "bz")
    found = (
        frontier.select(F.col("p_parent").alias("cell"), "s_parent")
        .join(leaf.withColumnsRenamed({"lat": "s_lat", "lng": "s_lng"}), "s_parent")
        .drop("s_parent")
    )
    # The rows are few but stand for many distances: keep them in all partitions.
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "cell")


def nearest_fences(
    positions: DataFrame,
    venues: DataFrame,
    merchants: DataFrame,
    branches: DataFrame,
    position_id: str,
    limit: int = V.MAX_FENCES,
    **bounds,
) -> DataFrame:
    """The ``limit`` nearest fences per position: one per venue and one per
    merchant, at its nearest branch. Ties: venues first, then catalog order."""
    stood = standing(positions, position_id)
    known = _base(places_of(stood), "b")
    cells = known.select("bx", "by", "bz").distinct()
    short_list = candidate_sites(
        cells, _base(fence_sites(venues, merchants, branches), "b"), limit
    )
    placed = known.select(SPOTS, "lat", "lng", _cube("b", 0).alias("cell"))
    crowded = hot_splits(placed, None, ["cell"], **bounds)
    pairs = skew_join(
        placed, short_list, ["cell"], [SPOTS], ["fence_id", "branch_no"], crowded
    ).withColumn(
        "distance_m",
        spherefn.haversine_m(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng")),
    )
    one_each = pairs.groupBy(SPOTS, "fence_id").agg(
        F.min(
            F.struct("distance_m", "branch_no", "kind", "seq", "name", "s_lat", "s_lng", "radius_m")
        ).alias("at")
    )
    order = Window.partitionBy(SPOTS).orderBy("distance_m", "kind", "seq")
    picked = (
        one_each.select(SPOTS, "fence_id", "at.*")
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
        .withColumnsRenamed({"s_lat": "fence_lat", "s_lng": "fence_lng"})
    )
    return at_points(stood, picked, position_id, **bounds)


def fences_to_monitor(
    last_known: DataFrame,
    venues: DataFrame,
    merchants: DataFrame,
    branches: DataFrame,
    position_id: str,
    limit: int = V.MAX_FENCES,
    **bounds,
) -> DataFrame:
    """Nearest fences where a position is known, the whole venue list where not."""
    picked = nearest_fences(
        last_known, venues, merchants, branches, position_id, limit, **bounds
    ).select(position_id, "fence_id", "radius_m")
    # Without a position every venue is armed. Venues are dealt into slots and each
    # such row visits every slot, so the list is never gathered in one place.
    slot = F.pmod(F.xxhash64("id"), F.lit(VENUE_SLOTS)).cast("int")
    malls = venues.select(
        slot.alias("_slot"), F.col("id").alias("fence_id"),
        F.col("radius_m").cast("int").alias("radius_m"),
    )
    unknown = (
        last_known.where("lat IS NULL OR lng IS NULL")
        .select(position_id, F.explode(F.sequence(F.lit(0), F.lit(VENUE_SLOTS - 1))).alias("_slot"))
        .join(malls, "_slot")
        .drop("_slot")
    )
    return picked.unionByName(unknown)
