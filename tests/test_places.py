from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from perkloom.functions import spherefn
from perkloom.operators import enrich, geo, nearest, spacing
from perkloom.operators.fences import _meters

HERE = (30.5, 34.9)


def points(spark, rows, id_="pos_id"):
    return spark.createDataFrame(rows, f"{id_} string, lat double, lng double")


def venues(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, seq int, lat double, lng double, radius_m int")


MALLS = [("north_mall", "א", 1, 30.5, 34.92, 250), ("south_mall", "ד", 2, 30.5, 34.9, 200)]


def test_only_the_venue_one_stands_in(spark):
    at = points(spark, [("a", 30.5001, 34.9201), ("b", 31.4, 35.4), ("c", None, None)])
    got = geo.venues_containing(at, venues(spark, MALLS), "pos_id").collect()
    assert [(r.pos_id, r.venue_id, r.position) for r in got] == [("a", "north_mall", 1)]


def branches(spark, rows):
    return spark.createDataFrame(rows, "merchant_id string, branch_no int, lat double, lng double")


def test_merchants_near(spark):
    b = branches(
        spark,
        [("far", 0, 31.2, 35.1), ("up", 0, 30.503, 34.9), ("chain", 0, 31.2, 35.1),
         ("chain", 1, *HERE)],
    )
    catalog = spark.createDataFrame([("far", 1), ("up", 2), ("chain", 3)], "id string, seq int")
    at = points(spark, [("me", *HERE)])
    near = lambda r: [
        x.merchant_id for x in geo.merchants_near(at, b, catalog, r, "pos_id").orderBy("position").collect()
    ]
    assert near(500.0) == ["chain", "up"]
    assert near(100.0) == ["chain"]


def test_points_of_a_spot_are_told_a_merchant_together(spark):
    b = branches(spark, [(m, 0, 30.5 + i * 1e-4, 34.9) for i, m in enumerate("abcd")])
    catalog = spark.createDataFrame([(m, i) for i, m in enumerate("abcd")], "id string, seq int")
    ids = [None, *(f"p{i:04}" for i in range(1299))]
    at = points(spark, [(i, *HERE) for i in ids] + [("p0000", *HERE), ("else", 10.0, 10.0)])
    sent = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = geo.merchants_near(at, b, catalog, 1_000.0, "pos_id", piece_rows=600).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", sent)
    assert got[0].asDict().keys() == {"pos_id", "merchant_id", "distance_m", "position"}
    want = [(i or "", m, n) for i in ids for n, m in enumerate("abcd", 1)]
    assert sorted((r.pos_id or "", r.merchant_id, r.position) for r in got) == sorted(want)
    assert sum(x.merchant_id != y.merchant_id for x, y in zip(got, got[1:])) < 50


def test_benefits_of_the_shops_around(spark):
    b = branches(spark, [("here", 0, *HERE), ("here", 1, *HERE), ("far", 0, 31.2, 35.1)])
    benefits = spark.createDataFrame(
        [("b1", "here"), ("b2", "here"), ("b3", "far"), ("b4", "gone")], "id string, merchant_id string"
    )
    at = points(spark, [("me", *HERE), ("nowhere", 10.0, 10.0)])
    got = geo.benefits_near(at, b, benefits, "pos_id").collect()
    assert sorted((r.pos_id, r.benefit_id) for r in got) == [("me", "b1"), ("me", "b2")]


def test_equally_near_merchants_follow_the_catalog(spark):
    b = branches(spark, [(m, 0, *HERE) for m in ("a_second", "z_first", "unlisted")])
    catalog = spark.createDataFrame([("z_first", 1), ("a_second", 2)], "id string, seq int")
    near = geo.merchants_near(points(spark, [("me", *HERE)]), b, catalog, 100.0, "pos_id")
    assert [r.merchant_id for r in near.orderBy("position").collect()] == ["z_first", "a_second", "unlisted"]


@pytest.mark.parametrize("bounds", [{}, {"piece_rows": 3}])
def test_a_crowd_at_one_spot_is_answered_once(spark, monkeypatch, bounds):
    asked = []
    for module, name in ((geo, "_in_reach"), (nearest, "_base")):
        def noted(df, *rest, inner=getattr(module, name), **more):
            asked.append(df.count())
            return inner(df, *rest, **more)

        monkeypatch.setattr(module, name, noted)
    crowd = [(f"p{i}", *HERE) for i in range(30)] + [("p0", 31.2, 35.1), ("lost", None, None)]
    at = points(spark, crowd)
    b = branches(spark, [("here", 0, *HERE), ("far", 0, 31.2, 35.1)])
    catalog = spark.createDataFrame([("here", "Here", 1), ("far", "Far", 2)], "id string, name string, seq int")
    benefits = spark.createDataFrame([("b2", "here"), ("b1", "here"), ("b3", "far")], "id string, merchant_id string")
    near = geo.merchants_near(at, b, catalog, 100.0, "pos_id", **bounds).collect()
    assert sorted((r.pos_id, r.merchant_id, r.position) for r in near) == sorted(
        [(f"p{i}", "here", 1) for i in range(30)] + [("p0", "far", 2)]
    )
    listed = geo.benefits_near(at, b, benefits, "pos_id", **bounds).collect()
    assert len(listed) == 61
    counted = geo.benefit_counts_near(at, b, benefits, "pos_id", **bounds).collect()
    assert sorted((r.pos_id, r.n, r.first_id) for r in counted) == sorted(
        (f"p{i}", 3 if i == 0 else 2, "b1") for i in range(30)
    )
    fences = nearest.nearest_fences(at, venues(spark, []), catalog, b, "pos_id", 1, **bounds).collect()
    assert sorted({(r.pos_id, r.distance_m) for r in fences}) == sorted((f"p{i}", 0.0) for i in range(30))
    # Three questions about branches in reach, positions and sites of fences: of places, not of points.
    assert len(asked) == 5 and max(asked) == 3


@pytest.mark.parametrize("seed, bounds", [(1, {}), (2, {"piece_rows": 3})])
def test_within_equals_brute_force_anywhere_on_the_globe(spark, seed, bounds):
    rnd = random.Random(seed)

    def place():
        spot = rnd.choice([HERE, (89.9, 10.0), (10.0, 179.999), (-33.0, -70.0)])
        return spot[0] + rnd.uniform(-0.05, 0.05), (spot[1] + rnd.uniform(-0.05, 0.05) + 180) % 360 - 180

    ps = [(f"p{i}", *place()) for i in range(150)]
    cs = [(f"c{i}", *place(), rnd.randint(50, 4000)) for i in range(60)]
    circles = spark.createDataFrame(cs, "cid string, c_lat double, c_lng double, radius_m int")
    got = geo.within(points(spark, ps), circles, ["pos_id"], ["cid"], **bounds)
    expect = {(p[0], c[0]) for p in ps for c in cs if _meters(p[1], p[2], c[1], c[2]) <= c[3]}
    rows = [(r.pos_id, r.cid) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expect and len(expect) > 100


def test_cells_cover_the_ball(spark):
    at = F.lit(HERE[0]), F.lit(HERE[1])
    cells = spark.range(1).select(
        spherefn.cells_within(*at, F.lit(500.0), 1000.0).alias("c"), spherefn.cell_of(*at, 1000.0).alias("own")
    ).first()
    assert cells.own in cells.c and 1 <= len(cells.c) <= 8


def _brute_fences(position, malls, shops, k):
    found = [(_meters(*position, m[3], m[4]), 0, m[2], m[0]) for m in malls]
    for seq, name in enumerate(sorted({s[0] for s in shops}, key=lambda n: int(n[1:]))):
        nearest_branch = min(_meters(*position, s[2], s[3]) for s in shops if s[0] == name)
        found.append((nearest_branch, 1, int(name[1:]), f"shop:{name}"))
    return [f[3] for f in sorted(found)[:k]]


@pytest.mark.parametrize("seed, k, bounds", [(3, 5, {}), (4, 20, {"piece_rows": 2})])
def test_nearest_fences_equal_brute_force(spark, seed, k, bounds):
    rnd = random.Random(seed)
    # A dense town, a sparse country and someone far out at sea.
    def town():
        return HERE[0] + rnd.gauss(0, 0.004), HERE[1] + rnd.gauss(0, 0.004)

    def country():
        return rnd.uniform(29.5, 33.3), rnd.uniform(34.3, 35.8)

    shops = [(f"m{i % 60}", i, *(town() if i % 3 else country())) for i in range(150)]
    ps = [(f"p{i}", *(town() if i % 2 else country())) for i in range(40)] + [
        ("sea", 20.0, -40.0), ("pole", 89.0, 0.0), ("on", shops[0][2], shops[0][3]), ("none", None, None),
    ]
    merchants = spark.createDataFrame(
        [(f"m{i}", f"name {i}", i) for i in range(60)], "id string, name string, seq int"
    )
    got = nearest.nearest_fences(
        points(spark, ps), venues(spark, MALLS), merchants, branches(spark, shops), "pos_id", k, **bounds
    ).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.position):
        by.setdefault(r.pos_id, []).append(r.fence_id)
    for name, lat, lng in ps:
        if lat is not None:
            assert by[name] == _brute_fences((lat, lng), MALLS, shops, k), name
    assert "none" not in by
    assert {r.radius_m for r in got if r.fence_id.startswith("shop:")} == {150}


def test_fewer_places_than_slots_and_no_position(spark):
    merchants = spark.createDataFrame([("m0", "n", 0)], "id string, name string, seq int")
    b = branches(spark, [("m0", 0, *HERE)])
    at = points(spark, [("here", *HERE), ("lost", None, None)])
    got = nearest.fences_to_monitor(at, venues(spark, MALLS), merchants, b, "pos_id").collect()
    assert {(r.pos_id, r.fence_id) for r in got} == {
        ("here", "shop:m0"), ("here", "south_mall"), ("here", "north_mall"),
        ("lost", "north_mall"), ("lost", "south_mall"),
    }


def test_fence_places(spark):
    merchants = spark.createDataFrame([("m0", "shop"), ("m1", "other")], "id string, name string")
    members = spark.createDataFrame([("north_mall", "m1")], "venue_id string, merchant_id string")
    b = branches(spark, [("m0", 0, 30.5, 34.92)])
    ids = spark.createDataFrame([("shop:m0",), ("north_mall",), ("shop:gone",), ("gone",)], "fence_id string")
    got = geo.fence_places(ids, merchants, venues(spark, MALLS), members, b).collect()
    assert {(r.fence_id, r.merchant_id) for r in got} == {
        ("shop:m0", "m0"), ("north_mall", "m0"), ("north_mall", "m1"),
    }


def _greedy(rows, min_m=50.0):
    kept = {}
    for key, seq, lat, lng in sorted(rows, key=lambda r: r[1]):
        mine = kept.setdefault(key, [])
        if all(_meters(lat, lng, k[1], k[2]) >= min_m for k in mine):
            mine.append((seq, lat, lng))
    return {(key, k[0]) for key, ks in kept.items() for k in ks}


@pytest.mark.parametrize("tile_m", [120.0, 1_000.0, 50_000.0])
def test_spacing_equals_the_sequential_rule(spark, tile_m):
    rnd = random.Random(9)
    rows = []
    for seq in range(700):
        key = rnd.choice(["a", "a", "b", f"s{seq % 40}"])
        lat, lng = HERE[0] + rnd.randint(0, 25) * 2e-4, HERE[1] + rnd.randint(0, 12) * 2e-4
        rows.append((key, seq, lat, lng))
    # A street walked in order: every point's fate hangs on the one before.
    rows += [("street", 1000 + i, HERE[0] + i * 3e-4, HERE[1]) for i in range(12)]
    df = spark.createDataFrame(rows, "key string, seq bigint, lat double, lng double")
    got = spacing.keep_spaced(df, "key", tile_m=tile_m)
    assert {(r.key, r.seq) for r in got.collect()} == _greedy(rows)


@pytest.mark.parametrize("step_m, tile_m", [(30.0, 50_000.0), (60.0, 50_000.0), (30.0, 20_000.0)])
def test_a_long_street_takes_a_round_per_tile(spark, monkeypatch, step_m, tile_m):
    """3 000 points in order, each deciding the next."""
    rows = [("street", i, HERE[0] + i * step_m / 111_195.0, HERE[1]) for i in range(3_000)]
    df = spark.createDataFrame(rows, "key string, seq bigint, lat double, lng double")
    rounds = []
    monkeypatch.setattr(spacing, "written", lambda d, n, w=spacing.written: (rounds.append(n), w(d, n))[1])
    got = spacing.keep_spaced(df, "key", tile_m=tile_m)
    every = 1 if step_m >= 50 else 2
    assert {r.seq for r in got.collect()} == set(range(0, 3_000, every))
    assert len(rounds) <= 8


def test_spacing_of_nothing_and_of_unplaced_points(spark):
    df = spark.createDataFrame([("a", 1, None, 3.0)], "key string, seq bigint, lat double, lng double")
    assert spacing.keep_spaced(df, "key").count() == 0


def test_category_and_program_rules(spark):
    cat = lambda t: spark.range(1).select(enrich.category_of(F.lit(t).cast("string"))).first()[0]
    assert cat("רשת מזון ומסעדות") == "grocery"
    assert cat("בית קפה") == "dining"
    assert cat("משהו אחר") is None and cat(None) is None
    category, sure = enrich.program_class(F.col("slug"), F.col("title"))
    df = spark.createDataFrame(
        [("TAU", "x"), ("My-MAX", "x"), ("Club", "כרטיס אשראי"), ("Club", "ארגון המורים"), ("Club", "רשת")],
        "slug string, title string",
    ).select(category, sure)
    assert [tuple(r) for r in df.collect()] == [
        ("employer_club", True), ("credit_card", True), ("credit_card", True),
        ("employer_club", True), ("retail_club", False),
    ]


def test_minted_ids_never_clash(spark):
    merchants = spark.createDataFrame(
        [("easy_7", "a", 1), ("easy_7_x_x", "b", 2)], "id string, name string, seq int"
    )
    approved = spark.createDataFrame(
        [(i, "unmapped_q", f"shop {i}") for i in range(3)] + [(9, "m1", "mapped")],
        "seq bigint, merchant_id string, merchant_name string",
    )
    candidates = spark.createDataFrame(
        [(i, "7", f"Shop{i}", "תחנת דלק", "st", 30.5, 34.92) for i in range(3)],
        "seq bigint, easy_id string, name string, easy_category string, address string, lat double, lng double",
    )
    minted, inside = enrich.mint_merchants(approved, merchants, candidates, venues(spark, MALLS))
    got = {r.name: r for r in minted.collect()}
    assert [got[f"shop {i}"].id for i in range(3)] == ["easy_7_x", "easy_7_x_x_x", "easy_7_x_x_x_x"]
    assert got["shop 0"].categories == ["fuel"]
    assert inside.count() == 3


def test_top_cube_holds_the_planet():
    assert nearest.BASE_SIDE_M * 2 ** (nearest.FANOUT_BITS * nearest.TOP) > 2 * 6_371_000
    assert 2 * 6_371_000 / nearest.BASE_SIDE_M < 2**21
    assert math.isclose(_meters(*HERE, *HERE), 0.0)
