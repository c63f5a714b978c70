import math
import random

import numpy as np
import pytest

from lokalis.operators import harvest, spatial


def metres(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * spatial.EARTH_M * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("radius,box", [(50.0, (46.5, 46.52, -1.0, -0.97)), (5_000.0, (-89.9, -89.0, -180, 180)), (20_000.0, (-1, 1, 179.5, 180.5)), (300_000.0, (60, 90, -180, 180))])
def test_pairs_against_brute_force(spark, radius, box):
    rnd = random.Random(5)
    pts = [(i, str(i % 40), rnd.uniform(box[0], box[1]), (rnd.uniform(box[2], box[3]) + 180) % 360 - 180) for i in range(250)]
    df = spark.createDataFrame(pts, "id long, g string, lat double, lng double")
    got = {(r["id_a"], r["id_b"]) for r in spatial.pairs_within(df, radius, group="g", rows_each=40).collect()}
    want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and a[1] != b[1] and metres(a[2:], b[2:]) <= radius}
    assert got == want and want


def test_hot_place_is_salted_and_complete(spark):
    pts = [(i, f"p{i}", 10.0, 20.0) for i in range(120)] + [(1000 + i, "x", 10.0 + i * 0.01, 20.0) for i in range(50)]
    df = spark.createDataFrame(pts, "id long, g string, lat double, lng double")
    got = [(r["id_a"], r["id_b"]) for r in spatial.pairs_within(df, 10.0, group="g", rows_each=10).collect()]
    assert len(got) == len(set(got)) == 120 * 119 // 2 + 120


def test_unusable_points_and_empty_tables(spark):
    schema = "id long, lat double, lng double, extra string"
    df = spark.createDataFrame([(1, None, 1.0, "a"), (2, 0.0, 0.0, "a"), (3, 91.0, 0.0, "a"), (4, 5.0, 181.0, "a"), (5, float("nan"), 5.0, "a"), (6, 5.0, 5.0, "a"), (7, 5.0, 5.0, None)], schema)
    assert [(r["id_a"], r["id_b"]) for r in spatial.pairs_within(df, 10.0).collect()] == [(6, 7)]
    assert spatial.pairs_within(df.where("false"), 10.0).count() == 0


def test_cover_holds_every_point_of_the_disc():
    rnd = random.Random(1)
    for _ in range(300):
        lat, lng, r = rnd.uniform(-89, 89), rnd.uniform(-180, 180), 10 ** rnd.uniform(0, 6)
        row, lo, hi = spatial.cover_boxes(*spatial.disc_boxes([lat], [lng], [r]))
        assert len(row) <= 9
        bearing, d = rnd.uniform(0, 2 * math.pi), r * rnd.random() / spatial.EARTH_M
        y = math.asin(math.sin(math.radians(lat)) * math.cos(d) + math.cos(math.radians(lat)) * math.sin(d) * math.cos(bearing))
        x = math.radians(lng) + math.atan2(math.sin(bearing) * math.sin(d) * math.cos(math.radians(lat)), math.cos(d) - math.sin(math.radians(lat)) * math.sin(y))
        code = spatial.cell_codes(np.array([math.degrees(y)]), np.array([(math.degrees(x) + 180) % 360 - 180]))[0]
        assert ((lo <= code) & (code < hi)).any()


def test_points_in_boxes_and_polygons(spark):
    rnd = random.Random(2)
    pts = [(i, rnd.uniform(-5, 5), rnd.uniform(-5, 5)) for i in range(400)]
    df = spark.createDataFrame(pts, "id long, lat double, lng double")
    boxes = spark.createDataFrame([(1, -1.0, 1.0, -2.0, 2.0), (2, 0.5, 4.0, 3.0, 4.5), (3, 2.0, 1.0, 0.0, 1.0), (4, None, 1.0, 0.0, 1.0)], "box_id long, south double, north double, west double, east double")
    got = {(r[0], r[1]) for r in spatial.points_in_boxes(df, boxes, rows_each=50).collect()}
    assert got == {(i, b) for i, a, o in pts for b, s, n, w, e in [(1, -1, 1, -2, 2), (2, 0.5, 4, 3, 4.5)] if s <= a <= n and w <= o <= e}
    rings = spark.createDataFrame([(7, 0, [-3.0, 3.0, 3.0, -3.0], [-3.0, -3.0, 3.0, 3.0]), (7, 1, [-1.0, 1.0, 1.0, -1.0], [-1.0, -1.0, 1.0, 1.0])], "polygon long, ring int, lat array<double>, lng array<double>")
    got = {r[0] for r in harvest.in_polygons(df, rings).collect()}
    assert got == {i for i, a, o in pts if abs(a) < 3 and abs(o) < 3 and not (abs(a) < 1 and abs(o) < 1)}


def test_quadtree_harvest_finds_more_where_answers_are_cut(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(0, 1), rnd.uniform(0, 1), i % 97) for i in range(300)]
    df = spark.createDataFrame(pts, "id long, lat double, lng double, total long")
    rows, cells = harvest.quadtree_harvest(df, (0, 1, 0, 1), max_depth=3, min_depth=1, cap=20, full=18)
    got = [r["id"] for r in rows.collect()]
    assert len(got) == len(set(got)) > 200
    seen = cells.collect()
    assert {c["path"] for c in seen if c["depth"] == 1} == {"0.0", "0.1", "0.2", "0.3"}
    parents = {c["path"] for c in seen if c["cut_off"]} | {"0"}
    assert all(c["path"].rpartition(".")[0] in parents for c in seen if c["depth"] > 0)
