import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lokalis.functions import geo
from lokalis.operators import aggregates, fit, matching, sequences, sets


def test_consensus_recovers_a_similarity(spark):
    rnd = np.random.default_rng(4)
    src = rnd.uniform(-3000, 3000, 20) + 1j * rnd.uniform(-3000, 3000, 20)
    a, b = 0.9 * np.exp(1j * math.radians(1.0)), 40 - 25j
    dst = a * src + b
    dst[3] += 4000
    dst[11] -= 2500j
    rows = [(1, *map(float, (s.real, s.imag, t.real, t.imag))) for s, t in zip(src, dst)] + [(2, 0.0, 0.0, 1.0, 1.0)]
    got = {r["g"]: r for r in fit.robust_fits(spark.createDataFrame(rows, "g long, sx double, sy double, dx double, dy double"), "g").collect()}
    assert got[1]["problem"] == "" and got[1]["inliers"] == 18 and abs(complex(got[1]["a_re"], got[1]["a_im"]) - a) < 1e-9
    assert got[2]["problem"] == "1 matches" and got[2]["a_re"] is None
    closed = fit.similarity(spark.createDataFrame([r for r in rows if r[0] == 1], "g long, sx double, sy double, dx double, dy double").where("abs(dx - sx) < 1000 and abs(dy - sy) < 1000"), ["g"], "sx", "sy", "dx", "dy").first()
    assert abs(complex(closed["a_re"], closed["a_im"]) - a) < 1e-9 and abs(complex(closed["b_re"], closed["b_im"]) - b) < 1e-6


def test_anchoring_carries_shifts_forward(spark):
    lat0, lng0 = 32.0, 34.0
    swept = [(i, None if i == 9 else i // 2, lat0 + i * 1e-3, lng0) for i in range(10)]
    drift = {1: (500.0, -200.0), 3: (90.0, 10.0)}
    known = [(c, 32.0 + k * 1e-3, 34.0, 32.0 + k * 1e-3 + n / geo.M_PER_DEG_LAT, 34.0 + e / (geo.M_PER_DEG_LNG * math.cos(math.radians(32)))) for c, (e, n) in drift.items() for k in range(3)]
    s = spark.createDataFrame(swept, "id long, cell int, lat double, lng double")
    m = spark.createDataFrame(known, "cell int, lat double, lng double, known_lat double, known_lng double")
    got = {r["id"]: r for r in fit.anchored_cells(s, m, F.lit(lat0), F.lit(lng0)).collect()}
    assert [got[i]["anchor"] for i in range(10)] == ["unmeasured"] * 2 + ["anchored"] * 2 + ["carried"] * 2 + ["anchored"] * 2 + ["carried"] * 2
    assert got[0]["lat"] == swept[0][2]
    assert got[4]["lat"] == pytest.approx(swept[4][2] - 200 / geo.M_PER_DEG_LAT, abs=1e-9)
    assert got[9]["lat"] == pytest.approx(swept[9][2] + 10 / geo.M_PER_DEG_LAT, abs=1e-9)


def test_widest_scale(spark):
    rnd = random.Random(1)
    pts = [(1, x := rnd.randint(0, 900), y := rnd.randint(200, 1500), x * 10.2, -y * 10.2) for _ in range(60)]
    got = fit.widest_scale(spark.createDataFrame(pts, "g long, x int, y int, e double, n double"), ["g"]).first()
    assert got["m_per_px"] == pytest.approx(10.2)


def test_shared_shift_rule(spark):
    def point(key, status, lat, lng, e, n):
        return (key, status, lat, lng, lat + n / geo.M_PER_DEG_LNG, lng + e / (geo.M_PER_DEG_LNG * math.cos(math.radians(lat))))

    rows = [point("a", "too_far", 51.50, -0.10, 1500, 900), point("b", "too_far", 51.51, -0.11, 1530, 880), point("c", "resolved", 51.52, -0.10, 1490, 910), point("lone", "too_far", 51.5, -0.1, -1500, 900), point("far", "too_far", 52.5, -0.1, 1500, 900), point("big", "too_far", 51.5, -0.1, 6000, 0)]
    df = spark.createDataFrame(rows, "key string, status string, pin_lat double, pin_lng double, page_lat double, page_lng double")
    assert {r["key"]: r["support"] for r in matching.shared_shifts(df).collect()} == {"a": 2, "b": 2}


def test_name_ranking_and_resolution(spark):
    names = spark.createDataFrame([(1, 1, "The Red Lion"), (1, 2, "Zzz")], "g int, name_id int, name string")
    refs = spark.createDataFrame([(1, 10, "Red Lion, The", "York", None), (1, 11, "The Red Lion", "Leeds", None), (1, 12, "The Red Lions", "New York", "1 Road"), (2, 13, "The Red Lion", "York", None)], "g int, ref_id int, name string, city string, address string")
    got = [(r["ref_id"], r["place_rank"], r["rank"]) for r in matching.ranked_candidates(names, refs, ["g"], "York").orderBy("rank").collect()]
    assert got == [(12, 2, 1), (11, 0, 2)]
    pins = spark.createDataFrame([(1, 51.5, -0.1), (2, None, None), (3, 51.5, -0.1), (4, 51.5, -0.1)], "name_id int, lat double, lng double")
    cand = spark.createDataFrame([(1, 100, 1), (1, 101, 2), (1, 102, 3), (4, 100, 1), (4, 103, 2)], "name_id int, page_id int, rank int")
    pages = spark.createDataFrame([(100, 51.6, -0.1), (101, 51.501, -0.1), (102, 51.5, -0.1)], "page_id int, lat double, lng double")
    got = {r["name_id"]: (r["status"], r["page_id"]) for r in matching.resolve_by_distance(pins, cand, pages).collect()}
    assert got == {1: ("resolved", 101), 2: ("unlocated", None), 3: ("no_match", None), 4: ("fetch_failed", 103)}


def test_unambiguous_is_one_sided(spark):
    swept = spark.createDataFrame([(1, "Oak Inn", 1.0, 1.0), (2, "Oak Inn (אלון)", 1.0, 1.0), (3, "Elm Bar", 1.0, 1.0), (4, "Oak Inn", None, None)], "sid long, name string, lat double, lng double")
    known = spark.createDataFrame([(10, "OAK INN"), (11, "Elm Bar"), (12, "elm-bar")], "kid long, name string")
    assert {(r[0], r[1]) for r in matching.match_known(swept, known, "sid", "kid").collect()} == {(1, 10), (2, 10)}


def test_windows_and_streaks_against_loops(spark):
    rnd = random.Random(8)
    ev = [(i, rnd.randint(1, 3), float(rnd.randint(0, 40_000)), rnd.random() < 0.6) for i in range(200)]
    df = spark.createDataFrame(ev, "id long, k long, t double, bad boolean")
    want, open_ = [], {}
    for _, k, t, _ in sorted(ev, key=lambda e: (e[1], e[2])):
        if k not in open_ or t - open_[k][0] >= 3600:
            open_[k] = [t, 0]
            want.append((k, open_[k]))
        open_[k][1] += 1
    got = sorted((r["k"], r["started"], r["events"]) for r in sequences.activation_windows(df, "k", "t").collect())
    assert got == sorted((k, w[0], w[1]) for k, w in want)
    run, exp = {}, {}
    for i, k, t, bad in sorted(ev, key=lambda e: (e[1], e[2], e[0])):
        exp[i] = run[k] = run.get(k, 0) + 1 if bad else 0
    assert {r["id"]: r["streak"] for r in sequences.streaks(df, F.col("bad"), ["t", "id"], ["k"]).collect()} == exp
    assert sequences.activation_windows(df.where("false"), "k", "t").count() == 0


def test_sample_and_rates(spark):
    df = spark.createDataFrame([(i, "a" if i < 100 else "b") for i in range(105)], "id long, s string").repartition(3)
    got = aggregates.stratified_sample(df, "s", "id", 10, seed=3).collect()
    assert sum(r["s"] == "a" for r in got) == 10 and sum(r["s"] == "b" for r in got) == 5
    assert {(r["s"], r["_stratum_size"]) for r in got} == {("a", 100), ("b", 5)}
    again = aggregates.stratified_sample(df.coalesce(1), "s", "id", 10, seed=3)
    assert {r["id"] for r in again.collect()} == {r["id"] for r in got}
    rows = spark.createDataFrame([("x", 100, "y"), ("x", 100, "n"), ("x", 100, None), ("z", 10, "n"), ("q", 50, None)], "s string, size long, a string")
    r = aggregates.weighted_rate(rows, "s", "size", F.col("a").isNotNull(), F.col("a") == "n").first()
    assert r["rate"] == pytest.approx((50 + 10) / 110) and r["covered"] == 110 and r["thin"] == 3


def test_quality_gate(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    with pytest.raises(ValueError):
        aggregates.assert_quality(df, F.col("a").isNotNull())
    with pytest.raises(ValueError):
        aggregates.assert_quality(df.where("false"), F.col("a").isNotNull())
    aggregates.assert_quality(df, F.col("a").isNotNull(), 0.5)


def test_merge_and_diff(spark):
    a = spark.createDataFrame([(1, "", "Oak", "1 Rd"), (2, "v1", "Elm", None)], "id long, venue_id string, name string, address string")
    b = spark.createDataFrame([(3, "v1", "Elm 2", None), (4, None, "Oak", "1 Rd"), (5, None, "Oak", None)], "id long, venue_id string, name string, address string")
    assert sorted((r["id"], r["duplicates"]) for r in sets.merge_unique([a, b], ["id"]).collect()) == [(1, 1), (2, 1), (5, 0)]
    old = spark.createDataFrame([("a", 1, None), ("b", 2, 3), ("c", 4, 4)], "k string, x long, y long")
    new = spark.createDataFrame([("a", 1, 0), ("b", 2, 3), ("d", 1, 1)], "k string, x long, y long")
    got = {r["k"]: (r["change"], r["deltas"]) for r in sets.run_diff(old, new, "k", ["x", "y"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "changed", "c": "gone", "d": "new"}
    assert got["a"][1]["y"]["before"] == "" and got["a"][1]["y"]["after"] == "0" and "x" not in got["a"][1]


def test_variants_fold_into_shorter_spellings(spark):
    counts = spark.createDataFrame([("tel aviv", 900), ("tel aviv yafo", 90), ("yafo", 60), ("ramat gan", 10), ("", 5)], "k string, n long")
    got = [(r["query"], r["places"]) for r in aggregates.spelling_variants(counts, "k", "n").collect()]
    assert got == [("tel aviv", 900), ("yafo", 150)]


def test_camera_uses_the_latitude_before_the_step(spark):
    pans = spark.createDataFrame([(1, 100.0, 4000.0), (2, -250.0, -900.0), (3, 300.0, 100.0)], "seq int, dx double, dy double")
    lat, lng, want = 51.5, -0.1, []
    for _, dx, dy in [(1, 100.0, 4000.0), (2, -250.0, -900.0), (3, 300.0, 100.0)]:
        lng -= dx * 10.2 / (geo.M_PER_DEG_LNG * math.cos(math.radians(lat)))
        lat += dy * 10.2 / geo.M_PER_DEG_LAT
        want.append((lat, lng))
    got = [(r["cam_lat"], r["cam_lng"]) for r in sequences.camera_track(pans, 51.5, -0.1, F.lit(10.2)).orderBy("seq").collect()]
    assert np.allclose(got, want)


def test_hot_keys_are_cut_into_slices(spark):
    rnd = random.Random(9)
    ev = [(i, None if k == 0 else k, rnd.randint(0, 500), rnd.random() < 0.7, rnd.choice([None, i])) for i in range(600) for k in [rnd.choice([0, 1, 1, 1, 2])]]
    df = spark.createDataFrame(ev, "id long, k long, t long, bad boolean, v long")
    key = lambda r: (r["id"],)
    for f in (
        lambda n: sequences.streaks(df, F.col("bad"), ["t", "id"], ["k"], slice_rows=n),
        lambda n: sequences.carried_forward(df, "v", ["t", "id"], ["k"], slice_rows=n),
        lambda n: sequences.running_ratio(df, "v", "t", "id", ["k"], least=10, slice_rows=n),
        lambda n: sequences.camera_track(df.withColumn("dx", F.col("t") * 1.0).withColumn("dy", F.col("t") * 0.5), 10.0, 20.0, F.lit(2.0), ["k"], "id", slice_rows=n),
    ):
        a, b = sorted(map(tuple, f(50).collect())), sorted(map(tuple, f(10**6).collect()))
        assert len(a) == len(b) == 600
        for x, y in zip(a, b):
            assert x[:4] == y[:4] and all(p == q or abs(p - q) < 1e-9 for p, q in zip(x[5:], y[5:]))
    counts = {r["id"]: r["recent"] for r in sequences.rolling_count(df, F.col("t"), 60, ["k"]).collect()}
    assert counts == {i: sum(1 for _, k2, t2, _, _ in ev if k2 == k and t - 60 <= t2 <= t) for i, k, t, _, _ in ev}


def test_large_groups_are_fitted_in_blocks(spark):
    rnd = np.random.default_rng(5)
    rows = []
    for g, n in ((1, 90), (None, 50), (3, 12), (4, 3)):
        src = rnd.uniform(-3000, 3000, n) + 1j * rnd.uniform(-3000, 3000, n)
        dst = 1.1 * src + 30 + rnd.normal(0, 25, n) + 1j * rnd.normal(0, 25, n)
        dst[: n // 3] += rnd.uniform(1000, 4000, n // 3)
        rows += [(g, *map(float, (s.real, s.imag, t.real, t.imag))) for s, t in zip(src, dst)]
    df = spark.createDataFrame(rows, "g long, sx double, sy double, dx double, dy double")
    whole, blocks = ({r["g"]: r for r in fit.robust_fits(df, "g", most).collect()} for most in (2_000, 20))
    assert set(whole) == set(blocks) == {1, None, 3, 4}
    for g, r in whole.items():
        assert (r["inliers"], r["problem"]) == (blocks[g]["inliers"], blocks[g]["problem"]) and r["a_re"] == pytest.approx(blocks[g]["a_re"])
    src = np.concatenate([rnd.uniform(-3000, 3000, 30) + 0j, np.full(1_980, 5.0 + 0j)])
    assert fit.robust_similarity(src, src + 7)["inliers"] == 2_010


def test_widest_pair_is_exact(spark):
    rnd = np.random.default_rng(6)
    rows, want = [], {}
    for g in [None, *range(1, 40)]:
        r, t = 500 * np.sqrt(rnd.uniform(0, 1, 1_500)), rnd.uniform(0, 2 * np.pi, 1_500)
        p, q = np.stack([r * np.cos(t), r * np.sin(t)], 1), rnd.uniform(0, 9_000, (1_500, 2))
        d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
        i, j = np.unravel_index(d.argmax(), d.shape)
        want[g] = float(np.hypot(*(q[i] - q[j])) / d[i, j])
        rows += [(g, *map(float, (*a, *b))) for a, b in zip(p, q)]
    rows += [(90, 0.0, 0.0, 0.0, 0.0), (90, 0.0, 0.0, 5.0, 0.0), (90, 2.0, 0.0, 9.0, 0.0), (91, 1.0, 1.0, 1.0, 1.0), (92, 1.0, None, 1.0, 1.0)]
    got = {r["g"]: r["m_per_px"] for r in fit.widest_scale(spark.createDataFrame(rows, "g long, x double, y double, e double, n double"), ["g"]).collect()}
    assert got == pytest.approx({**want, 90: 4.5, 91: None, 92: None})


def test_candidates_against_brute_force(spark):
    from difflib import SequenceMatcher

    from lokalis.functions.text import name_forms

    rnd = random.Random(11)
    base = ["Trapleox", "Oak Inn", "Abc", "Qz", "Golden Wheel Tavern", "Zum Roten Ochsen", "Bar 12", "Kelpwick"]

    def typo(t):
        k = rnd.randrange(len(t))
        return rnd.choice([t[:k] + t[k + 1 :], t[:k] + rnd.choice("aexz ") + t[k:], t[:k] + t[k : k + 2][::-1] + t[k + 2 :]])

    a = spark.createDataFrame([(1, i, typo(b) if i % 2 else b) for i, b in enumerate(base * 4)] + [(1, 90, "Traploex")], "g int, name_id int, name string")
    b = spark.createDataFrame([(1, i, typo(typo(b)) if i % 3 else b) for i, b in enumerate(base * 5)], "g int, ref_id int, name string")
    f, h = ([(r[0], r[1]) for r in d.select(k, name_forms(F.col("name"))).collect()] for d, k in ((a, "name_id"), (b, "ref_id")))
    want = {(i, j) for i, x in f for j, y in h if max((SequenceMatcher(None, p, q).ratio() for p in x for q in y), default=0) >= 0.85}
    got = {(r["name_id"], r["ref_id"]) for r in matching.ranked_candidates(a, b, ["g"]).collect()}
    assert got == want and (90, 0) in want


def test_candidates_shuffle_names_and_not_pairs(spark):
    rnd = random.Random(3)
    made = lambda n: [(1, i, " ".join("".join(rnd.choice("aeioubcdlmnrst") for _ in range(7)) for _ in range(3))) for i in range(n)]
    names, refs = made(100), made(800)
    refs[7] = (1, 7, names[3][2] + "s")
    store = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store()
    a, b = spark.createDataFrame(names, "g int, name_id int, name string"), spark.createDataFrame(refs, "g int, ref_id int, name string")
    got = {(r["name_id"], r["ref_id"]) for r in matching.ranked_candidates(a, b, ["g"]).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got == {(3, 7)}
    assert store() - before < 8 * sum(len(n) for _, _, n in names + refs)


def test_candidates_in_blocks_and_without_group(spark):
    rnd = random.Random(5)
    words = ["Oak Inn", "Étoile", "東京", "(north)", "- Leeds"]
    made = lambda n: [(i % 3 or None, i, " ".join(rnd.sample(words, rnd.randint(1, 2))) if i % 7 else None) for i in range(n)]
    a, b = spark.createDataFrame(made(40), "g int, name_id int, name string"), spark.createDataFrame([(*r, f"p{r[1] % 4}") for r in made(60)], "g int, ref_id int, name string, page string")
    for by in (["g"], []):
        whole, parts = ({tuple(r) for r in matching.ranked_candidates(a, b, by, also=["page"], **k).collect()} for k in ({}, {"rows_each": 4}))
        assert whole == parts and len(whole) > 20 and all(r[-1] == f"p{r[-5] % 4}" for r in whole)
        assert not by or {r[0] for r in whole} == {1, 2}


def test_close_forms_against_difflib():
    from difflib import SequenceMatcher

    rnd = random.Random(7)
    texts = ["".join(rnd.choice(c) for _ in range(rnd.randint(1, 12))) for c in ("ab", "abc", "aeiourst ") for _ in range(60)] + ["ab" * 120, "ab" * 119 + "ba", "a" * 250, "é" * 3]
    a, b = list(dict.fromkeys(texts[::2])), list(dict.fromkeys(texts[1::2] + ["ab" * 120]))
    for least in (0.6, 0.85, 1.0):
        want = {(i, j, r) for i, p in enumerate(a) for j, q in enumerate(b) if (r := SequenceMatcher(None, p, q).ratio()) >= least}
        got = list(matching.close_forms(a, b, least))
        assert set(got) == want and len(got) == len(want)
