from lokalis.llm import canonical_list

CITIES = [(1, "Upper Silaskquay", "Castovia", None, 56.2, -10.0), (2, "Silaskquay", "Castovia", None, 56.2, -10.0), (3, "Nedoholm", "Thessara", "Νεδοηολμ", 43.4, 3.5), (4, "Nedoholm", "Velgorye", "Недохолм", 37.0, -23.5), (5, "Saint Kneklirquay", "Thessara", None, 43.4, 3.5), (6, "Trizoftburg-on-Sea", "Castovia", None, 37.0, -14.5), (7, "Daimuthtarn", "Aubraine", None, 40.2, 21.5)]
SCHEMA = "city_id long, city_name string, country string, native_name string, metro_lat double, metro_lng double"
LINES = [
    ("Silaskquay, Upper", 1), ("  Silaskquay", 2), ("SILASKQUAY (Castovia)", 2), ("Up. Silaskquay", 1), ("Solaskquay", 2), ("Nedoholm Velgorye", 4), ("Недохолм", 4), ("St Kneklirquay", 5), ("Trizoftburg o/Sea", 6),
    ("Praula Quarter, Daimuthtarn", 7), ("12345 Daimuthtarn", 7), ("Daimuthtarn ", 7), ("Dai​muthtarn", 7), ("Castovia", -1), ("99887", -1), ("Jeshkoburg", -1), ("my garage", -1), ("-", -1), ("Damiuthtarn", 7), ("near Daimuthtarn City", 7),
]


def test_lines(spark):
    refs = spark.createDataFrame([(i, line, 1, "x") for i, (line, _) in enumerate(LINES)] + [(100, None, 1, ""), (101, "", 1, ""), (102, "Daimuthtarn", 1, "")], "ref_id long, city string, sweep_no long, city_id string")
    got = {r[0]: r[1] for r in canonical_list.map_values(refs.drop("city_id"), spark.createDataFrame(CITIES, SCHEMA)).collect()}
    assert [got.get(i) for i in range(len(LINES))] == [c for _, c in LINES] and not {100, 101, 102} & set(got)


def test_a_name_in_two_countries_follows_its_sweep(spark):
    rows = [(1, "Nedoholm.", 1), (2, "Saint Kneklirquay.", 1), (3, "Nedoholm.", 2), (4, "Nedoholm, Velgorye", 2), (5, "Недохолм", 2), (6, "Nedoholm.", None)]
    refs = spark.createDataFrame(rows, "ref_id long, city string, sweep_no long")
    got = {r[0]: r[1] for r in canonical_list.map_values(refs, spark.createDataFrame(CITIES, SCHEMA)).collect()}
    assert got == {1: 3, 2: 5, 3: 4, 4: 4, 5: 4, 6: 3}


def test_empty_list_and_table(spark):
    refs = spark.createDataFrame([(1, "Oak", 1)], "ref_id long, city string, sweep_no long")
    none = spark.createDataFrame([], SCHEMA)
    assert [tuple(r) for r in canonical_list.map_values(refs, none).collect()] == [(1, -1)]
    assert canonical_list.map_values(refs.where("false"), spark.createDataFrame(CITIES, SCHEMA)).count() == 0


def test_prefix_filter_loses_no_pair():
    import random

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(4, 9))) for _ in range(120)]
    sets = [canonical_list.pairs_of(w) for w in words]
    rarity = {}
    for s in sets[:40]:
        for t in s:
            rarity[t] = rarity.get(t, 0) + 1
    for a in sets:
        for b in sets[:40]:
            if len(a & b) / len(a | b) >= canonical_list.MIN_JACCARD:
                assert set(canonical_list.prefix(a, rarity)) & set(canonical_list.prefix(b, rarity))
