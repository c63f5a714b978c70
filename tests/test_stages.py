"""Stages, summaries, freshness, captured answers and saved state against small known cases."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lokalis.operators import freshness, matching, sequences, summaries
from lokalis.plans import pipelines
from lokalis.sinks import journals
from lokalis.sources import answers


def rows_of(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def texts(spark, tmp_path, **files):
    for name, body in files.items():
        (tmp_path / name).write_text(body if isinstance(body, str) else json.dumps(body), encoding="utf-8")
    return answers.documents(spark, str(tmp_path))


def test_journals_finished_and_unreadable(spark, tmp_path):
    venue = {"name": "Oak Inn", "lat": 1.5, "lng": 2.5, "total": 7}
    docs = texts(spark, tmp_path, a={"complete": True, "centre": [1.0, 2.0], "venues": [venue, venue]}, b={"complete": True, "centre": [], "venues": []}, c="{broken", d={"venues": [venue]})
    j = answers.journals(docs)
    assert {(os.path.basename(r["path"]), r["n_venues"], r["complete"]) for r in j.collect()} == {("a", 2, True), ("b", 0, True), ("c", 0, False), ("d", 1, False)}
    now = F.current_timestamp()
    assert [os.path.basename(r["path"]) for r in answers.finished(j, now).collect()] == ["a"]
    assert answers.finished(j, now + F.expr("interval 13 hours")).count() == 0
    assert rows_of(answers.journal_rows(j), "pos", "name", "total") == {(0, "Oak Inn", 7), (1, "Oak Inn", 7)}


def test_enrich_journal_needs_its_input(spark, tmp_path):
    docs = texts(spark, tmp_path, a={"source": "abc", "done": {"3": {"status": "resolved", "detail": "", "venue": {"name": "Oak"}}, "4": {"status": "no_match", "detail": "x"}}})
    assert rows_of(answers.enriched_rows(docs, F.lit("abc")), "pos", "status", "name") == {(3, "resolved", "Oak"), (4, "no_match", None)}
    assert answers.enriched_rows(docs, F.lit("other")).count() == 0
    (tmp_path / "in.csv").write_bytes(b"name\nOak\n")
    import hashlib

    assert rows_of(answers.fingerprints(spark, str(tmp_path / "in.csv")), "sha256") == {(hashlib.sha256(b"name\nOak\n").hexdigest(),)}


def test_baseline_falls_back(spark, tmp_path):
    docs = texts(spark, tmp_path, **{"baseline_york.json": {"7": {"name": "Oak", "total": 1}}, "baseline.json": {"8": {"name": "Elm"}}})
    assert rows_of(answers.baseline(docs, "baseline_york.json", "baseline.json"), "key", "name") == {("7", "Oak")}
    assert rows_of(answers.baseline(docs, "baseline_bath.json", "baseline.json"), "key", "name") == {("8", "Elm")}
    assert answers.baseline(docs, "none", "nothing").count() == 0


def test_service_answers(spark):
    ok = json.dumps({"status": "OK", "results": [{"geometry": {"location": {"lat": 1.5, "lng": 2.5}}}, {"geometry": {"location": {"lat": 9, "lng": 9}}}]})
    a = spark.createDataFrame([("a", ok), ("b", '{"status": "ZERO_RESULTS", "results": []}'), ("c", '{"status": "OVER_QUERY_LIMIT"}'), ("d", "{bad")], "query string, text string")
    assert rows_of(answers.geocoded(a), "query", "lat", "error") == {("a", 1.5, None), ("b", None, None), ("c", None, "OVER_QUERY_LIMIT"), ("d", None, "unreadable")}
    b = spark.createDataFrame([("a", '[{"lat": "1.5", "lon": "2.5"}, {"lat": "3", "lon": "4"}]'), ("b", "[]")], "query string, text string")
    assert rows_of(answers.listed_points(b), "query", "lat", "lng") == {("a", 1.5, 2.5), ("b", None, None)}
    hit = json.dumps({"places": [{"id": "p1", "displayName": {"text": "Oak Inn"}, "types": ["bar"], "businessStatus": "CLOSED_PERMANENTLY"}]})
    bare = json.dumps({"places": [{"id": "p2", "displayName": {"text": "Elm"}}]})
    p = spark.createDataFrame([("a", hit, 200), ("b", "{}", 200), ("c", "", 429), ("d", bare, 200), ("e", "", 500)], "query string, text string, code int")
    got = answers.found_places(p)
    assert rows_of(got, "query", "place_id", "business_status", "error", "systemic") == {("a", "p1", "CLOSED_PERMANENTLY", None, False), ("b", None, None, None, False), ("c", None, None, "HTTP 429", True), ("d", "p2", "unmatched", None, False), ("e", None, None, "HTTP 500", False)}
    near = json.dumps({"places": [{"displayName": {"text": f"N{i}"}} for i in range(30)]})
    n = answers.nearby_places(spark.createDataFrame([("bar", near, 200), ("pub", near, 500)], "type string, text string, code int"))
    assert n.count() == 20 and rows_of(n.where("pos = 19"), "type", "name") == {("bar", "N19")}


def test_boundaries(spark):
    poly = {"display_name": "York", "boundingbox": ["0", "4", "0", "4"], "geojson": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4]], [[1, 1], [2, 1], [2, 2], [1, 2]]]}}
    point = {"display_name": "York point", "boundingbox": ["0", "1", "0", "1"], "geojson": {"type": "Point", "coordinates": [0, 0]}}
    a = spark.createDataFrame([("york", json.dumps([point, poly])), ("late", json.dumps([point] * 5 + [poly])), ("none", "[]")], "city string, text string")
    b = answers.boundaries(a)
    assert rows_of(b, "city", "display_name", "south", "north", "west", "east") == {("york", "York", 0.0, 4.0, 0.0, 4.0)}
    from lokalis.operators.harvest import in_polygons

    rings = answers.rings_of(b.withColumn("polygon_id", F.lit(1)), "polygon_id").withColumnRenamed("polygon_id", "polygon")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 5.0, 1.0)], "id long, lat double, lng double")
    assert rows_of(in_polygons(pts, rings), "id") == {(1,)}


def test_place_cache_expiry_and_round_trip(spark, tmp_path):
    docs = texts(spark, tmp_path, a={"q1": {"place_id": "p", "display_name": "Oak", "business_status": "X", "types": ["bar"], "fetched_at": 1000.0}, "q2": {"place_id": "old", "fetched_at": 1.0}, "q3": {"display_name": "no id", "fetched_at": 1000.0}})
    cache = answers.place_cache(docs)
    assert rows_of(cache, "query", "place_id", "display_name") == {("q1", "p", "Oak"), ("q2", "old", ""), ("q3", "", "no id")}
    out = str(tmp_path / "cache")
    journals.write_place_cache(cache, out, F.lit(1001.0), 30.0)
    assert rows_of(spark.read.parquet(out), "query", "place_id", "display_name", "fetched_at") == {("q1", "p", "Oak", 1000.0), ("q2", "old", None, None)}
    back = cache.select("query", answers.parsed(answers.place_json(), answers.PLACE).alias("p"))
    assert rows_of(back.select("query", "p.*"), "query", "place_id", "display_name") == rows_of(cache, "query", "place_id", "display_name")


def test_journal_table_and_diff(spark, tmp_path):
    path = str(tmp_path / "journal")
    rows = lambda *r: spark.createDataFrame(list(r), "city string, pos int, status string")
    journals.append_journal(rows(("york", 1, "failed"), ("york", 2, "ok")), path, ["city"], F.lit(1))
    journals.append_journal(rows(("york", 1, "ok")), path, ["city"], F.lit(2))
    assert rows_of(journals.latest(spark.read.parquet(path), ["city", "pos"]), "pos", "status") == {(1, "ok"), (2, "ok")}
    assert journals.completed(path) == {}
    journals.mark_complete(path, (1.0, 2.0), "geocoder")
    assert journals.completed(path)["centre"] == [1.0, 2.0] and spark.read.parquet(path).count() == 3
    diff = spark.createDataFrame([("1", "new", None), ("2", "changed", {"total": ("1", "2")})], "venue_id string, change string, deltas map<string,struct<before:string,after:string>>")
    out = journals.write_diff(diff, str(tmp_path), "2026-01-01")
    assert spark.read.json(out["diff"]).count() == 2 and rows_of(spark.read.option("header", True).csv(out["new"]), "venue_id") == {("1",)}
    assert "new" not in journals.write_diff(diff.where("change = 'changed'"), str(tmp_path), "2026-01-02")
    base = str(tmp_path / "base")
    journals.write_baseline(rows(("york", 1, "a"), ("bath", 1, "b")), base, "city")
    journals.write_baseline(rows(("york", 9, "c")), base, "city")
    assert rows_of(spark.read.parquet(base), "city", "pos") == {("york", 9), ("bath", 1)}
    journals.write_table_csv(spark.createDataFrame([("Oak, \"Inn\"", 1.5, None)], "name string, lat double, total long"), str(tmp_path / "t"), ["name", "lat", "total"])
    assert rows_of(spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "t")), "name", "lat", "total") == {('Oak, "Inn"', "1.500000", None)}


def test_envelope():
    good, bad = json.loads(journals.envelope("filter", {"kept": 3}, ["é"])), json.loads(journals.envelope("x", {}, error="no input"))
    assert good["ok"] and "error" not in good and good["warnings"] == ["é"] and not bad["ok"] and bad["error"] == "no input"
    assert journals.envelope("filter", {"n": "é"}).isascii()


def test_freshness(spark):
    df = spark.createDataFrame([(1, 0), (2, 43_200), (3, None)], "id int, at long")
    assert rows_of(df.select("id", freshness.fresh_within(F.col("at"), F.lit(43_201), 43_200).alias("f")), "id", "f") == {(1, False), (2, True), (3, False)}
    assert freshness.retained(df, "at", F.lit(43_201)).count() == 0 and rows_of(freshness.retained(df, "at", F.lit(43_201), 12), "id") == {(2,)}
    paths = spark.createDataFrame([("/x/2026-01-02/rows_2026-03-04.csv",), ("/x/rows.csv",)], "p string")
    assert [str(r[0]) for r in paths.select(freshness.data_date(F.col("p"), F.lit("2020-05-06 01:00:00").cast("timestamp"))).collect()] == ["2026-03-04", "2020-05-06"]
    out, src = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "stage string, modified int"), spark.createDataFrame([("a", 6), ("b", 5)], "stage string, modified int")
    assert rows_of(freshness.stale_outputs(out, src), "stage", "stale") == {("a", True), ("b", False), ("c", False)}
    ev = spark.createDataFrame([("u", 100), ("u", 90_000), ("v", 90_000)], "k string, s long")
    block = spark.createDataFrame([("v", 95_000.0), ("w", 1.0)], "k string, until double")
    got = freshness.allowance(ev, ["k"], "s", F.lit(90_001), 1, block)
    assert rows_of(got, "k", "used", "remaining", "wait_s", "may_start") == {("u", 1, 0, 0.0, False), ("v", 1, 0, 4999.0, False), ("w", 0, 1, 0.0, True)}
    assert rows_of(freshness.kept_events(ev, "s", F.lit(90_001)), "k", "s") == {("u", 90_000), ("v", 90_000)}


def test_running_ratio_without_a_measure_is_one(spark):
    df = spark.createDataFrame([(1, 100.0, None), (2, 100.0, 120.0), (3, 100.0, None)], "n int, asked double, measured double")
    run = sequences.running_ratio(df, "measured", "asked", "n")
    assert rows_of(run.select("n", "ratio", summaries.accounted(run, "measured", "asked").alias("used")), "n", "ratio", "used") == {(1, 1.0, 100.0), (2, 1.0, 120.0), (3, 1.2, 120.0)}


def test_enrich_stage(spark):
    names = spark.createDataFrame([(1, 1, "Golden Pig Bar", 10.0, 20.0), (2, 1, "Golden Pig", None, None), (3, 1, "Nowhere", 10.0, 20.0), (4, 1, "Golden Pig Bar", 10.0, 20.0), (5, 1, "Traploex", 10.0, 20.0), (6, 1, None, 10.0, 20.0)], "name_id long, sweep_no long, name string, lat double, lng double")
    refs = spark.createDataFrame([(11, 1, "Golden Pig Bar", "York", None, "a"), (12, 1, "Trapleox", "York", None, "b"), (13, 2, "Nowhere", "York", None, "c")], "ref_id long, sweep_no long, name string, city string, address string, page_id string")
    pages = spark.createDataFrame([("a", 10.001, 20.0), ("b", 11.0, 20.0)], "page_id string, lat double, lng double")
    kept, report, counts = pipelines.enrich_stage(names, refs, pages, ["sweep_no"])
    assert rows_of(report, "name_id", "status", "page_id", "duplicate") == {(1, "resolved", "a", False), (2, "unlocated", None, False), (3, "no_match", None, False), (4, "resolved", "a", True), (5, "too_far", "b", False), (6, "no_match", None, False)}
    assert rows_of(counts, "status", "n") == {("resolved", 1), ("duplicate", 1), ("unlocated", 1), ("no_match", 2), ("too_far", 1)} and kept.count() == 5


def test_second_search_only_where_the_city_has_none(spark):
    base = spark.createDataFrame([(1, 1, 10, 0.9, 1, 1), (1, 2, 20, 0.9, 2, 1)], "g int, name_id int, ref_id int, score double, place_rank int, rank int")
    more = spark.createDataFrame([(1, 1, 10, 1.0, 2, 1), (1, 1, 11, 0.95, 2, 1), (1, 2, 21, 1.0, 2, 1), (1, 3, 30, 1.0, 2, 1)], base.schema)
    assert rows_of(matching.second_search(base, more, ["g"]), "name_id", "ref_id", "rank") == {(1, 11, 1), (1, 10, 2), (2, 20, 1), (3, 30, 1)}


def test_shared_shifts_keep_to_their_longitude(spark):
    rows = [(f"a{i}", "too_far", 10.0, lng + i * 0.001, 10.02, lng + i * 0.001) for lng in (20.0, -150.0, 179.9995) for i in range(1)] + [("b1", "too_far", 10.0, -179.9995, 10.02, -179.9995), ("b2", "resolved", 10.0, 179.99, 10.02, 179.99)]
    df = spark.createDataFrame([(f"{k}{n}", *r) for n, (k, *r) in enumerate(rows)], "key string, status string, pin_lat double, pin_lng double, page_lat double, page_lng double")
    assert rows_of(matching.shared_shifts(df), "key", "support") == {("a02", 2), ("b13", 2)}


def test_stages_of_labels_and_closures(spark, tmp_path):
    rows = spark.createDataFrame([(i, "bar" if i % 3 else "cafe", "", None) for i in range(30)], "id long, kind string, business_status string, x int")
    sheet, summary = pipelines.label_stage(rows, F.col("kind"), "id", 4)
    assert summary.first().asDict() == {"rows": 8, "buckets": 2, "thin": 2} and rows_of(sheet, "_stratum", "_stratum_size") == {("bar", 20), ("cafe", 10)}
    rates = pipelines.score_stage(sheet, {"all": (F.lit(True), F.col("kind") == "cafe"), "none": (F.lit(False), F.lit(True))})
    assert {r["question"]: r["rate"] for r in rates.collect()} == {"all": pytest.approx(1 / 3), "none": None}
    said = spark.createDataFrame([(1, "p", "CLOSED_PERMANENTLY", None), (2, None, None, None), (3, None, None, "HTTP 500"), (4, "p", None, None)], "id long, place_id string, business_status string, error string")
    done, tally = pipelines.closures_stage(rows.where("id < 6"), said, "id")
    assert rows_of(done, "id", "business_status") == {(0, ""), (1, "CLOSED_PERMANENTLY"), (2, "unmatched"), (3, ""), (4, "unmatched"), (5, "")}
    assert rows_of(tally, "business_status", "n") == {("unchecked", 3), ("CLOSED_PERMANENTLY", 1), ("unmatched", 2)}
    placed = spark.createDataFrame([("Oak", 1.0, 2.0, "osm"), ("Elm", None, None, "none")], "name string, lat double, lng double, geo_source string").selectExpr("*", "cast(null as string) category", "cast(null as string) address", "cast(null as string) city", "cast(null as long) total", "cast(null as long) `unique`", "cast(null as long) monthly", "cast(null as long) you", "'' url")
    files, report = pipelines.export_stage(placed, str(tmp_path), "york", ["kml", "geojson"], ["name"], "open map data")
    assert "open map data" in open(files["kml"]).read() and "Elm" not in open(files["geojson"]).read() and report.first().asDict() == {"placemarks": 1, "unplaced": 1, "credit": True}


def test_small_summaries(spark):
    assert [r[0] for r in spark.range(1).select(summaries.note_line(F.lit(1234), F.lit(None).cast("long"), F.lit(0), F.lit(3), F.lit("2026-01-02"), "Pubs")).collect()] == ["Pubs #3 | 1,234 check-ins | 0/month | as of 2026-01-02"]
    none = F.lit(None).cast("long")
    assert spark.range(1).select(summaries.note_line(none, none, none, F.lit(1))).first()[0] == ""
    pins = spark.createDataFrame([("d", 100, 100), ("d", 400, 100)], "k string, x int, y int")
    assert rows_of(summaries.clear_origin(pins, ["k"], 0, -100, (100, 100, 400, 400), 100), "k", "x", "y") == {("d", 200, 400)}
    with pytest.raises(ValueError):
        summaries.clear_origin(pins, ["k"], 1000, 0, (100, 100, 400, 400))
    df = spark.createDataFrame([(1, "Oak", 3), (2, "oak", 1), (3, "Elm", 2), (4, " ", 0)], "id int, name string, p int")
    assert [r[0] for r in summaries.prominent_names(df, "name", ["p", "id"], 2).collect()] == ["oak", "Elm"]
    assert rows_of(summaries.ranked(df, [], [F.col("p")], 2), "id", "rank") == {(4, 1), (2, 2)}


def test_note_rows(spark, tmp_path):
    from lokalis.sources import tables

    (tmp_path / "n.csv").write_text("rank,name,address,city,total,unique,monthly\n1,Oak,1 Road,York,1200,,3\n2,Elm,,York,5,,\n3,Ash,2 Lane York,York,,,\n", encoding="utf-8")
    assert rows_of(tables.note_rows(spark, str(tmp_path / "n.csv"), "Pubs"), "name", "address", "note") == {("Oak", "1 Road, York", "Pubs #1 | 1,200 check-ins | 3/month"), ("Elm", None, "Pubs #2 | 5 check-ins")}
