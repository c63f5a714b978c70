import csv
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lokalis.sinks import maps
from lokalis.sources import markup, tables


def test_stage_csv(spark, tmp_path):
    p = tmp_path / "1.csv"
    p.write_text('﻿name,venue_id,total,lat,lng,url,note\n"Mike\'s ""Place""",7,"2,628",32.07,34.7,https://x/v/mikes/7,hi\n  ,8,1,,,,\nOak,,,bad,1,,\n', encoding="utf-8")
    got = tables.stage(spark, str(p)).orderBy("name").collect()
    assert [(r["name"], r["venue_id"], r["total"], r["lat"], r["slug"], r["note"], r["geo_source"]) for r in got] == [('Mike\'s "Place"', "7", 2628, 32.07, "mikes", "hi", "none"), ("Oak", "", None, None, "", None, "none")]
    other = tables.any_table(spark, str(p)).orderBy("name").collect()
    assert [(r["venue_id"], r["geo_source"]) for r in other] == [("7", "csv"), ("Oak", "none")]


def test_place_pairs_and_label_sheet(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("Name,Address,city\nOak,1 Road,York\nElm,2 Road York,York\nAsh,,York\n")
    assert [(r[0], r[1]) for r in tables.place_pairs(spark, str(p)).orderBy("name").collect()] == [("Ash", "York"), ("Elm", "2 Road York"), ("Oak", "1 Road, York")]
    s = tmp_path / "s.csv"
    s.write_bytes("name,_stratum,_stratum_size\nCafé,keep:a,5\nOak,keep:a,5\n".encode("cp1252"))
    assert "Café" in {r["name"] for r in tables.label_sheet(spark, str(s)).collect()}
    s.write_text("name,_stratum,_stratum_size\na,x,5\nb,x,6\n")
    with pytest.raises(ValueError):
        tables.label_sheet(spark, str(s))


def test_json_sources(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"q1": {"lat": 1.5, "lng": 2.0, "source": "nominatim", "fetched_at": 5}}')
    assert [tuple(r) for r in tables.point_cache(spark, str(p)).collect()] == [("q1", 1.5, 2.0, "nominatim", 5.0)]
    p.write_text("not json")
    assert tables.point_cache(spark, str(p)).count() == 0
    e = tmp_path / "e.json"
    e.write_text(json.dumps([{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "A"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"name": "B"}}, {"type": "node", "id": 3, "lat": 1.0, "lon": 2.0, "tags": {}}, {"type": "way", "id": 4, "tags": {"name": "C"}}]))
    assert [(r["osm_id"], r["lat"], r["lng"]) for r in tables.osm_elements(spark, str(e)).orderBy("osm_id").collect()] == [(1, 1.0, 2.0), (2, 3.0, 4.0)]


DUMP = """<hierarchy><node class="a.FrameLayout" content-desc="Google Map" bounds="[0,0][900,1600]"><node class="a.View" content-desc="Oak Inn." bounds="[10,20][31,40]"/>
<node class="a.View" content-desc="Filter" bounds="[0,0][5,5]"/><node class="a.View" content-desc="Oak Inn." bounds="[1,1][2,2]"/><node class="a.ViewGroup" content-desc="Card" bounds="[0,0][5,5]"/></node>
<node class="a.Button" text="Switch to list view"/><node class="a.CheckBox" content-desc="Bar, Diner, 3, " checked="true"/><node class="a.CheckBox" content-desc="Pub"/></hierarchy>"""


def test_screens(spark):
    df = spark.createDataFrame([(1, DUMP), (2, "<oops"), (3, "<hierarchy/>")], "dump_id long, xml string")
    nodes = markup.screen_nodes(df).cache()
    assert [(r["dump_id"], r["name"], r["x"], r["y"]) for r in markup.pins(nodes).collect()] == [(1, "Oak Inn", 20, 40)]
    assert {(r["name"], r["count"], r["checked"]) for r in markup.category_rows(nodes).collect()} == {("Bar, Diner", 3, True), ("Pub", None, False)}
    assert {r["dump_id"] for r in markup.screen_errors(nodes).collect()} == {2, 3}


def test_pages(spark):
    stats = '<div class="stats"><ul><li>Total <b>1.2k</b></li><li>136 Monthly</li><li>Unique n/a</li></ul></div><img src="https://x/staticmap?a=1&center=32.07,34.77&z=1">'
    df = spark.createDataFrame([(1, stats), (2, "<p>Log In to view Venue Stats</p>"), (3, "<p>x</p><script>center: {lat: 0.0, lng: 0.0}</script>"), (4, None)], "page_id long, html string")
    got = {r["page_id"]: r for r in markup.page_stats(df).collect()}
    assert (got[1]["total"], got[1]["unique"], got[1]["monthly"], got[1]["you"], got[1]["lat"], got[1]["error"]) == (1200, None, 136, None, 32.07, None)
    assert got[2]["error"] == "login required" and got[3]["error"] == "no stats block" and got[3]["lat"] is None and got[4]["error"]
    cards = '<div class="beer-item"><p class="name"><a href="/v/oak-inn/12">Oak Inn</a></p><p class="style">Pub</p><p class="style">1 Road</p><p class="style">York</p></div><div class="beer-item"><p class="name"><a href="/user/x">no</a></p></div><div class="beer-item"><a href="/v/elm/13">Elm</a><p class="style">2 Road</p></div>'
    got = markup.search_cards(spark.createDataFrame([(1, cards)], "page_id long, html string")).orderBy("pos").collect()
    assert [(r["venue_id"], r["slug"], r["name"], r["category"], r["address"], r["city"]) for r in got] == [("12", "oak-inn", "Oak Inn", "Pub", "1 Road", "York"), ("13", "elm", "Elm", None, "2 Road", None)]
    assert spark.range(1).select(markup.result_total(F.lit("about 1,234 venue results"))).first()[0] == 1234


def test_map_files(spark, tmp_path):
    rows = [("1", "A & <B>", "Bar", None, "York", 1234, None, 5, None, 1.5, 2.25, "app", "https://x/v/a/1"), ("2", "C", None, None, None, None, None, None, None, None, None, "none", "")]
    df = spark.createDataFrame(rows, "venue_id string, name string, category string, address string, city string, total long, unique long, monthly long, you long, lat double, lng double, geo_source string, url string").withColumn("uniques", F.col("unique"))
    assert maps.needs_credit(df)
    kml = ET.parse(maps.write_kml(df, str(tmp_path / "a.kml"), "T & t", ["venue_id"], "credit")).getroot()
    ns = "{http://www.opengis.net/kml/2.2}"
    assert [e.text for e in kml.iter(ns + "coordinates")] == ["2.250000,1.500000,0"] and "Unique: n/a" in next(kml.iter(ns + "Placemark")).find(ns + "description").text
    gpx = ET.parse(maps.write_gpx(df, str(tmp_path / "a.gpx"), "T", ["venue_id"])).getroot()
    w = next(gpx.iter("{http://www.topografix.com/GPX/1/1}wpt"))
    assert w.get("lat") == "1.500000" and w[0].text == "A & <B>" and w[1].text == "1,234 check-ins | 5/month | Bar"
    g = json.load(open(maps.write_geojson(df, str(tmp_path / "a.geojson"), ["venue_id"], "©")))
    assert g["features"][0]["geometry"]["coordinates"] == [2.25, 1.5] and g["features"][0]["properties"]["unique" if "unique" in g["features"][0]["properties"] else "uniques"] is None and g["attribution"] == "©"
    with pytest.raises(ValueError):
        maps.write_kml(df, str(tmp_path / "b.kml"), "T", ["venue_id"], most=0)
    with open(maps.write_csv(df, str(tmp_path / "a.csv"), ["name", "total", "lat"], ["venue_id"]), encoding="utf-8-sig") as f:
        assert list(csv.reader(f)) == [["name", "total", "lat"], ["A & <B>", "1234", "1.500000"], ["C", "", ""]]
    assert maps.map_formats("KML, gpx ,kml") == ["kml", "gpx"]
    with pytest.raises(ValueError):
        maps.map_formats("shp")
