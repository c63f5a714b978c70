import math
from itertools import combinations

import pytest

from lokalis.llm import entity_match

V = "venue_key long, venue_id string, name string, category string, address string, city string, lat double, lng double, geo_source string, osm_id string"
O = "osm_id long, name string, lat double, lng double, kind string, tags map<string,string>"


def exact_marginals(edges):
    total, per = 0.0, dict.fromkeys(range(len(edges)), 0.0)
    for n in range(len(edges) + 1):
        for sel in combinations(range(len(edges)), n):
            if len({edges[i][0] for i in sel}) == n == len({edges[i][1] for i in sel}):
                w = math.prod(edges[i][2] for i in sel)
                total += w
                for i in sel:
                    per[i] += w
    return {(a, b): per[i] / total for i, (a, b, _) in enumerate(edges)}


def test_propagation_is_exact_on_trees_and_converges(spark):
    edges = [(1, 11, 8.0), (1, 12, 2.0), (2, 12, 5.0), (3, 13, 4.0), (2, 14, 0.5)]
    got = {(r["a"], r["b"]): r["p"] for r in entity_match.propagate(spark.createDataFrame(edges, "a long, b long, w double")).collect()}
    want = exact_marginals(edges)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-3 for k in want)
    loop = [(1, 11, 9.0), (1, 12, 3.0), (2, 11, 3.0), (2, 12, 9.0)]
    got = {(r["a"], r["b"]): r["p"] for r in entity_match.propagate(spark.createDataFrame(loop, "a long, b long, w double")).collect()}
    assert got[1, 11] > 0.7 and got[1, 12] < 0.3 and got[1, 11] == pytest.approx(got[2, 12], abs=1e-3)


def test_matches(spark):
    venues = [
        (1, "a", "The Golden Anvil Alehouse", "Pub", "16 Square Rd", "York", 51.5, -0.1, "embedded", "x"), (2, "a", "The Golden Anvil Alehouse", "Pub", None, "York", 51.5, -0.1, "embedded", "x"), (3, "b", "Golden Anvil Ale House", None, None, None, 51.5001, -0.1, "embedded", "x"),
        (4, "c", "Zorkel Brewery", None, None, None, 51.503, -0.1, "nominatim", "x"), (5, "d", "Zorkel Brewery", None, None, None, 0.0, 0.0, "none", "x"), (6, "e", None, None, None, None, 51.5, -0.1, "embedded", "x"), (7, None, "Heron Inn - Station", None, None, None, 51.51, -0.1, "embedded", "x"),
        (8, "f", "The Golden Anvil Alehouse", None, None, None, 52.5, -0.1, "embedded", "x"),
    ]
    osm = [(100, "Golden Anvill Alehouse", 51.5002, -0.1001, "pub", {"amenity": "pub"}), (101, "The Golden Anvil Ale House", 51.5001, -0.1001, "bar", {}), (102, "Zorkel Brewing", 51.5, -0.1, "brewery", {}), (103, "", 51.5, -0.1, "pub", {}), (104, "Heron Inn", 51.5101, -0.1, "pub", {}), (105, "Zorkel Brewery", None, None, "pub", {}), (106, "Trout & Button", 51.5001, -0.1, "pub", {})]
    v, o = spark.createDataFrame(venues, V), spark.createDataFrame(osm, O)
    want = {(k, e) for k in (1, 2, 3) for e in (100, 101)} | {(4, 102), (7, 104)}
    rows = entity_match.match_places(v, o).collect()
    assert {(r["venue_key"], r["osm_id"]) for r in rows} == want and len(rows) == len(want) and all(0.5 <= r["confidence"] <= 1 for r in rows)
    salted = entity_match.match_places(v, o, group_rows=3)
    assert {(r["venue_key"], r["osm_id"]) for r in salted.collect()} == want
    assert entity_match.match_places(v.where("false"), o).count() == 0


def test_candidates_whatever_the_cells_hold(spark):
    """Repeated words, a chain of pages, equal records and crowded cells: the bound on a cell's records changes nothing."""
    venues = [(i, f"v{i}", "Bora Bora Brewery", "Brewery", None, "York", 51.5 + i * 0.0015, -0.1, "embedded", "x") for i in range(8)] + [(20 + i, f"w{i}", "Copper Kettle", "Bar", None, "York", 51.6, -0.1, "embedded", "x") for i in range(30)]
    osm = [(100, "Bora Bora Brewery", 51.5, -0.1, "brewery", {}), (101, "Coper Kettle", 51.6001, -0.1, "bar", {}), (102, "Copper Kettle", 51.6, -0.1, "bar", {}), (103, "Bora Inn", 51.5, -0.1, "pub", {})]
    v, o = spark.createDataFrame(venues, V), spark.createDataFrame(osm, O)
    want = {(i, 100) for i in range(8)} | {(20 + i, e) for i in range(30) for e in (101, 102)}
    for bound in (12_000, 4):
        assert {(r["venue_key"], r["osm_id"]) for r in entity_match.match_places(v, o, group_rows=bound).collect()} == want, bound


def test_rivals_share_their_confidence(spark):
    """Two branches of one house claim an element that names no branch: the nearer one wins, less surely than alone."""
    venues = [(1, "a", "Golden Anvil - Station", "Bar", None, None, 51.5, -0.1, "embedded", "x"), (2, "b", "Golden Anvil - Harbour", "Bar", None, None, 51.502, -0.1, "embedded", "x")]
    osm = [(100, "Golden Anvil", 51.5001, -0.1, "bar", {})]
    both = {r["venue_key"]: r["confidence"] for r in entity_match.match_places(spark.createDataFrame(venues, V), spark.createDataFrame(osm, O), accept=0.0).collect()}
    alone = entity_match.match_places(spark.createDataFrame(venues[:1], V), spark.createDataFrame(osm, O)).first()["confidence"]
    assert 0.5 < both[1] < alone and 0.02 < both[2] < 0.5


def test_grouped_follows_long_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 12)] + [(50, 51)], "a long, b long")
    assert {(r["id"], r["grp"]) for r in entity_match.grouped(chain).collect()} == {(i, 1) for i in range(1, 13)} | {(50, 50), (51, 50)}
    assert entity_match.grouped(chain.where("false")).count() == 0


def test_kind_of_house_is_evidence():
    same, other, unknown = (entity_match.evidence(0.8, 50.0, False, None, None, k, c) for k, c in (("pub", "Gastropub"), ("alcohol", "Cocktail Bar"), ("unknown", "Pub")))
    assert same > unknown > other
