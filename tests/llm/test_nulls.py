"""Rows with NULL in any column, ids included, crash no operator."""

from lokalis.llm import addresses, canonical_list, entity_match, eval_leaks, junk_pages, name_variants, textforms

TEXT = " ".join(f"word{i} is the best of {i}" for i in range(10))


def test_null_ids_take_no_part(spark):
    docs = spark.createDataFrame([(None, TEXT, "x"), (1, TEXT, "y"), (2, None, None)], "doc_id long, text string, words string")
    items = spark.createDataFrame([(None, TEXT), (5, TEXT), (6, None)], "item_id long, text string")
    assert [tuple(r[:2]) for r in eval_leaks.verbatim(eval_leaks.leaked(docs, items)).collect()] == [(1, 5)]
    assert junk_pages.junk_pages(docs).count() == 0
    v = spark.createDataFrame([(None, "a", "Oak Inn", 51.5, -0.1), (2, None, "Oak Inn", 51.5, -0.1), (None, None, "Oak Inn", 51.5, -0.1)], "venue_key long, venue_id string, name string, lat double, lng double")
    v = v.selectExpr("*", "cast(null as string) category", "cast(null as string) address", "cast(null as string) city", "cast(null as string) geo_source")
    o = spark.createDataFrame([(None, "Oak Inn", 51.5, -0.1, None, None), (7, "Oak Inn", 51.5, -0.1, None, None)], "osm_id long, name string, lat double, lng double, kind string, tags map<string,string>")
    assert [tuple(r[:2]) for r in entity_match.match_places(v, o).collect()] == [(2, 7)]


def test_null_fields_of_refs(spark):
    r = spark.createDataFrame([(None, 1, "Oak Inn", "1 Oak Road", "York"), (1, 1, "Oak Inn", "Oak Rd 1", None), (2, None, None, "1 Oak Road", "Yrk"), (3, 1, None, "1 Oak Road", None)], "ref_id long, sweep_no long, name string, address string, city string")
    q = spark.createDataFrame([(None, 1, "Oka Inn"), (4, 1, "Oka Inn"), (5, None, None)], "res_id long, sweep_no long, name string")
    c = spark.createDataFrame([(None, "York", "X", None, 1.0, 2.0), (1, "York", None, None, None, None), (2, None, "X", None, 1.0, 1.0)], "city_id long, city_name string, country string, native_name string, metro_lat double, metro_lng double")
    assert {tuple(p[:2]) for p in addresses.address_pairs(r, c).collect()} == {(1, 3)}
    assert (1, 4) in {tuple(p[:2]) for p in name_variants.variant_pairs(r, q).collect()}
    assert canonical_list.map_values(r, c).count() == 1 and textforms.canonical_values(r, "ref_id", ("name", "city")).count() == 4
