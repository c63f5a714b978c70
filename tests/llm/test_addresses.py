import pytest

from lokalis.llm import addresses

SAME = [
    ("10 Cietisam Court", "Cietisam Crt., 10"), ("No. 88 Glashauthask Str (Floor 6), New Theafarkville", "88 Glashauthask Street"), ("c/ Lepriecrurn 125", "Calle de Lepriecrurn num. 125"), ("Suite 5 49 Anvilbrook Road 63255 ", "#49 Anvilbrook Rd"),
    ("Biethar-Platz  80,85958 ", "80 Bietharplatz"), ("Tanedrelmweg 3b", "Tanedrelm-Weg Nr. 3b"), ("Rerlaskgasse 82", "Floor 9, Rerlaskg., 82"), ("115 bd Anchorbrook", "boulevard Anchorbrook, 115"), ("31 Spindlebrok Avenue, 98303", "31 Spindlebrook Av."),
    ("Buttonerstr. Nr. 101", "Soskistzell, Buttonerstrasse 101, 87330 "), ("9A CROWFIELD COURT", "9a Crowfield Ct"),
]
OTHER = [("10 Cietisam Court", "11 Cietisam Court"), ("12 Oak Road", "12a Oak Road"), ("10 Cietisam Court", "10 Cietisam Lane"), ("5 Marrow Street", "5 Pigeon Street")]
TOWNS = frozenset({"soskistzell", "new", "theafarkville"})


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert addresses.match_addresses([(1, a, None), (2, b, None)], TOWNS), (vars_of(a), vars_of(b))


def vars_of(a):
    p = addresses.parse(a, None, TOWNS)
    return p and (p.number, p.words, p.kinds, p.town)


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert not addresses.same_place(addresses.parse(a, None, TOWNS), addresses.parse(b, None, TOWNS))


def test_towns_tell_streets_apart():
    p = [addresses.parse("5 Oak Road", t, TOWNS) for t in ("Theafarkville", "New Theafarkville", None, "unknown")]
    assert not addresses.same_place(p[0], p[1]) and addresses.same_place(p[0], p[2]) and addresses.same_place(p[1], p[3])


def test_no_number_no_case():
    assert addresses.parse("main square", None, TOWNS) is None and addresses.parse("12345", None, TOWNS) is None and addresses.parse("", None, TOWNS) is None


def test_affine_gaps():
    assert addresses.align(("a1", "b1"), ("a1", "b1")) == 0
    one, two = addresses.align(("oaken",), ("oaken", "xx")), addresses.align(("oaken",), ("oaken", "xx", "yy"))
    assert one == pytest.approx(addresses.GAP_OPEN) and two == pytest.approx(addresses.GAP_OPEN + addresses.GAP_MORE)


def test_pairs_copies_and_salting(spark):
    rows = [(i, 1, "10 Cietisam Court" if i % 3 else "Cietisam Crt., 10", "York" if i % 2 else None) for i in range(12)] + [(50, 1, None, "York"), (51, 1, "somewhere", ""), (52, 2, "10 Cietisam Court", "York"), (53, None, "1 Oak Rd", None), (54, None, "1, Oak Road", None), (55, 1, "7 " + "Oak " * 4000 + "Road", None)]
    df = spark.createDataFrame(rows, "ref_id long, sweep_no long, address string, city string").withColumn("id_a", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    cities = spark.createDataFrame([("York",)], "city_name string")
    want = {(a, b) for a in range(12) for b in range(a + 1, 12) if (a % 3 == 0) != (b % 3 == 0)} | {(53, 54)}
    got = [(r[0], r[1]) for r in addresses.address_pairs(df, cities).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert addresses.address_pairs(df.where("false"), cities).count() == 0
    recs = df.selectExpr("ref_id as id", "sweep_no as grp", "address", "city").where("address is not null")
    none = frozenset()
    key = lambda n: {tuple(sorted(r[:2])) for r in addresses.link_addresses(recs, none, n).collect()}
    assert key(3) == key(20_000)


def test_a_town_rare_in_its_sweep_is_known(spark):
    many = [(i, 1, None, "York") for i in range(400)]
    rare = [(500, 1, "7 Anvilbrook Square", "Old Nejawick"), (501, 1, "Old Nejawick, #7 Anvlibrook Square", None), (502, 1, "9 Oak Road", "Theafarkville"), (503, 1, "Oak Rd 9", "Old Nejawick"), (504, 1, "Oak Rd 9", None)]
    df = spark.createDataFrame(many + rare, "ref_id long, sweep_no long, address string, city string")
    cities = spark.createDataFrame([("York",), ("Old Nejawick",), ("Theafarkville",)], "city_name string")
    assert {(r[0], r[1]) for r in addresses.address_pairs(df, cities).collect()} == {(500, 501), (502, 504)}


def test_long_house_numbers():
    assert addresses.match_addresses([(1, "12345 Elm Street", None), (2, "12345 Elm Str., Suite 4", None)], TOWNS)
    assert not addresses.match_addresses([(1, "12345 Elm Street", None), (2, "12346 Elm Street", None)], TOWNS)
    assert addresses.parse("Elm Street 5, 12345 Soskistzell", None, TOWNS).number == "5" and addresses.parse("12345 Soskistzell", None, TOWNS) is None


def test_kinds_are_part_of_the_alignment():
    one, two = addresses.parse("5 Oaken Street", None, TOWNS), addresses.parse("5 Oaken Str", None, TOWNS)
    assert one.street == ("oaken", "~street") and addresses.street_cost(one.street, two.street) == pytest.approx(addresses.KIND_SHORT)
    assert addresses.street_cost(("oaken",), ("oaken", "~street")) == pytest.approx(addresses.KIND_GAP)
    assert addresses.street_cost(("oaken",), ("oakn",)) == pytest.approx(0.25)


def test_null_groups_are_spread(spark):
    rows = [(i, None, f"{i % 5} Oak {'Road' if i % 2 else 'Rd'}", f"c{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, grp long, address string, city string")
    pairs = [{tuple(sorted(r[:2])) for r in addresses.link_addresses(df, frozenset(), n).collect()} for n in (3, 20_000)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 4 * 16  # number 0 is none
