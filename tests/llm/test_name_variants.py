import random

import pytest

from lokalis.llm import edits, name_variants, names

SAME = [
    ("Three Otters PH", "3 Otters Public House"), ("A. Hejell's Tavern - Oldtown", "Alexander Hejell's Tavern – Oldtown"), ("Dot Glaknigle's Bottle Shop", "Dorothy Glaknigle's Bottle Store"), ("Bellows & Wheel", "Wheel and Bellows"),
    ("Lietagoth Beer Gaarden", "Lietagoth Beer Gdn"), ("The Foggy Ladder", "Foggy Ladder, The"), ("Seven Buttonstaproom", "7 Buttons Tap"), ("Five Badgers Tavern", "FIVE BADGERS"), ("Cafékungelm", "Café Kungelm"), ("Kauli Bar", "Καυλι μπυραρία"),
    ("Mt Viewer Tav.", "Mount Viewer Tavern"), ("Ｎｉｅｈｉｔｈ Craft Brewery", "Niehith Craft Brewery"), ("Brewery Kobrur", "Kobrur Breweries"), ("Tujerk Btotle Shop", "Tujerk Bottle Shop"),
]
OTHER = [("The Golden Anvil - Station", "The Golden Anvil - Harbour"), ("The Golden Anvil - Station", "The Golden Anvil"), ("Three Badgers", "Four Badgers"), ("Button & Kettle", "Oar & Kettle"), ("Saint Kudar Inn", "Saint Pleron Inn"), ("Oak Bottle Shop", "Oak Taproom"), ("Mount Jaibim Bar", "Mount Stoker Bar")]


@pytest.mark.parametrize("a,b", SAME)
def test_variants(a, b):
    br = frozenset({"oldtown", "station", "harbour"})
    assert names.same_name(names.parse(a, br), names.parse(b, br)) > 0
    assert name_variants.match_names([a], [b], br, frozenset())


@pytest.mark.parametrize("a,b", OTHER)
def test_different(a, b):
    br = frozenset({"oldtown", "station", "harbour"})
    assert names.same_name(names.parse(a, br), names.parse(b, br)) == 0


def test_osa_against_the_full_table():
    def full(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if not i or not j:
                    d[i][j] = i + j
                    continue
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rnd = random.Random(1)
    for _ in range(4000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7))) for _ in "ab")
        assert edits.osa(a, b, 3) == min(full(a, b), 4), (a, b)
        if full(a, b) <= 2 and len(a) > 4 and len(b) > 4:
            assert edits.deletes(a, 2) & edits.deletes(b, 2)


def test_groups_ties_nulls_and_salting(spark):
    refs = [(1, 1, "Three Otters PH", None), (2, 1, "Three Otters PH", "York"), (3, 2, "Three Otters PH", ""), (4, 1, None, "x"), (5, 1, "  ", "x"), (6, 1, "3 Otters", "x"), (7, None, "3 Otters", "x"), (8, 1, "Oak " * 3000, "x")]
    res = [(10, 1, "3 Otters", "resolved"), (11, 1, "Four Otters", None), (12, 3, "3 Otters", None), (13, 1, None, None)]
    a = spark.createDataFrame(refs, "ref_id long, sweep_no long, name string, city string")
    b = spark.createDataFrame(res, "res_id long, sweep_no long, name string, name2 string")
    want = {(1, 10), (2, 10)}
    assert {(r[0], r[1]) for r in name_variants.variant_pairs(a, b).collect()} == want
    assert name_variants.variant_pairs(a.where("false"), b).count() == 0
    left, right = (df.selectExpr("sweep_no as grp", "name") for df in (a, b))
    none = spark.createDataFrame([], "grp long, word string")
    links = lambda n: {tuple(r) for r in name_variants.link_names(left, right, none, n, n).select("grp", "left", "right").collect()}
    assert links(2) == links(20_000) == {(1, "Three Otters PH", "3 Otters")}


def test_blocks_find_what_one_task_finds(spark):
    rnd = random.Random(2)
    syl = ["ka", "lo", "mi", "tru", "shen", "vor", "pla", "nix"]
    base = [" ".join("".join(rnd.choice(syl) for _ in range(3)) for _ in range(rnd.randint(1, 2))) + rnd.choice([" Bar", " Inn", ""]) for _ in range(60)]
    typo = [b.replace("a", "e", 1) for b in base] + [b.replace(" ", "") for b in base[:20]]
    a, b = (spark.createDataFrame([(1, x) for x in xs], "grp long, name string") for xs in (base, typo))
    none = spark.createDataFrame([], "grp long, word string")
    one, many = ({tuple(r) for r in name_variants.link_names(a, b, none, n, n).select("left", "right").collect()} for n in (10**6, 20))
    assert one == many and len(one) >= 60


def test_long_names_are_compared_whole():
    for n in (9, 20, 60):
        words = [f"{a}{b}x" for a in ("Barton", "Quill", "Moss", "Thorn", "Wren", "Ember", "Gale", "Pike") for b in ("ley", "ham", "wick", "stead", "combe", "thorpe", "mere", "holt")][:n]
        typo = [*words[1:], words[0][:-2] + words[0][-1] + words[0][-2]]
        assert names.same_name(names.parse(" ".join(words)), names.parse(" ".join(words))) == 1.0
        assert names.same_name(names.parse(" ".join(words)), names.parse(" ".join(typo))) > 0.5
        assert names.same_name(names.parse(" ".join(words)), names.parse(" ".join([*words[:-3], "Other", "Strange", "Ending"]))) == 0.0
    assert names.parse("Tap Room Shop Bar Garden Kitchen").core and names.same_name(names.parse("bar " * 5000), names.parse("bar " * 5000)) == 1.0


def test_mistyped_articles_and_short_forms():
    for a, b in (("Teh Golden Pig", "The Golden Pig"), ("Golden Pig adn Whistle", "Golden Pig and Whistle"), ("Golden Pig Brwry", "Golden Pig Brewery"), ("Golden Pig Tvrn", "Golden Pig Tavern"), ("Golden Pig Btl Shp", "Golden Pig Bottle Shop")):
        assert names.same_name(names.parse(a), names.parse(b)) > 0.5, a


def test_null_sweep_and_block_bounds(spark):
    left = [(None, "Golden Pig Bar"), (1, "Silver Otter Inn"), (1, "Copper Kettle"), (1, "Marlb. Wheel"), (2, "Golden Pig Bar")]
    right = [(None, "Goldne Pig Bar"), (1, "Silver Oter Inn"), (1, "Coper Kettle"), (1, "Marlborough Wheel"), (2, "Silver Otter Inn")]
    a, b = spark.createDataFrame(left, "grp long, name string"), spark.createDataFrame(right, "grp long, name string")
    none = spark.createDataFrame([], "grp long, word string")
    want = {(None, "Golden Pig Bar", "Goldne Pig Bar"), (1, "Silver Otter Inn", "Silver Oter Inn"), (1, "Copper Kettle", "Coper Kettle")}
    for bounds in ((60_000, 10_000), (1, 1), (2, 1)):
        assert {(r["grp"], r["left"], r["right"]) for r in name_variants.link_names(a, b, none, *bounds).collect()} >= want, bounds
