import random

import numpy as np
import pytest

from lokalis.llm import eval_leaks, junk_pages, packing, token_count


def test_token_counts_are_exact():
    count = token_count.Counter()
    for t in ["", " ", "a", "Tap room's  beer", " lead", "trail ", "a\nb", "a \n b", "x\n\n y", "it's 12,345\t!", "ル ビール é", "don't  \n\n  stop", "a " * 50]:
        assert count(t) == len(count.encoding.encode_ordinary(t)), repr(t)
    rnd = random.Random(1)
    for _ in range(500):
        t = "".join(rnd.choice(["a", "B", " ", "\n", "'s", "1", ".", "é", "\t"]) for _ in range(rnd.randint(0, 30)))
        assert count(t) == len(count.encoding.encode_ordinary(t)), repr(t)


def test_fill_is_optimal():
    from itertools import product

    rnd = random.Random(4)
    for _ in range(200):
        count = {rnd.randint(1, 20): rnd.randint(1, 3) for _ in range(rnd.randint(1, 5))}
        room = rnd.randint(0, 60)
        got = packing.closest_fill(sorted(count, reverse=True), count, room)
        assert all(0 < n <= count[s] for s, n in got)
        best = max(t for ns in product(*(range(c + 1) for c in count.values())) if (t := sum(n * s for n, s in zip(ns, count))) <= room)
        assert sum(n * s for s, n in got) == best


def test_packing_places_every_token_once(spark):
    rnd = random.Random(5)
    texts = [(i, " ".join("beer" for _ in range(rnd.randint(1, 60)))) for i in range(200)] + [(500, " ".join("beer" for _ in range(333))), (501, ""), (502, None), (503, "same"), (503, "same"), (503, "other text")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sizes = spark.createDataFrame([(1, "s", 64), (2, "m", 200)], "pack_no long, pack_name string, capacity_tokens long")
    rows = packing.pack_documents(docs, sizes, shard_texts=60).collect()
    count = token_count.Counter()
    for no, cap in ((1, 64), (2, 200)):
        mine = [r for r in rows if r["pack_no"] == no]
        load: dict = {}
        for r in mine:
            load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
        assert max(load.values()) <= cap and sum(load.values()) == sum(count(t) for _, t in texts if t)
        for d in {i for i, _ in texts}:
            n = [count(t) for i, t in texts if i == d and t]
            got = sorted((r["start_token"], r["tokens"]) for r in mine if r["doc_id"] == d)
            if len(n) == 1:
                assert [s for s, _ in got] == [sum(t for _, t in got[:k]) for k in range(len(got))] and sum(t for _, t in got) == n[0] and len(got) == -(-n[0] // cap)
            else:
                assert sorted(t for _, t in got) == sorted(n)
        assert sum(load.values()) / (len(load) * cap) > 0.9
    assert packing.pack_documents(docs.where("false"), sizes).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, spark.createDataFrame([(1, "x", 0)], "pack_no long, pack_name string, capacity_tokens long"))


def item(rnd):
    w = lambda: "".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(3)).capitalize()
    parts = [f"In {rnd.randint(1500, 1900)} the {w()} cellar flooded to step {rnd.randint(1, 900)}.", f"The {w()} kiln burned alder for {rnd.randint(9, 900)} nights.", f"A toll of {rnd.randint(9, 900)} groats was owed at {w()} bridge.", f"Two coopers named {w()} and {w()} split the yard at {w()}."]
    rnd.shuffle(parts)
    return " ".join(parts)


def brute(doc, it, least=15):
    """The longest run of successive item words in a document, at most a tenth changed, over every place and length."""
    d, w = eval_leaks.words_of(doc), eval_leaks.words_of(it)
    best = 0
    for shift in range(-len(w), len(d)):
        same = np.array([0 <= k + shift < len(d) and d[k + shift] == x for k, x in enumerate(w)])
        for s in range(len(w)):
            for e in range(s + max(least, best + 1), len(w) + 1):
                if same[s] and same[e - 1] and 10 * (~same[s:e]).sum() <= e - s:
                    best = e - s
    return best


def test_leaks_against_brute_force(spark):
    rnd = random.Random(6)
    items = [(i, item(rnd)) for i in range(12)]
    docs = []
    for k in range(60):
        w = items[k % 12][1].split()
        n = rnd.randint(8, len(w))
        s = rnd.randint(0, len(w) - n)
        part = w[s : s + n]
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            part[rnd.randrange(len(part))] = "roughly"
        docs.append((k, "Fans of beer said: <b>" + "\n".join(" ".join(part[i : i + 7]) for i in range(0, n, 7)).upper() + "</b>, as they say. " + item(rnd)))
    docs += [(900, None), (901, ""), (902, items[3][1].replace("'", "’").replace(" ", "  ")), (902, items[3][1])]
    got = {(r["doc_id"], r["item_id"]): r["words"] for r in eval_leaks.verbatim(eval_leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(77, None), (78, "too short")], "item_id long, text string"))).collect()}
    want = {(d, i): n for d, t in docs if t for i, x in items if (n := brute(t, x)) >= 15}
    assert got == want and len(want) > 30
    blocks = eval_leaks.verbatim(eval_leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=200))
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == set(want)
    assert eval_leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_reparameterised_questions_are_caught(spark):
    rnd = random.Random(12)
    name = lambda: "".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(3)).capitalize()
    ask = lambda a, b, n, m: f"In {n} the {a} cellar flooded to step {m} and the brewers of {b} paid {n} groats to {a}, so how many casks were left in {b} when the water had gone?"
    items = [(1, ask("Zadeka", "Morilu", 1880, 426)), (2, item(rnd)), (3, item(rnd))]
    value = lambda: (name(), name(), rnd.randint(1000, 1999), rnd.randint(100, 900))
    other = ask(*value())
    mixed = other.replace("groats to " + other.split()[3], "groats to Anotherone")
    docs = [(1, "Quiz night: " + ask(*value())), (2, "As he said, " + other + " Nobody knew."), (3, items[0][1]), (4, other[: len(other) // 3]), (5, mixed), (6, "Nothing of the kind."), (7, "<a " + "x" * 2000 + ">" + items[1][1])]
    found = eval_leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    new = {(r["doc_id"], r["item_id"]): (r["template_words"], r["replaced"]) for r in eval_leaks.reparameterised(found).collect()}
    n = len(items[0][1].split())
    assert {k for k, v in new.items() if v[0] == n} == {(1, 1), (2, 1)} and new[(1, 1)][1] == 7
    assert (3, 1) not in new and (4, 1) not in new and new.get((5, 1), (0, 0))[0] < n  # the same old value, two new ones
    assert {(r["doc_id"], r["item_id"]) for r in eval_leaks.verbatim(found).collect()} == {(3, 1), (7, 2)}


def sentence(rnd):
    w = lambda: "".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    n = lambda: w().capitalize()
    return rnd.choice([
        f"The {w()} keeps a {w()} of every {w()} that came through since {rnd.randint(1950, 2020)}.", f"We stopped at {n()} {n()} in the first {w()} week and found the {w()} nearly empty.", f"If you only have one {w()} in {n()}, walk past it and decide by the {w()}.",
        f"On the way back, a {w()} slept under the {w()} while the {w()} argued about {w()}.", f"They {w()} the {w()} every {rnd.randint(2, 9)} days and it shows in the {w()}, or so they {w()}.", f"Of the {w()} in {n()} not one is as {w()} as that of {n()}, but it is {w()}.",
    ])


def test_junk_pages(spark):
    rnd = random.Random(7)
    prose = [" ".join(sentence(rnd) for _ in range(rnd.randint(12, 25))) for _ in range(120)]
    words = ["cheap beer", "top pubs", "beer deals", "taproom near me", "best beer"]
    junk = [
        " ".join(f"{rnd.choice(words)} {rnd.choice(['Oakton', 'Elmville', 'Ashby'])}" for _ in range(60)), " ".join("#" + rnd.choice(words).replace(" ", "") for _ in range(60)),
        " ".join(f'<a href="https://x{i}.example/a">{rnd.choice(words)}</a>' for i in range(50)), "\n".join(f"* Beer Deals https://a{i}.example/{i}" for i in range(40)), ", ".join(f"zork{i} {rnd.choice(['mug', 'tap', 'sign'])} {rnd.choice(['set', 'xl', 'gift'])}" for i in range(60)),
    ]
    fine = [
        "Taps this week\n" + "\n".join(f"{i}. Zork{i} Pale Ale - {i % 9}.5% - Brewco (Oakton)" for i in range(1, 30)), "\n".join(f"{d} 13:00-22:30" for d in ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"] * 3),
        " ".join(sentence(rnd) for _ in range(12)) + "\nSources\n" + "\n".join(f"[{i}] The Oak Inn: https://oak.example/v/{i}" for i in range(6)), "cheap beer cheap beer", "",
    ]
    texts = prose + junk + fine
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in junk_pages.junk_pages(df).collect()} == set(range(len(prose), len(prose) + len(junk)))
    assert junk_pages.junk_pages(df.where("false")).count() == 0


def test_junk_share_follows_the_border(spark):
    rnd = random.Random(8)
    prose = [" ".join(sentence(rnd) for _ in range(20)) for _ in range(120)]
    tags = lambda n: " ".join(rnd.choice(["#cheapbeer", "#toppubs", "#beerdeals", "#bestbeer"]) for _ in range(n))
    words = lambda n: " ".join(" ".join(sentence(rnd) for _ in range(n)).split()[:n])
    mixed = [words(n) + ". " + tags(round(n * s / (1 - s))) for n in (45, 65, 85, 105, 150, 210) for s in (0.4, 0.57)]
    df = spark.createDataFrame(list(enumerate(prose + mixed)), "doc_id long, text string")
    share = {r["doc_id"]: r["share"] for r in junk_pages.junk_scores(df).collect()}
    assert all(abs(share[len(prose) + k] - (0.57 if k % 2 else 0.4)) < 0.05 for k in range(len(mixed))), [share[len(prose) + k] for k in range(len(mixed))]
    assert {r["doc_id"] for r in junk_pages.junk_pages(df).collect()} == {len(prose) + k for k in range(1, len(mixed), 2)}


def test_joined_words_and_links_are_all_counted(spark):
    rnd = random.Random(9)
    prose = [" ".join(sentence(rnd) for _ in range(20)) for _ in range(120)]
    tag = lambda: rnd.choice(["cheapbeer", "toppubs", "beerdeals", "taproom", "bestbeer"])
    many = [[tag() for _ in range(300)], [tag() for _ in range(300)], [tag() for _ in range(300)], [f"https://a{i}.example/" for i in range(300)], [f"b33r{i}" for i in range(300)]]
    junk = [" ".join(sentence(rnd) for _ in range(8)) + " " + by.join(w) for by, w in zip(",|/,,", many)]
    df = spark.createDataFrame(list(enumerate(prose + junk)), "doc_id long, text string")
    words = {r["doc_id"]: r["words"] for r in junk_pages.junk_scores(df).collect()}
    assert all(words[len(prose) + k] >= 300 for k in range(len(junk)))
    assert {r["doc_id"] for r in junk_pages.junk_pages(df).collect()} == set(range(len(prose), len(prose) + len(junk)))
    classes = lambda t: junk_pages.encoded(t, junk_pages.Known())
    assert len(classes("#a," * 400)) == 1 + 800 and classes("https://a.example/,www.b.example/x") == classes("https://a.example/, www.b.example/x")


def test_both_tails_flag_pages(spark):
    """Links are perplexing to the class model; ordinary sentences said over and over are predictable to the cache model."""
    rnd = random.Random(10)
    prose = [" ".join(sentence(rnd) for _ in range(20)) for _ in range(120)]
    links = " ".join(f"https://x{rnd.randint(1, 9999)}.example/{rnd.randint(1, 99)}" for _ in range(60))
    said = "The cheap beer of the town is the best beer of the town, and nobody in the town has a cheap beer like it. " * 12
    df = spark.createDataFrame(list(enumerate([*prose, links, said, "The cheap beer of the town is the best beer of the town, and nobody has one like it."])), "doc_id long, text string")
    assert {r["doc_id"] for r in junk_pages.junk_pages(df).collect()} == {len(prose), len(prose) + 1}
    _, c, state, _ = junk_pages.decoded(junk_pages.encoded(said, junk_pages.Known()))
    assert (state == 3).sum() > 8 * (state == 1).sum()
