import random

import pytest

from tidemark.llm.canonical import Grams, Matcher, edits, map_values

SERVICES = [("Physical Therapy", "PT"), ("Wound Care", "WC"), ("General Check-up", "GC"), ("Speech Therapy", "ST"), ("Occupational Therapy", "OT"), ("Blood Pressure Review", "BR"), ("Palliative Visit", "PV"), ("Post-natal Visit", "PN"), ("Stoma Care", "SC")]
PLACES = [("North", "N"), ("East", "E"), ("West", "W"), ("South", "S"), ("North-East", "NE"), ("South-West", "SW"), ("Old Town", "OT"), ("Airport Road", "AR")]
MEANT = {
    "Physical Therapy": ["pt.", "(PT)", "P.T.", "Physical_Therapy", "PhysicalTherapy", "Therapy, Physical", "Therapy/Physical", "Physcl Thrpy", "Phys. Ther.", "lhysicaal therapy", "Physícal Therapy", "physical therapy (home)", "home PHYSICAL THERAPY", "Physical Therapy - 2nd", "\tPhysical Therapy ", "*Physical Therapy*"],
    "General Check-up": ["Gnrl Chck-p", "Gene. Che up", "general check up", "general check-up, follow up", "General hCevk-up"], "Palliative Visit": ["palliative visit visit", "Palli. Visit.", "PV "], "Post-natal Visit": ["Pst-ntl Vst", "Post-aental Visit"], "Wound Care": ["Wnd Cr", "WOUND ARE", "Wound Vare"],
}
PLACED = {"North": ["nroth", "north side", "Zone: north", "N.", "(N)", "the North"], "North-East": ["northeast", "Nort-East", "North East", "NE "], "East": ["Eats", "rast", "Eat"], "West": ["Wset", "qest", "Wst"], "South-West": ["Sth-Wst", "SOUTH-WWST"], "Airport Road": ["Air. Road", "iarport road"]}
NONE = ["Hair Care", "Lawn Care", "Piano Lesson", "misc", "xxx", "???", "to be confirmed", "unknown", "12", "Ирина"]


def test_meanings():
    services, places = Matcher([(n, [c]) for n, c in SERVICES]), Matcher([(n, [c]) for n, c in PLACES])
    assert {v: services.resolve(v) for n, vs in MEANT.items() for v in vs} == {v: n for n, vs in MEANT.items() for v in vs}
    assert {v: places.resolve(v) for n, vs in PLACED.items() for v in vs} == {v: n for n, vs in PLACED.items() for v in vs}
    assert {services.resolve(v) for v in NONE} == {"UNMATCHED"}
    assert {places.resolve(v) for v in ("n.a.", "tbc", "east west", "Moon Base", "999", "x" * 100_000)} == {"UNMATCHED"}


def test_edits():
    assert edits("west", "west", 2) == 0 and edits("wset", "west", 2) == pytest.approx(0.9) and edits("", "ab", 3) == 2
    assert edits("aental", "natal", 3) == pytest.approx(1.9) and edits("abcdef", "uvwxyz", 2) > 2


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "rid bigint, f string, v string, _id string, canonical int")


def test_rows(spark):
    reference = spark.createDataFrame([("service", n, c) for n, c in SERVICES] + [("place", n, c) for n, c in PLACES] + [(None, "x", "x"), ("place", None, "q")], "field string, entry string, code string")
    rows = [(1, "service", "pt"), (2, "place", "OT"), (2, "place", "ot"), (2, "place", "ot"), (3, "service", None), (4, "service", " \t "), (5, "service", "Wound Care"), (6, "place", "Wound Care"), (7, "other", "pt"), (8, "service", "Wound Care ")]
    got = sorted((r.rid, r.field, r.canonical) for r in map_values(frame(spark, rows), "rid", "f", "v", reference, "field", "entry", "code").collect())
    assert got == [(1, "service", "Physical Therapy"), *[(2, "place", "Old Town")] * 3, (6, "place", "UNMATCHED"), (7, "other", "UNMATCHED"), (8, "service", "Wound Care")]
    assert map_values(frame(spark, []), "rid", "f", "v", reference, "field", "entry", "code").count() == 0
    assert [r.canonical for r in map_values(frame(spark, rows[:1]), "rid", "f", "v", reference.limit(0), "field", "entry", "code").collect()] == ["UNMATCHED"]


def invented(n, seed):
    rnd = random.Random(seed)
    part = lambda: "".join(rnd.choice("bdfgklmnprstv") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 4))) + rnd.choice(["", "n", "r", "st"])
    return sorted({" ".join(part().title() for _ in range(rnd.randrange(1, 7))) for _ in range(n)})


def spoilt(name, rnd):
    """A name as it might be typed: words in another order, one of them shortened or with a slip."""
    words = name.split()
    rnd.shuffle(words)
    k = max(range(len(words)), key=lambda i: len(words[i]))
    w = words[k]
    at = rnd.randrange(1, len(w) - 1)
    words[k] = rnd.choice([w[:at] + w[at + 1 :], w[:at] + w[at] + w[at:], w[:at] + w[at + 1] + w[at] + w[at + 2 :], w])
    return rnd.choice([" ", "-", ", "]).join(words)


def test_sets_of_any_size_in_any_order():
    matcher = Matcher([("Saint Mary Of The Sea Clinic", []), ("Saint Mary Of The Lake Clinic", []), ("Grand Old House On The Hill", ["GH"])])
    for typed in ("Clinic Saint Mary of the Sea", "sea clinic, saint mary of the", "Clinic of the sea Siant Mary", "SAINT MARY OF THE SEA CLINC"):
        assert matcher.resolve(typed) == "Saint Mary Of The Sea Clinic", typed
    assert matcher.resolve("hill house grand old on the") == "Grand Old House On The Hill" and matcher.resolve("the clinic of the mary") == "UNMATCHED"


@pytest.mark.parametrize("n", [40, 3000])
def test_recall_on_names_it_was_not_made_for(n):
    names, rnd = invented(n, 5), random.Random(2)
    matcher = Matcher([(name, []) for name in names])
    typed = [(name, spoilt(name, rnd)) for name in (names * 3)[:400]]
    found = [matcher.resolve(t) for _, t in typed]
    assert sum(f == name for (name, _), f in zip(typed, found, strict=True)) >= 0.9 * len(typed)
    assert sum(f not in (name, "UNMATCHED") for (name, _), f in zip(typed, found, strict=True)) <= 0.03 * len(typed)
    assert sum(matcher.resolve(x) != "UNMATCHED" for x in invented(300, 77) if x not in set(names)) <= 30


def test_candidates_by_pairs_of_letters_are_complete():
    rnd = random.Random(9)
    texts = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 9))) for _ in range(300)})
    grams = Grams(texts)
    for _ in range(150):
        asked, most = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 9))), rnd.choice([1.0, 2.0, 3.0])
        assert {k for k, t in enumerate(texts) if edits(asked, t, most) <= most} <= set(grams.near(asked, most).tolist())


def test_blocks_of_a_list_give_what_the_list_gives(spark):
    names, rnd = invented(150, 8), random.Random(3)
    reference = spark.createDataFrame([("f", n, f"c{k}") for k, n in enumerate(names)] + [("service", n, c) for n, c in SERVICES], "field string, entry string, code string")
    typed = [spoilt(n, rnd) for n in names] + ["c7", "home visit", f"{names[3]} {names[4]}", "Quux"]
    rows = [(k, "f", t) for k, t in enumerate(typed)] + [(1000 + k, "service", t) for k, t in enumerate([v for vs in MEANT.values() for v in vs] + NONE)] + [(5000, "none", "x")]
    one, many = ({(r.rid, r.field): r.canonical for r in map_values(frame(spark, rows), "rid", "f", "v", reference, "field", "entry", "code", block=b).collect()} for b in (20_000, 25))
    assert one == many and len(one) >= len(rows) - 60 and one[5000, "none"] == "UNMATCHED"
