import random
import unicodedata

import pytest

from tidemark.llm.leakage import build_index, leaked_items, search_index, words


def brute(docs, items, length):
    found = set()
    for i, t in items:
        w = words(t)
        grams = {tuple(w[k : k + length]) for k in range(len(w) - length + 1)}
        for d, text in docs:
            v = words(text)
            if any(tuple(v[k : k + length]) in grams for k in range(len(v) - length + 1)):
                found.add((d, i))
    return found


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, d, "x") for d, t in docs], "doc bigint, body string, item bigint, _doc string").repartition(3), spark.createDataFrame(items, "item bigint, body string")


def run(spark, docs, items, **kw):
    d, i = frames(spark, docs, items)
    return {(r.doc, r.item): r.exact for r in leaked_items(d, "doc", "body", i, "item", "body", **kw).collect()}


@pytest.mark.parametrize("seed,blocks", [(0, 20_000_000), (1, 300), (2, 20_000_000)])
def test_against_brute_force(spark, seed, blocks):
    rnd = random.Random(seed)
    vocabulary = ["the", "a", "of", "Nurse", "Quay", "pump", "ledger", "rain", "é", "x9"]
    sentence = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, sentence(rnd.randrange(2, 12))) for k in range(40)] + [(99, None), (98, ""), (None, sentence(9)), (0, items_text := sentence(8))]
    docs = [(k, sentence(rnd.randrange(0, 90)) if rnd.random() < 0.8 else f"{sentence(5)} {items_text} {sentence(5)}") for k in range(120)] + [(500, None), (501, ""), (502, items_text), (502, items_text)]
    got = run(spark, docs, items, length=4, block_bytes=blocks)
    assert set(got) == brute(docs, [x for x in items if x[0] is not None], 4) and all(got.values())


def test_spelling_does_not_matter(spark):
    item = "Of 470 barrels kept in Umbdarhaven, 25 mention the upper pumping station."
    cut = "barrels kept in Umbdarhaven, 25 mention the upper pumping station"
    docs = [(1, cut.upper()), (2, cut.replace("barrels", "bar­rels​").replace("e", "é")), (3, unicodedata.normalize("NFD", cut.replace("a", "à"))), (4, "**" + cut.replace(" ", "_\n ") + "**"), (5, cut.replace("the", "then the")), (6, cut[8:]), (7, cut.replace("25", "2 5")), (8, "x " * 200_000 + cut)]
    assert {d for d, _ in run(spark, docs, [(1, item)])} == {1, 2, 3, 4, 8}


def test_documents_do_not_run_into_each_other(spark):
    assert run(spark, [(1, "a b c"), (2, "d e f")], [(1, "a b c d e f")], length=4) == {}
    assert run(spark, [], [(1, "a b c d")], length=2) == {} and run(spark, [(1, "a b")], [], length=2) == {}


def test_proximity(spark):
    item = "one two three four five six"
    docs = [(1, "one two x three four y five six"), (2, "one two x x x three four five six"), (3, "six five four three two one"), (4, item), (5, "one two three four x five")]
    got = run(spark, docs, [(7, item)], length=6, slop=2)
    assert got == {(1, 7): False, (4, 7): True}
    assert set(run(spark, docs, [(7, item)], length=5, slop=1)) == {(4, 7), (5, 7)}


def test_index_is_stored_once_for_any_number_of_items(spark):
    rnd = random.Random(8)
    sentence = lambda n: " ".join(rnd.choice(["oil", "rope", "Deck", "é", "sail", "42"]) for _ in range(n))
    docs = [(k, sentence(rnd.randrange(60))) for k in range(90)] + [(200, None), (201, "?!")]
    index = build_index(spark.createDataFrame(docs, "doc bigint, body string").repartition(2), "doc", "body", segment_bytes=600)
    assert index.count() > 10 and "Scan parquet" in index._jdf.queryExecution().executedPlan().toString()
    for n in (1, 30):
        items = [(k, sentence(9)) for k in range(n)]
        got = {(r._doc, r._item) for r in search_index(index, spark.createDataFrame(items, "i bigint, t string"), "i", "t", length=5).collect()}
        assert got == brute(docs, items, 5)


def test_proximity_against_brute_force(spark):
    rnd = random.Random(3)
    sentence = lambda n: " ".join(rnd.choice("abcdef") for _ in range(n))
    docs, items = [(k, sentence(40)) for k in range(60)], [(k, sentence(7)) for k in range(25)]

    def near(v, w, slop):
        def span(at, k):
            if k == len(w):
                return at
            nxt = next((j for j in range(at + 1, len(v)) if v[j] == w[k]), None)
            return None if nxt is None else span(nxt, k + 1)

        return any((end := span(b, 1)) is not None and end - b < len(w) + slop for b in range(len(v)) if v[b] == w[0])

    want = {(d, i) for d, text in docs for i, t in items if any(near(text.split(), t.split()[k : k + 5], 2) for k in range(3))}
    got = run(spark, docs, items, length=5, slop=2)
    assert set(got) == want and {p for p, e in got.items() if e} == brute(docs, items, 5)
