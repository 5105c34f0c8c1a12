import glob
import os

import duckdb
import pytest
from test_queries import rows

from tidemark.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, data, duck, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(duck.execute(ORACLE[name]).df())


def test_golden_agrees_with_found(spark, data):
    found = {r.visit_id: r.row_id for r in QUERIES["p4_found"](spark, data).collect()}
    golden = {r.visit_id: r for r in QUERIES["p4_golden"](spark, data).collect()}
    assert found.keys() <= golden.keys() and all(golden[v].notes_row_id == r for v, r in found.items())
    assert all(g.nurse_id is None or g.nurse_id.startswith("N") for g in golden.values())


def test_golden_values_are_claimed_by_rows_of_the_visit(spark, data, duck):
    golden = QUERIES["p4_golden"](spark, data).toPandas()
    entries = {tuple(r) for r in duck.execute("SELECT field, canonical_value FROM canonical_values").fetchall()}
    claims = duck.execute("SELECT upper(regexp_replace(visit_id, '[^\\p{L}\\p{N}]', '', 'g')) AS k, * FROM visits").df().groupby("k")
    assert len(golden) and golden.visit_id.is_unique
    for r in golden.itertuples():
        held = claims.get_group(r.visit_id)
        assert len(held) > 1
        assert r.nurse_id in set(held.nurse_id) or r.nurse_id is None and held.nurse_id.isna().all()
        for field in ("service_type", "visit_location"):
            value = getattr(r, field)
            assert value is None or (field, value) in entries
            # A value that stands in the list is never lost to one that does not.
            assert value is not None or not any((field, v) in entries for v in held[field])


def test_every_typed_value_has_a_meaning(spark, data, duck):
    got = QUERIES["p6_found"](spark, data).toPandas()
    asked = duck.execute(
        """SELECT row_id, field FROM (SELECT row_id, 'service_type' AS field, service_type AS v FROM visits UNION ALL SELECT row_id, 'visit_location', visit_location FROM visits)
        WHERE regexp_replace(v, '[\\s\\p{Z}]', '', 'g') <> '' AND (field, v) NOT IN (SELECT field, canonical_value FROM canonical_values)"""
    ).fetchall()
    assert sorted(zip(got.row_id, got.field, strict=True)) == sorted(asked)
    entries = {tuple(r) for r in duck.execute("SELECT field, canonical_value FROM canonical_values").fetchall()}
    assert all(c == "UNMATCHED" or (f, c) in entries for f, c in zip(got.field, got.canonical, strict=True)) and (got.canonical != "UNMATCHED").mean() > 0.8


def test_ids_decode_to_the_texts(spark, data, duck):
    got = {r.doc_id: list(r.ids) for r in QUERIES["p8_ids"](spark, data).collect()}
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert got.keys() == texts.keys() and all(not ids for d, ids in got.items() if not texts[d])
    import base64

    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        pieces = {int(n): base64.b64decode(p) for p, n in (line.split() for line in f if line.strip())}
    assert all(b"".join(pieces[i] for i in ids).decode() == (texts[d] or "") for d, ids in got.items())


def test_residue_is_not_content(spark, data, duck):
    got = {r.doc_id for r in QUERIES["p10_found"](spark, data).collect()}
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert got and all(texts[d].strip() for d in got) and len(got) < 0.15 * len(texts)
    assert {d for d, t in texts.items() if t and ("{{" in t or "lorem ipsum" in t.lower())} <= got
