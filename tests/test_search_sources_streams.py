import json
import zipfile

from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.sources import office, tables
from tidemark.streaming import events


def docs(spark):
    return spark.createDataFrame([(1, "Beach house, walk to the BEACH"), (2, "quiet house"), (3, None), (4, ""), (5, "beachfront"), (6, "Été à la plage " * 2000)], "id int, t string")


def test_index_and_scan(spark):
    index = search.build_index(docs(spark), "id", ["t"])
    assert {(r.term, r.id): r.tf for r in index.where("id = 1").collect()} == {("beach", 1): 2, ("house", 1): 1, ("walk", 1): 1}
    assert {r.id for r in search.match_any(index, "id", ["beach", "quiet"]).collect()} == {1, 2}
    assert {r.id for r in search.match_all(index, "id", ["house", "quiet"]).collect()} == {2}
    assert {r.id for r in search.like_scan(docs(spark), ["t"], "beach").collect()} == {1, 5}
    assert [tuple(r) for r in search.search_difference(docs(spark), index, "id", ["t"], "beach").collect()] == [(5, "like")]
    assert index.where("term = 'été'").first().tf == 2000
    scores = {r.id: r.score for r in search.tfidf(index, "id", ["house", "beach"], docs(spark)).collect()}
    assert scores[1] > scores[2] > 0


def test_stored_index_is_pruned(spark, tmp_path):
    search.save_index(search.build_index(docs(spark), "id", ["t"]), str(tmp_path / "i"))
    stored = spark.read.parquet(str(tmp_path / "i"))
    found = search.match_any(stored, "id", ["quiet"])
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,quiet)]" in found._jdf.queryExecution().toString().replace("In(term, [quiet])", "EqualTo(term,quiet)")
    assert [r.id for r in found.collect()] == [2]


CHAT = "[09:00] ann: keep this between us\n[09:05] bob: ok\r\n[09:10] ann: 10 done at 9.5 [09:15] cy: delete that pls\nnot a turn"


def test_conversations(spark):
    turns = search.chat_turns(spark.createDataFrame([(1, CHAT), (2, None), (3, "")], "id int, t string"), "id", "t")
    assert [(r.turn, r.minute, r.speaker) for r in turns.orderBy("turn").collect()] == [(0, 540, "ann"), (1, 545, "bob"), (2, 550, "ann"), (3, 555, "cy")]
    dictionary = spark.createDataFrame([("secrecy", "Keep this between us"), ("secrecy", "delete that"), ("x", "elete"), (None, None), ("y", "?!")], "category string, phrase string")
    assert sorted((r.turn, r.phrase) for r in search.keyword_screen(turns, dictionary).collect()) == [(0, "keep this between us"), (3, "delete that")]
    context = search.context_window(turns, "id", F.col("turn") == 0).first().context
    assert context == ["keep this between us", "ok"]
    linked = search.linked_behaviour(turns, "id", F.contains("message", F.lit("between us")), F.contains("message", F.lit("done at")))
    assert [tuple(r) for r in linked.collect()] == [(1, 0, 2)]
    assert search.novel_terms(turns, F.col("turn") == 0, 1).where("term = 'keep'").first().lift > 1


def test_phrases_within_phrases_and_with_signs(spark):
    turns = spark.createDataFrame([(1, 0, "Delete that now, a+b at p (net) 5% or \\Ehm"), (2, 0, None), (3, 0, "undelete thats")], "id int, turn int, message string")
    phrases = ["delete that", "delete that now", "that", "p (net", "a+b", "5% or", "\\Ehm", "a b", "now, a"]
    dictionary = spark.createDataFrame([("c", p) for p in phrases] + [("d", "that")], "category string, phrase string")
    got = sorted((r.category, r.phrase) for r in search.keyword_screen(turns, dictionary).collect())
    assert got == sorted([("c", p.lower()) for p in phrases if p != "a b"] + [("d", "that")])
    assert search.keyword_screen(turns, dictionary.limit(0)).count() == 0 and search.keyword_screen(turns.limit(0), dictionary).count() == 0


def test_words_of_all_scripts(spark):
    df = spark.createDataFrame([(1, "Café œuvre šest"), (2, "Cafe\u0301, Œuvre"), (3, "这房子很安静 beach"), (4, None)], "id int, t string")
    index = search.build_index(df, "id", ["t"])
    found = lambda w: {r.id for r in search.match_any(index, "id", [w]).collect()}
    assert found("café") == {1, 2} and found("œuvre") == {1, 2} and found("šest") == {1} and found("房子") == {3} and found("安静") == {3} and found("beach") == {3} and found("cafe") == set()


def test_fuzzy_search(spark):
    df = spark.createDataFrame([(1, "Quiet harbour", "boats"), (2, "harbor wall", None), (3, "nothing", "harbour"), (4, None, None), (5, "", "")], "id int, a string, b string")
    got = {r.id: r.score for r in search.fuzzy_search(df, "id", {"a": 20, "b": 10}, "harbour", 0.2).collect()}
    assert got.keys() == {1, 2, 3} and got[1] < got[2] and got[1] < got[3]
    assert {r.id for r in search.fuzzy_search(df.where("id = 2"), "id", {"a": 20, "b": 10}, "harbour", 0.2).collect()} == {2}
    assert search.fuzzy_search(df, "id", {"a": 1}, "x").count() == 0


def test_scores_and_rules(spark):
    turns = spark.createDataFrame([(1, "delete"), (2, "hello"), (3, None)], "id int, message string")
    got = {r.id: r.intent for r in search.classified(turns, lambda s: s.str.contains("delete").astype(float)).collect()}
    assert got[1] == "suspicious" and got[2] == "legitimate"
    rules = search.with_rules(spark.createDataFrame([("a",), ("b",)], "category string"), spark.createDataFrame([("a", "r1"), ("a", "r2")], "category string, rule string"))
    assert sorted(map(tuple, rules.collect()), key=str) == [("a", "r1"), ("a", "r2"), ("b", None)]


def test_lookups_open_the_folders_of_their_terms(spark, tmp_path):
    search.save_index(search.build_index(docs(spark), "id", ["t"]), str(tmp_path / "s"), 8)
    stored = search.StoredIndex(spark, str(tmp_path / "s"), 8)
    found = search.match_any(stored.postings(["quiet"]), "id", ["quiet"])
    assert [r.id for r in found.collect()] == [2] and stored.postings([]).count() == 0
    assert search.rows_examined(found) < stored.rows.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "EqualTo(term,quiet)" in plan


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('a,b,c\n1,"x, ""y""",NA\n,n/a,3\n')
    df = tables.read_csv(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [("1", 'x, "y"', None), (None, None, "3")]
    assert tables.read_csv(spark, str(path), "a int, b string, c double", ["a", "c"]).columns == ["a", "c"]
    latin = tmp_path / "latin.csv"
    latin.write_bytes("n\nMünchen\n".encode("latin-1"))
    assert tables.read_csv(spark, str(latin), encoding="ISO-8859-1").first().n == "München"
    tables.write_csv(df, str(tmp_path / "out"), single=True)
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "out")).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert tables.report_lines(spark.createDataFrame([("a", 2.5)], "n string, v double"), "%s: %.2f", ["n", "v"]).first().line == "a: 2.50"


def test_csv_with_lines_in_values_and_torn_records(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('n,t\n1,"line one\nline two"\nx,b\n3,c,d\n4\n')
    got = [tuple(r) for r in tables.read_csv(spark, str(path), torn="bad").collect()]
    assert got[0] == ("1", "line one\nline two", None) and got[1] == ("x", "b", None) and got[2][2] == "3,c,d" and got[3][2] == "4"
    typed = {r.n: r.bad for r in tables.read_csv(spark, str(path), "n int, t string", torn="bad").collect()}
    assert typed[1] is None and typed[None] == "x,b"
    numbers = tmp_path / "n.csv"
    numbers.write_text("a,b,c\n1,2.5,2024-01-02\n2,,2024-01-03\n")
    assert tables.read_csv(spark, str(numbers), infer=True).dtypes == [("a", "int"), ("b", "double"), ("c", "date")]
    assert tables.read_csv(spark, str(numbers), multi_line=False).count() == 2
    assert "2024-01-02" in tables.table_text(tables.read_csv(spark, str(numbers)), 1) and "2024-01-03" not in tables.table_text(tables.read_csv(spark, str(numbers)), 1)


def test_database_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).selectExpr("id", "concat('n', id) as name").write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    df = tables.read_jdbc(spark, url, "t", "id", 0, 100, 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100
    few = df.where("id = 7").select("name")
    assert few.first()[0] == "n7" and "PushedFilters: [*IsNotNull(id), *EqualTo(id,7)]" in few._jdf.queryExecution().executedPlan().toString()


def test_shared_formulas(spark, tmp_path):
    assert office.shifted("SUM(A1:$B$2)+LOG10(C3)&\"A1\"", 1, 2) == "SUM(B3:$B$2)+LOG10(D5)&\"A1\"" and office.shifted("A1", -1, 0) == "#REF!" and office.shifted("Z9+AZ9", 1, 0) == "AA9+BA9"
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<w xmlns:r="http://r"><sheets><sheet name="S" r:id="r1"/></sheets></w>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>')
        z.writestr("xl/worksheets/sheet1.xml", '<s><row><c r="B1"><f t="shared" ref="B1:B3" si="0">A1*2</f><v>2</v></c><c r="B2"><f t="shared" si="0"/><v>4</v></c><c r="B3"><f t="shared" si="0"/></c></row></s>')
    cells = office.read_xlsx(spark, str(tmp_path))
    assert sorted((r.cell, r.formula) for r in cells.collect()) == [("B1", "=A1*2"), ("B2", "=A2*2"), ("B3", "=A3*2")]
    assert sorted((r.row, r.cells) for r in office.first_cells(cells, 1).collect()) == [(1, ["B1=2"]), (2, ["B2=4"]), (3, ["B3==A3*2"])]


W = 'xmlns:w="http://w" xmlns:a="http://a"'


def test_office_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body><w:p><w:r><w:t>Hello </w:t><w:t>you</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    with zipfile.ZipFile(tmp_path / "s.pptx", "w") as z:
        for n in (10, 2):
            z.writestr(f"ppt/slides/slide{n}.xml", f"<a:s {W}><a:t>slide {n}</a:t></a:s>")
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<w xmlns:r="http://r"><sheets><sheet name="S" r:id="r1"/></sheets></w>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>word</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<s><row><c r="A1" t="s"><v>0</v></c><c r="AB7"><f>SUM(A1:A2)</f><v>3</v></c></row></s>')
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": ["# t", "itle"]}, {"cell_type": "code", "source": "x", "outputs": [{"output_type": "stream", "text": ["o", "k"]}, {"output_type": "execute_result", "data": {"text/plain": ["42"]}}]}]}))
    root = str(tmp_path)
    got = office.read_docx(spark, root).collect()
    assert [(r.kind, r.text) for r in sorted((r for r in got if r.error is None), key=lambda r: r.part)] == [("paragraph", "Hello you"), ("table_row", "a | b")]
    assert [r.path.endswith("broken.docx") for r in got if r.error] == [True]
    assert [(r.part, r.text) for r in office.read_pptx(spark, root).collect()] == [(2, "slide 2"), (10, "slide 10")]
    cells = office.read_xlsx(spark, root)
    assert sorted((r.cell, r.formula, r.value) for r in cells.collect()) == [("A1", None, "word"), ("AB7", "=SUM(A1:A2)", "3")]
    assert tuple(office.sheet_size(cells).select("max_row", "max_column").first()) == (7, 28)
    notebook = office.read_notebooks(spark, root).orderBy("cell", "kind").collect()
    assert [(r.cell, r.kind, r.text) for r in notebook] == [(1, "MARKDOWN", "# title"), (2, "CODE", "x"), (2, "OUTPUT", "ok"), (2, "OUTPUT", "42")]


def test_streams(spark, tmp_path):
    schema = "id bigint, ts timestamp, user string"
    rows = [(1, "2024-01-01 00:10:00", "a"), (1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:50:00", "a"), (3, "2024-01-01 05:00:00", "b"), (4, "2024-01-03 00:00:00", "c")]
    spark.createDataFrame(rows, "id bigint, ts string, user string").selectExpr("id", "cast(ts as timestamp) ts", "user").coalesce(1).write.parquet(str(tmp_path / "in"))
    arrived = lambda: events.event_stream(spark, str(tmp_path / "in"), schema)
    for name, df in (("w", events.windowed_counts(arrived(), "ts", "user")), ("d", events.deduplicated(arrived(), ["id"], "ts")), ("s", events.session_counts(arrived(), "ts", "user"))):
        events.append_to(df, str(tmp_path / name), str(tmp_path / f"c{name}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 4
    assert {(r.user, r.n) for r in spark.read.parquet(str(tmp_path / "w")).collect()} == {("a", 3), ("b", 1)}
    assert {(r.user, r.n) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {("a", 3), ("b", 1)}


def test_speed_is_timed_over_34_terms_ten_times(spark, data, monkeypatch):
    from tidemark.plans import texts

    seen = []
    monkeypatch.setattr(texts.search, "compare_speed", lambda runs, repeats=10: seen.append((list(runs), repeats)) or [{"name": n, "matches": 0, "rows_examined": 0, "mean_ms": 1.0} for n in runs])
    assert texts.search_speed(spark, data).count() == 68
    assert len(set(texts.TIMED)) == 34 and seen == [([f"{way} {t}" for way in ("index", "like") for t in texts.TIMED], 10)]
