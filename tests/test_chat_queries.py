"""Queries of chats against their SQL on texts with odd white space, which sf0.001 does not hold."""

from collections import Counter

import duckdb
import pytest

from tidemark.plans import texts

CHATS = [
    (1, "[09:00] ann: keep this between us\x0b[09:01] bob: delete that \x0b [09:02] cy: ok", "trader_chat"),
    (2, "[09:00] ann: move it offline [09:01] [09:02] bob: delete that\t\f[09:03] ann: fine\x0b\r\n[09:04] b\x0bb: who told", "trader_chat"),
    (3, "\x0b[09:00] ann: delete that\n [09:01] bob: offline \n\n[09:02] ann: keep this between us now, delete that", "trader_chat"),
    (4, "[09:00] ann: keep this between us\r[09:01] bob:   [09:02] ann: delete that [09:03] bob: delete that", "trader_chat"),
    (5, None, "trader_chat"),
    (6, "[09:00] ann: delete that", "web"),
    (7, "\n".join(f"[09:0{k}] bob: delete that one\x0b[09:0{k}] cy: fine by me" for k in range(6)), "trader_chat"),
]


@pytest.mark.parametrize("name", ["chat_turns", "keyword_context", "novel_terms", "chat_intents"])
def test_odd_white_space(spark, tmp_path, name):
    spark.createDataFrame(CHATS, "doc_id bigint, text string, kind string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = texts.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(texts.ORACLE[name]).df()
    rows = lambda frame: Counter(frame[sorted(frame.columns)].itertuples(index=False, name=None))
    assert len(want) and rows(got) == rows(want)
