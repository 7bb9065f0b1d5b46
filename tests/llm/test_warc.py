import base64
import gzip
import hashlib

import pytest

from plumbline.llm import query_warc as Q
from plumbline.llm import warc as W

HTML = [None, "", "<p>a</p>", "<p>a</p>", "é" * 70_000, "<p>a</p>", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "big " * 400_000, ""]


def pages(spark):
    rows = [(10 - i, f"http://h/{i}\r\nX: y" if i % 2 else None, h, "c", 1) for i, h in enumerate(HTML)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string, length int"), rows


def brute(rows, min_bytes=0):
    best = {}
    for p, _, h, *_ in rows:
        best[h or ""] = max(best.get(h or "", p), p)
    out = set()
    for p, _, h, *_ in rows:
        data = (h or "").encode()
        first = len(data) < min_bytes or best[h or ""] == p
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.add((p, len(data), digest, "response" if first else "revisit", None if first else best[h or ""]))
    return out


@pytest.mark.parametrize("min_bytes", [0, 5, 100])
def test_archives_against_brute_force(spark, min_bytes):
    df, rows = pages(spark)
    back = W.read_archives(W.archive_pages(df, min_bytes)).collect()
    assert {tuple(r)[:1] + tuple(r)[2:6] for r in back} == brute(rows, min_bytes)
    html = {p: h for p, _, h, *_ in rows}
    assert all(r.payload.decode() == (html[r.page_id] or "") for r in back if r.record_type == "response")


def test_query(spark, tmp_path):
    df, rows = pages(spark)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    assert {tuple(r) for r in Q.op4_warc(spark, str(tmp_path)).collect()} == brute(rows)
    (tmp_path / "none").mkdir()
    df.limit(0).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert Q.op4_warc(spark, str(tmp_path / "none")).count() == 0


def test_nulls_and_repeats(spark):
    rows = [(None, None, "a"), (None, None, "b"), (4, None, "a"), (7, "u", "c"), (7, "u", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in W.read_archives(W.archive_pages(df)).collect())
    assert got == [("4", "response", None), ("7", "response", None), ("7", "response", None), ("None", "response", None), ("None", "revisit", 4)]


def test_normaliser_takes_streams_of_any_members(tmp_path):
    records = [W.build_record(i, "u", "D", 3, b"abc" if i % 2 else None, 9) for i in range(50)]
    whole = str(tmp_path / "whole.warc.gz")
    with open(whole, "wb") as f:
        f.write(gzip.compress(b"".join(records[:20])) + gzip.compress(b"".join(records[20:])))
    n, size = W.normalise(whole, str(tmp_path / "out.warc.gz"))
    entries = W.read_index(str(tmp_path / "out.warc.gz"))
    assert n == len(entries) == 50 and entries[-1][0] + entries[-1][1] == size
    with W.open_input(str(tmp_path / "out.warc.gz")) as f:
        assert [W.read_member(f, o, k) for o, k, _ in entries] == records
    with open(whole, "wb") as f:
        f.write(gzip.compress(b"".join(records)[:-7]))
    with pytest.raises(ValueError, match="within a record"):
        W.normalise(whole, str(tmp_path / "cut.warc.gz"))


def test_query_matches_oracle(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    rel = con.sql(Q.ORACLES["op4_warc"])
    got = Q.op4_warc(spark, d).select(*rel.columns).collect()
    assert sorted(rel.fetchall(), key=repr) == sorted((tuple(r) for r in got), key=repr) and len(got) > 0


def test_payloads_do_not_move(spark):
    df, _ = pages(spark)
    facts = W.spool_pages(df)
    assert "payload" not in facts.columns and "html" not in W.page_records(facts)._jdf.queryExecution().toString()


def test_ids_are_whole_numbers(spark):
    df = spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string")
    with pytest.raises(ValueError, match="page_id"):
        W.archive_pages(df)
