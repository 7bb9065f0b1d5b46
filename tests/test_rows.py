import pytest
from pyspark.sql import functions as F

from plumbline.sources.store import open_input
from plumbline.streaming import scan as A
from plumbline.streaming.rows import after, parquet_files


def tables(spark, folder, sizes, first=0, name="part"):
    for k, n in enumerate(sizes):
        one = spark.range(first, first + n).selectExpr("id", "concat('t', id) AS text").coalesce(1)
        one.toPandas().to_parquet(f"{folder}/{name}-{k:03d}.parquet", row_group_size=7)
        first += n
    return first


def ids(spark, folder):
    return sorted(r.id for r in A.scanned(spark, folder).collect())


def own(df):
    return df.select("id", "row_index", F.upper("text").alias("t"))


def test_offsets_within_files(spark, tmp_path):
    tables(spark, tmp_path, [10, 0, 25])
    files = parquet_files(f"file://{tmp_path}")
    assert [f.rsplit("/", 1)[1] for f in files] == ["part-000.parquet", "part-001.parquet", "part-002.parquet"]
    assert after(files, ("", 0), 4) == (files[0], 4) and after(files, (files[0], 4), 6) == (files[0], 10)
    assert after(files, (files[0], 10), 3) == (files[2], 3) and after(files, (files[2], 3), 100) == (files[2], 25)
    assert parquet_files(files[0]) == [files[0]]


def test_budgets_in_the_middle_of_files_visit_each_row_once(spark, tmp_path):
    (src := tmp_path / "src").mkdir()
    tables(spark, src, [10, 25])
    out = f"{tmp_path}/out"
    told = [A.advance_rows(spark, str(src), own, out, A.Budgets(rows=r, batch_rows=6)) for r in (4, 9, 1)]
    assert [(t["reason"], t["rows"], t["row"]) for t in told] == [("rows", 4, 4), ("rows", 9, 3), ("rows", 1, 4)]
    assert ids(spark, out) == list(range(14))
    # with no seconds left nothing is begun; results that reach the disk's budget end it
    assert A.advance_rows(spark, str(src), own, out, A.Budgets(seconds=0))["reason"] == "seconds"
    assert A.advance_rows(spark, str(src), own, out, A.Budgets(disk=1, batch_rows=5)) == {"reason": "disk", "rows": 5, "path": f"file:{src}/part-001.parquet", "row": 9}
    assert A.advance_rows(spark, str(src), own, out)["reason"] == "complete" and A.advance_rows(spark, str(src), own, out)["rows"] == 0
    assert ids(spark, out) == list(range(35))
    # later files go on, earlier ones are an error
    tables(spark, src, [3], 35, "q")
    assert A.advance_rows(spark, str(src), own, out)["rows"] == 3 and ids(spark, out) == list(range(38))
    tables(spark, src, [3], 100, "a")
    with pytest.raises(ValueError):
        A.advance_rows(spark, str(src), own, out)


def test_failures_leave_the_cursor_and_repeat_the_batch(spark, tmp_path, monkeypatch):
    (src := tmp_path / "src").mkdir()
    tables(spark, src, [20])
    out = f"{tmp_path}/out"
    A.advance_rows(spark, str(src), own, out, A.Budgets(rows=5))

    def broken(df):
        raise RuntimeError("stop")

    with pytest.raises(Exception, match="stop"):
        A.advance_rows(spark, str(src), broken, out, A.Budgets(rows=6))
    assert ids(spark, out) == list(range(5))
    # the batch that was planned is done as it was planned
    assert A.advance_rows(spark, str(src), own, out, A.Budgets(rows=2))["row"] == 11
    # a call that dies after its batch, before the cursor moves
    put = A.Cursor.put
    monkeypatch.setattr(A.Cursor, "put", lambda self, state: put(self, state) if state["planned"] else (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        A.advance_rows(spark, str(src), own, out, A.Budgets(rows=4))
    monkeypatch.undo()
    assert ids(spark, out) == list(range(11))
    assert A.advance_rows(spark, str(src), own, out)["reason"] == "complete" and ids(spark, out) == list(range(20))


def test_one_call_at_a_time(spark, tmp_path):
    (src := tmp_path / "src").mkdir()
    tables(spark, src, [5])
    out = f"{tmp_path}/out"
    cursor = A.Cursor(spark, out)
    cursor.lock(False)
    with pytest.raises(A.Busy):
        A.advance_rows(spark, str(src), own, out)
    assert A.advance_rows(spark, str(src), own, out, steal=True)["rows"] == 5
    (tmp_path / "none").mkdir()
    assert A.advance_rows(spark, f"{tmp_path}/none", own, f"{tmp_path}/o2")["reason"] == "complete"
    with open_input(f"{cursor.folder}/cursor.json") as f:
        assert b'"batches": 1' in f.read()
