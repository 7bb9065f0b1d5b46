import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import exact as E
from plumbline.operators import review as R
from plumbline.sinks import export as X

ROW = "line int, case_id string, status string, decision string, reviewer string, notes string"
HISTORY = "case_id string, revision int, id string, previous_id string, decision string, reviewer string, notes string, digest string"


def test_imports_are_whole_and_revisions_grow(spark):
    cases = spark.createDataFrame([("a", "d1"), ("b", "d2")], "case_id string, digest string")
    rows = [(2, "a", "reviewed", "confirmed", "ann", ""), (3, "a", "reviewed", "confirmed", "ann", ""), (4, "b", "", "", "", ""), (5, "b", None, None, None, None)]
    checked = R.check_reviews(spark.createDataFrame(rows, ROW), cases)
    assert sorted((r.line, r.state) for r in checked.collect()) == [(2, "accepted"), (3, "duplicate"), (4, "pending"), (5, "pending")]
    empty = spark.createDataFrame([], HISTORY)
    first = R.append_reviews(empty, checked)
    assert [(r.case_id, r.revision, r.previous_id) for r in first.collect()] == [("a", 1, None)]
    history = spark.createDataFrame(first.collect(), HISTORY)
    assert R.append_reviews(history, checked).count() == 0
    again = R.check_reviews(spark.createDataFrame([(2, "a", "reviewed", "rejected", "ann", "x")], ROW), cases)
    r = R.append_reviews(history, again).first()
    assert r.revision == 2 and r.previous_id == history.first().id
    bad = [(2, "z", "", "confirmed", "ann", ""), (3, "a", "odd", "confirmed", "a", ""), (4, "a", "pending", "confirmed", "a", ""), (5, "b", "reviewed", "maybe", "a", ""), (6, "b", "reviewed", "confirmed", "", ""), (7, "b", "reviewed", "confirmed", "a", ""), (8, "b", "reviewed", "rejected", "a", "")]
    checked = R.check_reviews(spark.createDataFrame(bad, ROW), cases)
    assert [r.state for r in checked.orderBy("line").collect()] == ["unknown_case_id", "invalid_review_status", "pending_with_decision", "explicit_valid_decision_required", "reviewer_required", "conflicting_duplicate_case", "conflicting_duplicate_case"]
    assert R.append_reviews(empty, checked).count() == 0
    s = R.stale(history, spark.createDataFrame([("a", "new")], "case_id string, digest string")).first()
    assert s.present and s.stale and not R.stale(history, cases).first().stale


REVIEW = "id string, case_id string, kind string, slot string, reviewer string, recorded_at string, queue string, dimensions string, annotation_ids array<string>"


def test_gold_metrics_and_disputes(spark):
    rows = [
        ("1", "a", "human", "reviewer_1", "x", "t0", "C", "d", None), ("2", "a", "human", "reviewer_1", "x", "t1", "A", "d", None), ("3", "a", "human", "reviewer_2", "y", "t1", "A", "d", None),
        ("4", "b", "human", "reviewer_1", "x", "t1", "A", "d", None), ("5", "b", "human", "reviewer_2", "y", "t1", "C", "d", None), ("6", "b", "adjudication", None, "z", "t2", "C", "d", ["4", "5"]),
        ("7", "c", "human", "reviewer_1", "x", "t1", "A", "d", None), ("8", "c", "human", "reviewer_2", "y", "t1", "C", "d", None), ("9", "c", "adjudication", None, "x", "t2", "C", "d", ["7", "8"]),
    ]
    reviews = spark.createDataFrame(rows, REVIEW)
    assert {(r.case_id, r.queue) for r in R.gold(reviews).collect()} == {("a", "A"), ("b", "C")}
    assert {(r.case_id, r.status) for r in R.disagreements(reviews).collect()} == {("b", "adjudicated"), ("c", "adjudicated")}
    assert R.disagreements(reviews.where("kind = 'human'")).where("status = 'pending_adjudication'").count() == 2
    p = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "B")], "case_id string, queue string")
    m = R.review_metrics(p.where("case_id <> 'c'"), p, reviews).first()
    assert (m.status, m.tp, m.fp, m.fn, m.tn, m.precision, m.recall) == ("evaluated_declared_sample", 1, 1, 0, 0, 0.5, 1.0)
    m = R.review_metrics(p, p, reviews).first()
    assert m.status == "pending_human_evaluation" and m.precision is None and m.tp is None
    files = spark.createDataFrame([("f",)], "file_id string")
    notes = spark.createDataFrame([("f", "x", "1", True, ["a", "b"]), ("f", "y", "2", True, ["b", "a"])], "file_id string, reviewer string, slot string, complete boolean, anchors array<string>")
    d = R.detection_metrics(files, spark.createDataFrame([("f", ["a", "q"])], "file_id string, anchors array<string>"), notes).first()
    assert (d.tp, d.fp, d.fn, d.precision, d.recall) == (1, 1, 1, 0.5, 0.5)
    assert R.detection_metrics(files, spark.createDataFrame([], "file_id string, anchors array<string>"), notes).first().recall is None


PATH = "struct<source:string,output:string,connected:boolean,understood:boolean,relation:string,evidence:array<string>,unknowns:array<string>,boundary:string,boundary_status:string>"
DIM = f"struct<paths:array<{PATH}>,unknowns:array<string>,evidence:array<string>,clues:array<struct<text:string,evidence:array<string>>>,source:string,output:string,connection:string,connection_reason:string,complete:boolean,processed:string,clean_basis:array<string>,boundary:string,boundary_status:string>"


def test_queues(spark):
    good = ("supported", "supported", True, True, "value", ["e"], [], None, None)
    base = dict(paths=[], unknowns=[], evidence=[], clues=[], source="unknown", output="unknown", connection="not_established", connection_reason="insufficient_evidence", complete=False, processed="partial", clean_basis=[], boundary="log_record", boundary_status="supported")
    clean = dict(complete=True, processed="success", evidence=["e"], clean_basis=["b"], output="not_found", source="not_found")
    cases = [
        ({}, "D"), ({"paths": [good]}, "A"), ({"paths": [good], "unknowns": ["u"]}, "B"), ({"paths": [good[:4] + ("type",) + good[5:]]}, "B"), ({"paths": [good[:6] + (["u"],) + good[7:]]}, "B"),
        (clean, "C"), ({**clean, "complete": False}, "D"), ({**clean, "source": "suspected"}, "C"), ({**clean, "output": "suspected"}, "B"), ({**clean, "unknowns": ["u"]}, "D"), ({**clean, "clean_basis": []}, "D"),
        ({"clues": [("x", ["e"])]}, "B"), ({"clues": [("x", [])]}, "D"), ({"clues": [("x", [])], "evidence": ["e"]}, "B"), ({**clean, "output": "unknown", "connection_reason": "target_connection_excluded"}, "C"), ({"paths": [good], "boundary_status": "unknown"}, "B"),
    ]
    df = spark.createDataFrame([(tuple({**base, **c}.values()),) for c, _ in cases], f"d {DIM}")
    assert [r[0] for r in df.select(R.queue(F.col("d"))).collect()] == [q for _, q in cases]


def test_runs_and_ledgers(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    tries = spark.createDataFrame([("a", "base", 1, "interrupted"), ("a", "dfg", 1, "complete")], "case_id string, variant string, attempt int, status string")
    assert {tuple(r) for r in R.pending_runs(cases, ("base", "dfg"), tries).collect()} == {("a", "base", 2), ("b", "base", 1), ("b", "dfg", 1)}
    res = spark.createDataFrame([("a", "base", "D"), ("a", "dfg", "A"), ("b", "base", "D")], "case_id string, variant string, queue string")
    assert {tuple(r) for r in R.migrations(res, "base", "dfg").collect()} == {("D", "A", 1), ("D", None, 1)}
    f = spark.createDataFrame([("r", "1", "ok"), ("r", "1", "failed"), ("r", "2", "ok"), ("r", "3", "skipped")], "repository string, sha string, status string")
    assert {(r.sha, r.status) for r in R.ledger(f).collect()} == {("1", "failed"), ("2", "complete"), ("3", "partial")}
    rows = spark.createDataFrame([("a", "d", "unknown"), ("b", "d", "known"), ("c", "old", "unknown")], "case_id string, digest string, v string")
    ans = spark.createDataFrame([("a", "yes", "d"), ("b", "no", "d"), ("c", "x", "new")], "case_id string, answer string, digest string")
    assert {(r.case_id, r.v) for r in R.apply_answers(rows, ans, "v").collect()} == {("a", "yes"), ("b", "known"), ("c", "unknown")}
    ctx = spark.createDataFrame([("o/r", "A" * 40, "1"), ("o/r", "a" * 40, "2"), ("bad", "a" * 40, "3"), ("o/r", "x", "4"), ("o/r", "b" * 40, "5")], "repository string, sha string, context_id string")
    done = spark.createDataFrame([("o/r", "a" * 40, "running"), ("o/r", "b" * 40, "partial")], "repository string, sha string, status string")
    assert {(r.sha[0], r.contexts, r.state) for r in R.job_queue(ctx, done).collect()} == {("a", 2, "pending"), ("b", 1, "partial")}
    assert {(r.sha[0], r.state) for r in R.job_queue(ctx, done, True).collect()} == {("a", "pending"), ("b", "pending")}
    b = R.blind(spark.createDataFrame([("a", "label", "x")], "case_id string, label string, path string"), ["case_id", "path"])
    assert b.columns == ["case_id", "path", "case_sha256"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(2, "=1+1 a@b.org", "secret", ["1.2.3.4"]), (1, None, "", [])], "id int, note string, api_key string, list array<string>")
    for _ in range(2):
        X.export_rows(df, str(tmp_path), "cases", ["id"])
    rows = [json.loads(x) for p in sorted((tmp_path / "cases.jsonl").glob("part*")) for x in p.read_text().splitlines()]
    assert rows == [{"id": 1, "note": None, "api_key": "", "list": "[]"}, {"id": 2, "note": "=1+1 <REDACTED:EMAIL>", "api_key": "<REDACTED:VALUE>", "list": '["<REDACTED:IP>"]'}]
    got = spark.read.csv(str(tmp_path / "cases.csv"), header=True, escape='"').orderBy("id").collect()
    assert got[1].note == "'=1+1 <REDACTED:EMAIL>" and sorted(p.name for p in tmp_path.iterdir()) == ["cases.csv", "cases.jsonl"]
    digest = X.write_manifest(str(tmp_path / "m.json"), {"b": 1, "a": "x@y.org"})
    assert (tmp_path / "m.json").read_text() == '{"a":"<REDACTED:EMAIL>","b":1}\n' and len(digest) == 64
    s = X.KindStore(spark, str(tmp_path / "store"))
    for n in (3, 2):
        s.replace("kind", spark.range(n))
    assert s.read("kind").count() == 2 and s.next_stages() == X.STAGES
    s.finish("ingest")
    s.finish("mine")
    assert s.next_stages()[0] == "collect" and s.status("nothing") is None and s.next_stages(resume=False) == X.STAGES
    ok = X.allowed(df, ["id", "api_key"], {"api_key": "[a-z]*"})
    assert ok.count() == 2
    with pytest.raises(Exception, match="not allowed"):
        X.allowed(df, ["note"], {"note": "x"}).collect()


def test_power(spark):
    assert E.paired_power(100, 0.0, 0.1) == pytest.approx(0.05, abs=1e-9) and E.paired_power(50, 1.0, 1.0) == 1.0
    n = E.required_pairs(0.02, 0.05, 0.8)
    assert E.paired_power(n, 0.02, 0.05) >= 0.8 > E.paired_power(n - 1, 0.02, 0.05) and E.required_pairs(1e-6, 0.05, 0.8) is None
    d = E.detectable_effect(n, 0.05, 0.8)
    assert d == pytest.approx(0.02, rel=0.01) and E.paired_power(n, d, 0.05) >= 0.8 and E.detectable_effect(2, 0.01, 0.9) is None
    with pytest.raises(ValueError):
        E.paired_power(10, 0.3, 0.2)
    p = E.power_plan(spark, (0.02, 0.05), (0.01, 0.03), 1.5)
    assert p.count() == 3 and all(r.inflated_80 >= 1.5 * r.pairs_80 for r in p.collect())
