import difflib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import lines as L
from plumbline.functions import similarity as S
from plumbline.operators import history as H
from plumbline.operators import resampling as R
from plumbline.sources import artefacts as A


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny"\n2,z\n')
    assert A.read_keyed_csv(spark, str(tmp_path / "a.csv"), ["k"]).count() == 2
    (tmp_path / "b.csv").write_text("k,v\n1,x\n1,y\n")
    with pytest.raises(ValueError):
        A.read_keyed_csv(spark, str(tmp_path / "b.csv"), ["k"])
    (tmp_path / "c.jsonl").write_text('{"a": 1}\nbroken\n')
    assert [(r.source_row, r.error) for r in A.trace_rows(spark, str(tmp_path / "c.jsonl")).collect()] == [(1, None), (2, "invalid_row")]
    item = [{"file_path": "f", "logging_statement": "s", "logging_statement_begin_line": 3, "changes": [{"change_type": "add", "new_content": "n", "new_content_start_line": 9}, {"change_type": "del", "old_content": "o"}, {"change_type": "x"}]}]
    df = spark.createDataFrame([("r", json.dumps(item)), ("q", "broken")], "repo string, j string")
    assert [(r.line, r.text) for r in A.flatten_changes(df, "repo", "j").collect()] == [(9, "n"), (3, "o"), (3, "s")]


def test_sessions(spark):
    def ev(n, kind, **kw):
        return json.dumps({"ordinal": n, "type": "event_msg", "payload": {"type": "item_completed", "item": {"type": kind, "status": "completed", "exit_code": 0, **kw}}})

    pr = {"command": "gh pr create", "stdout": "https://github.com/o/r/pull/3"}
    good = [ev(1, "CommandExecution", command="git status --porcelain"), ev(2, "FileChange"), ev(3, "CommandExecution", command="git commit -m x"), ev(4, "CommandExecution", command="git push"), ev(5, "CommandExecution", **pr)]
    bad = [ev(1, "FileChange"), ev(2, "CommandExecution", command="git status --porcelain"), ev(3, "CommandExecution", command="git commit", exit_code=1), ev(4, "CommandExecution", **pr), "broken"]
    rows = spark.createDataFrame([("g", x) for x in good] + [("b", x) for x in bad], "session string, raw string")
    events, sessions = A.session_events(rows)
    got = {r.session: r.missing for r in A.missing_requirements(events, sessions).collect()}
    assert got == {"g": [], "b": ["malformed_session_jsonl", "no_commit_before_pr", "no_push_before_pr", "no_prechange_clean_status_check"]}


def test_documents(spark):
    run = lambda t: {"paragraph": {"elements": [{"textRun": {"content": t}}]}}
    doc = {"body": {"content": [run("a😀"), {"table": {"rows": [{"cells": [run("b")]}]}}]}, "tabs": [{"child": [run("c")]}]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "broken"), (3, None)], "id long, j string")
    assert [(r.n, r.start, r.end, r.text) for r in A.paragraphs(df, "id", "j").collect()] == [(0, 0, 3, "a😀"), (1, 3, 4, "b"), (2, 4, 5, "c")]
    rows = [(["see u"], "u", None), (["see u"], "u", "v"), (["x"], "u", None), (["v"], None, "v")]
    got = spark.createDataFrame(rows, "t array<string>, p string, c string").select(A.selected_reference(F.col("t"), F.col("p"), F.col("c"))).collect()
    assert [r[0] for r in got] == ["u", None, None, "v"]


def test_similarity_and_modules(spark):
    df = spark.createDataFrame([("log(a)", ["log(b)", "x"], "mixed", "add", ["log(a)"]), ("q", [], "mixed", "add", ["q"]), (None, ["a"], "agent", "add", []), ("log(b)", ["log(b)"], "mixed", "remove", [])], "t string, ls array<string>, at string, ch string, co array<string>")
    near = S.nearest_line(F.col("t"), F.col("ls"))
    got = df.select(near.alias("n"), S.mixed_review(F.col("ch"), F.col("at"), F.col("t"), F.col("ls"), F.col("co"), near).alias("m")).collect()
    assert got[0].n.score == pytest.approx(difflib.SequenceMatcher(a="log(a)", b="log(b)").ratio()) and got[1].n == (0.0, "")
    assert [r.m for r in got] == ["confirmed_by_version_diff_human_modified_ai_log", "not_review_target", "not_review_target", "confirmed_by_version_diff_human_removed_ai_log"]
    assert df.select(S.sequence_ratio(F.col("t"), F.lit("log(a)"))).first()[0] == 1.0
    m = spark.createDataFrame([("src/auth.py", ""), ("x.py", "http"), ("zzz", "q")], "p string, t string").select(L.module_category(F.col("p"), F.col("t"))).collect()
    assert [r[0] for r in m] == ["auth/security", "api/http boundary", "other application code"]
    p = spark.createDataFrame([("User", None, "t", False), ("Bot", None, "t", False), ("User", "app", "t", False), ("User", None, None, False), ("User", None, "t", True)], "k string, a string, m string, g boolean")
    assert [r[0] for r in p.select(L.human_pull(*map(F.col, "kamg"))).collect()] == [True, False, False, False, False]


def test_resampling_and_origins(spark):
    few = spark.createDataFrame([(i, v) for i, v in enumerate([2.0, 3.0, -1.0, 0.5, 1.0, 1.5, 0.2, 2.2])], "c long, v double")
    assert R.sign_flip_sampled(few, "c", "v", 3000).first().p == pytest.approx(R.sign_flip(few, "c", "v").first().p, abs=0.03)
    rows = spark.createDataFrame([(True, float(i % 2)) for i in range(60)] + [(False, float(i % 4 == 0)) for i in range(60)], "s boolean, v double").coalesce(1)
    r = R.two_sample_bootstrap(rows, "s", "v", replicates=300).first()
    assert r.effect == pytest.approx(0.25) and r.lo < 0.25 < r.hi
    ev = spark.createDataFrame([("e1", "r", "a", "x"), ("e2", "r", "m", "x"), ("e3", "r", "m", "y"), ("e4", "r", "z", "q")], "event_id string, repo string, sha string, entity string")
    prs = spark.createDataFrame([("p", "r", ["a", "a"], "m")], "pr_id string, repo string, commits array<string>, merge_sha string")
    assert {(r.event_id, r.view[:5]) for r in H.origins(ev, prs).collect()} == {("e1", "pull_"), ("e3", "merge")}
    c = spark.createDataFrame([("f", "Fix leak of tokens"), ("g", "feature")], "sha string, message string")
    d = spark.createDataFrame([("f", "p", 1, True), ("f", "p", 2, False), ("f", "q", 3, True), ("g", "p", 1, True)], "sha string, path string, old int, is_log boolean")
    b = spark.createDataFrame([("f", "p", 1, "intro")], "sha string, path string, old int, introduced string")
    assert {(r.path, r.introduced) for r in H.reverse_candidates(c, d, b, ["leak", "redact"]).collect()} == {("p", "intro"), ("q", None)}
