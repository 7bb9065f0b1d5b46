import json

import pytest
from pyspark.sql import functions as F

from plumbline.sources import records as R
from plumbline.sources import sessions as S

A, B = "a" * 40, "b" * 40


def number(df):
    return df.coalesce(1).withColumn("row_number", F.monotonically_increasing_id() + 1)


def session_tables(spark):
    return {
        "repositories": number(spark.createDataFrame([("Own/Repo",), ("own/two",)], "repo_id string")),
        "sessions": number(spark.createDataFrame(
            [("s1", "Own/Repo", '["c1", "c1"]', "claude"), ("s2", "own/two", '["own/repo#c1"]', None), ("s3", None, "broken", "codex"), ("s4", "own/repo", "[1]", None), ("s5", "own/repo", None, None)],
            "session_id string, repo_id string, checkpoint_ids string, agent string")),
        "checkpoints": number(spark.createDataFrame(
            [("c1", "own/repo", '["s1", "s3", "nobody"]', f'["{A.upper()}", "short"]'), ("Own/Repo#amb", "own/repo", "[]", "[]"), ("own/repo#amb", "own/two", "[]", "[]")],
            "checkpoint_pk string, repo_id string, session_pks string, commit_shas string")),
        "commits": number(spark.createDataFrame([(A, "own/repo", "c1"), (A, "own/two", None), (B, None, "own/repo#c1"), (B, "own/two", "own/repo#c1"), (None, "own/two", "gone")], "commit_sha string, repo_id string, checkpoint_pk string")),
    }


def test_links_and_audits(spark):
    rows, refs, audit = S.load(session_tables(spark))
    got = {(r.table_name, r.field, r.status): r.rows for r in audit.collect()}
    assert got == {
        ("sessions", "checkpoint_ids", "duplicate_entries"): 1, ("sessions", "checkpoint_ids", "valid"): 1, ("sessions", "checkpoint_ids", "invalid_json"): 1,
        ("sessions", "checkpoint_ids", "invalid_array"): 1, ("sessions", "checkpoint_ids", "missing"): 1,
        ("checkpoints", "session_pks", "valid"): 3, ("checkpoints", "commit_shas", "valid"): 3,
    }
    known = S.entities(rows)
    assert {(r.entity_key, r.repository_variants) for r in known.where("table_name = 'checkpoints'").collect()} == {("own/repo#c1", 1), ("own/repo#amb", 2)}
    links = S.session_checkpoint_links(rows, refs, known)
    assert {tuple(r) for r in links.collect()} == {("s1", "own/repo#c1", "checkpoint_ids"), ("s1", "own/repo#c1", "session_pks"), ("s3", "own/repo#c1", "session_pks")}
    assert [tuple(r) for r in S.one_sided(links).collect()] == [("s3", "own/repo#c1", "checkpoint_to_session")]
    commits = S.commit_entities(rows, known)
    assert {tuple(r) for r in commits.collect()} == {(A, "own/repo"), (A, "own/two"), (B, "own/repo"), (B, "own/two")}
    found = {(r.table_name, r.relation, r.status): r.rows for r in S.relation_audit(rows, refs, known, commits).collect()}
    assert found["sessions", "checkpoint", "linked"] == 1 and found["sessions", "checkpoint", "repository_conflict"] == 1
    assert found["checkpoints", "session", "orphan"] == 1 and found["checkpoints", "session", "linked"] == 2
    assert found["checkpoints", "commit", "linked"] == 1 and found["checkpoints", "commit", "orphan"] == 1
    assert found["commits", "checkpoint", "repository_conflict"] == 1 and found["commits", "checkpoint", "orphan"] == 1
    contexts, unusable = S.commit_contexts(rows, refs, known, links)
    got = {(r.repository, r.commit_sha): r for r in contexts.collect()}
    assert got.keys() == {("own/repo", A), ("own/two", A), ("own/repo", B), ("own/two", B)}
    r = got["own/repo", A]
    assert (r.checkpoints, r.sessions, r.agents, r.statuses, r.n_rows) == (["own/repo#c1"], ["s1", "s3"], ["claude", "codex"], ["linked", "provided_reference"], 2)
    assert got["own/two", B].checkpoints == [] and got["own/two", B].statuses == ["checkpoint_repository_conflict"]
    assert sorted(map(str, (r.commit_sha for r in unusable.collect()))) == ["None", "short"]


def test_native_arrays(spark):
    df = spark.createDataFrame([(["a", "a"],), (["a", None],), (None,), ([],), (["x"],)], "v array<string>")
    values, status = S.array_status(F.col("v"), True)
    assert [(r.v, r.s) for r in df.select(values.alias("v"), status.alias("s")).collect()] == [(["a"], "duplicate_entries"), ([], "invalid_array"), ([], "missing"), ([], "valid"), (["x"], "valid")]


def test_ingest_of_every_format(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text("﻿repo,number,html_url\nO/R,3,\nO/R,9,https://github.com/O/R/pull/3\nbad name,1,\n,,\nX/Y,5,https://github.com/Z/W/pull/5\n", encoding="utf-8")
    records, gaps, schema = R.ingest(spark, str(csv))
    r = records.collect()
    assert [(x.repository, x.pr_number, x.pr_url, x.source_rows) for x in r] == [("O/R", 3, "https://github.com/O/R/pull/3", [2, 3])]
    assert {tuple(x) for x in gaps.collect()} == {(4, "invalid_repository"), (5, "missing_pr_identity"), (6, "repository_url_mismatch")}
    assert schema["rows_read"] == 5 and schema["columns_observed"] == ["html_url", "number", "repo"] and len(schema["input_sha256"]) == 64
    lines = tmp_path / "b.jsonl"
    lines.write_text('{"row": {"base.repo.full_name": "a/b", "number": "4", "commits": [{"sha": "x"}, "y", {"commit_sha": "x"}]}}\nbroken\n[1]\n\n' + json.dumps({"base": {"repo": {"full_name": "a/c"}}, "number": 1, "commit_shas": "p; q,p"}) + "\n")
    records, gaps, _ = R.ingest(spark, str(lines))
    assert {(x.repository, tuple(x.commit_shas)) for x in records.collect()} == {("a/b", ("x", "y")), ("a/c", ("p", "q"))}
    assert {tuple(x) for x in gaps.collect()} == {(2, "invalid_row"), (3, "invalid_row")}
    assert [x.repository for x in R.ingest(spark, str(lines), limit=1)[0].collect()] == ["a/b"] and R.ingest(spark, str(lines), limit=0)[0].count() == 0
    doc = tmp_path / "c.json"
    doc.write_text(json.dumps({"n": 1, "records": [{"is_synthetic": True, "local_repo_path": "/x", "repository": "a/b", "pr_number": 2, "cohort": "odd"}, {"local_repo_path": "/y", "cohort": "odd"}]}))
    got = {x.local_repo_path: x for x in R.ingest(spark, str(doc))[0].collect()}
    assert got["/x"].repository is None and got["/x"].cohort == "calibration_only" and got["/x"].fixture_repository_id.startswith("fixture-") and got["/y"].cohort == "primary_cohort"
    text = tmp_path / "d.txt"
    text.write_text("# list\n\nhttps://github.com/O/R/pull/8\n")
    assert [(x.pr_number, x.source_rows) for x in R.ingest(spark, str(text))[0].collect()] == [(8, [3])]
    assert [x.repository for x in R.ingest(spark, str(csv), {"repository": "repo"})[0].collect()] == ["O/R"]
    with pytest.raises(ValueError):
        R.read_rows(spark, "x.xml")
    with pytest.raises(ValueError):
        R.normalise(R.read_rows(spark, str(csv)), {"nothing": "x"})
