import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.sources import census as C

A, B = "a" * 40, "b" * 40


def tables(spark):
    t = {
        "repository": spark.createDataFrame([(1.0, "Own/Repo", "https://api.github.com/repos/Own/Repo"), (2.0, "own/other", None)], "id double, full_name string, url string"),
        "all_user": spark.createDataFrame([(7, "ann"), (8, "bob")], "id long, login string"),
        "all_pull_request": spark.createDataFrame(
            [(10, 3, 1, "https://github.com/Own/Repo/pull/3", "x", 7, "open", "t1"), (11, 4, 1, None, "x", 9, None, "t2"), (12, None, 99, None, "x", None, None, None)],
            "id long, number long, repo_id long, html_url string, agent string, user_id long, state string, created_at string",
        ),
        "human_pull_request": spark.createDataFrame([(10, 3, 1, "https://GITHUB.com/OWN/repo/pull/3/", None, "closed")], "id long, number long, repo_id long, html_url string, agent string, state string"),
        "pr_commits": spark.createDataFrame([(10, A.upper()), (10, A), (999, B)], "pr_id long, sha string"),
        "pr_commit_details": spark.createDataFrame([(10, A, "f.py", None), (None, A, "g.py", "[MASKED]"), (None, B, "h.py", "@@ -1 +1 @@ licence")], "pr_id long, sha string, filename string, patch string"),
        "pr_reviews": spark.createDataFrame([(50, 10, "ann"), (51, None, "zed")], "id long, pr_id long, user string"),
        "pr_review_comments": spark.createDataFrame([(60, 50), (61, 51), (62, 777)], "id long, pull_request_review_id long"),
        "issue": spark.createDataFrame([(70, "u")], "id long, html_url string"),
        "related_issue": spark.createDataFrame([(10, 70), (11, 71)], "pr_id long, issue_id long"),
        "pr_task_type": spark.createDataFrame([(11, "fix")], "id long, type string"),
    }
    return {k: df.withColumn("row_number", F.monotonically_increasing_id() + 1) for k, df in t.items()}


def test_prs_fold_and_children_link(spark):
    rows = C.source_rows({k: v.coalesce(1) for k, v in tables(spark).items()}).cache()
    assert rows.count() == 23
    aliases = C.repository_aliases(rows)
    assert {tuple(r) for r in aliases.select("alias", "repository").collect()} == {
        ("1", "own/repo"), ("https://api.github.com/repos/Own/Repo", "own/repo"), ("own/repo", "own/repo"), ("2", "own/other"), ("own/other", "own/other"),
    }
    prs = C.identified(rows, aliases)
    assert sorted(r.pr_key for r in prs.collect()) == ["own/repo#3", "own/repo#3", "own/repo#4"]
    one = {r.pr_key: r for r in C.folded(prs).collect()}
    assert one.keys() == {"own/repo#3", "own/repo#4"}
    r = one["own/repo#3"]
    assert r.ids == ["10"] and r.labels == ["human", "x"] and r.provided_label == "unknown" and one["own/repo#4"].provided_label == "x"
    assert r.fields == {"state": "open", "created_at": "t1"} and [(c.field, c.table) for c in r.conflicts] == [("state", "human_pull_request")]
    links = C.linked(rows, prs)
    found = {}
    for x in links.collect():
        found.setdefault((x.table_name, x.method), []).append(x.pr_key)
    assert {k: sorted(v) for k, v in found.items()} == {
        ("all_pull_request", "pr_identity"): ["own/repo#3", "own/repo#4"], ("human_pull_request", "pr_identity"): ["own/repo#3"],
        ("pr_commits", "pr_id"): ["own/repo#3"] * 2, ("pr_commit_details", "pr_id"): ["own/repo#3"], ("pr_commit_details", "commit_sha"): ["own/repo#3"],
        ("pr_reviews", "pr_id"): ["own/repo#3"], ("pr_review_comments", "review_id"): ["own/repo#3"],
        ("related_issue", "pr_id"): ["own/repo#3", "own/repo#4"], ("pr_task_type", "pr_id"): ["own/repo#4"],
    }
    audit = {(a.table_name, a.relation, a.status): a.rows for a in C.relationship_audit(rows, links, prs, aliases).collect()}
    assert audit["all_pull_request", "pr", "unresolved"] == 1 and audit["pr_review_comments", "review_id", "orphan"] == 1 and audit["pr_review_comments", "review_id", "linked"] == 2
    assert audit["related_issue", "issue_id", "orphan"] == 1 and audit["all_pull_request", "user", "orphan"] == 1 and audit["all_pull_request", "repository", "orphan"] == 1
    assert audit["pr_reviews", "user", "linked"] == 1 and audit["pr_reviews", "user", "orphan"] == 1 and audit["issue", "user", "missing_foreign_key"] == 1
    e = C.commit_evidence(rows, links).collect()
    assert [(x.pr_key, x.shas) for x in e] == [("own/repo#3", [A])]
    assert C.related_counts(links).where("pr_key = 'own/repo#4'").first().related == {"all_pull_request": 1, "pr_task_type": 1, "related_issue": 1}


def test_ambiguous_ids_link_nothing(spark):
    t = {
        "pull_request": spark.createDataFrame([(1, "https://github.com/a/b/pull/1", 1), (1, "https://github.com/a/b/pull/2", 2)], "id long, html_url string, row_number long"),
        "pr_comments": spark.createDataFrame([(5, 1, "https://github.com/a/b/pull/1", 1), (6, 1, None, 2), (7, None, "https://api.github.com/repos/A/b/pulls/2", 3)], "id long, pr_id long, pr_url string, row_number long"),
    }
    rows = C.source_rows(t)
    prs = C.identified(rows, C.repository_aliases(rows))
    links = C.linked(rows, prs)
    assert {(r.row_number, r.pr_key, r.method) for r in links.where("table_name = 'pr_comments'").collect()} == {(3, "a/b#2", "pr_url")}


def test_identities_and_statuses(spark):
    df = spark.createDataFrame(
        [("https://github.com/A/b/pull/12/", None, None), ("https://api.github.com/repos/A/b/pulls/7", None, None), ("https://github.com/A/b/issues/7", "x/y", "5"), ("https://github.com/A/b/pull/0", None, None), ("https://evil.com/A/b/pull/3", None, None), (None, "x/y", "-1"), (None, "no slash", "1")],
        "u string, r string, n string",
    )
    assert [r[0] for r in df.select(C.pr_identity(F.col("u"), F.col("r"), F.col("n"))).collect()] == ["a/b#12", "a/b#7", "x/y#5", None, None, None, None]
    names = [("https://github.com/A/B.git",), ("https://api.github.com/repos/A/B/",), ("a/b/c",), ("A/b",), (None,)]
    assert [r[0] for r in spark.createDataFrame(names, "v string").select(C.repo_name(F.col("v"))).collect()] == ["a/b", "a/b", None, "a/b", None]
    patches = [None, "", " \n", "[MASKED]", "<removed>.", "This is under a license", "@@ -1 +1 @@\n+license", "+x", "not available"]
    want = ["null", "empty", "empty", "masked", "masked", "masked", "present_unverified", "present_unverified", "masked"]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in patches], "p string").select(C.patch_status(F.col("p"))).collect()] == want


def test_inventory_and_mapping(spark, tmp_path):
    pq.write_table(pa.table({"number": [1, 2], "sha": ["a", None]}), tmp_path / "commits.parquet")
    (tmp_path / "prs.parquet").write_bytes(b"version https://git-lfs.github.com/spec/v1\noid sha256:00\nsize 5\n")
    (tmp_path / "odd.parquet").write_bytes(b"nothing")
    got = {r.table: r for r in C.inventory(spark, sorted(str(p) for p in tmp_path.glob("*.parquet"))).collect()}
    assert [(got[t].status, got[t].rows, got[t].role) for t in ("commits", "prs", "odd")] == [("readable", 2, "commit"), ("missing_lfs_object", None, "pr"), ("unreadable_parquet", None, "unrecognized")]
    assert [r.row_number for r in C.read_table(spark, str(tmp_path / "commits.parquet")).orderBy("row_number").collect()] == [1, 2]
    with pytest.raises(ValueError):
        C.inventory(spark, ["/a/x.parquet", "/b/x.parquet"])
    assert C.column_mapping(["number", "html_url"])["pr_number"] == "number" and C.column_mapping(["z"], {"sha": "z"})["sha"] == "z"
    with pytest.raises(ValueError):
        C.column_mapping(["a"], {"sha": "z"})
    with pytest.raises(ValueError):
        C.column_mapping(["a"], {"nothing": "a"})


def test_accounts_and_anchors(spark):
    users = spark.createDataFrame([("ann",), ("",), (None,)], "login string")
    found, coverage, status = C.account_references({"user": users})
    assert [r.login for r in found.collect()] == ["ann"] and coverage == "partial" and status["all_user"] == "missing_table"
    assert C.account_references({})[1] == "unavailable" and C.account_references({"user": users, "all_user": users})[1] == "complete"
    timeline = spark.createDataFrame([("p#1", A, "committed"), ("p#1", B, "odd"), ("p#1", None, "committed")], "pr_key string, commit_id string, event string")
    comments = spark.createDataFrame([("p#1", B.upper(), "short"), (None, A, A)], "pr_key string, commit_id string, original_commit_id string")
    known = spark.createDataFrame([("p#1", A)], "pr_key string, sha string")
    assert [(r.sha, r.kind) for r in C.anchors(timeline, comments, known, ("committed",)).collect()] == [(B, "review_comment")]


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    prs = spark.range(40).selectExpr("id AS row_number", "id", "id + 1 AS number", "concat('https://github.com/a/b/pull/', id + 1) AS html_url")
    n = 400
    # comments know their pull request by its URL alone, or by its id alone
    comments = spark.range(0, n, 1, 4).selectExpr(
        "id AS row_number", "id", "IF(id % 2 = 0, concat('https://github.com/a/b/pull/', id % 40 + 1), NULL) AS pr_url", "IF(id % 2 = 1, id % 40, NULL) AS pr_id"
    )
    rows = C.source_rows({"pull_request": prs, "pr_comments": comments})
    links = C.linked(rows, C.identified(rows, C.repository_aliases(rows)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = links.where("table_name = 'pr_comments'").select("row_number", "pr_key", "method", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.row_number, r.pr_key, r.method) for r in got) == [(i, f"a/b#{i % 40 + 1}", "pr_id" if i % 2 else "pr_url") for i in range(n)]
    for method in ("pr_url", "pr_id"):
        assert len({r.task for r in got if r.method == method}) > 1


def test_links_read_no_table_again(spark, tmp_path):
    """What leads to the links is written once, so that their plan doesn't grow with the ways from table to link."""
    for name, df in tables(spark).items():
        df.write.parquet(str(tmp_path / name))
    rows = C.source_rows({name: spark.read.parquet(str(tmp_path / name)) for name in tables(spark)})
    links = C.linked(rows, C.identified(rows, C.repository_aliases(rows)))
    assert links.count() == 12 and links.inputFiles() and not [f for f in links.inputFiles() if str(tmp_path) in f]
