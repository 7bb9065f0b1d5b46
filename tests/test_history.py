import datetime
import itertools
import random

import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import history as H
from plumbline.operators import matching as M

SIDE = "pair string, id string, path string, symbol string, statement string, template string, behavior string"


def test_versions_match_by_unique_keys(spark):
    a = [("p", "a1", "f", "s", "x", "t1", "b1"), ("p", "a2", "f", "s", "y", "t2", "b2"), ("p", "a3", "f", "u", "z", None, "b3"), ("p", "a4", "f", "d", "k", "dd", "b"), ("p", "a5", "f", "d", "k", "dd", "b"), ("p", "a6", "g", "m", "mv", "q", "b"), ("p", "a7", "r", "s", "rr", "r", "b")]
    b = [("p", "b1", "f", "s", "x", "t1", "b1"), ("p", "b2", "f", "s", "y2", "t2", "c"), ("p", "b3", "f", "u", "z2", None, "c"), ("p", "b4", "f", "d", "k", "dd", "b"), ("p", "b6", "h", "m", "mv", "q", "b"), ("p", "b7", "r2", "s", "rr", "r", "b"), ("q", "b9", "f", "s", "x", "t1", "b1")]
    before = spark.createDataFrame(a, SIDE).withColumn("new_path", F.when(F.col("path") == "r", "r2").otherwise(F.col("path")))
    after = spark.createDataFrame(b, SIDE)
    pairs = M.match_versions(before, after)
    got = {(r.before_id, r.after_id): (r.match_status, r.change_kind) for r in pairs.collect()}
    assert got == {
        ("a1", "b1"): ("unique_semantic_statement", "unchanged"), ("a2", "b2"): ("unique_template", "modified"), ("a3", "b3"): ("unique_template", "modified"), ("a7", "b7"): ("unique_semantic_statement", "moved"),
        ("a4", None): ("ambiguous", "deleted"), ("a5", None): ("ambiguous", "deleted"), (None, "b4"): ("ambiguous", "added"), ("a6", None): ("unmatched", "deleted"), (None, "b6"): ("unmatched", "added"), (None, "b9"): ("unmatched", "added"),
    }
    moved = {(r.before_id, r.after_id): (r.match_status, r.change_kind) for r in M.match_moves(pairs, before, after).collect()}
    assert moved["a6", "b6"] == ("unique_cross_file_semantic", "moved") and ("a6", None) not in moved and len(moved) == 9
    chosen = spark.createDataFrame([("p", "a4", "b4", "ann"), ("p", "a1", "b1", "ann"), ("p", "a5", None, " ")], "pair string, before_id string, after_id string, reviewer string")
    over = {(r.before_id, r.after_id): r.match_status for r in M.override_pairs(pairs, chosen).collect()}
    assert over["a4", "b4"] == "human_selected" and over["a1", "b1"] == "unique_semantic_statement" and over["a5", None] == "ambiguous" and (None, "b4") not in over


def test_calipers_and_maximum(spark):
    day = datetime.datetime(2024, 1, 1)
    a = spark.createDataFrame([("s", 1, day, 10), ("s", 2, day + datetime.timedelta(days=1), 10), ("t", 3, day, 5)], "g string, id long, time timestamp, size long")
    b = spark.createDataFrame([("s", 11, day + datetime.timedelta(days=1), 10), ("s", 12, day + datetime.timedelta(days=9), 12), ("t", 13, day + datetime.timedelta(days=30), 5), ("s", 14, day, 100)], "g string, id long, time timestamp, size long")
    got = [(r.left_id, r.right_id) for r in M.caliper_match(a, b, "g", 10.0, 2.0).orderBy("left_id").collect()]
    assert got == [(1, 11), (2, 12)]
    rnd = random.Random(2)
    edges = {(rnd.choice("xy"), rnd.randint(0, 5), rnd.randint(0, 5)) for _ in range(25)}
    got = M.maximum_match(spark.createDataFrame(list(edges), "stratum string, left_id int, right_id int")).collect()
    for g in "xy":
        own = [(a, b) for s, a, b in edges if s == g]
        best = max(k for k in range(7) for c in itertools.combinations(own, k) if len({a for a, _ in c}) == len({b for _, b in c}) == k)
        mine = [(r.left_id, r.right_id) for r in got if r.stratum == g]
        assert len(mine) == best and set(mine) <= set(own) and len({a for a, _ in mine}) == len({b for _, b in mine}) == best


def test_ancestry(spark):
    commits = [("r", "a", []), ("r", "b", ["a"]), ("r", "c", ["a"]), ("r", "d", ["b", "c"]), ("r", "e", ["d"]), ("q", "a", ["lost"])]
    df = spark.createDataFrame(commits, "repository_id string, sha string, parents array<string>")
    closure = H.ancestors(df, df.where("sha IN ('d', 'e', 'b') OR repository_id = 'q'"))
    got = {}
    for r in closure.collect():
        got.setdefault((r.repository_id, r.sha), set()).add(r.ancestor)
    assert got == {("r", "d"): set("abcd"), ("r", "e"): set("abcde"), ("r", "b"): set("ab"), ("q", "a"): {"a", "lost"}}
    chain = spark.createDataFrame([("r", "b", 1), ("r", "d", 2), ("r", "e", 3)], "repository_id string, sha string, position int")
    found = H.first_integration(df.where("repository_id = 'r'"), chain, closure)
    assert {(r.sha, r.integration) for r in found.collect()} == {("a", "b"), ("b", "b"), ("c", "d"), ("d", "d"), ("e", "e")}


ENTITY = "struct<path:string,symbol:string,identity:string,level:string,statement:string,conditions:array<string>,assessment:string,sanitized:boolean,sources:array<struct<source:string,types:array<string>>>>"


def entity(level="info", statement="s", assessment="supported", sanitized=False, sources=(("email", ("pii",)),), path="f"):
    return (path, "s", "i", level, statement, [], assessment, sanitized, [(s, list(t)) for s, t in sources])


def test_changes(spark):
    e, none = entity(), entity(assessment="not_supported", sources=())
    two = entity(sources=(("email", ("pii",)), ("token", ("cred",))))
    rows = [
        (e, None, "deleted", "x"), (None, e, "added", "x"), (e, none, "modified", "direct"), (e, entity(assessment="not_supported", sources=(), sanitized=True), "modified", "dependency_change"), (two, e, "modified", "direct"),
        (none, entity(level="debug", assessment="not_supported", sources=()), "modified", "direct"), (e, entity(level="debug"), "modified", "direct"), (none, entity(statement="t", assessment="not_supported", sources=()), "modified", "direct"), (e, e, "moved", "direct"), (e, entity(statement="t"), "modified", "direct"),
    ]
    df = spark.createDataFrame(rows, f"b {ENTITY}, a {ENTITY}, k string, r string")
    got = [r[0] for r in df.select(H.change_labels(F.col("b"), F.col("a"), F.col("k"), F.col("r"))).collect()]
    assert [(r.labels, r.effect) for r in got] == [
        (["delete_feature"], "unknown"), (["unclear"], "unknown"), (["remove_sensitive_field"], "eliminates_observed_flow"), (["add_redaction", "fix_shared_sanitizer"], "eliminates_observed_flow"), (["remove_sensitive_field"], "partial"),
        (["level_or_condition_change"], "not_privacy_related"), (["level_or_condition_change"], "unknown"), (["message_or_format"], "not_privacy_related"), (["refactor_or_move"], "not_privacy_related"), (["message_or_format"], "unknown"),
    ]
    rel = [r[0] for r in df.select(H.introduction_relation(F.col("b"), F.col("a"))).collect()]
    assert rel[:6] == ["preexisting_unchanged", "new_sensitive_flow", "preexisting_unchanged", "preexisting_unchanged", "preexisting_unchanged", "unknown"]
    grown = spark.createDataFrame([(e, two)], f"b {ENTITY}, a {ENTITY}").select(H.introduction_relation(F.col("b"), F.col("a"))).first()[0]
    assert grown == "expanded_sensitive_flow"


def test_actors_and_bindings(spark):
    ok = [("platform_commit_binding", "agent", "x", "u", True)]
    rows = [("x", ok, None, "m", "n", None), ("y", ok, None, "m", "n", None), ("x", ok + [("human_authorship_review", "human_led", "x", "u", True)], None, None, None, None), ("x", [("guess", "agent", "x", "u", True)], None, None, None, None), ("x", [], "dependabot[bot]", None, None, None), ("x", [], None, "a\nCo-authored-by: Z", "n", None), ("x", None, None, "m", "Ann", None)]
    df = spark.createDataFrame(rows, "sha string, e array<struct<kind:string,actor_type:string,commit_sha:string,evidence_ref:string,verified:boolean>>, l string, m string, a string, t string")
    got = [r[0] for r in df.select(H.classify_actor(*[F.col(c) for c in ("sha", "e", "l", "m", "a", "t")])).collect()]
    assert [(r.actor, r.confidence) for r in got] == [("agent", "high"), ("unknown", "low"), ("mixed", "high"), ("unknown", "low"), ("automation_non_agent", "medium"), ("unknown", "low"), ("unknown", "unknown")]
    base = dict(session_repo="o/r", base="B", commit="H", tree="T", patch="P", content=None, pr_key="k", url=None, created=1, clean_base=True, dirty=False, made_commit=True, whole_chain=True, accounted=True, coverage=0.0, in_base=False, claims_exact=False)
    pr = dict(repo="o/r", base="B", head="H", tree="T2", patch="P", content=None, key="k", url=None, committed=2, candidate=True)
    cases = [{}, {"commit": "Z"}, {"commit": "Z", "patch": "Q"}, {"dirty": True}, {"dirty": None}, {"whole_chain": False}, {"created": 3}]
    out = []
    for c in cases:
        row = {f"s_{k}": v for k, v in {**base, **c}.items()} | {f"p_{k}": v for k, v in pr.items()}
        kind = lambda v: "boolean" if isinstance(v, bool) else "double" if isinstance(v, float) else "int" if isinstance(v, int) else "string"
        d = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'boolean' if k == 's_dirty' else kind(v)}" for k, v in row.items()))
        r = d.select(H.binding_grade({k: F.col(f"s_{k}") for k in base}, {k: F.col(f"p_{k}") for k in pr})).first()[0]
        out.append((r.grade, r.status, r.failures))
    assert [g for g, _, _ in out] == ["A", "B", "C", "C", "C", "C", "C"] and out[0][1] == "high_confidence_commit_or_tree"
    assert out[3][2] == ["unaccounted_pre_session_worktree_changes"] and out[4][1] == "github_app_candidate_only" and out[5][2] == ["incomplete_pr_commit_chain"] and out[6][1] == "hard_failure"


def test_walk_and_assessment(spark):
    cases = spark.createDataFrame([("c1", "f|s|i", "b0", "f|s|i", "b0", False), ("c2", "f|s|i", "b0", None, None, False), ("c3", "f|s|i", "b0", "f|s|i", "b0", True)], "case_id string, entity string, entity_behavior string, mapped string, mapped_behavior string, ambiguous boolean")
    ev = [
        ("c1", "e1", "x1", 1, False, "f|s|i", "f|s|i", "b0", "b1", "ok", ["message_or_format"], "unknown", "modified"), ("c1", "e2", "x2", 2, True, "f|s|i", "f|s|j", "b0", "b2", "ok", ["remove_sensitive_field"], "partial", "modified"),
        ("c1", "e3", "x3", 3, True, "f|s|i", "f|s|k", "b9", "b9", "ok", ["unclear"], "unknown", "modified"), ("c1", "e4", "x4", 4, True, "f|s|j", None, "b2", None, "ok", ["delete_feature"], "eliminates_observed_flow", "deleted"),
        ("c2", "e5", "x5", 5, True, "f|s|i", "f|s|i", "b0", "b0", "ok", ["unclear"], "unknown", "modified"), ("c3", "e6", "x6", 1, False, "f|s|i", "f|s|i", "b0", "b0", "ok", ["remove_sensitive_field"], "partial", "modified"),
    ]
    events = spark.createDataFrame(ev, "case_id string, event_id string, sha string, order int, post boolean, before string, after string, before_behavior string, after_behavior string, match_status string, labels array<string>, effect string, kind string")
    events = events.withColumn("before_place", F.regexp_replace("before", r"\|[^|]*$", ""))
    t = H.trace(cases, events)
    got = [(r.case_id, r.event_id, r.phase, r.effect, r.confidence) for r in t.orderBy("case_id", "position").collect()]
    assert got == [("c1", "e1", "pre_merge", "unknown", "supported"), ("c1", "e2", "post_merge", "partial", "supported"), ("c1", "e4", "post_merge", "eliminates_observed_flow", "supported"), ("c3", "e6", "pre_merge", "unknown", "possible")]
    rows = [("c1", "supported", "ok", None, False, False, True, False, "agent", "high"), ("c2", "not_supported", "ok", None, False, False, False, False, "unknown", "low"), ("c3", "supported", "ok", None, True, False, True, False, "agent", "high"), ("c4", "supported", "bad", None, False, False, True, False, "agent", "high")]
    a = H.assessed(spark.createDataFrame(rows, "case_id string, risk string, extraction_status string, censoring_reason string, ambiguous boolean, has_gap boolean, introduced boolean, lexical_only boolean, actor string, confidence string"), t)
    assert {r.case_id: (r.bucket, r.priority, r.first_mitigation, r.candidate_without_observed_fix) for r in a.collect()} == {
        "c1": ("REVIEW_READY", "P1", "x2", False), "c2": ("OUT_OF_SCOPE_OR_FALSE_POSITIVE", "P3", None, False), "c3": ("NEEDS_CONTEXT", "P2", None, True), "c4": ("BLOCKED_BY_DATA", "P2", None, True),
    }


def test_gaps_lineage_and_windows(spark):
    s = spark.createDataFrame([("r", "p", i, f"c{i}", ok) for i, ok in enumerate([True, False, False, True, True, False])], "repo string, path string, order int, sha string, readable boolean")
    assert [(r.last_observed, r.start, r.end) for r in H.gap_states(s).orderBy("start").collect()] == [("c0", "c1", "c3"), ("c4", "c5", None)]
    added = spark.createDataFrame([(1, "f", "a"), (2, "f", "b"), (3, "f", "c"), (4, "g", "a")], "id int, file string, text string")
    later = spark.createDataFrame([("f", 0, "deleted", "b", "p1"), ("f", 0, "added", "b2", "p1"), ("f", 1, "deleted", "c", "p1")], "file string, hunk int, kind string, text string, patch string")
    heads = spark.createDataFrame([("f", "a")], "file string, text string")
    assert {r.id: r.status for r in H.exact_lineage(added, later, heads).collect()} == {1: "PRESENT_AT_CURRENT_HEAD", 2: "MODIFIED_AFTER_MERGE", 3: "DELETED_AFTER_MERGE", 4: "UNRESOLVED"}
    v = spark.createDataFrame([(["a"], ["a", "b"]), (["a"], []), (["a"], ["a"]), (None, ["a"])], "b array<string>, a array<string>")
    assert [r[0] for r in v.select(H.variant_change(F.col("b"), F.col("a"))).collect()] == ["added_risk", "removed_path", "no_relevant_change", "cannot_compare"]
    t = spark.createDataFrame(pd.DataFrame({"t": [pd.Timestamp("2024-01-01"), pd.Timestamp("2024-03-01"), pd.NaT]}))
    o = [r[0] for r in t.select(H.observation(F.col("t"), F.lit("2024-03-11").cast("timestamp"), 30)).collect()]
    assert [r.days for r in o] == [30.0, 10.0, None]
    c = t.select(H.censoring_reason(F.lit(False), F.lit("x"), F.col("t"), F.lit(10.0), 30, F.lit(True), F.lit(False))).collect()
    assert [r[0] for r in c] == ["right_censored", "right_censored", "integration_time_unknown"]


def test_integration_mapping(spark):
    rows = [("m", True, False, False, None, "s"), ("m", False, True, True, "d", "s"), (None, False, False, True, "d", "s"), (None, False, False, False, None, "s")]
    df = spark.createDataFrame(rows, "m string, on boolean, direct boolean, reach boolean, anc string, sha string")
    got = [r[0] for r in df.select(H.integration_mapping(*[F.col(c) for c in ("m", "on", "direct", "reach", "anc", "sha")])).collect()]
    assert [(r.sha, r.mapping) for r in got] == [("m", "metadata_integration_sha"), ("s", "direct_target_commit"), ("d", "ancestry_to_first_parent_integration"), (None, "unknown")]


def test_earliest_integration_on_random_graphs(spark):
    rnd = random.Random(11)
    commits, want = [], {}
    for g in range(12):
        n, parents = 40, {}
        for i in range(n):
            back = list(range(max(0, i - 8), i))
            parents[i] = [str(x) for x in rnd.sample(back, min(len(back), rnd.choice([1, 1, 1, 2, 3])))] + (["lost"] if rnd.random() < 0.05 else [])
        head, line = str(n - 1), []
        while head in {str(i) for i in parents}:
            line.append(head)
            head = parents[int(head)][0] if parents[int(head)] else ""
        line.reverse()
        for pos, at in enumerate(line):
            todo, seen = [at], set()
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += parents.get(int(x), []) if x != "lost" else []
            for x in seen:
                want.setdefault((f"r{g}", x), (pos, at))
        commits.append((f"r{g}", parents, line))
    rows = [(r, str(i), p) for r, parents, _ in commits for i, p in parents.items()] + [("none", "x", None)]
    df = spark.createDataFrame(rows, "repository_id string, sha string, parents array<string>")
    chain = spark.createDataFrame([(r, sha, k) for r, _, line in commits for k, sha in enumerate(line)], "repository_id string, sha string, position long")
    got = {(r.repository_id, r.sha): (r.position, r.integration) for r in H.earliest_integration(df, chain).collect()}
    assert got == want
    assert H.earliest_integration(df, chain.limit(0)).count() == 0 and H.earliest_integration(df.limit(0), chain.limit(0)).count() == 0


def test_integration_of_a_long_line(spark, monkeypatch):
    n, writes = 100_000, []
    write = H.materialize
    monkeypatch.setattr(H, "materialize", lambda df, tag: writes.append(tag) or write(df, tag))
    df = spark.range(n).selectExpr("'r' AS repository_id", "CAST(id AS STRING) AS sha", "CASE WHEN id > 0 THEN array(CAST(id - 1 AS STRING)) ELSE CAST(array() AS ARRAY<STRING>) END AS parents")
    chain = spark.createDataFrame([("r", str(n - 1), 7), ("r", str(n // 2), 3)], "repository_id string, sha string, position long")
    got = H.earliest_integration(df, chain).groupBy("position", "integration").count().collect()
    assert {tuple(r) for r in got} == {(3, str(n // 2), n // 2 + 1), (7, str(n - 1), n - n // 2 - 1)}
    assert len(writes) < 40
