import hashlib
import hmac

from pyspark.sql import functions as F

from plumbline.code import logs as G
from plumbline.operators import cells as C
from plumbline.operators.reconcile import reconcile

PY = '''
import logging
from logging import getLogger
logger = logging.getLogger(__name__)
other = logger

def login(user, request):
    email = user.email
    if request.ok:
        logger.info("in %s", email)
    else:
        other.warning("bad %s", mask(user.password))
    n = len(user.password)
    logger.debug(f"n {n}")
    log.error("x", request.body)
    try:
        pass
    except ValueError as e:
        getLogger("a").exception("failed")
    print("same")
    print("same")
'''


def test_python_log_calls():
    found, gaps = G.detect("a/b.py", PY)
    assert not gaps
    assert [(e["level"], e["certainty"], e["assessment"], [s for s, *_ in e["flows"]]) for e in found] == [
        ("info", "confirmed", "supported", ["user.email"]), ("warning", "confirmed", "not_supported", ["user.password"]), ("debug", "confirmed", "not_supported", []),
        ("error", "possible", "unknown", ["request.body"]), ("error", "confirmed", "not_supported", []), ("print", "confirmed", "not_supported", []), ("print", "confirmed", "not_supported", []),
    ]
    assert found[0]["symbol"] == "login" and found[0]["conditions"] == ["condition:request.ok"] and found[0]["dependency_lines"] == [8] and found[1]["sanitized"]
    assert found[1]["conditions"] == ["condition:not (request.ok)"] and found[4]["conditions"] == ["except:ValueError"]
    assert [e["identity"][-2:] for e in found[-2:]] == [":0", ":1"] and found[0]["template"].endswith("in <slot>")
    same = G.detect("a/b.py", PY.replace('logger.info("in %s", email)', 'logger.info(\n            "in %s",  # x\n            email)'))[0]
    assert G.behavior(same[0]) == G.behavior(found[0]) and G.behavior(found[0]) != G.behavior(found[1])
    assert G.detect("x.py", "def (")[1][0]["reason"] == "python_ast_parse_failed" and G.detect("x.rb", "")[1][0]["reason"] == "unsupported_language"
    assert G.semantic("f( 1 )  # c") == G.semantic("f(1)") and G.semantic("func {") == "func {"
    assert [u["source"] for u in G.output_units(found[0])] == ["user.email"] and G.output_units(found[2])[0]["basis"] == "literal"


def test_other_languages():
    js = 'function save(user) {\n  const token = user.apiToken;\n  console.log("saved (",\n    token);\n  // console.log(x)\n  logger.error("a" + `${user.id}`);\n}\nconsole.log("open'
    found, gaps = G.detect("x.ts", js)
    assert [(e["symbol"], e["level"], e["start_line"], e["end_line"], e["assessment"]) for e in found] == [("save", "log", 3, 4, "possible"), ("save", "error", 6, 6, "possible")]
    assert found[0]["dependencies"] == ["token=user.apiToken"] and [g["reason"] for g in gaps] == ["unbalanced_log_call"]
    assert G.hidden('f("a)b") # (\nx') == "f(xxxxx) xxx\nx"
    known = {"a/b.py", "a/c.py", "d.py", "w/y.ts", "w/z/index.ts"}
    assert G.imports_of("a/b.py", "import d\nfrom . import c\nimport os", known) == ["d.py", "a/c.py"]
    assert G.imports_of("w/x.ts", "import q from './y'\nimport r from './z'\nimport s from 'lib'", known) == ["w/y.ts", "w/z/index.ts"]
    a, b = "def f():\n    x = 1\n    log(x)\n", "def f():\n  x = 22\n  log(x)\n"
    assert G.duplicate_key(a, 2) == G.duplicate_key(b, 2) != G.duplicate_key(a.replace("log", "lag"), 2)


def test_files_and_changed_lines(spark):
    df = spark.createDataFrame([(1, "a.py", PY), (2, "b.py", "def ("), (3, "c.py", None)], "id long, path string, source string")
    found = G.detect_files(df)
    assert found.where("gap IS NULL").count() == 7 and {(r.id, r.gap) for r in found.where("gap IS NOT NULL").collect()} == {(2, "python_ast_parse_failed"), (3, "source_unavailable")}
    lines = spark.createDataFrame([(1, "a.py", 8), (1, "a.py", 12), (2, "a.py", 12)], "id long, path string, line int")
    assert {(r.start_line, r.relation) for r in G.touched(found, lines).collect()} == {(10, "dependency_change"), (12, "direct_call_change")}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("d",)], "start string")
    assert {tuple(r) for r in G.reachable(edges, starts).collect()} == {("a", x) for x in "abc"} | {("d", x) for x in "dabc"}
    assert {tuple(r) for r in G.reachable(edges, starts, 1).collect()} == {("a", "a"), ("a", "b"), ("d", "d"), ("d", "a")}


def test_scan_repair_and_summary(spark):
    many = " ".join(f"u{i}@corp.org" for i in range(8))
    rows = [(1, "plain", None), (2, "text", ""), (3, "x a@corp.org", "fine"), (4, "more", "fine"), (5, many, "fine"), (6, "end", "token='abc'"), (7, "me@example.com", "z")]
    df = spark.createDataFrame(rows, "row_number long, body string, note string")
    cells = C.text_cells(df, "t")
    assert cells.count() == 14
    parts = {k: v.collect() for k, v in C.scan(cells, b"k" * 32, 5).items()}
    assert {(c.source_row, c.column_name, c.status) for c in parts["cells"]} == {(3, "body", "scanned_with_semantic_gaps"), (5, "body", "truncated"), (6, "note", "scanned_with_semantic_gaps"), (7, "body", "scanned_with_semantic_gaps")}
    assert all(c.digest == hmac.new(b"k" * 32, dict((r[0], r[1] if c.column_name == "body" else r[2]) for r in rows)[c.source_row].encode(), hashlib.sha256).hexdigest() for c in parts["cells"])
    assert {(r.column_name, r.start, r.end) for r in parts["ranges"]} == {("body", 1, 2), ("body", 4, 4), ("body", 6, 6), ("note", 3, 5), ("note", 7, 7)}
    assert {(c.column_name, c.status): c.cells for c in parts["counts"]}["note", "null"] == 1 and len(parts["matches"]) == 8
    whole = C.scan(cells, b"k" * 32, 5)
    q = C.review_queue(whole["cells"], whole["ranges"])
    assert q.agg(F.sum("row_count")).first()[0] == 12
    s = {(r.level, r.category, r.subtype): r for r in C.type_summary(whole["matches"]).collect()}
    assert len(s) == 49 + 6 and s["subtype", "PII", "email"].occurrences == 6 and s["subtype", "PII", "email"].cells == 2 and s["category", "PII", None].cells == 2
    assert s["subtype", "PII", "medical"].occurrences == 0 and s["subtype", "AUTH", "access_token"].statuses == {"named_value_candidate": 1}
    matches, done = C.repair(whole["cells"], cells, b"k" * 32)
    assert matches.count() == 8 and [(r.state, r.complete) for r in done.collect()] == [("complete", True)]
    out = reconcile(whole["matches"].drop("id", "excluded"), matches, done.select("cell_id", "complete"), ["cell_id"], ["start", "end", "category", "subtype"], ["rule", "value_status"])
    assert out.count() == 11 and out.where("removed OR conflict").count() == 0 and out.where("origin = 'repair'").count() == 3
    changed = cells.withColumn("text", F.when(F.col("source_row") == 5, "new").otherwise(F.col("text")))
    assert C.repair(whole["cells"], changed, b"k" * 32)[1].first().state == "source_changed" and C.repair(whole["cells"], cells.where("source_row < 5"), b"k" * 32)[1].first().state == "source_missing"


def test_schema_context(spark):
    df = spark.createDataFrame([(1, 5.0, "ann", "a@corp.org"), (2, 2.0**53, " ", "odd"), (3, 1.5, "{x", "a@example.com"), (4, -1.0, "dummy", None), (5, None, "a\tb", "b@corp.org"), (6, 7.0, "bob", "c@corp.org")], "row_number long, uid double, login string, mail string")
    got = C.schema_scan(df, "t", {"uid": "numeric_account_id", "login": "account_login", "mail": "author_email"}).collect()
    by = {c: [r.reason for r in sorted(got, key=lambda r: r.start) if r.column_name == c] for c in ("uid", "login", "mail")}
    assert by["uid"] == ["explicit_numeric_account_field", "floating_id_precision_unverifiable", "nonintegral_numeric_id", "nonpositive_numeric_id", "arrow_null", "explicit_numeric_account_field"]
    assert by["login"] == ["explicit_account_login_field", "empty_or_whitespace_text", "structured_metadata_requires_interpretation", "example_shaped_metadata_not_validated", "control_characters_in_metadata", "explicit_account_login_field"]
    assert by["mail"] == ["explicit_author_email_field", "email_field_shape_unresolved", "example_shaped_metadata_not_validated", "arrow_null", "explicit_author_email_field"]
    known = spark.createDataFrame([("ann",)], "login string")
    q = {r.login: r.quality.reason for r in C.account_quality(df, "login", known, "complete").collect()}
    assert q["ann"] == "exact_frozen_account_login_match" and q["bob"] == "account_login_not_found_in_frozen_references" and q[" "] == "empty_or_whitespace_text"
    assert C.account_quality(df, "login", None, "partial").where("login = 'ann'").first().quality.reason == "account_reference_sources_unavailable_or_incomplete"
    taken, rest = C.within_budget(df, [F.col("row_number")], 4, "row_number", 6)
    assert sorted(r.row_number for r in taken.collect()) == [1, 2, 3] and rest.count() == 3
