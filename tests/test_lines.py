import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import lines as L
from plumbline.functions import patches as P


def of(spark, values, f, schema="t string"):
    rows = [(v,) if not isinstance(v, tuple) else v for v in values]
    return [r[0] for r in spark.createDataFrame(rows, schema).select(f).collect()]


def t_():
    return F.col("t")


def test_paths(spark):
    paths = ["src/a.py", "tests/a.py", "a/examples/x.js", "vendor/x.go", "scripts/x.sh", "src/a.spec.ts", "Dockerfile", "src/.hidden", "", "dist/a.py", "src\\x_test.py", "a/b.md"]
    assert of(spark, paths, L.file_scope(t_())) == ["application_or_unknown", "test", "example", "generated_or_vendor", "development_tool", "test", "application_or_unknown", "application_or_unknown", "application_or_unknown", "generated_or_vendor", "application_or_unknown", "application_or_unknown"]
    assert of(spark, paths, L.is_source_file(t_())) == [True, True, True, False, True, True, True, False, False, False, True, False]
    assert of(spark, paths, L.is_production_path(t_())) == [True, False, False, False, True, False, True, True, False, False, False, True]
    names = ["a/b.py", "build/b.py", "test_b.py", "x/Y.java", "x/YTest.java", "a.min.js", "public/a.ts", "a.tsx", "b.go"]
    want = ["python", None, None, "java", None, None, None, "javascript_typescript", None]
    assert of(spark, names, L.study_language(t_())) == want == [P.study_language(n) for n in names]
    assert of(spark, [("/home/x/repo/src/a.py",), ("b/src/a.py",), ("/o__repo/z",)], L.repository_path(t_(), F.lit("o/repo"))) == ["src/a.py", "src/a.py", "z"]


def test_code_and_quotes(spark):
    assert of(spark, ["a = 1 # x", "u = 'http://x' // y", 'print("a#b", c)', "x / y", "'open # q"], L.without_comment(t_())) == ["a = 1 ", "u = 'http://x' ", 'print("a#b", c)', "x / y", "'open # q"]
    texts = ["f(a, (b)", "f(')'", 'f("(")', "f(`)`", "a)", "f('open ("]
    assert of(spark, texts, L.paren_balance(t_())) == [1, 1, 0, 1, -1, 1] == [P.balance(t) for t in texts]


def test_log_lines(spark):
    rows = [("a.py", 'logger.info("user token", token)'), ("a.py", "# logger.info(x)"), ("a.sh", "echo $PASSWORD"), ("a.py", "echo x"), ("a.js", "console.error('request failed')"), ("a.py", "print(api_key)  # temp"), ("a.py", "x = 1"), ("a.rs", "debug!(session)")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, t string").select(L.classify_log(F.col("p"), t_())).collect()]
    assert [r.executable for r in got] == [True, False, True, False, True, True, False, True]
    assert got[0].features == ["auth_config_data", "whole_object_dump"] and got[0].concepts == ["token", "user"] and got[1].concepts == []
    assert got[4].features == ["error_diagnostic_data", "unstructured_stdio"] and got[5].features == ["auth_config_data", "unstructured_stdio", "whole_object_dump"]
    assert of(spark, ["panic(x)", "log.warning('error')", "log.warn()", "dbg!(x)", "trace()", "log.info()", "print()"], L.severity(t_())) == ["fatal", "error", "warn", "debug", "trace", "info", "neutral"]
    rows = [("a.py", "logger.info(x)"), ("a.py", "s = 'print(x)'"), ("a.py", "// print(x)"), ("a.sh", "x=$(echo y)"), ("a.sh", "echo y | grep z"), ("a.sh", "echo y"), ("a.py", "x"), ("a.py", "console.log(print(x))")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, t string").select(L.sink_family(t_(), F.col("p"))).collect()]
    assert [(r.family, r.reason) for r in got] == [
        ("structured_logger", "executable_sink"), ("print_stdio", "sink_token_inside_string"), ("noncode_match", "comment_or_blank"), ("unknown", "no_supported_sink"),
        ("shell_stdio", "piped_data_not_log"), ("shell_stdio", "executable_sink"), ("unknown", "no_supported_sink"), ("console_stdio", "executable_sink"),
    ]


def test_risks_and_labels(spark):
    got = of(spark, ["log(token)", "log('token')", "log('token %s')", "log(user)", "log('x')"], L.risk_level(t_()))
    assert [r.level for r in got] == ["high", "low", "medium", "medium", "low"] and got[0].keywords == ["token"]
    rows = [("logger.info(password)", "high"), ("logger.error('failed', e)", "low"), ("x = 5", "low"), ("console.log(JSON.stringify(request))", "low"), ("logger.warn(mask(payload))", "low"), ("e.printStackTrace(); logger.error(x)", "low")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, r string").select(L.security_patterns(t_(), F.lit("a.py"), F.col("r"))).collect()]
    assert [(r.status, r.primary) for r in got] == [("candidate", "SS-Cr"), ("no_candidate", None), ("non_log", None), ("candidate", "RM-Ms"), ("candidate", "RM-Ft"), ("candidate", "EE-St")]
    assert got[0].confidence == "high" and "IL-Lv" in got[0].patterns and of(spark, [(["SS-Cr", "RM-Ms"],)], L.review_labels(t_()), "t array<string>")[0] == ["PR-CRED", "PR-RAW-DUMP", "PR-REDACTION"]
    assert of(spark, ["cat .env", "printenv", "echo $API_TOKEN", "ls"], L.sensitive_probe(t_())) == [True, True, True, False]
    assert of(spark, ["please add some\nlogging", "print the request", "fix it"], L.logging_prompt(t_())) == [True, True, False]
    f = spark.createDataFrame([("log.info('a=%s b', x)",), ("log.info('plain')",)], "t string").select(*[c.alias(n) for n, c in L.structural_features(t_()).items()]).collect()
    assert f[0].dynamic_value and f[0].key_value_message and f[1].literal_only and not f[1].dynamic_value
    assert of(spark, ["log(`a ${x.y}` + 'lit', z)"], L.dynamic_values(t_()))[0].split() == ["x.y", "x.y", "log(", "+", ",", "z)"]


def test_references_digests_and_times(spark):
    text = "see https://github.com/a/b/issues/3, c/d#4, #5 and `#6` x#7"
    assert of(spark, [text], L.issue_references(t_(), F.lit("o/r")))[0] == ["a/b#3", "c/d#4", "o/r#5"]
    a, b = of(spark, ["@@ -1 +1 @@ f()\r\n+x\r\n\r\n", "@@ -1 +1 @@ g()\n+x\n"], L.patch_digests(t_()))
    assert a.canonical != b.canonical and a.content == b.content and of(spark, [""], L.patch_digests(t_()))[0].canonical == ""
    t = of(spark, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "2024-01-02T04:04:05+01:00", "odd", None], L.iso_time(t_()))
    assert t[:3] == [datetime.datetime(2024, 1, 2, 3, 4, 5)] * 3 and t[3:] == [None, None]
    assert of(spark, ["x ghp_" + "a" * 25 + " b@c.org 1.2.3.4"], L.redact_excerpt(t_())) == ["x [REDACTED_SECRET] [REDACTED_EMAIL] [REDACTED_IP]"]
    d = spark.createDataFrame([([".py"], [".py", ".go"], 10, 0, 1, 3, "2024-01-01", "2024-12-31")], "a array<string>, b array<string>, x int, y int, f int, g int, s string, t string")
    got = d.select(L.log_distance(*map(F.col, "abxyfg"), F.col("s").cast("timestamp"), F.col("t").cast("timestamp"))).first()[0]
    assert got == pytest.approx(1 + 2.3978952727983707 + 0.5 + 1)
    assert of(spark, [(1,)], L.spans_overlap(F.lit(0), F.lit(2), F.lit(2), F.lit(4)), "t int") == [False] and of(spark, [(1,)], L.spans_overlap(F.lit(2), F.lit(2), F.lit(2), F.lit(4)), "t int") == [True]


DIFF = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -1,3 +1,6 @@ def f
 x = 1
-old
+user = load()
+logger.info(
+    "a (%s", user,
+)
 end
diff --git a/gone.js b/gone.js
--- a/gone.js
+++ /dev/null
@@ -5 +0,0 @@
--- console.log(x)
"""


def test_diffs(spark):
    df = spark.createDataFrame([(1, DIFF), (2, None), (3, "no diff")], "k long, d string")
    rows = P.patch_lines(df, "k", "d").collect()
    assert [(r.file, r.kind, r.old, r.new) for r in rows if r.kind != "context"] == [
        ("src/a.py", "deleted", 2, None), ("src/a.py", "added", None, 2), ("src/a.py", "added", None, 3), ("src/a.py", "added", None, 4), ("src/a.py", "added", None, 5), ("gone.js", "deleted", 5, None),
    ]
    s = P.patch_statements(df, "k", "d").collect()
    assert [(r.line, r.level, r.statement_lines, r.context) for r in s] == [(3, "info", 3, "x = 1\nuser = load()")]
    p = P.diff_profiles(P.patch_lines(df, "k", "d")).collect()
    assert [(r.id, r.source_files, r.production_source_files, r.added_lines, r.deleted_lines, r.extensions) for r in p] == [(1, 2, 2, 4, 2, [".js", ".py"])]
    assert P.strict_patch(DIFF) == [("src/a.py", 1, 3, 1, 6), ("gone.js", 5, 1, 0, 0)]
    for bad, why in ((DIFF.replace("+1,6", "+1,7"), "hunk_count"), (DIFF + DIFF, "duplicate"), ("@@ -1 +1 @@\n x", "without_file"), ("--- a\n+++ b\n@@ odd", "invalid_hunk")):
        with pytest.raises(ValueError, match=why):
            P.strict_patch(bad)
    assert P.reconstruct("a\nf(1,\n2)\nb", 2, "f(1,") == {"statement": "f(1,\n2)", "context": "a", "statement_lines": 2, "complete": True, "source": "committed_version", "matches": True}
    assert P.reconstruct(None, 2, "f(")["source"] == "single_line_fallback"


def test_templates():
    assert P.log_template('logger.info("User %s has {n} items", u)') == "logger.info|user <slot> has <slot> items"
    assert P.log_template("console.log(x)") == "console.log|<dynamic>" and P.log_template('echo "Hi $NAME"') == "echo|hi <slot>"
    assert P.log_template("log.warn('a' + f('b,c') + 'd', z)") == "log.warn|a|b,c|d"


def test_predicates(spark):
    df = spark.createDataFrame([(True, "a", "x"), (False, "Robot[bot]", "x"), (False, "ann", "made with copilot"), (False, "ann", "x")], "g boolean, u string, t string")
    assert [r[0] for r in df.select(L.human_exclusion(F.col("g"), F.col("u"), F.col("t"), "(?i)copilot")).collect()] == ["canonical_pr_also_in_agent_table", "bot_login", "explicit_ai_assistance_marker", ""]
    df = spark.createDataFrame([("add", "A", True, "agent"), ("add", "B", True, "agent"), ("add", "A", False, "agent"), ("del", "A", True, "agent"), ("add", "A", True, "odd"), ("add", None, True, "agent")], "c string, g string, e boolean, a string")
    assert [r[0] for r in df.select(L.graded_evidence(*map(F.col, "cgea"), ("agent", "human"))).collect()] == [True, False, False, False, False, False]
    assert of(spark, [("x", "x", 5, 6), ("x", "y", 0, 6), ("x", "y", 5, 0), ("x", "y", 5, 50), ("x", "y", 5, 6)], L.pair_reason(F.col("a"), F.col("b"), F.col("m"), F.col("n"), 2.0), "a string, b string, m long, n long") == ["identical_final_diff", "agent_no_production_source_change", "human_no_production_source_change", "final_size_caliper", "accepted"]
