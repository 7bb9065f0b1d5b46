"""Queries that apply the library's functions as they are, over values that both engines derive from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import lines, shapes
from plumbline.functions.exact import mcnemar_p
from plumbline.functions.identity import REDACTIONS, csv_guard, keyed_digest, redact
from plumbline.functions.structured import Budget, scan_structured
from plumbline.functions.taxonomy import classify_names, snake
from plumbline.operators.cells import schema_quality
from plumbline.operators.matching import suffix_matches
from plumbline.operators.resampling import sign_flip
from plumbline.operators.review import queue
from plumbline.plans.linkage import N, over, plain
from plumbline.runtime import table
from plumbline.sources.census import column_mapping

LABELLED = "SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"


def fun05_redacted_shapes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", redact(F.col("text")).alias("r"))
    return docs.select("doc_id", F.md5("r").alias("digest"), (F.col("r") != F.col("text")).alias("changed"))


CELLS = f"SELECT p_partkey, concat(CASE p_partkey % 8 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) WHEN 5 THEN chr(13) WHEN 6 THEN concat(chr(10), '=') ELSE '' END, p_name, {N('p_size')}) AS cell FROM {{part}}"


def fun07_formula_guard(spark, sf_dir):
    return over(spark, sf_dir, CELLS).select("p_partkey", csv_guard(F.when(F.col("p_partkey") % 11 > 0, F.col("cell"))).alias("cell"))


NAMES = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('HTTP', p_brand, 'Id') WHEN 1 THEN concat(lower(p_type), 'XMLParser2Go') WHEN 2 THEN concat('_', p_name, '--URLPath_') ELSE concat(p_type, ' userID') END AS name FROM {part}"


def fun08_identifier_snake(spark, sf_dir):
    return over(spark, sf_dir, NAMES).select("p_partkey", snake(F.col("name")).alias("ident"))


FIELDS = f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN user_id + 0.5E0 WHEN 2 THEN CAST(user_id AS DOUBLE) + 1 WHEN 3 THEN -1.0E0 - user_id WHEN 4 THEN 1.0E17 WHEN 5 THEN 0.0E0 ELSE CAST(event_id AS DOUBLE) END AS uid,
  CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN concat('u', {N('user_id')}, '@corp.org') WHEN 3 THEN concat('u', {N('user_id')}, '@mail.example.com') WHEN 4 THEN '[x' WHEN 5 THEN 'xxxx' WHEN 6 THEN concat('a', chr(9), 'b') ELSE concat(event_type, ' at corp') END AS mail FROM {{events}}"""


def prj06_value_quality(spark, sf_dir):
    rows = over(spark, sf_dir, FIELDS)
    return rows.select("event_id", schema_quality(F.col("uid"), "numeric_account_id", "double")["reason"].alias("id_reason"), schema_quality(F.col("mail"), "author_email", "string")["reason"].alias("mail_reason"))


SUFFIXES = f"SELECT p_partkey, concat('src/', replace(lower(p_name), ' ', '/'), '/', {N('p_size')}, '.py') AS path FROM {{part}}"
PATTERNS = f"SELECT DISTINCT concat(CASE WHEN p_partkey % 2 = 0 THEN concat(element, '/') ELSE '' END, {N('p_size')}, '.py') AS pattern FROM (SELECT p_partkey, p_size, split_part(lower(p_name), ' ', 2) AS element FROM {{part}} WHERE p_partkey % 3 = 0 AND p_size % 4 < 2) x"


def jon31_suffix_join(spark, sf_dir):
    return suffix_matches(over(spark, sf_dir, SUFFIXES), over(spark, sf_dir, PATTERNS), "p_partkey", "path", "pattern")


def src07_column_mapping(spark, sf_dir):
    """Of each table's columns those that the census knows, and how many rows have a value there."""
    out = None
    for name in ("pages", "events", "documents", "conversations"):
        df = table(spark, sf_dir, name)
        found = {k: v for k, v in column_mapping(df.columns).items() if v}
        if found:
            counts = F.array(*[F.struct(F.lit(k).alias("canonical"), F.lit(v).alias("name"), F.count(v).alias("n")) for k, v in found.items()])
            one = df.agg(counts.alias("x")).select(F.lit(name).alias("table_name"), F.explode("x").alias("x")).select("table_name", "x.*")
            out = one if out is None else out.unionByName(one)
    return out


def txt02_literal_shapes(spark, sf_dir):
    """The literal shapes of all documents by language, rule and status."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = shapes.scan_cells(docs, "doc_id", "text", None, ["lang"]).select("lang", F.explode("matches").alias("m"))
    literal = found.where("m.rule NOT IN ('named_field_taxonomy', 'unclassified_sensitive_field')")
    return literal.groupBy("lang", F.col("m.rule").alias("rule")).agg(F.count("*").alias("n"), F.sum(F.col("m.end") - F.col("m.start")).alias("chars"))


UNITS = LABELLED + " WHERE d.n_chars IS NOT NULL"


def rev04_queue_policy(spark, sf_dir):
    """Queues of units whose dimensions follow from labels and lengths."""
    n, toxic, quality = F.col("n_chars"), F.col("toxic") == 1, F.col("quality") == 1
    some, none = F.array(F.lit("e")), F.array().cast("array<string>")
    word = lambda holds, a, b: F.when(holds, a).otherwise(b)
    path = F.struct(
        word(toxic, "supported", "unknown").alias("source"), word(n % 2 == 0, "supported", "suspected").alias("output"), (n % 3 > 0).alias("connected"), F.lit(True).alias("understood"),
        word(n % 5 == 0, "type", "flow").alias("relation"), word(n % 7 > 0, some, none).alias("evidence"), none.alias("unknowns"), F.lit("log_record").alias("boundary"), F.lit("supported").alias("boundary_status"),
    )
    d = F.struct(
        word(toxic, F.array(path), F.array().cast("array<struct<source:string,output:string,connected:boolean,understood:boolean,relation:string,evidence:array<string>,unknowns:array<string>,boundary:string,boundary_status:string>>")).alias("paths"),
        word(quality, none, some).alias("unknowns"), word(n % 7 > 0, some, none).alias("evidence"), F.array().cast("array<struct<text:string,evidence:array<string>>>").alias("clues"),
        F.lit("unknown").alias("source"), word(toxic, "suspected", "not_found").alias("output"), F.lit("established").alias("connection"), F.lit("").alias("connection_reason"),
        (n % 11 > 0).alias("complete"), F.lit("success").alias("processed"), some.alias("clean_basis"), F.lit("log_record").alias("boundary"), F.lit("supported").alias("boundary_status"),
    )
    return over(spark, sf_dir, UNITS).select("doc_id", queue(d).alias("queue"))


def fun04_keyed_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keyed_digest(F.col("text"), b"k" * 32).alias("digest"))


def sta02_exact_mcnemar(spark, sf_dir):
    """Discordant counts of two yes-or-no marks by source."""
    rows = over(spark, sf_dir, LABELLED)
    n = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    return rows.groupBy("source").agg(n(1, 0).alias("b"), n(0, 1).alias("c")).withColumn("p", F.round(mcnemar_p(F.col("b"), F.col("c")), 9))


def sta11_sign_flip(spark, sf_dir):
    """The languages' mean differences between quality and toxicity, under all patterns of signs."""
    out = sign_flip(over(spark, sf_dir, LABELLED).withColumn("v", F.col("quality") - F.col("toxic")), "lang", "v")
    return out.select(F.round("mean", 9).alias("mean"), "p")


TALK = "SELECT conv_id, turn, text, concat('src/', CASE conv_id % 6 WHEN 0 THEN 'oauth' WHEN 1 THEN 'web_handler' WHEN 2 THEN 'sql_store' WHEN 3 THEN 'docker' WHEN 4 THEN 'metrics' ELSE 'misc' END, '.py') AS path FROM {conversations}"


def fun29_module_category(spark, sf_dir):
    return over(spark, sf_dir, TALK).select("conv_id", "turn", lines.module_category(F.col("path"), F.substring("text", 1, 40)).alias("module"))


PULLS = f"""SELECT o_orderkey AS id, o_orderkey % 10 = 3 AS by_agent, CASE o_orderkey % 6 WHEN 0 THEN 'renovate[Bot]' ELSE concat('u', {N('o_custkey')}) END AS login,
  CASE o_orderkey % 5 WHEN 0 THEN 'made with copilot' ELSE 'plain words' END AS text, CASE o_orderkey % 7 WHEN 0 THEN 'Bot' ELSE 'User' END AS kind,
  CASE o_orderkey % 9 WHEN 0 THEN 'app' END AS app, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS merged,
  CASE o_orderkey % 4 WHEN 0 THEN 'delete' ELSE 'add' END AS change, CASE o_orderkey % 3 WHEN 0 THEN 'B' ELSE 'A' END AS grade, o_orderkey % 13 > 0 AS executable, CASE o_orderkey % 8 WHEN 0 THEN 'agent' WHEN 1 THEN 'mixed' ELSE 'human_led' END AS attribution FROM {{orders}}"""


def prj12_human_exclusion(spark, sf_dir):
    return over(spark, sf_dir, PULLS).select("id", lines.human_exclusion(F.col("by_agent"), F.col("login"), F.col("text"), r"(?i)\b(?:copilot|claude)\b").alias("reason"))


def prj11_human_pull(spark, sf_dir):
    return over(spark, sf_dir, PULLS).select("id", lines.human_pull(F.col("kind"), F.col("app"), F.col("merged"), F.col("by_agent")).alias("counts"))


def prj13_graded_evidence(spark, sf_dir):
    return over(spark, sf_dir, PULLS).select("id", lines.graded_evidence(F.col("change"), F.col("grade"), F.col("executable"), F.col("attribution"), ("agent", "mixed")).alias("counts"))


KEYS = ("userEmail", "api_key", "passwordCount", "misc", "request_id", "customer_age", "config_path", "stackTrace")


def fun10_name_labels(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(k) for k in KEYS]), (F.col("event_id") % len(KEYS) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    meaning = classify_names(rows, "name").select("name", F.explode("labels").alias("x"))
    return rows.join(meaning, "name").select("event_id", "x.category", "x.subtype", "x.carrier")


LINES = f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('password = "', md5({N('event_id')}), '"') WHEN 1 THEN concat('token=v', {N('user_id')}) WHEN 2 THEN concat('payload: ''', event_type, '''')
  WHEN 3 THEN 'private_data = "xxxx"' WHEN 4 THEN concat('misc = ', event_type) ELSE concat('example: a', chr(10), 'user_id: "', {N('user_id')}, '"') END AS line FROM {{events}}"""


def txt03_named_assignments(spark, sf_dir):
    found = shapes.scan_cells(over(spark, sf_dir, LINES), "event_id", "line", None).select(F.col("id").alias("event_id"), F.explode("matches").alias("m"))
    return found.select("event_id", "m.start", "m.end", "m.subtype", "m.candidate_status")


def _bodies(spark, sf_dir):
    n, u, kind = F.col("event_id"), F.col("user_id").cast("string"), F.col("event_type")
    text = (
        F.when(n % 5 == 0, F.concat(F.lit('{"user": {"email": "u'), u, F.lit('@corp.org", "age": '), u, F.lit("}}")))
        .when(n % 5 == 1, F.concat(F.lit('{"data": "{\\"password\\": \\"p'), n.cast("string"), F.lit('\\"}"}')))
        .when(n % 5 == 2, F.concat(F.lit('["'), kind, F.lit('", "1.2.3.4"]')))
        .when(n % 5 == 3, F.concat(F.lit('{"broken": '), kind))
        .otherwise(kind)
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("body"))


def txt16_structured_scan(spark, sf_dir):
    found = scan_structured(_bodies(spark, sf_dir), "event_id", "body", Budget.whole())
    return found.select(F.col("id").alias("event_id"), "status", F.explode_outer("matches").alias("m")).select("event_id", "status", F.array_join("m.node_path", "/").alias("path"), "m.subtype", "m.candidate_status")


CALLS = f"""SELECT event_id, concat(CASE event_id % 6 WHEN 0 THEN 'log(("a(" ' WHEN 1 THEN 'f(x)) // (' WHEN 2 THEN concat(chr(39), '(', chr(39), '(') WHEN 3 THEN 'g(`(`)(' WHEN 4 THEN '"open (' ELSE 'none ' END, event_type, CASE WHEN event_id % 4 = 0 THEN ')' ELSE '' END) AS line FROM {{events}}"""


def fun22_paren_balance(spark, sf_dir):
    return over(spark, sf_dir, CALLS).select("event_id", lines.paren_balance(F.col("line")).alias("balance"))


FILES = f"SELECT p_partkey, 'Own/repo' AS repo, concat(CASE p_partkey % 6 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/' WHEN 2 THEN '/tmp/repo/' WHEN 3 THEN 'x/Own__repo/' WHEN 4 THEN '//' ELSE '' END, 'src', chr(92), replace(p_name, ' ', '/'), {N('p_size')}) AS path FROM {{part}}"


def fun24_repository_path(spark, sf_dir):
    return over(spark, sf_dir, FILES).select("p_partkey", lines.repository_path(F.col("path"), F.col("repo")).alias("path"))


ASKED = f"""SELECT event_id, CASE event_id % 8 WHEN 0 THEN concat('please add some ', event_type, ' logging') WHEN 1 THEN concat('dump the ', event_type, chr(10), ' request') WHEN 2 THEN concat('show ', event_type) WHEN 3 THEN 'printenv | sort' WHEN 4 THEN concat('cat .env.', event_type)
  WHEN 5 THEN concat('echo $', upper(event_type), '_TOKEN') WHEN 6 THEN 'cat ~/.ssh/id' ELSE concat('ls ', {N('user_id')}) END AS words FROM {{events}}"""


def txt29_prompts_and_probes(spark, sf_dir):
    return over(spark, sf_dir, ASKED).select("event_id", lines.logging_prompt(F.col("words")).alias("prompt"), lines.sensitive_probe(F.col("words")).alias("probe"))


def fun06_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(lines.redact_excerpt(F.col("text"))).alias("digest"))


VALUES = f"SELECT event_id, CASE event_id % 7 WHEN 0 THEN concat(chr(34), 'xxxx', chr(34)) WHEN 1 THEN concat('your_token_', event_type) WHEN 2 THEN concat('u', {N('user_id')}, '@mail.example.org') WHEN 3 THEN concat('dummy ', event_type) WHEN 4 THEN '***' WHEN 5 THEN 'xx' ELSE event_type END AS v, CASE event_id % 3 WHEN 0 THEN ' Example: ' WHEN 1 THEN 'examples: ' ELSE '' END AS line FROM {{events}}"


def fun13_examples(spark, sf_dir):
    return over(spark, sf_dir, VALUES).select("event_id", shapes.is_example(F.col("v"), F.col("line")).alias("example"))


QUERIES = {f.__name__: f for f in (
    fun22_paren_balance, fun24_repository_path, txt29_prompts_and_probes, fun06_excerpts, fun13_examples,
    fun05_redacted_shapes, fun07_formula_guard, fun08_identifier_snake, prj06_value_quality, jon31_suffix_join, src07_column_mapping, txt02_literal_shapes, rev04_queue_policy, fun04_keyed_digest, sta02_exact_mcnemar,
    sta11_sign_flip, fun29_module_category, prj12_human_exclusion, prj11_human_pull, prj13_graded_evidence, fun10_name_labels, txt03_named_assignments, txt16_structured_scan,
)}

INNER, OUTER = ("".join(f"{b ^ pad:02x}" for b in (b"k" * 32).ljust(64, b"\0")) for pad in (0x36, 0x5C))
MODULES = "CASE " + " ".join(f"WHEN regexp_matches(w, '{words}') THEN '{name}'" for name, words in lines.MODULES) + " ELSE 'other application code' END"
#: Families of shapes with what may not stand beside them taken in, as an engine without looking back needs it.
SHAPES = (
    ("email_shape", r"(?i)(?:^|[^A-Z0-9._%+-])([A-Z0-9._%+-]{1,64}@[A-Z0-9.-]{1,253}\.[A-Z]{2,63})(?:[^A-Z0-9.-]|$)", r"[^A-Za-z0-9._%+@-]"),
    ("ipv4_shape", r"(?:^|[^\p{L}0-9._])((?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]))(?:[^\p{L}0-9._]|$)", r"[^\p{L}0-9._]"),
    ("credential_prefix_shape", r"(?:^|[^\p{L}0-9_])((?:gh[opsu]_[A-Za-z0-9]{20,256}|github_pat_[A-Za-z0-9_]{20,256}|glpat-[A-Za-z0-9_-]{20,256}|sk-[A-Za-z0-9_-]{20,256}|AKIA[A-Z0-9]{16}))(?:[^\p{L}0-9_-]|$)", r"[^\p{L}0-9_-]"),
    ("bearer_scheme_shape", r"(?i)(?:^|[^\p{L}0-9_])(Bearer[ \t]{1,8}[A-Z0-9._~+/=-]{1,900})(?:[^A-Z0-9._~+/=-]|$)", r"[^\p{L}0-9._~+/= -]"),
    ("url_userinfo_shape", r"(?i)([a-z][a-z0-9+.-]{0,31}://[^\s/:]{1,256}:[^\s/@]{1,256}@)", r"\x01"),
    ("private_key_envelope_shape", "(?s)(" + "|".join(f"-----BEGIN {k}-----.*?-----END {k}-----" for k in shapes.PEM_KINDS) + ")", r"\x01"),
)


def _redacted(out: str = "text", families: tuple = REDACTIONS) -> str:
    """redact as SQL: quotes that have to be alike are two replacements."""
    for pattern, mark in families:
        pairs = [(pattern, mark)]
        if r"\2" in pattern:
            head = pattern[: pattern.index("""(["'])""")]
            pairs = [(f"{head}{q}([^\\n]*?){q}", f"$1{q}<REDACTED:CREDENTIAL>{q}") for q in "\"'"]
        for p, m in pairs:
            out = f"regexp_replace({out}, '{p.replace(chr(39), chr(39) * 2)}', '{m.replace('$', chr(92)).replace(chr(39), chr(39) * 2)}', 'g')"
    return out


ORACLES = {name: plain(sql) for name, sql in {
    "fun05_redacted_shapes": f"SELECT doc_id, md5(r) AS digest, r <> text AS changed FROM (SELECT doc_id, text, {_redacted()} AS r FROM documents)",
    "fun07_formula_guard": rf"SELECT p_partkey, CASE WHEN regexp_matches(c, '^\s*[=+\-@]') OR regexp_matches(c, '^[\t\r]') THEN '''' || c ELSE c END AS cell FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN cell ELSE '' END AS c FROM ({CELLS}))",
    "fun08_identifier_snake": rf"SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')) AS ident FROM ({NAMES})",
    "prj06_value_quality": """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'arrow_null' WHEN 1 THEN 'nonintegral_numeric_id' WHEN 3 THEN 'nonpositive_numeric_id' WHEN 4 THEN 'floating_id_precision_unverifiable' WHEN 5 THEN 'nonpositive_numeric_id' ELSE 'explicit_numeric_account_field' END AS id_reason,
       CASE event_id % 8 WHEN 0 THEN 'arrow_null' WHEN 1 THEN 'empty_or_whitespace_text' WHEN 2 THEN 'explicit_author_email_field' WHEN 3 THEN 'example_shaped_metadata_not_validated' WHEN 4 THEN 'structured_metadata_requires_interpretation'
         WHEN 5 THEN 'example_shaped_metadata_not_validated' WHEN 6 THEN 'control_characters_in_metadata' ELSE 'email_field_shape_unresolved' END AS mail_reason FROM {events}""",
    "jon31_suffix_join": f"""
WITH m AS (SELECT p_partkey, pattern FROM ({SUFFIXES}) JOIN ({PATTERNS}) ON path = pattern OR path LIKE '%/' || pattern)
SELECT p_partkey, min(pattern) AS pattern FROM m GROUP BY 1 HAVING count(*) = 1""",
    "src07_column_mapping": """
SELECT 'pages' AS table_name, 'pr_url' AS canonical, 'url' AS name, count(url) AS n FROM {pages} UNION ALL SELECT 'events', 'user_id', 'user_id', count(user_id) FROM {events}""",
    "txt02_literal_shapes": "WITH found AS (" + " UNION ALL ".join(f"SELECT lang, '{rule}' AS rule, unnest(regexp_extract_all(regexp_replace(text, '{apart}', '\\0\\0', 'g'), '{p}', 1)) AS v FROM documents" for rule, p, apart in SHAPES) + ") SELECT lang, rule, count(*) AS n, CAST(sum(length(v)) AS BIGINT) AS chars FROM found GROUP BY ALL",
    "rev04_queue_policy": f"""
SELECT doc_id, CASE WHEN a THEN 'A' WHEN clue AND NOT clean THEN 'B' WHEN clean THEN 'C' ELSE 'D' END AS queue FROM (
  SELECT doc_id, quality = 1 AND toxic = 1 AND n_chars % 2 = 0 AND n_chars % 3 > 0 AND n_chars % 5 > 0 AND n_chars % 7 > 0 AS a, toxic = 1 AND n_chars % 7 > 0 AS clue,
         n_chars % 11 > 0 AND quality = 1 AND n_chars % 7 > 0 AND toxic <> 1 AS clean FROM ({UNITS}))""",
    "fun04_keyed_digest": f"SELECT doc_id, sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(text)))) AS digest FROM documents",
    "sta02_exact_mcnemar": f"""
WITH t AS (SELECT source, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c FROM ({LABELLED}) GROUP BY 1),
x AS (SELECT *, unnest(range(0, least(b, c) + 1)) AS k FROM t)
SELECT source, b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0)))) END, 9) AS p FROM x GROUP BY source, b, c""",
    "sta11_sign_flip": f"""
WITH m AS (SELECT row_number() OVER (ORDER BY lang) - 1 AS i, avg(CAST(quality - toxic AS DOUBLE)) AS m FROM ({LABELLED}) GROUP BY lang),
s AS (SELECT k, sum(CASE WHEN (k >> i) & 1 = 1 THEN m ELSE -m END) AS s FROM m, (SELECT unnest(range(0, CAST(power(2, (SELECT count(*) FROM m)) AS BIGINT))) AS k) GROUP BY k)
SELECT round((SELECT avg(m) FROM m), 9) AS mean, avg(CASE WHEN abs(s) >= abs((SELECT sum(m) FROM m)) - 1e-12 THEN 1.0 ELSE 0.0 END) AS p FROM s""",
    "fun29_module_category": f"SELECT conv_id, turn, {MODULES} AS module FROM (SELECT conv_id, turn, lower(path || ' ' || coalesce(substring(text, 1, 40), '')) AS w FROM ({TALK}))",
    "prj12_human_exclusion": f"SELECT id, CASE WHEN by_agent THEN 'canonical_pr_also_in_agent_table' WHEN lower(login) LIKE '%[bot]' THEN 'bot_login' WHEN text LIKE '%copilot%' THEN 'explicit_ai_assistance_marker' ELSE '' END AS reason FROM ({PULLS})",
    "prj11_human_pull": f"SELECT id, kind = 'User' AND app IS NULL AND merged IS NOT NULL AND NOT by_agent AS counts FROM ({PULLS})",
    "prj13_graded_evidence": f"SELECT id, change = 'add' AND grade = 'A' AND executable AND attribution IN ('agent', 'mixed') AS counts FROM ({PULLS})",
    "fun10_name_labels": """
SELECT event_id, category, subtype, carrier FROM {events} JOIN (VALUES (0, 'PII', 'email', false), (1, 'AUTH', 'api_key', false), (4, 'QID', 'request_identifier', false), (4, 'BIZ', 'request_body', true), (5, 'PII', 'age', false), (6, 'CFG', 'filesystem_path', false),
  (7, 'DIAG', 'stack_trace', true)) v(k, category, subtype, carrier) ON event_id % 8 = k""",
    "txt03_named_assignments": f"""
SELECT event_id, CAST(s AS INT) AS start, CAST(s + n AS INT) AS "end", subtype, status AS candidate_status FROM (
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN 12 WHEN 1 THEN 6 WHEN 2 THEN 10 WHEN 3 THEN 16 WHEN 5 THEN 21 END AS s, CASE event_id % 6 WHEN 0 THEN 32 WHEN 1 THEN 1 + length({N('user_id')}) WHEN 2 THEN length(event_type) WHEN 3 THEN 4 WHEN 5 THEN length({N('user_id')}) END AS n,
         CASE event_id % 6 WHEN 0 THEN 'password' WHEN 1 THEN 'access_token' WHEN 2 THEN 'request_body' WHEN 5 THEN 'user_identifier' END AS subtype,
         CASE event_id % 6 WHEN 0 THEN 'named_value_candidate' WHEN 1 THEN 'identifier_reference' WHEN 2 THEN 'carrier_candidate' WHEN 3 THEN 'placeholder_or_example' ELSE 'named_value_candidate' END AS status FROM {{events}} WHERE event_id % 6 <> 4)""",
    "txt16_structured_scan": """
WITH v AS (SELECT * FROM (VALUES (0, 'parsed_with_semantic_gaps', '0', 'business_object', 'carrier_candidate'), (0, 'parsed_with_semantic_gaps', '0/0', 'email', 'literal_candidate'), (0, 'parsed_with_semantic_gaps', '0/1', 'age', 'named_value_candidate'),
  (1, 'parsed_with_semantic_gaps', '0/-1/0', 'password', 'named_value_candidate'), (2, 'parsed_with_semantic_gaps', '1', 'network_identifier', 'literal_candidate'), (3, 'invalid_json', NULL, NULL, NULL), (4, 'not_applicable', NULL, NULL, NULL)) t(k, status, path, subtype, candidate_status))
SELECT event_id, status, path, subtype, candidate_status FROM {events} JOIN v ON event_id % 5 = k""",
    "fun22_paren_balance": """
SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN -1 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END + CASE WHEN event_id % 6 = 1 THEN 1 ELSE 0 END - CASE WHEN event_id % 4 = 0 AND event_id % 6 <> 4 THEN 1 ELSE 0 END AS INT) AS balance FROM {events}""",
    "fun24_repository_path": f"SELECT p_partkey, concat('src/', replace(p_name, ' ', '/'), {N('p_size')}) AS path FROM {{part}}",
    "txt29_prompts_and_probes": f"""
SELECT event_id, event_id % 8 IN (0, 1) OR words = 'show error' AS prompt, event_id % 8 IN (3, 4, 5, 6) AS probe FROM ({ASKED})""",
    "fun06_excerpts": f"SELECT doc_id, md5({_redacted('substring(text, 1, 800)', lines.EXCERPT)}) AS digest FROM documents",
    "fun13_examples": "SELECT event_id, event_id % 7 < 5 OR event_id % 3 = 0 AS example FROM {events}",
}.items()}
