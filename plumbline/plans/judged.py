"""Line classes, histories and reviews as queries over the driver's tables, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import lines
from plumbline.operators import history, matching, review
from plumbline.operators.matching import caliper_match, maximum_match
from plumbline.plans.custom import GREEDY
from plumbline.plans.linkage import N, over, plain
from plumbline.runtime import dealt, table

# paths and log lines out of the driver's tables, the same text for both engines
PATHS = """SELECT p_partkey AS id, concat(CASE p_partkey % 9 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/examples/' WHEN 2 THEN 'vendor/' WHEN 3 THEN 'Scripts/x/' WHEN 4 THEN 'build/' WHEN 5 THEN 'target/' ELSE 'src/' END,
  replace(lower(p_brand), '#', ''), CASE p_partkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.min.js' WHEN 3 THEN '.ts' WHEN 4 THEN '_test.py' WHEN 5 THEN '.md' ELSE '.spec.ts' END) AS path FROM {part}"""
LOGS = f"""SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN concat('logger.info("', event_type, ' token")') WHEN 1 THEN concat('console.error(''', event_type, ''', payload)') WHEN 2 THEN concat('print(', event_type, ')')
  WHEN 3 THEN concat('log.warn("', event_type, ' %s", user)') WHEN 4 THEN 'x = 1' WHEN 5 THEN concat('debug!("', event_type, '")') WHEN 6 THEN 'trace(password)' ELSE concat('fatal("', event_type, ' session ', {N('user_id')}, '")') END AS line FROM {{events}}"""


def prj08_file_scope(spark, sf_dir):
    return over(spark, sf_dir, PATHS).select("id", lines.file_scope(F.col("path")).alias("scope"))


def prj09_production_path(spark, sf_dir):
    return over(spark, sf_dir, PATHS).select("id", lines.is_production_path(F.col("path")).alias("production"))


def prj10_source_file(spark, sf_dir):
    return over(spark, sf_dir, PATHS).select("id", lines.is_source_file(F.col("path")).alias("source"))


def prj22_study_language(spark, sf_dir):
    return over(spark, sf_dir, PATHS).select("id", lines.study_language(F.col("path")).alias("language"))


def fun19_severity(spark, sf_dir):
    return over(spark, sf_dir, LOGS).select("id", lines.severity(F.col("line")).alias("severity"))


def fun30_risk_level(spark, sf_dir):
    return over(spark, sf_dir, LOGS).select("id", lines.risk_level(F.col("line")).alias("r")).select("id", "r.level", F.array_join("r.keywords", ";").alias("keywords"))


def fun20_literals_stripped(spark, sf_dir):
    return over(spark, sf_dir, LOGS).select("id", lines.without_literals(F.col("line")).alias("outside"), lines.paren_balance(F.col("line")).alias("balance"))


def txt22_structural_features(spark, sf_dir):
    df = over(spark, sf_dir, LOGS)
    found = lines.structural_features(F.col("line"))
    return df.select("id", *[found[k].alias(k) for k in ("dynamic_value", "literal_only", "long_literal_message")])


def fun14_iso_time(spark, sf_dir):
    df = over(spark, sf_dir, "SELECT o_orderkey, concat(substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10), CASE o_orderkey % 4 WHEN 0 THEN 'T06:07:08Z' WHEN 1 THEN 'T06:07:08' WHEN 2 THEN 'T06:07:08+02:00' ELSE ' odd' END) AS t FROM {orders}")
    return df.select("o_orderkey", F.unix_micros(lines.iso_time(F.col("t"))).alias("micros"))


def fun15_patch_digest(spark, sf_dir):
    return over(spark, sf_dir, "SELECT doc_id, text FROM {documents}").select("doc_id", lines.patch_digests(F.col("text"))["canonical"].alias("digest"))


def fun27_log_distance(spark, sf_dir):
    size = lambda c: F.floor(F.abs(F.col(c)))
    day = lambda c: F.timestamp_micros((F.col(c) % 50) * 86_400_000_000)

    def side(name, key, nation, balance, files):
        ext = F.array(F.lit("x"), (F.col(key) % 3).cast("string"))
        rest = (F.col(key) % 7).alias("rest")
        return table(spark, sf_dir, name).select(F.col(key).alias("id"), F.col(nation).alias("nation"), rest, ext.alias("ext"), size(balance).alias("size"), (F.col(key) % files).alias("files"), day(key).alias("time"))

    a, b = side("supplier", "s_suppkey", "s_nationkey", "s_acctbal", 5), side("customer", "c_custkey", "c_nationkey", "c_acctbal", 4)
    return matching.log_distances(a, b, ["nation", "rest"]).withColumnsRenamed({"a_id": "s_suppkey", "b_id": "c_custkey"})


def prj17_span_overlap(spark, sf_dir):
    df = over(spark, sf_dir, "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS a, CAST(l_partkey % 40 AS INT) AS b, CAST(l_suppkey % 3 AS INT) AS w FROM {lineitem}")
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    return df.select("l_orderkey", "l_linenumber", "a", "b", lines.spans_overlap(a, a + w, b, b + 2).alias("overlap")).distinct()


def prj21_pair_acceptance(spark, sf_dir):
    df = over(spark, sf_dir, "SELECT o_orderkey, o_orderkey % 5 AS a, o_custkey % 5 AS b, CAST(o_orderkey % 40 AS BIGINT) AS x, CAST(o_custkey % 40 AS BIGINT) AS y FROM {orders}")
    return df.select("o_orderkey", lines.pair_reason(F.col("a"), F.col("b"), F.col("x"), F.col("y"), 2.0).alias("reason"))


def lin06_censoring_reason(spark, sf_dir):
    df = over(spark, sf_dir, "SELECT o_orderkey, o_orderkey % 11 = 0 AS gap, CASE WHEN o_orderkey % 7 > 0 THEN 'sha' END AS sha, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS t, o_orderkey % 3 = 0 AS local FROM {orders}")
    seen = history.observation(F.col("t").cast("timestamp"), F.lit("1998-06-01").cast("timestamp"), 90)
    return df.select("o_orderkey", seen["days"].alias("days"), history.censoring_reason(F.col("gap"), F.col("sha"), seen["start"], seen["days"], 90, F.col("local"), F.lit(False)).alias("reason"))


def lin10_actor_classification(spark, sf_dir):
    item = "struct<kind:string,actor_type:string,commit_sha:string,evidence_ref:string,verified:boolean>"
    df = over(spark, sf_dir, f"SELECT event_id, {N('user_id')} AS sha, {N('event_id % 40')} AS bound, event_type, event_id % 3 = 0 AS robot FROM {{events}}")
    one = F.struct(F.lit("platform_commit_binding").alias("kind"), F.when(F.col("event_type") == "view", "agent").otherwise("human_led").alias("actor_type"), F.col("bound").alias("commit_sha"), F.lit("u").alias("evidence_ref"), (F.col("event_type") != "click").alias("verified"))
    actor = history.classify_actor(F.col("sha"), F.array(one).cast(f"array<{item}>"), F.when(F.col("robot"), "renovate[bot]"), F.lit("m"), F.lit("n"), F.lit(None).cast("string"))
    return df.select("event_id", actor["actor"].alias("actor"), actor["confidence"].alias("confidence"))


def lin14_exact_lineage(spark, sf_dir):
    added = over(spark, sf_dir, f"SELECT event_id AS id, event_type AS file, {N('user_id')} AS text FROM {{events}}")
    later = over(spark, sf_dir, f"SELECT event_type AS file, CAST(event_id % 3 AS INT) AS hunk, CASE WHEN event_id % 2 = 0 THEN 'deleted' ELSE 'added' END AS kind, {N('user_id + 1')} AS text, event_id % 50 AS patch FROM {{events}} WHERE event_id % 4 < 2")
    heads = over(spark, sf_dir, f"SELECT event_type AS file, {N('user_id + 7')} AS text FROM {{events}} WHERE event_id % 6 = 0")
    return history.exact_lineage(added, later, heads)


def lin16_variant_change(spark, sf_dir):
    df = over(spark, sf_dir, "SELECT o_orderkey, o_orderkey % 4 AS a, o_custkey % 4 AS b FROM {orders}")
    own = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(2).cast("long"), F.col(c) + 1).cast("array<string>"))
    return df.select("o_orderkey", history.variant_change(own("a"), own("b")).alias("change"))


def win09_gap_states(spark, sf_dir):
    return history.gap_states(over(spark, sf_dir, f"SELECT 'r' AS repo, {N('user_id')} AS path, event_id AS order, {N('event_id')} AS sha, event_type <> 'error' AS readable FROM {{events}}".replace(" AS order,", " AS `order`,")))


def jon21_ancestors(spark, sf_dir):
    # a forest: each supplier's parents are the suppliers of half and a third of its number
    df = table(spark, sf_dir, "supplier").where("s_suppkey > 0").select(F.lit("r").alias("repository_id"), F.col("s_suppkey").alias("sha"), F.expr("array_distinct(filter(array(s_suppkey div 2, s_suppkey div 3), x -> x > 0))").alias("parents"))
    return history.ancestors(df, df).select("sha", "ancestor")


def jon25_caliper_match(spark, sf_dir):
    a = over(spark, sf_dir, "SELECT o_orderpriority AS g, o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS time, CAST(o_totalprice AS BIGINT) AS size FROM {orders} WHERE o_orderkey % 9 = 0")
    b = over(spark, sf_dir, "SELECT o_orderpriority AS g, o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS time, CAST(o_totalprice AS BIGINT) AS size FROM {orders} WHERE o_orderkey % 9 = 1")
    found = caliper_match(a, b, "g", 7.0, 3.0)
    return found.withColumns({c: F.round(c, 9) for c in ("ratio", "score")})


def jon26_maximum_match(spark, sf_dir):
    # a supplier may have the customers of its nation whose keys lie where its own does, of suppliers by 40 and customers by 600
    pairs = over(spark, sf_dir, "SELECT s_nationkey AS stratum, s_suppkey AS left_id, c_custkey AS right_id FROM {supplier} JOIN {customer} ON s_nationkey = c_nationkey AND floor(s_suppkey / 40) = floor(c_custkey / 600)")
    return maximum_match(pairs).groupBy("stratum").agg(F.count("*").alias("n"))


REVIEWS = f"""SELECT {N('l_orderkey * 10 + l_linenumber')} AS id, {N('l_orderkey')} AS case_id, 'human' AS kind, CASE WHEN l_linenumber % 2 = 0 THEN 'reviewer_1' ELSE 'reviewer_2' END AS slot,
  {N('l_linenumber % 2')} AS reviewer, {N('l_linenumber')} AS recorded_at, CASE WHEN min(l_returnflag) = 'N' THEN 'A' ELSE 'C' END AS queue, min(l_linestatus) AS dimensions FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber"""
LAST = f"r AS (SELECT * FROM ({REVIEWS}) QUALIFY row_number() OVER (PARTITION BY case_id, slot, reviewer ORDER BY recorded_at DESC, id DESC) = 1)"


def _reviews(spark, sf_dir):
    lineitem = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    return spark.sql(REVIEWS, lineitem=lineitem).withColumn("annotation_ids", F.lit(None).cast("array<string>"))


def rev03_disagreements(spark, sf_dir):
    return review.disagreements(_reviews(spark, sf_dir)).select("case_id", F.array_join("annotation_ids", ";").alias("ids"), "status")


def sta19_gold(spark, sf_dir):
    return review.gold(_reviews(spark, sf_dir))


def rev01_review_import(spark, sf_dir):
    rows = over(spark, sf_dir, f"SELECT CAST(event_id AS INT) AS line, {N('user_id')} AS case_id, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'odd' ELSE 'reviewed' END AS status, CASE WHEN event_type = 'view' THEN 'confirmed' WHEN event_type = 'click' THEN '' ELSE 'rejected' END AS decision, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'ann' END AS reviewer, '' AS notes FROM {{events}}")
    known = over(spark, sf_dir, f"SELECT {N('c_custkey')} AS case_id, c_name AS digest FROM {{customer}} WHERE c_custkey % 2 = 0")
    return review.check_reviews(rows, known).select("line", "state")


def inc06_latest_revisions(spark, sf_dir):
    return review.latest(over(spark, sf_dir, "SELECT user_id, event_id AS revision, event_type AS decision FROM {events}"), ["user_id"], ["revision"])


def inc07_stale_reviews(spark, sf_dir):
    old = over(spark, sf_dir, f"SELECT c_custkey AS case_id, 1 AS revision, {N('c_custkey % 13')} AS digest FROM {{customer}}")
    now = over(spark, sf_dir, f"SELECT c_custkey AS case_id, {N('c_custkey % 11')} AS digest FROM {{customer}} WHERE c_custkey % 5 > 0")
    return review.stale(old, now).select("case_id", "present", "stale")


def rev07_pending_runs(spark, sf_dir):
    cases = over(spark, sf_dir, "SELECT o_orderkey AS case_id FROM {orders}")
    tries = over(spark, sf_dir, "SELECT l_orderkey AS case_id, CASE WHEN l_linenumber % 2 = 0 THEN 'baseline' ELSE 'dfg_augmented' END AS variant, CAST(l_linenumber AS INT) AS attempt, CASE WHEN l_returnflag = 'R' THEN 'complete' ELSE 'interrupted' END AS status FROM {lineitem}")
    return review.pending_runs(cases, ("baseline", "dfg_augmented"), tries)


def rev08_queue_migrations(spark, sf_dir):
    res = over(spark, sf_dir, "SELECT l_orderkey AS case_id, CASE WHEN l_linenumber % 2 = 0 THEN 'baseline' ELSE 'dfg_augmented' END AS variant, l_returnflag AS queue FROM {lineitem}")
    return review.migrations(res, "baseline", "dfg_augmented")


def rev09_ledger_coverage(spark, sf_dir):
    files = over(spark, sf_dir, "SELECT l_suppkey AS repository, l_orderkey AS sha, CASE l_linenumber % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'ok' END AS status FROM {lineitem}")
    return review.ledger(files)


def inc04_job_queue(spark, sf_dir):
    contexts = over(spark, sf_dir, f"SELECT concat('Own/r', {N('l_suppkey % 9')}, CASE WHEN l_linenumber = 3 THEN '/bad' ELSE '' END) AS repository, concat(md5({N('l_orderkey')}), '89ABCDEF') AS sha, {N('l_partkey')} AS context_id FROM {{lineitem}}")
    done = over(spark, sf_dir, f"SELECT DISTINCT concat('Own/r', {N('o_orderkey % 9')}) AS repository, concat(md5({N('o_orderkey')}), '89abcdef') AS sha, CASE o_orderkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'running' WHEN 2 THEN 'partial' ELSE 'blocked' END AS status FROM {{orders}}")
    return review.job_queue(contexts, done)


QUERIES = {f.__name__: f for f in (
    prj08_file_scope, prj09_production_path, prj10_source_file, prj22_study_language, fun19_severity, fun30_risk_level, fun20_literals_stripped, txt22_structural_features, fun14_iso_time, fun15_patch_digest, fun27_log_distance,
    prj17_span_overlap, prj21_pair_acceptance, lin06_censoring_reason, lin10_actor_classification, lin14_exact_lineage, lin16_variant_change, win09_gap_states, jon21_ancestors, jon25_caliper_match, jon26_maximum_match,
    rev03_disagreements, sta19_gold, rev01_review_import, inc06_latest_revisions, inc07_stale_reviews, rev07_pending_runs, rev08_queue_migrations, rev09_ledger_coverage, inc04_job_queue,
)}

HAS = "list_has_any(string_split(lower(path), '/'), [{}])".format
WORDS = lambda words: HAS(", ".join(f"'{w}'" for w in words))
NAME = "string_split(lower(path), '/')[-1]"
SCOPED = " ".join(f"WHEN {WORDS(w)}" + (f" OR regexp_matches({NAME}, '{p}')" if p else "") + f" THEN '{s}'" for s, w, p in lines.SCOPES)
BARE = r"""regexp_replace(line, '''(?:\\.|[^''\\])*''|"(?:\\.|[^"\\])*"', '', 'g')"""
ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
DYNAMIC = rf"""(contains({BARE}, ',') OR regexp_matches(line, '%[sdv]|\{{\w*\}}|#\{{[^}}]+\}}|\$\{{[^}}]+\}}') OR regexp_matches(lower({BARE}), '\b(request|response|headers?|cookies?|token|payload|session|user|error|err)\b\s*[.)\]}}]'))"""
ORACLES = {name: plain(sql) for name, sql in {
    "prj08_file_scope": f"SELECT id, CASE {SCOPED} ELSE 'application_or_unknown' END AS scope FROM ({PATHS})",
    "prj09_production_path": f"SELECT id, NOT {WORDS(lines.EXCLUDED_PARTS)} AND NOT regexp_matches({NAME}, '^test[_-]|_test\\.py$|\\.(test|spec)\\.|\\.snap$') AS production FROM ({PATHS})",
    "prj10_source_file": f"SELECT id, NOT {WORDS([w for w in lines.EXCLUDED_PARTS if w not in lines.TEST_PARTS])} AND regexp_matches(path, '\\.(py|java|js|ts)$') AS source FROM ({PATHS})",
    "prj22_study_language": f"""
        SELECT id, CASE WHEN path LIKE '%.py' AND NOT {WORDS(['build', 'dist', 'site-packages', 'vendor'])} AND NOT regexp_matches({NAME}, '_test\\.py$|^test_') THEN 'python'
          WHEN path LIKE '%.java' AND NOT {WORDS(['target', 'bin', 'build'])} AND path NOT LIKE '%test.java' THEN 'java'
          WHEN regexp_matches(path, '\\.(js|jsx|ts|tsx)$') AND NOT {WORDS(['node_modules', 'dist', 'public', 'vendor'])} AND NOT path LIKE '%.min.js' THEN 'javascript_typescript' END AS language FROM ({PATHS})""",
    "fun19_severity": "SELECT id, CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{s}'" for s, p in lines.SEVERITIES) + f" ELSE 'neutral' END AS severity FROM ({LOGS})",
    "fun30_risk_level": f"""
        SELECT id, CASE WHEN {ANY(f'lower({BARE})', lines.HIGH_RISK)} THEN 'high' WHEN {ANY(f'lower({BARE})', lines.MEDIUM_RISK)} THEN 'medium' WHEN {ANY('lower(line)', lines.HIGH_RISK + lines.MEDIUM_RISK)} AND {DYNAMIC} THEN 'medium' ELSE 'low' END AS level,
               array_to_string(list_filter([{', '.join(f"'{w}'" for w in lines.HIGH_RISK + lines.MEDIUM_RISK)}], lambda w: contains(lower(line), w)), ';') AS keywords FROM ({LOGS})""",
    "fun20_literals_stripped": f"SELECT id, {BARE} AS outside, CAST(length(regexp_replace({BARE}, '[^(]', '', 'g')) - length(regexp_replace({BARE}, '[^)]', '', 'g')) AS INT) AS balance FROM ({LOGS})",
    "txt22_structural_features": f"SELECT id, id % 8 IN (1, 3) AS dynamic_value, id % 8 NOT IN (1, 3) AS literal_only, false AS long_literal_message FROM ({LOGS})",
    "fun14_iso_time": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + CAST(CASE WHEN o_orderkey % 4 = 2 THEN 4 ELSE 6 END * 3600 + 428 AS BIGINT) * 1000000 END AS micros FROM {orders}",
    "fun15_patch_digest": r"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE sha256(concat(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n+$', ''), chr(10))) END AS digest FROM {documents}",
    "fun27_log_distance": """
        SELECT s_suppkey, c_custkey, 2 * CASE WHEN s_suppkey % 3 = c_custkey % 3 THEN 0.0 ELSE 2 / 3.0E0 END + abs(ln(1 + floor(abs(s_acctbal))) - ln(1 + floor(abs(c_acctbal)))) + 0.25 * abs(s_suppkey % 5 - c_custkey % 4) + abs(s_suppkey % 50 - c_custkey % 50) / 365.0E0 AS score
        FROM {supplier} JOIN {customer} ON s_nationkey = c_nationkey AND s_suppkey % 7 = c_custkey % 7""",
    "prj17_span_overlap": """
        SELECT DISTINCT l_orderkey, l_linenumber, a, b, CASE WHEN w = 0 THEN greatest(a, b) <= least(a + w, b + 2) ELSE greatest(a, b) < least(a + w, b + 2) END AS overlap
        FROM (SELECT *, CAST(l_quantity AS INT) AS a, CAST(l_partkey % 40 AS INT) AS b, CAST(l_suppkey % 3 AS INT) AS w FROM {lineitem})""",
    "prj21_pair_acceptance": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 = o_custkey % 5 THEN 'identical_final_diff' WHEN x = 0 THEN 'agent_no_production_source_change' WHEN y = 0 THEN 'human_no_production_source_change'
          WHEN (greatest(x, y) + 1) / CAST(least(x, y) + 1 AS DOUBLE) > 2 THEN 'final_size_caliper' ELSE 'accepted' END AS reason FROM (SELECT *, o_orderkey % 40 AS x, o_custkey % 40 AS y FROM {orders})""",
    "lin06_censoring_reason": """
        SELECT o_orderkey, days, CASE WHEN o_orderkey % 11 = 0 THEN 'history_incomplete' WHEN o_orderkey % 7 = 0 THEN 'not_integrated' WHEN days IS NULL THEN 'integration_time_unknown' WHEN days < 90 THEN 'right_censored' WHEN o_orderkey % 3 = 0 THEN 'remote_collection_cutoff_unverified' END AS reason
        FROM (SELECT *, CASE WHEN o_orderkey % 5 > 0 THEN greatest(0.0, least(90.0, (epoch_us(TIMESTAMP '1998-06-01') - epoch_us(o_orderdate)) / 86400e6)) END AS days FROM {orders})""",
    "lin10_actor_classification": """
        SELECT event_id, CASE WHEN ok THEN CASE WHEN event_type = 'view' THEN 'agent' ELSE 'human_led' END WHEN event_id % 3 = 0 THEN 'automation_non_agent' ELSE 'unknown' END AS actor, CASE WHEN ok THEN 'high' WHEN event_id % 3 = 0 THEN 'medium' ELSE 'low' END AS confidence
        FROM (SELECT *, user_id = event_id % 40 AND event_type <> 'click' AS ok FROM {events})""",
    "lin14_exact_lineage": """
        WITH d AS (SELECT DISTINCT event_type AS f, user_id + 1 AS t, event_id % 50 AS p, event_id % 3 AS h FROM {events} WHERE event_id % 4 = 0), a AS (SELECT DISTINCT event_type AS f, event_id % 50 AS p, event_id % 3 AS h FROM {events} WHERE event_id % 4 = 1),
        l AS (SELECT f, t, bool_or(a.p IS NOT NULL) AS changed FROM d LEFT JOIN a USING (f, p, h) GROUP BY f, t), h AS (SELECT DISTINCT event_type AS f, user_id + 7 AS t FROM {events} WHERE event_id % 6 = 0)
        SELECT event_id AS id, CASE WHEN h.t IS NOT NULL THEN 'PRESENT_AT_CURRENT_HEAD' WHEN l.changed THEN 'MODIFIED_AFTER_MERGE' WHEN l.t IS NOT NULL THEN 'DELETED_AFTER_MERGE' ELSE 'UNRESOLVED' END AS status
        FROM {events} e LEFT JOIN h ON e.event_type = h.f AND e.user_id = h.t LEFT JOIN l ON e.event_type = l.f AND e.user_id = l.t""",
    "lin16_variant_change": "SELECT o_orderkey, CASE WHEN a = 0 OR b = 0 THEN 'cannot_compare' WHEN b > a THEN 'added_risk' WHEN a > b THEN 'removed_path' ELSE 'no_relevant_change' END AS change FROM (SELECT *, o_orderkey % 4 AS a, o_custkey % 4 AS b FROM {orders})",
    "win09_gap_states": f"""
        WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS ok, lag(event_type <> 'error') OVER w AS was, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
                     min(CASE WHEN event_type <> 'error' THEN event_id END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM {{events}} WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
        SELECT 'r' AS repo, {N('user_id')} AS path, {N('seen')} AS last_observed, {N('event_id')} AS start, {N('next')} AS "end" FROM e WHERE NOT ok AND coalesce(was, true)""",
    "jon21_ancestors": """
        WITH RECURSIVE a AS (SELECT s_suppkey AS sha, s_suppkey AS ancestor FROM {supplier} WHERE s_suppkey > 0 UNION SELECT sha, unnest([ancestor // 2, ancestor // 3]) FROM a WHERE ancestor > 1)
        SELECT DISTINCT sha, ancestor FROM a WHERE ancestor > 0""",
    "jon25_caliper_match": f"""
WITH RECURSIVE o AS (SELECT o_orderpriority AS g, o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS t, epoch_us(CAST(o_orderdate AS TIMESTAMP)) / 86400e6 AS d, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders),
met AS (
  SELECT a.g AS stratum, a.id AS left_id, b.id AS right_id, abs(a.d - b.d) AS days, (greatest(a.size, b.size) + 1) / CAST(least(a.size, b.size) + 1 AS DOUBLE) AS ratio, a.t AS t,
         abs(ln(1.0 + a.size) - ln(1.0 + b.size)) + abs(a.d - b.d) / 365 AS score
  FROM o a JOIN o b ON a.g = b.g AND a.id % 9 = 0 AND b.id % 9 = 1 AND abs(a.d - b.d) <= 7),
p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY t, left_id, score, days, ratio, right_id) AS nr FROM met WHERE ratio <= 3),
{GREEDY}
SELECT stratum, left_id, right_id, days, round(ratio, 9) AS ratio, round(score, 9) AS score FROM go JOIN p USING (nr) WHERE taken""",
    "jon26_maximum_match": """
SELECT stratum, CAST(sum(least(s, c)) AS BIGINT) AS n FROM (
  SELECT s_nationkey AS stratum, s_suppkey // 40 AS b, count(DISTINCT s_suppkey) AS s, count(DISTINCT c_custkey) AS c
  FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey // 40 = c_custkey // 600 GROUP BY 1, 2) GROUP BY 1""",
    "rev03_disagreements": f"""
        WITH {LAST} SELECT case_id, string_agg(id, ';' ORDER BY id) AS ids, 'pending_adjudication' AS status FROM r GROUP BY case_id HAVING count(DISTINCT queue || dimensions) > 1""",
    "sta19_gold": f"WITH {LAST} SELECT case_id, min(queue) AS queue FROM r GROUP BY case_id HAVING count(DISTINCT reviewer) = 2 AND count(DISTINCT slot) = 2 AND count(DISTINCT queue || dimensions) = 1",
    "rev01_review_import": """
        WITH c AS (SELECT event_id, user_id, event_type = 'view' AS yes, CASE WHEN user_id % 2 = 1 OR user_id >= (SELECT count(*) FROM {customer}) THEN 'unknown_case_id' WHEN event_id % 5 = 1 THEN 'invalid_review_status'
                     WHEN event_id % 5 = 0 AND event_type = 'click' THEN 'pending' WHEN event_type = 'click' THEN 'explicit_valid_decision_required' WHEN event_id % 5 = 0 THEN 'pending_with_decision' WHEN event_id % 7 = 0 THEN 'reviewer_required' END AS s FROM {events}),
        g AS (SELECT user_id AS u, count(DISTINCT yes) AS k, min(event_id) AS first FROM c WHERE s IS NULL GROUP BY 1)
        SELECT CAST(event_id AS INT) AS line, coalesce(s, CASE WHEN k > 1 THEN 'conflicting_duplicate_case' WHEN event_id > first THEN 'duplicate' ELSE 'accepted' END) AS state FROM c LEFT JOIN g ON user_id = u""",
    "inc06_latest_revisions": "SELECT user_id, max(event_id) AS revision, arg_max(event_type, event_id) AS decision FROM {events} GROUP BY 1",
    "inc07_stale_reviews": "SELECT c_custkey AS case_id, c_custkey % 5 > 0 AS present, NOT (c_custkey % 5 > 0 AND c_custkey % 11 = c_custkey % 13) AS stale FROM {customer}",
    "rev07_pending_runs": """
        WITH t AS (SELECT l_orderkey AS k, l_linenumber % 2 AS v, max(l_linenumber) AS a, bool_or(l_returnflag = 'R') AS d FROM {lineitem} GROUP BY 1, 2)
        SELECT o_orderkey AS case_id, n AS variant, CAST(coalesce(a + 1, 1) AS INT) AS attempt FROM (SELECT DISTINCT o_orderkey FROM {orders}), (VALUES (0, 'baseline'), (1, 'dfg_augmented')) x(i, n) LEFT JOIN t ON o_orderkey = k AND i = v WHERE NOT coalesce(d, false)""",
    "rev08_queue_migrations": """
        SELECT f AS from_queue, t AS to_queue, count(*) AS n FROM (SELECT max(l_returnflag) FILTER (l_linenumber % 2 = 0) AS f, max(l_returnflag) FILTER (l_linenumber % 2 = 1) AS t FROM {lineitem} GROUP BY l_orderkey) GROUP BY ALL""",
    "rev09_ledger_coverage": """
        SELECT l_suppkey AS repository, l_orderkey AS sha, CASE WHEN bool_or(l_linenumber % 5 = 0) THEN 'failed' WHEN bool_or(l_linenumber % 5 = 1) THEN 'partial' ELSE 'complete' END AS status, count(*) AS files FROM {lineitem} GROUP BY 1, 2""",
    "inc04_job_queue": f"""
        SELECT j.*, CASE WHEN o.s IN ('complete', 'blocked', 'partial') THEN o.s ELSE 'pending' END AS state
        FROM (SELECT concat('Own/r', {N('l_suppkey % 9')}) AS repository, concat(md5({N('l_orderkey')}), '89abcdef') AS sha, count(DISTINCT l_partkey) AS contexts FROM {{lineitem}} WHERE l_linenumber <> 3 GROUP BY 1, 2) j
        LEFT JOIN (SELECT DISTINCT concat('Own/r', {N('o_orderkey % 9')}) AS repository, concat(md5({N('o_orderkey')}), '89abcdef') AS sha, CASE o_orderkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'running' WHEN 2 THEN 'partial' ELSE 'blocked' END AS s FROM {{orders}}) o USING (repository, sha)""",
}.items()}
