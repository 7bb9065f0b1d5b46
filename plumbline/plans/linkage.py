"""Census, linkage and ordered statistics as queries over the driver's tables, dressed as the tables that they link.

The dress is one SQL text that both engines read; the query runs the library's operators on it, the oracle says the
same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import statistics as stats
from plumbline.operators.ranking import global_rank, global_running
from plumbline.plans.relational import ORACLES as STATED
from plumbline.plans.relational import TABLES
from plumbline.runtime import table
from plumbline.sources import census, sessions


def over(spark, sf_dir: str, sql: str):
    """sql over the tables that it names in braces."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})


def plain(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql


N = "CAST({} AS VARCHAR(20))".format
REPO_OF = f"concat('Org/R', {N('o_orderkey % 30')})"
PRS = f"""SELECT o_orderkey AS row_number, o_orderkey AS id, o_custkey + 1 AS number, o_orderkey % 30 AS repo_id, o_orderpriority AS agent, o_orderstatus AS state,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN concat('https://api.github.com/repos/', {REPO_OF}, '/pulls/', {N('o_custkey + 1')})
       ELSE concat('https://GitHub.com/', {REPO_OF}, '/pull/', {N('o_custkey + 1')}, '/') END AS html_url FROM {{orders}}"""
REPOSITORIES = f"SELECT n_nationkey AS row_number, n_nationkey AS id, concat('Org/R', {N('n_nationkey')}) AS full_name FROM {{nation}}"
SHA = f"concat(md5({N('l_suppkey * 7 + l_orderkey')}), '01234567')"
COMMITS = f"SELECT l_orderkey * 10 + l_linenumber AS row_number, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_orderkey END AS pr_id, {SHA} AS sha FROM {{lineitem}} WHERE l_linenumber <= 2"
FILES = f"""SELECT l_orderkey * 10 + l_linenumber AS row_number, {SHA} AS sha, CASE WHEN l_partkey % 3 = 0 THEN l_orderkey END AS pr_id,
  CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_partkey % 4 = 1 THEN '[MASKED]' WHEN l_partkey % 4 = 2 THEN 'under a licence' ELSE '@@ -1 +1 @@' END AS patch FROM {{lineitem}} WHERE l_linenumber = 2"""
REVIEWS = "SELECT l_orderkey AS row_number, l_orderkey * 100 AS id, l_orderkey AS pr_id FROM {lineitem} WHERE l_linenumber = 1"
COMMENTS = "SELECT event_id AS row_number, event_id AS id, user_id * 100 AS pull_request_review_id FROM {events}"
CENSUS = {"pull_request": PRS, "repository": REPOSITORIES, "pr_commits": COMMITS, "pr_commit_details": FILES, "pr_reviews": REVIEWS, "pr_review_comments": COMMENTS}
KEYED = f"""prs AS ({PRS}), keyed AS (SELECT *, CASE WHEN html_url IS NULL AND repo_id >= 25 THEN NULL ELSE concat('org/r', {N('repo_id')}, '#', {N('number')}) END AS pr_key FROM prs),
commits AS ({COMMITS}), files AS ({FILES}), reviews AS ({REVIEWS}), comments AS ({COMMENTS}),
known AS (SELECT id, pr_key FROM keyed WHERE pr_key IS NOT NULL),
c AS (SELECT s.*, k.pr_key FROM commits s JOIN known k ON s.pr_id = k.id), r AS (SELECT s.*, k.pr_key FROM reviews s JOIN known k ON s.pr_id = k.id),
by_sha AS (SELECT sha, min(pr_key) AS pr_key FROM c GROUP BY sha HAVING count(DISTINCT pr_key) = 1),
links AS (
  SELECT 'pull_request' AS table_name, row_number, pr_key, 'pr_identity' AS method FROM keyed WHERE pr_key IS NOT NULL
  UNION ALL SELECT 'pr_commits', row_number, pr_key, 'pr_id' FROM c UNION ALL SELECT 'pr_reviews', row_number, pr_key, 'pr_id' FROM r
  UNION ALL SELECT 'pr_commit_details', f.row_number, k.pr_key, 'pr_id' FROM files f JOIN known k ON f.pr_id = k.id
  UNION ALL SELECT 'pr_commit_details', f.row_number, b.pr_key, 'commit_sha' FROM files f JOIN by_sha b ON f.sha = b.sha WHERE f.pr_id IS NULL
  UNION ALL SELECT 'pr_review_comments', m.row_number, r.pr_key, 'review_id' FROM comments m JOIN (SELECT DISTINCT id, pr_key FROM r) r ON m.pull_request_review_id = r.id)"""


def _census(spark, sf_dir):
    rows = census.source_rows({name: over(spark, sf_dir, sql) for name, sql in CENSUS.items()})
    aliases = census.repository_aliases(rows)
    return rows, aliases, census.identified(rows, aliases)


def _linked(spark, sf_dir):
    rows, _, prs = _census(spark, sf_dir)
    return census.linked(rows, prs)


def prj02_url_identity(spark, sf_dir):
    df = over(spark, sf_dir, PRS)
    return df.select("id", census.pr_identity(F.col("html_url"), census.repo_name(F.concat(F.lit("https://github.com/Org/R"), F.col("repo_id").cast("string"), F.lit(".git"))), F.col("number")).alias("pr_key"))


def prj03_repo_normalization(spark, sf_dir):
    return over(spark, sf_dir, "SELECT page_id, url FROM {pages}").select("page_id", census.repo_name(F.regexp_replace("url", "^[a-z]+://[^/]+/", "https://github.com/")).alias("repository"))


def prj04_patch_status(spark, sf_dir):
    return over(spark, sf_dir, FILES).groupBy(census.patch_status(F.col("patch")).alias("status")).agg(F.count("*").alias("n"))


def src08_source_rows(spark, sf_dir):
    rows = _census(spark, sf_dir)[0]
    return rows.groupBy("table_name", "role").agg(F.count("*").alias("n"), F.count("entity_id").alias("n_ids"), F.count("sha").alias("n_shas"), F.count("pr_key").alias("n_keys"), F.sum(F.col("row_number")).alias("row_numbers"))


def jon03_unique_alias(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.floor("c_acctbal").alias("alias"), F.col("c_custkey").alias("target"))
    return census.unique_targets(c, "alias", "target")


def jon05_link_through_review(spark, sf_dir):
    return _linked(spark, sf_dir).where("method = 'review_id'")


def jon06_link_through_commit(spark, sf_dir):
    return _linked(spark, sf_dir).where("method = 'commit_sha'")


def agg07_metadata_conflicts(spark, sf_dir):
    _, _, prs = _census(spark, sf_dir)
    return census.folded(prs).select("pr_key", F.explode("conflicts").alias("c")).select("pr_key", "c.field", "c.table", "c.row")


def agg14_related_counts(spark, sf_dir):
    return census.related_counts(_linked(spark, sf_dir)).select("pr_key", F.explode("related").alias("table_name", "n"))


def jon08_census_audit(spark, sf_dir):
    rows, aliases, prs = _census(spark, sf_dir)
    return census.relationship_audit(rows, census.linked(rows, prs), prs, aliases).where("relation IN ('pr', 'review_id', 'repository')")


SESSIONS = f"""SELECT c_custkey AS row_number, concat('s', {N('c_custkey')}) AS session_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('Org/R', {N('c_nationkey')}) END AS repo_id, c_mktsegment AS agent,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN 'broken' ELSE concat('["org/r', {N('c_nationkey')}, '#c', {N('c_custkey % 60')}, '"]') END AS checkpoint_ids FROM {{customer}}"""
CHECKPOINTS = f"""SELECT s_suppkey AS row_number, concat('c', {N('s_suppkey')}) AS checkpoint_pk, concat('org/r', {N('s_nationkey')}) AS repo_id,
  concat('["s', {N('s_suppkey')}, '", "s', {N('s_suppkey + 60')}, '", "s', {N('s_suppkey')}, '"]') AS session_pks FROM {{supplier}}"""
LINKED = f"""s AS ({SESSIONS}), k AS ({CHECKPOINTS}),
a AS (SELECT s.session_id, concat('org/r', {N('c_nationkey')}, '#c', {N('c_custkey % 60')}) AS pk, 'checkpoint_ids' AS method FROM s JOIN {{customer}} c ON s.row_number = c.c_custkey WHERE c_custkey % 5 >= 2),
kk AS (SELECT concat(repo_id, '#', checkpoint_pk) AS pk, repo_id, row_number AS n FROM k),
b AS (SELECT pk, repo_id, n AS m FROM kk UNION ALL SELECT pk, repo_id, n + 60 FROM kk),
links AS (SELECT a.session_id, a.pk AS checkpoint_pk, a.method FROM a JOIN kk ON a.pk = kk.pk JOIN s ON s.session_id = a.session_id WHERE s.repo_id IS NULL OR lower(s.repo_id) = kk.repo_id
  UNION SELECT s.session_id, b.pk, 'session_pks' FROM b JOIN s ON s.row_number = b.m WHERE s.repo_id IS NULL OR lower(s.repo_id) = b.repo_id)"""


def _sessions(spark, sf_dir):
    rows, refs, audit = sessions.load({"sessions": over(spark, sf_dir, SESSIONS), "checkpoints": over(spark, sf_dir, CHECKPOINTS)})
    known = sessions.entities(rows)
    return rows, refs, audit, known, sessions.session_checkpoint_links(rows, refs, known)


def src10_array_audit(spark, sf_dir):
    return _sessions(spark, sf_dir)[2]


def jon10_reciprocal_links(spark, sf_dir):
    return _sessions(spark, sf_dir)[4]


def jon11_null_tolerant_links(spark, sf_dir):
    rows, refs, _, known, _ = _sessions(spark, sf_dir)
    return sessions.relation_audit(rows, refs, known, sessions.commit_entities(rows, known)).where("relation IN ('session', 'checkpoint')")


def jon14_one_sided_pairs(spark, sf_dir):
    return sessions.one_sided(_sessions(spark, sf_dir)[4])


def prj05_checkpoint_key(spark, sf_dir):
    df = over(spark, sf_dir, f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat('Org/R#', c_mktsegment) WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS v, CASE WHEN c_custkey % 2 = 0 THEN concat('org/r', {N('c_nationkey')}) END AS repo FROM {{customer}}")
    return df.select("c_custkey", sessions.checkpoint_key(F.col("v"), F.col("repo")).alias("checkpoint"))


# ---- statistics in a total order, without a window over all rows


def agg32_gini(spark, sf_dir):
    return stats.gini(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("x")), "x").select("gini")


def win12_step_up_adjustment(spark, sf_dir):
    p = over(spark, sf_dir, "SELECT doc_id, (n_chars % 997 + 1) / 99700.0E0 AS p FROM {documents}")
    n = p.count()
    ranked = global_rank(p, [F.col("p"), F.col("doc_id")], "r0").withColumn("r", F.col("r0") + 1)
    bh = global_running(ranked, [F.col("r").desc()], F.least(F.lit(1.0), F.col("p") * n / F.col("r")), "min", "bh")
    return global_running(bh, [F.col("r")], F.least(F.lit(1.0), F.col("p") * (n - F.col("r") + 1)), "max", "holm").select("doc_id", "bh", "holm")


def win17_round_robin(spark, sf_dir):
    rows = stats.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], [F.col("n_chars"), F.col("doc_id")], "turn")
    return rows.select("doc_id", (F.col("turn") + 1).cast("int").alias("place"))


def srt03_repository_budget(spark, sf_dir):
    return stats.first_groups(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)


def rev06_frame_batches(spark, sf_dir):
    key = F.md5(F.concat(F.lit("9:"), F.col("doc_id").cast("string")))
    return stats.batches(table(spark, sf_dir, "documents").select("doc_id"), [key, F.col("doc_id")], 50)


def jon22_first_later_event(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    # one pass over each user's events; equal times are no later ones
    after = Window.partitionBy("user_id").orderBy("t").rangeBetween(1, Window.unboundedFollowing)
    bought = F.when(F.col("event_type") == "purchase", F.col("ts"))
    later = events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("first_later", F.min(bought).over(after))
    return later.where("event_type = 'error' AND first_later IS NOT NULL").groupBy("event_id").agg(F.min("first_later").alias("first_later"))


def win18_prior_requirements(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    prior = Window.partitionBy("user_id").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    n = lambda kind: F.coalesce(F.sum((F.col("event_type") == kind).cast("long")).over(prior), F.lit(0))
    rows = events.withColumns({"prior_views": n("view"), "prior_clicks": n("click")}).where("event_type = 'purchase'")
    return rows.groupBy("event_id").agg(F.sum("prior_views").alias("prior_views"), F.sum("prior_clicks").alias("prior_clicks"))


def win15_date_windows(spark, sf_dir):
    # the window's number comes from the date, so that nothing is joined by a range
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.to_date(F.lit("1995-01-01")))
    counted = table(spark, sf_dir, "orders").where((days >= 0) & (days < 37 * 30)).groupBy(F.floor(days / 30).cast("int").alias("w")).agg(F.count("*").alias("n"))
    windows = spark.range(0, 37).select(F.col("id").cast("int").alias("w"), F.date_add(F.to_date(F.lit("1995-01-01")), (F.col("id") * 30).cast("int")).alias("start_day"))
    return windows.join(counted, "w", "left").select("start_day", F.coalesce("n", F.lit(0)).alias("n"))


def sta12_paired_binary(spark, sf_dir):
    rows = over(spark, sf_dir, "SELECT toxic, quality FROM {labels}")
    return stats.paired_binary(rows, "toxic", "quality").select("n", "left_n", "right_n", "left_only", "right_only", "left_rate", "right_rate", "effect", "left_low", "left_high")


def sta10_balanced_effect(spark, sf_dir):
    rows = over(spark, sf_dir, "SELECT d.source, d.lang = 'en' AS side, CAST(l.toxic AS DOUBLE) AS v FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id")
    return stats.balanced_effect(rows, "source", "side", "v")


def sta23_sensitivity(spark, sf_dir):
    return stats.sensitivity(sta10_balanced_effect(spark, sf_dir))


def sta15_decision_stump(spark, sf_dir):
    return stats.stump(over(spark, sf_dir, "SELECT d.n_chars, l.toxic FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"), "n_chars", "toxic")


def sta17_classification_metrics(spark, sf_dir):
    rows = over(spark, sf_dir, "SELECT n_chars > 1500 AS p, quality = 1 AS y FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id")
    return stats.classification(rows, "p", "y").select("tp", "fp", "fn", "tn", "precision", "recall", "specificity", "balanced_accuracy", "f1", "mcc", "lr_positive", "lr_negative")


def sta06_benjamini_hochberg(spark, sf_dir):
    return stats.benjamini_hochberg(over(spark, sf_dir, "SELECT event_id, (event_id * 37 % 9973 + 1) / 99740.0E0 AS p FROM {events}"), "p")


def sta07_holm(spark, sf_dir):
    return stats.holm(over(spark, sf_dir, "SELECT event_id, (event_id * 37 % 9973 + 1) / 99740.0E0 AS p FROM {events}"), "p")


ORDERED = (agg32_gini, win12_step_up_adjustment, win17_round_robin, srt03_repository_budget, rev06_frame_batches, jon22_first_later_event, win18_prior_requirements, win15_date_windows)
QUERIES = {f.__name__: f for f in (
    prj02_url_identity, prj03_repo_normalization, prj04_patch_status, src08_source_rows, jon03_unique_alias, jon05_link_through_review, jon06_link_through_commit,
    agg07_metadata_conflicts, agg14_related_counts, jon08_census_audit, src10_array_audit, jon10_reciprocal_links, jon11_null_tolerant_links, jon14_one_sided_pairs, prj05_checkpoint_key,
    sta12_paired_binary, sta10_balanced_effect, sta23_sensitivity, sta15_decision_stump, sta17_classification_metrics, sta06_benjamini_hochberg, sta07_holm, *ORDERED,
)}

P = "SELECT event_id, (event_id * 37 % 9973 + 1) / 99740.0E0 AS p FROM events"
EFFECTS = """SELECT source AS cluster, avg(CASE WHEN lang = 'en' THEN CAST(toxic AS DOUBLE) END) AS a, avg(CASE WHEN lang <> 'en' THEN CAST(toxic AS DOUBLE) END) AS b
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source HAVING a IS NOT NULL AND b IS NOT NULL"""
ORACLES = {f.__name__: STATED[f.__name__] for f in ORDERED} | {name: plain(sql) for name, sql in {
    "prj02_url_identity": f"SELECT id, concat('org/r', {N('repo_id')}, '#', {N('number')}) AS pr_key FROM ({PRS})",
    "prj03_repo_normalization": r"""
        SELECT page_id, CASE WHEN regexp_matches(p, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$') THEN lower(p) END AS repository
        FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '\.git$', ''), '/+$', '') AS p FROM {pages})""",
    "prj04_patch_status": f"""
        SELECT CASE WHEN patch IS NULL THEN 'null' WHEN patch LIKE '@@%' THEN 'present_unverified' ELSE 'masked' END AS status, count(*) AS n FROM ({FILES}) GROUP BY 1""",
    "src08_source_rows": f"""
        WITH {KEYED}
        SELECT 'pull_request' AS table_name, 'pr' AS role, count(*) AS n, count(id) AS n_ids, 0 AS n_shas, count(html_url) AS n_keys, CAST(sum(row_number) AS BIGINT) AS row_numbers FROM keyed
        UNION ALL SELECT 'repository', 'repository', count(*), count(id), 0, 0, CAST(sum(row_number) AS BIGINT) FROM ({REPOSITORIES})
        UNION ALL SELECT 'pr_commits', 'commit', count(*), 0, count(sha), 0, CAST(sum(row_number) AS BIGINT) FROM commits
        UNION ALL SELECT 'pr_commit_details', 'file', count(*), 0, count(sha), 0, CAST(sum(row_number) AS BIGINT) FROM files
        UNION ALL SELECT 'pr_reviews', 'review', count(*), count(id), 0, 0, CAST(sum(row_number) AS BIGINT) FROM reviews
        UNION ALL SELECT 'pr_review_comments', 'review_comment', count(*), count(id), 0, 0, CAST(sum(row_number) AS BIGINT) FROM comments""",
    "jon03_unique_alias": "SELECT CAST(floor(c_acctbal) AS BIGINT) AS alias, min(c_custkey) AS target FROM {customer} WHERE c_acctbal IS NOT NULL GROUP BY 1 HAVING count(DISTINCT c_custkey) = 1",
    "jon05_link_through_review": f"WITH {KEYED} SELECT * FROM links WHERE method = 'review_id'",
    "jon06_link_through_commit": f"WITH {KEYED} SELECT * FROM links WHERE method = 'commit_sha'",
    "agg07_metadata_conflicts": f"""
        WITH {KEYED} SELECT pr_key, 'state' AS field, 'pull_request' AS "table", row_number AS "row"
        FROM (SELECT *, first_value(state) OVER (PARTITION BY pr_key ORDER BY row_number) AS f FROM keyed WHERE pr_key IS NOT NULL) WHERE state <> f""",
    "agg14_related_counts": f"WITH {KEYED} SELECT pr_key, table_name, count(*) AS n FROM links GROUP BY ALL",
    "jon08_census_audit": f"""
        WITH {KEYED}, every AS (SELECT 'pull_request' AS t, row_number AS n FROM prs UNION ALL SELECT 'pr_commits', row_number FROM commits UNION ALL SELECT 'pr_commit_details', row_number FROM files
          UNION ALL SELECT 'pr_reviews', row_number FROM reviews UNION ALL SELECT 'pr_review_comments', row_number FROM comments)
        SELECT t AS table_name, 'pr' AS relation, CASE WHEN l.pr_key IS NULL THEN 'unresolved' ELSE 'linked' END AS status, count(*) AS rows FROM every LEFT JOIN links l ON t = table_name AND n = row_number GROUP BY ALL
        UNION ALL SELECT t, 'review_id', CASE WHEN t <> 'pr_review_comments' THEN 'missing_foreign_key' WHEN EXISTS (SELECT 1 FROM comments c JOIN reviews r ON c.pull_request_review_id = r.id WHERE c.row_number = n) THEN 'linked' ELSE 'orphan' END, count(*) FROM every GROUP BY ALL
        UNION ALL SELECT t, 'repository', CASE WHEN t <> 'pull_request' THEN 'missing_foreign_key' WHEN n % 30 < 25 THEN 'linked' ELSE 'orphan' END, count(*) FROM every GROUP BY ALL""",
    "src10_array_audit": """
        SELECT 'sessions' AS table_name, 'checkpoint_ids' AS field, CASE c_custkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid_json' ELSE 'valid' END AS status, count(*) AS rows FROM {customer} GROUP BY 3
        UNION ALL SELECT 'checkpoints', 'session_pks', 'duplicate_entries', count(*) FROM {supplier}""",
    "jon10_reciprocal_links": f"WITH {LINKED} SELECT * FROM links",
    "jon11_null_tolerant_links": f"""
        WITH {LINKED}
        SELECT 'sessions' AS table_name, 'checkpoint' AS relation, CASE WHEN kk.pk IS NULL THEN 'orphan' WHEN s.repo_id IS NOT NULL AND lower(s.repo_id) <> kk.repo_id THEN 'repository_conflict' ELSE 'linked' END AS status, count(*) AS rows
        FROM a JOIN s USING (session_id) LEFT JOIN kk ON a.pk = kk.pk GROUP BY ALL
        UNION ALL SELECT 'checkpoints', 'session', CASE WHEN s.session_id IS NULL THEN 'orphan' WHEN s.repo_id IS NOT NULL AND lower(s.repo_id) <> b.repo_id THEN 'repository_conflict' ELSE 'linked' END, count(*)
        FROM b LEFT JOIN s ON s.row_number = b.m GROUP BY ALL""",
    "jon14_one_sided_pairs": f"""
        WITH {LINKED} SELECT session_id, checkpoint_pk, CASE WHEN min(method) = 'session_pks' THEN 'checkpoint_to_session' ELSE 'session_to_checkpoint' END AS seen_from FROM links GROUP BY 1, 2 HAVING count(DISTINCT method) = 1""",
    "prj05_checkpoint_key": f"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('Org/R#', c_mktsegment) WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN concat('org/r', {N('c_nationkey')}, '#', c_mktsegment) ELSE c_mktsegment END END AS checkpoint FROM {{customer}}".replace("'Org/R#'", "'org/r#'"),
    "sta12_paired_binary": """
        SELECT n, left_n, right_n, left_only, right_only, p AS left_rate, right_n / n AS right_rate, p - right_n / n AS effect,
               (p + z / (2 * n) - sqrt(z) * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n) AS left_low, (p + z / (2 * n) + sqrt(z) * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n) AS left_high
        FROM (SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS left_n, count(*) FILTER (quality = 1) AS right_n, count(*) FILTER (toxic = 1 AND quality = 0) AS left_only, count(*) FILTER (toxic = 0 AND quality = 1) AS right_only,
                     left_n / CAST(count(*) AS DOUBLE) AS p, 1.959963984540054E0 * 1.959963984540054E0 AS z FROM {labels} WHERE toxic IS NOT NULL AND quality IS NOT NULL)""",
    "sta10_balanced_effect": f"SELECT *, a - b AS effect FROM ({EFFECTS})",
    "sta23_sensitivity": f"""
        WITH e AS (SELECT a - b AS effect FROM ({EFFECTS})), t AS (SELECT count(*) AS n, sum(effect) AS s FROM e)
        SELECT max(n) AS n, max(s / n) AS effect, min((s - e.effect) / (n - 1)) AS low, max((s - e.effect) / (n - 1)) AS high, bool_and(sign((s - e.effect) / (n - 1)) = sign(s)) AS same_direction FROM e, t""",
    "sta15_decision_stump": """
        WITH r AS (SELECT CAST(d.n_chars AS DOUBLE) AS x, l.toxic AS y FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.toxic IS NOT NULL), t AS (SELECT sum(y) AS tp, sum(1 - y) AS tq FROM r),
        c AS (SELECT x, sum(sum(y)) OVER (ORDER BY x) - sum(y) AS bp, sum(sum(1 - y)) OVER (ORDER BY x) - sum(1 - y) AS bq FROM r GROUP BY x),
        s AS (SELECT x, ((tp - bp) / tp + bq / tq) / 2 AS ba FROM c, t), b AS (SELECT x, true AS above, ba FROM s UNION ALL SELECT x, false, 1 - ba FROM s)
        SELECT x AS threshold, above, ba AS balanced_accuracy FROM b ORDER BY round(ba, 12) DESC, x, above DESC LIMIT 1""",
    "sta17_classification_metrics": """
        SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy,
               2 * tp / (2 * tp + fp + fn) AS f1, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc, (tp / (tp + fn)) / (1 - tn / (tn + fp)) AS lr_positive, (1 - tp / (tp + fn)) / (tn / (tn + fp)) AS lr_negative
        FROM (SELECT CAST(count(*) FILTER (n_chars > 1500 AND quality = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (n_chars > 1500 AND quality = 0) AS DOUBLE) AS fp,
                     CAST(count(*) FILTER (n_chars <= 1500 AND quality = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (n_chars <= 1500 AND quality = 0) AS DOUBLE) AS tn FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id)""",
    "sta06_benjamini_hochberg": f"""
        WITH r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM ({P}))
        SELECT event_id, p, min(least(p * n / r, 1.0)) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS q FROM r""",
    "sta07_holm": f"""
        WITH r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM ({P}))
        SELECT event_id, p, max(least(p * (n - r + 1), 1.0)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS adjusted FROM r""",
}.items()}
