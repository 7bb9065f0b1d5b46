"""More of the surveyed relational operators as single statements, in SQL that both engines plan or in a pair of texts."""

from __future__ import annotations

from plumbline.plans.linkage import over, plain
from plumbline.runtime import dealt, table

#: name: SQL for both engines, or (Spark, other)
STATEMENTS: dict[str, str | tuple[str, str]] = {
    # ---- joins
    "jon01_equi_join": "SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, c.c_nationkey FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey",
    "jon15_context_union": (
        """SELECT context, array_join(sort_array(collect_set(status)), ';') AS statuses, count(*) AS n FROM (
             SELECT e.user_id AS context, CASE WHEN c.c_custkey IS NULL THEN 'checkpoint_missing' ELSE 'linked' END AS status FROM {events} e LEFT JOIN {customer} c ON e.user_id = c.c_custkey
             UNION ALL SELECT o.o_custkey, CASE WHEN c.c_custkey IS NULL THEN 'checkpoint_missing' WHEN c.c_acctbal < 0 THEN 'checkpoint_ambiguous' ELSE 'provided_reference' END FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey) u GROUP BY context""",
        """SELECT context, array_to_string(list_sort(list_distinct(list(status))), ';') AS statuses, count(*) AS n FROM (
             SELECT e.user_id AS context, CASE WHEN c.c_custkey IS NULL THEN 'checkpoint_missing' ELSE 'linked' END AS status FROM {events} e LEFT JOIN {customer} c ON e.user_id = c.c_custkey
             UNION ALL SELECT o.o_custkey, CASE WHEN c.c_custkey IS NULL THEN 'checkpoint_missing' WHEN c.c_acctbal < 0 THEN 'checkpoint_ambiguous' ELSE 'provided_reference' END FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey) u GROUP BY context""",
    ),
    # a failure with a null names all of its column: an anti join for each kind of null instead of one by OR
    "jon17_available_evidence": """
        WITH f AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS fs, CASE WHEN s_suppkey % 3 = 1 THEN NULL ELSE s_nationkey % 7 + 1 END AS fl FROM {supplier} WHERE s_suppkey % 40 = 0)
        SELECT l_orderkey, l_linenumber, l_suppkey FROM {lineitem} l
        WHERE NOT EXISTS (SELECT 1 FROM f WHERE fs = l.l_suppkey AND fl = l.l_linenumber) AND NOT EXISTS (SELECT 1 FROM f WHERE fs = l.l_suppkey AND fl IS NULL) AND NOT EXISTS (SELECT 1 FROM f WHERE fs IS NULL AND fl = l.l_linenumber)""",
    "jon29_validated_three_way": """
        SELECT d.doc_id, l.toxic, d.lang FROM {documents} d JOIN (SELECT doc_id, min(toxic) AS toxic FROM {labels} GROUP BY doc_id HAVING count(*) = 1) l ON d.doc_id = l.doc_id
        JOIN (SELECT doc_id FROM {documents} GROUP BY doc_id HAVING count(*) = 1) u ON d.doc_id = u.doc_id WHERE l.toxic IS NOT NULL""",
    "jon32_before_after_pairs": """
        WITH b AS (SELECT l_orderkey AS k, l_partkey AS h, min(l_linenumber) AS line, count(*) AS n FROM {lineitem} WHERE l_linenumber % 2 = 1 GROUP BY 1, 2), a AS (SELECT l_orderkey AS k, l_partkey AS h, min(l_linenumber) AS line, count(*) AS n FROM {lineitem} WHERE l_linenumber % 2 = 0 GROUP BY 1, 2)
        SELECT b.k, b.h, b.line AS before_line, a.line AS after_line FROM b JOIN a ON b.k = a.k AND b.h = a.h WHERE b.n = 1 AND a.n = 1""",
    "jon34_comment_relation": """
        SELECT e.event_id, l.l_linenumber, CASE WHEN e.event_type = 'view' THEN 'pr_context' WHEN e.user_id % 7 = l.l_linenumber AND e.value > 10 THEN 'direct_log_location' ELSE 'same_file_context' END AS relation
        FROM {events} e JOIN {lineitem} l ON e.event_id = l.l_orderkey""",
    "jon35_prompt_association": """
        SELECT e.event_id, o.o_orderkey, c.c_custkey, n.n_name, CASE WHEN o.o_orderkey IS NULL THEN 'commit_missing' WHEN c.c_custkey IS NULL THEN 'checkpoint_missing' WHEN n.n_nationkey IS NULL THEN 'session_missing' ELSE 'associated' END AS state
        FROM {events} e LEFT JOIN {orders} o ON e.event_id = o.o_orderkey LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "jon36_inventory_join": """
        SELECT s.s_suppkey, CASE WHEN i.k IS NULL THEN 'inventory_missing' WHEN i.n < 20 THEN 'inventory_not_ready' ELSE 'ready' END AS state, coalesce(i.n, 0) AS n
        FROM {supplier} s LEFT JOIN (SELECT l_suppkey AS k, count(*) AS n FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY 1) i ON s.s_suppkey = i.k""",
    "jon37_session_concepts": (
        """SELECT a.user_id, array_join(sort_array(array_intersect(a.s, b.s)), ';') AS both FROM (SELECT user_id, collect_set(event_type) AS s FROM {events} WHERE event_id % 2 = 0 GROUP BY 1) a
           JOIN (SELECT user_id, collect_set(event_type) AS s FROM {events} WHERE event_id % 2 = 1 GROUP BY 1) b ON a.user_id = b.user_id""",
        """SELECT a.user_id, array_to_string(list_sort(list_intersect(a.s, b.s)), ';') AS both FROM (SELECT user_id, list(DISTINCT event_type) AS s FROM {events} WHERE event_id % 2 = 0 GROUP BY 1) a
           JOIN (SELECT user_id, list(DISTINCT event_type) AS s FROM {events} WHERE event_id % 2 = 1 GROUP BY 1) b ON a.user_id = b.user_id""",
    ),
    # ---- aggregations
    "agg03_having": "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM {orders} GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1",
    "agg10_context_fold": (
        "SELECT l_suppkey, array_join(sort_array(collect_set(l_returnflag)), ';') AS flags, array_join(sort_array(collect_set(l_linestatus)), ';') AS statuses, count(DISTINCT l_orderkey) AS n FROM {lineitem} GROUP BY 1",
        "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ';') AS flags, array_to_string(list_sort(list(DISTINCT l_linestatus)), ';') AS statuses, count(DISTINCT l_orderkey) AS n FROM {lineitem} GROUP BY 1",
    ),
    "agg13_status_histogram": (
        "SELECT user_id, array_join(sort_array(collect_list(concat(event_type, ':', CAST(n AS STRING)))), ';') AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY 1, 2) x GROUP BY 1",
        "SELECT user_id, array_to_string(list_sort(list(event_type || ':' || n)), ';') AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY 1, 2) x GROUP BY 1",
    ),
    "agg15_coverage_metrics": (
        """SELECT m.metric, m.n, total FROM (SELECT count(DISTINCT o_orderkey) AS total, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS a, count(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_orderkey END) AS b, count(DISTINCT CASE WHEN o_custkey % 3 = 0 THEN o_orderkey END) AS c FROM {orders})
           LATERAL VIEW stack(3, 'finished', a, 'large', b, 'third', c) m AS metric, n""",
        """WITH t AS (SELECT count(DISTINCT o_orderkey) AS total, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS a, count(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_orderkey END) AS b, count(DISTINCT CASE WHEN o_custkey % 3 = 0 THEN o_orderkey END) AS c FROM {orders})
           SELECT 'finished' AS metric, a AS n, total FROM t UNION ALL SELECT 'large', b, total FROM t UNION ALL SELECT 'third', c, total FROM t""",
    ),
    "agg17_batch_summary": (
        "SELECT event_type, CAST(sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS jobs FROM {events} GROUP BY 1",
        "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS jobs FROM {events} GROUP BY 1",
    ),
    "agg19_sampling_probability": "SELECT o_orderpriority AS stratum, count(*) AS population, sum(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) AS sampled, sum(CASE WHEN o_orderkey % 10 = 0 THEN 1.0E0 ELSE 0.0E0 END) / count(*) AS probability FROM {orders} GROUP BY 1",
    "agg20_frontier_counts": "SELECT l_orderkey AS graph, l_returnflag AS endpoint, count(*) AS n FROM {lineitem} GROUP BY 1, 2",
    "agg22_patch_profile": """
        SELECT l_orderkey, count(*) AS files, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS masked, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS empty, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS present,
               count(DISTINCT l_suppkey) AS commits, CAST(sum(l_quantity) AS DOUBLE) AS added FROM {lineitem} GROUP BY 1""",
    "agg23_log_profile": """
        SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS error, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS view, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS click, count(*) AS total FROM {events} GROUP BY 1""",
    "agg25_feature_vector": """
        SELECT l_orderkey, sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) * 1.0E0 / sum(n) AS duplicate_share, sum(CASE WHEN flag = 'R' THEN n ELSE 0 END) * 1.0E0 / sum(n) AS error_share, CAST(sum(n) AS BIGINT) AS n_logs
        FROM (SELECT l_orderkey, l_returnflag AS flag, l_suppkey % 4 AS template, count(*) AS n FROM {lineitem} GROUP BY 1, 2, 3) x GROUP BY 1""",
    "agg26_unit_feature_means": "SELECT user_id, avg(CASE WHEN event_type = 'error' THEN 1.0E0 ELSE 0.0E0 END) AS error, avg(CASE WHEN value > 50 THEN 1.0E0 ELSE 0.0E0 END) AS large, count(*) AS n FROM {events} GROUP BY 1",
    "agg27_set_union": (
        "SELECT user_id, array_join(sort_array(array_distinct(flatten(collect_list(array(event_type, concat('k', CAST(event_id % 3 AS STRING))))))), ';') AS features FROM {events} GROUP BY 1",
        "SELECT user_id, array_to_string(list_sort(list_distinct(flatten(list([event_type, 'k' || (event_id % 3)])))), ';') AS features FROM {events} GROUP BY 1",
    ),
    "agg28_any_to_side": "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_r, bool_or(l_linestatus = 'O') AS any_o, bool_and(l_quantity > 5) AS all_large FROM {lineitem} GROUP BY 1",
    "agg29_risk_distribution": """
        SELECT d.lang, v.level, coalesce(c.n, 0) AS n, coalesce(c.n, 0) * 100.0E0 / t.total AS share FROM (SELECT DISTINCT lang FROM {documents}) d CROSS JOIN (SELECT 'low' AS level UNION ALL SELECT 'medium' UNION ALL SELECT 'high') v
        JOIN (SELECT lang, count(*) AS total FROM {documents} GROUP BY 1) t ON d.lang = t.lang
        LEFT JOIN (SELECT lang, CASE WHEN n_chars > 4000 THEN 'high' WHEN n_chars > 1000 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM {documents} GROUP BY 1, 2) c ON d.lang = c.lang AND v.level = c.level""",
    "agg30_label_explosion": (
        "SELECT label, count(*) AS n FROM (SELECT explode(split(concat(event_type, ';', CASE WHEN value > 50 THEN 'large;' ELSE '' END), ';')) AS label FROM {events}) x WHERE label <> '' GROUP BY 1",
        "SELECT label, count(*) AS n FROM (SELECT unnest(string_split(concat(event_type, ';', CASE WHEN value > 50 THEN 'large;' ELSE '' END), ';')) AS label FROM {events}) x WHERE label <> '' GROUP BY 1",
    ),
    "agg31_stratum_summaries": "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    # ---- ordered rows
    "win04_first_occurrence": "SELECT user_id, event_type, min(event_id) AS first_event FROM {events} GROUP BY 1, 2",
    "win13_context_lines": (
        "SELECT user_id, event_id, array_join(collect_list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), ' ') AS context FROM {events}",
        "SELECT user_id, event_id, coalesce(array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), ' '), '') AS context FROM {events}",
    ),
    "srt05_smallest_hashes": "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('21:', CAST(doc_id AS VARCHAR(20)))), doc_id) AS r FROM {documents}) x WHERE r <= 7",
    "srt06_semantic_strata": """
        SELECT doc_id, CAST(r AS INT) AS round FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, lang, n_chars > 2000 ORDER BY md5(concat('22:', CAST(doc_id AS VARCHAR(20)))), doc_id) AS r FROM {documents}) x WHERE r <= 2""",
    "srt08_enriched_and_uniform": """
        SELECT doc_id, 'enriched' AS sample FROM (SELECT d.doc_id, row_number() OVER (PARTITION BY l.toxic ORDER BY md5(concat('23:', CAST(d.doc_id AS VARCHAR(20)))), d.doc_id) AS r FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id) x WHERE r <= 10
        UNION ALL SELECT doc_id, 'uniform' FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('24:', CAST(doc_id AS VARCHAR(20)))), doc_id) AS r FROM {documents}) y WHERE r <= 10""",
    # ---- sets
    "set05_subset": "SELECT o.o_orderkey, count(CASE WHEN l.l_linenumber > 3 THEN 1 END) = 0 AS covered FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey GROUP BY 1",
    "set06_equal_sets": (
        "SELECT a.l_suppkey AS k, a.s = b.s AS same FROM (SELECT l_suppkey, sort_array(collect_set(l_linenumber)) AS s FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY 1) a JOIN (SELECT l_suppkey, sort_array(collect_set(l_linenumber)) AS s FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY 1) b ON a.l_suppkey = b.l_suppkey",
        "SELECT a.l_suppkey AS k, a.s = b.s AS same FROM (SELECT l_suppkey, list_sort(list(DISTINCT l_linenumber)) AS s FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY 1) a JOIN (SELECT l_suppkey, list_sort(list(DISTINCT l_linenumber)) AS s FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY 1) b ON a.l_suppkey = b.l_suppkey",
    ),
    "set07_ordered_distinct": (
        "SELECT conv_id, array_join(array_distinct(transform(array_sort(collect_list(struct(turn, coalesce(role, '') AS role))), x -> x.role)), ';') AS roles FROM {conversations} GROUP BY 1",
        "SELECT conv_id, string_agg(role, ';' ORDER BY first) AS roles FROM (SELECT conv_id, coalesce(role, '') AS role, min((turn, coalesce(role, ''))) AS first FROM {conversations} GROUP BY 1, 2) GROUP BY 1",
    ),
    "txt27_multi_source_corpus": """
        SELECT source_kind, id, body FROM (SELECT source_kind, id, body, row_number() OVER (PARTITION BY source_kind, body ORDER BY id) AS r FROM (
          SELECT 'documents' AS source_kind, doc_id AS id, text AS body FROM {documents} UNION ALL SELECT 'benchmark', item_id, text FROM {benchmark} UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM {conversations}) u WHERE body IS NOT NULL) x WHERE r = 1""",
    "sta09_equal_repository_mean": "SELECT count(*) AS repositories, avg(m) AS effect FROM (SELECT d.source, avg(CAST(l.toxic AS DOUBLE)) AS m FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY 1) x",
    "sta21_outlier_audit": """
        WITH a AS (SELECT l_returnflag, l_suppkey, count(*) AS n FROM {lineitem} GROUP BY 1, 2), m AS (SELECT l_returnflag AS f, avg(n) AS average FROM a GROUP BY 1)
        SELECT l_returnflag, l_suppkey, n, n > 3 * average AS flagged
        FROM (SELECT * FROM (SELECT l_returnflag, l_suppkey, n, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey) AS r FROM a) b WHERE r <= 20) c JOIN m ON l_returnflag = f""",
    "sta22_density": """
        SELECT d.lang, sum(l.toxic) * 1000.0E0 / sum(d.n_chars) AS pooled, avg(l.toxic * 1000.0E0 / d.n_chars) AS mean FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE d.n_chars > 0 GROUP BY 1""",
    "sta26_subgroups": """
        SELECT dimension, value, n, a, b, a - b AS difference FROM (
          SELECT 'lang' AS dimension, d.lang AS value, count(*) AS n, avg(CAST(l.toxic AS DOUBLE)) AS a, avg(CAST(l.quality AS DOUBLE)) AS b FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY 2
          UNION ALL SELECT 'source', d.source, count(*), avg(CAST(l.toxic AS DOUBLE)), avg(CAST(l.quality AS DOUBLE)) FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY 2) x WHERE n >= 20""",
    "lin13_human_controls": """
        SELECT a.l_orderkey AS case_key, a.l_linenumber AS case_line, b.l_orderkey AS control_key, b.l_linenumber AS control_line FROM {lineitem} a JOIN {lineitem} b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey AND a.l_orderkey <> b.l_orderkey
        WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'N'""",
    "lin15_fingerprint_reuse": """
        SELECT d.doc_id, f.first IS NOT NULL AND f.first < d.doc_id AS reused FROM {documents} d LEFT JOIN (SELECT md5(text) AS fp, min(doc_id) AS first FROM {documents} GROUP BY 1) f ON md5(d.text) = f.fp""",
    "lin18_motive_judgement": """
        SELECT user_id, CASE WHEN count(DISTINCT CASE WHEN event_type IN ('purchase', 'signup') THEN 'for' WHEN event_type = 'error' THEN 'against' END) > 1 THEN 'conflicting' WHEN max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 THEN 'explicit' WHEN max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) = 1 THEN 'inferred' ELSE 'unknown' END AS motive
        FROM {events} GROUP BY 1""",
}


#: name: table and key by which its rows are dealt before the statement groups them
DEALT = {"agg22_patch_profile": ("lineitem", "l_orderkey")}


def _query(name: str):
    sql = STATEMENTS[name]

    def run(spark, sf_dir):
        if name in DEALT:
            source, key = DEALT[name]
            return spark.sql(sql, **{source: dealt(table(spark, sf_dir, source), key)})
        return over(spark, sf_dir, sql if isinstance(sql, str) else sql[0])

    run.__name__ = name
    return run


QUERIES = {name: _query(name) for name in STATEMENTS}
ORACLES = {name: plain(sql if isinstance(sql, str) else sql[1]) for name, sql in STATEMENTS.items()}
