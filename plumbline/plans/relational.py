"""Relational operators of the reference's families as named queries, in SQL that Spark plans and an oracle can run.

Each entry is one declarative statement; what differs between the dialects is given twice. Statements that rank or fold
state a total order, so that results don't depend on partitioning.
"""

from __future__ import annotations

import re

from plumbline.runtime import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: name: SQL for both engines, or (Spark, other)
STATEMENTS: dict[str, str | tuple[str, str]] = {
    # ---- joins and linkage
    "jon02_double_link_agreement": """
        SELECT l.l_orderkey, l.l_linenumber,
               CASE WHEN o.o_orderkey IS NOT NULL AND s.s_suppkey IS NOT NULL THEN 'both'
                    WHEN o.o_orderkey IS NOT NULL THEN 'order_only' WHEN s.s_suppkey IS NOT NULL THEN 'supplier_only' ELSE 'none' END AS method
        FROM {lineitem} l LEFT JOIN {orders} o ON l.l_orderkey = o.o_orderkey LEFT JOIN {supplier} s ON l.l_suppkey = s.s_suppkey""",
    "jon04_unambiguous_links": """
        SELECT s.s_suppkey, c.c_custkey FROM {supplier} s JOIN {customer} c ON s.s_nationkey = c.c_nationkey AND floor(s.s_acctbal / 500) = floor(c.c_acctbal / 500)
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT c_nationkey AS n, floor(c_acctbal / 500) AS b FROM {customer} GROUP BY 1, 2 HAVING count(*) > 1) a
                          WHERE a.n = s.s_nationkey AND a.b = floor(s.s_acctbal / 500))""",
    "jon07_first_link_method": """
        SELECT event_id, link, method FROM (
          SELECT event_id, link, method, row_number() OVER (PARTITION BY event_id ORDER BY method_rank, link) AS r FROM (
            SELECT e.event_id, c.c_custkey AS link, 'direct' AS method, 1 AS method_rank FROM {events} e JOIN {customer} c ON e.user_id = c.c_custkey
            UNION ALL
            SELECT e.event_id, o.o_custkey, 'through_order', 2 FROM {events} e JOIN {orders} o ON e.event_id = o.o_orderkey) m) ranked
        WHERE r = 1""",
    "jon09_conflict_audit": """
        SELECT n.n_regionkey AS regionkey, CAST(count(*) AS BIGINT) AS rows_linked,
               CAST(sum(CASE WHEN c.c_nationkey <> s.s_nationkey THEN 1 ELSE 0 END) AS BIGINT) AS conflicts
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
        JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY 1""",
    "jon12_exact_then_cross": """
        SELECT e.event_id, CASE WHEN x.o_orderkey IS NOT NULL THEN 'exact' WHEN y.k IS NOT NULL THEN 'cross_reference' ELSE 'orphan' END AS status
        FROM {events} e LEFT JOIN {orders} x ON e.event_id = x.o_orderkey AND e.user_id = x.o_custkey
        LEFT JOIN (SELECT DISTINCT o_orderkey AS k FROM {orders}) y ON e.event_id = y.k""",
    "jon13_four_state_audit": """
        SELECT status, CAST(count(*) AS BIGINT) AS n FROM (
          SELECT CASE WHEN c.n IS NULL THEN 'orphan' WHEN c.n > 1 AND c.k > 1 THEN 'ambiguous_repository' WHEN c.lo <> s.s_nationkey THEN 'repository_conflict' ELSE 'linked' END AS status
          FROM {supplier} s LEFT JOIN (SELECT c_custkey % 100 AS id, count(*) AS n, count(DISTINCT c_nationkey) AS k, min(c_nationkey) AS lo FROM {customer} GROUP BY 1) c ON s.s_suppkey = c.id) a
        GROUP BY status""",
    "jon16_reasons_of_rejection": """
        SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no_label' WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'low_quality' ELSE 'accepted' END AS reason
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "jon22_first_later_event": """
        SELECT a.event_id, min(b.ts) AS first_later FROM {events} a JOIN {events} b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.ts > a.ts
        WHERE a.event_type = 'error' GROUP BY a.event_id""",
    "jon23_date_window_join": (
        """SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM {orders} a JOIN {orders} b
           ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(datediff(a.o_orderdate, b.o_orderdate)) <= 14""",
        """SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM orders a JOIN orders b
           ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', CAST(b.o_orderdate AS DATE), CAST(a.o_orderdate AS DATE))) <= 14""",
    ),
    "jon28_zip_pairs_in_strata": """
        SELECT a.n AS stratum, a.s_suppkey, b.c_custkey FROM
          (SELECT s_nationkey AS n, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5(concat('7:', CAST(s_suppkey AS VARCHAR(20)))), s_suppkey) AS r FROM {supplier}) a
          JOIN (SELECT c_nationkey AS n, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(concat('7:', CAST(c_custkey AS VARCHAR(20)))), c_custkey) AS r FROM {customer}) b
          ON a.n = b.n AND a.r = b.r""",
    "jon30_or_join_as_union": """
        SELECT event_id, o_orderkey, CAST(min(grade) AS INT) AS grade FROM (
          SELECT e.event_id, o.o_orderkey, 1 AS grade FROM {events} e JOIN {orders} o ON e.event_id = o.o_orderkey
          UNION ALL SELECT e.event_id, o.o_orderkey, 2 FROM {events} e JOIN {orders} o ON e.user_id = o.o_custkey AND o.o_orderstatus = 'P') u
        GROUP BY event_id, o_orderkey""",
    # ---- aggregations
    "agg01_count_by_key": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY 1, 2",
    "agg02_distinct_count": "SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM {lineitem} GROUP BY 1",
    "agg04_conditional_counts": """
        SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) AS BIGINT) AS n_long,
               CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS n_en FROM {documents} GROUP BY source""",
    "agg05_null_safe_sum": """
        SELECT n.n_nationkey, CAST(coalesce(sum(c.c_acctbal), 0) AS DOUBLE) AS balance FROM {nation} n LEFT JOIN {customer} c ON n.n_nationkey = c.c_nationkey GROUP BY 1""",
    "agg06_first_non_null_fold": (
        "SELECT user_id, min_by(value, struct(ts, event_id)) AS first_value, array_join(sort_array(collect_set(event_type)), ';') AS kinds FROM {events} GROUP BY user_id",
        "SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS kinds FROM events GROUP BY user_id",
    ),
    "agg08_single_label_or_unknown": """
        SELECT c_nationkey, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN min(c_mktsegment) ELSE 'unknown' END AS segment FROM {customer} GROUP BY 1""",
    "agg09_entity_variants": "SELECT text, min(source) AS source, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source) AS BIGINT) AS n_sources FROM {documents} GROUP BY text HAVING count(*) > 1",
    "agg11_two_level_rollup": """
        SELECT p_brand, p_type, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS orders FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
        GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand))""",
    "agg12_zero_filled_catalog": """
        SELECT r.r_name, p.o_orderpriority, CAST(coalesce(x.n, 0) AS BIGINT) AS n
        FROM {region} r CROSS JOIN (SELECT DISTINCT o_orderpriority FROM {orders}) p LEFT JOIN (
          SELECT r_name, o_orderpriority, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
          JOIN {region} ON n_regionkey = r_regionkey WHERE o_totalprice > 400000 GROUP BY 1, 2) x
        ON r.r_name = x.r_name AND p.o_orderpriority = x.o_orderpriority""",
    "agg16_any_all": """
        SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS any_final, min(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS all_final FROM {orders} GROUP BY 1""",
    "agg18_funnel": """
        SELECT CAST(1 AS INT) AS stage, 'orders' AS unit, CAST(count(*) AS BIGINT) AS n FROM {orders} UNION ALL
        SELECT 2, 'with_customer', CAST(count(*) AS BIGINT) FROM {orders} JOIN {customer} ON o_custkey = c_custkey UNION ALL
        SELECT 3, 'large', CAST(count(*) AS BIGINT) FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_totalprice > 200000""",
    "agg21_census_share": """
        SELECT lang, CAST(count(*) AS BIGINT) AS n, count(*) * 1.0E0 / sum(count(*)) OVER () AS share FROM {documents} GROUP BY lang""",
    "agg32_gini": """
        SELECT sum((2 * r - n - 1) * CAST(x AS DOUBLE)) / (max(n) * sum(CAST(x AS DOUBLE))) AS gini FROM (
          SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM (SELECT o_custkey, count(*) AS x FROM {orders} GROUP BY 1) a) b""",
    "agg36_total_variation": """
        SELECT sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2 AS distance FROM
          (SELECT source, count(*) * 1.0E0 / sum(count(*)) OVER () AS p FROM {documents} WHERE lang = 'en' GROUP BY source) a
          FULL OUTER JOIN (SELECT source, count(*) * 1.0E0 / sum(count(*)) OVER () AS p FROM {documents} WHERE lang <> 'en' GROUP BY source) b ON a.source = b.source""",
    "agg37_concentration": """
        SELECT source, CAST(n AS BIGINT) AS n, CAST(r AS INT) AS rank, sum(n) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) * 1.0E0 / sum(n) OVER () AS cumulative FROM (
          SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS r FROM {documents} GROUP BY source) x""",
    "agg38_effective_clusters": "SELECT sum(CAST(n AS DOUBLE)) * sum(CAST(n AS DOUBLE)) / sum(CAST(n AS DOUBLE) * n) AS clusters FROM (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1) x",
    # ---- ordered sequences
    "win01_run_length_ranges": """
        SELECT user_id, event_type, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS n FROM (
          SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM {events}) x
        GROUP BY user_id, event_type, island""",
    "win02_ordinal_in_group": """
        SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) - 1 AS INT) AS ordinal FROM {lineitem}""",
    "win03_unique_in_group": "SELECT o_orderkey FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM {orders}) x WHERE n = 1",
    "win05_tail_budget": """
        SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END DESC, o_orderdate DESC, o_orderkey) AS r FROM {orders}) x WHERE r <= 3""",
    "win06_latest_per_group": """
        SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) x WHERE r = 1""",
    "win07_revision_chain": """
        SELECT event_id, CAST(row_number() OVER w AS INT) AS revision, lag(event_id) OVER w AS previous FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "win10_first_mitigation": (
        "SELECT user_id, min_by(event_id, struct(ts, event_id)) FILTER (WHERE event_type = 'purchase') AS first_purchase FROM {events} GROUP BY user_id",
        "SELECT user_id, arg_min(event_id, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS first_purchase FROM events GROUP BY user_id",
    ),
    "win12_step_up_adjustment": """
        SELECT doc_id, min(raw) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS bh, max(holm) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS holm FROM (
          SELECT doc_id, r, least(1.0E0, p * n / r) AS raw, least(1.0E0, p * (n - r + 1)) AS holm FROM (
            SELECT doc_id, p, row_number() OVER (ORDER BY p, doc_id) AS r, count(*) OVER () AS n FROM (
              SELECT doc_id, (n_chars % 997 + 1) / 99700.0E0 AS p FROM {documents}) a) b) c""",
    "win15_date_windows": (
        "SELECT CAST(w AS DATE) AS start_day, CAST(count(o_orderkey) AS BIGINT) AS n FROM (SELECT explode(sequence(DATE'1995-01-01', DATE'1997-12-31', INTERVAL 30 DAYS)) AS w) s LEFT JOIN {orders} ON o_orderdate >= w AND o_orderdate < date_add(w, 30) GROUP BY 1",
        "SELECT CAST(w AS DATE) AS start_day, CAST(count(o_orderkey) AS BIGINT) AS n FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1997-12-31', INTERVAL 30 DAYS)) AS w) s LEFT JOIN orders ON o_orderdate >= w AND o_orderdate < w + INTERVAL 30 DAYS GROUP BY 1",
    ),
    "win16_observation_window": (
        "SELECT o_orderkey, least(date_add(CAST(o_orderdate AS DATE), 90), DATE'1998-08-01') AS window_end, date_add(CAST(o_orderdate AS DATE), 90) > DATE'1998-08-01' AS right_censored FROM {orders}",
        "SELECT o_orderkey, least(CAST(o_orderdate AS DATE) + 90, DATE '1998-08-01') AS window_end, CAST(o_orderdate AS DATE) + 90 > DATE '1998-08-01' AS right_censored FROM orders",
    ),
    "win17_round_robin": """
        SELECT doc_id, CAST(row_number() OVER (ORDER BY layer, source) AS INT) AS place FROM (
          SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS layer FROM {documents}) x""",
    "win18_prior_requirements": """
        SELECT e.event_id, CAST(sum(CASE WHEN p.event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS prior_views, CAST(sum(CASE WHEN p.event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS prior_clicks
        FROM {events} e LEFT JOIN {events} p ON e.user_id = p.user_id AND p.ts < e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id""",
    # ---- sampling and order
    "srt03_repository_budget": """
        SELECT doc_id, source, d <= 5 AS kept FROM (SELECT doc_id, source, dense_rank() OVER (ORDER BY f, source) AS d FROM (SELECT doc_id, source, min(doc_id) OVER (PARTITION BY source) AS f FROM {documents}) a) b""",
    "srt04_stratified_round_robin": """
        SELECT doc_id, CAST(r AS INT) AS layer FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY md5(concat('11:', CAST(doc_id AS VARCHAR(20)))), doc_id) AS r FROM {documents}) x WHERE r <= 4""",
    "srt07_inclusion_probability": """
        SELECT doc_id, least(20, n) * 1.0E0 / n AS probability FROM (
          SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('3:', CAST(doc_id AS VARCHAR(20)))), doc_id) AS r FROM {documents}) x
        JOIN (SELECT lang AS l, count(*) AS n FROM {documents} GROUP BY 1) c ON lang = l WHERE r <= 20""",
    "srt09_group_holdout": """
        SELECT source, row_number() OVER (ORDER BY md5(concat('5:', source)), source) <= floor(0.2 * count(*) OVER ()) AS held_out FROM (SELECT DISTINCT source FROM {documents}) x""",
    "srt10_latest_before_cutoff": (
        "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM {orders} WHERE o_orderdate < TIMESTAMP'1997-01-01') x WHERE r <= 2",
        "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01') x WHERE r <= 2",
    ),
    "srt12_top_twenty": "SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n FROM {lineitem} GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 20",
    # ---- sets
    "set01_union_all": "SELECT o_custkey AS k, 'order' AS origin FROM {orders} UNION ALL SELECT user_id, 'event' FROM {events}",
    "set02_union_distinct": "SELECT o_custkey AS k FROM {orders} UNION SELECT user_id FROM {events}",
    "set03_intersection": "SELECT o_custkey AS k FROM {orders} INTERSECT SELECT user_id FROM {events}",
    "set04_difference": "SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 25 EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_quantity <= 10",
    "set10_matched_units": "SELECT source FROM {documents} WHERE lang IN ('en', 'de', 'fr') GROUP BY source HAVING count(DISTINCT lang) = 3",
    "set11_conflict_drop": """
        SELECT d.text, min(d.doc_id) AS doc_id FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.text HAVING count(DISTINCT l.toxic) = 1""",
    # ---- projections and scalar functions
    "fun02_stable_id": (
        "SELECT doc_id, substring(sha2(concat('[\"2.0\",', CAST(doc_id AS STRING), ']'), 256), 1, 24) AS stable_id FROM {documents}",
        "SELECT doc_id, substring(sha256('[\"2.0\",' || CAST(doc_id AS VARCHAR) || ']'), 1, 24) AS stable_id FROM documents",
    ),
    "fun03_text_digest": ("SELECT doc_id, sha2(text, 256) AS digest FROM {documents}", "SELECT doc_id, sha256(text) AS digest FROM documents"),
    "fun28_compact_text": (
        r"SELECT doc_id, substring(regexp_replace(text, r'[ \t\r\n]+', ' '), 1, 80) AS compact FROM {documents}",
        r"SELECT doc_id, substring(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), 1, 80) AS compact FROM documents",
    ),
    "fun32_json_field": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    # ---- lineage and statistics
    "lin06_censoring_reason": """
        SELECT o_orderkey, CASE WHEN c.c_custkey IS NULL THEN 'no_customer' WHEN o.o_orderstatus = 'P' THEN 'pending' WHEN x.n IS NULL THEN 'no_lines' WHEN x.open_lines > 0 THEN 'open_lines' ELSE 'observed' END AS reason
        FROM {orders} o LEFT JOIN {customer} c ON o.o_custkey = c.c_custkey
        LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open_lines FROM {lineitem} GROUP BY 1) x ON o.o_orderkey = x.l_orderkey""",
    "sta01_wilson_interval": """
        SELECT lang, n, k, (p + z2 / (2 * n) - z * sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n) AS lo, (p + z2 / (2 * n) + z * sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n) AS hi FROM (
          SELECT d.lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(l.toxic) AS BIGINT) AS k, sum(l.toxic) * 1.0E0 / count(*) AS p, 1.959963984540054E0 AS z, 1.959963984540054E0 * 1.959963984540054E0 AS z2
          FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.lang) x""",
    "sta05_odds_ratio": """
        SELECT source, CASE WHEN a * b * c * d = 0 THEN (a + 0.5E0) * (d + 0.5E0) / ((b + 0.5E0) * (c + 0.5E0)) ELSE a * 1.0E0 * d / (b * c) END AS odds_ratio FROM (
          SELECT d.source, sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS b,
                 sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS c, sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS d
          FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source) x""",
    "sta13_leave_one_out": """
        SELECT source, (t - s) / (n - k) AS effect_without FROM (
          SELECT source, s, k, sum(s) OVER () AS t, sum(k) OVER () AS n FROM (
            SELECT d.source, CAST(sum(l.toxic) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS k FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source) a) b""",
    "sta25_repository_prevalence": """
        SELECT source, CASE WHEN a > h THEN 'higher' WHEN a < h THEN 'lower' ELSE 'equal' END AS direction, CASE WHEN a + h > 0 THEN a / (a + h) END AS score FROM (
          SELECT d.source, avg(CASE WHEN d.lang = 'en' THEN CAST(toxic AS DOUBLE) END) AS a, avg(CASE WHEN d.lang <> 'en' THEN CAST(toxic AS DOUBLE) END) AS h,
                 sum(CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END) AS na, sum(CASE WHEN d.lang <> 'en' THEN 1 ELSE 0 END) AS nh
          FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source) x WHERE na >= 3 AND nh >= 3""",
    # ---- review
    "rev03_disagreements": """
        SELECT l_partkey AS case_id, CAST(count(DISTINCT concat(l_returnflag, l_linestatus)) AS BIGINT) AS signatures, CAST(count(*) AS BIGINT) AS reviews FROM {lineitem}
        GROUP BY l_partkey HAVING count(DISTINCT concat(l_returnflag, l_linestatus)) > 1""",
    "rev06_frame_batches": """
        SELECT doc_id, CAST(floor((r - 1) / 50) AS INT) AS batch FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('9:', CAST(doc_id AS VARCHAR(20)))), doc_id) AS r FROM {documents}) x""",
}


def _query(name: str):
    sql = STATEMENTS[name]
    sql = sql if isinstance(sql, str) else sql[0]
    used = [t for t in TABLES if f"{{{t}}}" in sql]

    def run(spark, sf_dir):
        # braces of regular expressions are no placeholders
        text = re.sub(r"\{(?!(?:%s)\})" % "|".join(TABLES), "{{", sql)
        text = re.sub(r"(?<!\w)((?:\{\{)[^{}]*)\}", r"\1}}", text)
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    run.__name__ = name
    return run


def _oracle(sql: str | tuple[str, str]) -> str:
    if isinstance(sql, tuple):
        return sql[1]
    return re.sub(r"\{(%s)\}" % "|".join(TABLES), r"\1", sql)


QUERIES = {name: _query(name) for name in STATEMENTS}
ORACLES = {name: _oracle(sql) for name, sql in STATEMENTS.items()}
