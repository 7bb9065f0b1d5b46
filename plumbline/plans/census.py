"""Census and linkage over the driver's tables: foreign keys are audited, never assumed."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.runtime import table


def fk_audit_orders(spark, sf_dir):
    """JON-08: lineitem to orders, orders to customer; linked, missing or orphan."""
    orders, items, people = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    parts = []
    for name, child, key, parent, pk in (
        ("lineitem.l_orderkey", items, "l_orderkey", orders, "o_orderkey"),
        ("orders.o_custkey", orders, "o_custkey", people, "c_custkey"),
    ):
        keys = parent.select(F.col(pk).alias("_key")).distinct()
        status = F.when(F.col(key).isNull(), "missing_foreign_key").when(F.col("_key").isNull(), "orphan").otherwise("linked")
        counted = child.groupBy(key).agg(F.count("*").alias("_n"))
        parts.append(
            counted.join(keys, F.col(key) == F.col("_key"), "left")
            .groupBy(F.lit(name).alias("relation"), status.alias("status"))
            .agg(F.sum("_n").alias("n_rows"))
        )
    return parts[0].unionByName(parts[1])


QUERIES = {"fk_audit_orders": fk_audit_orders}

ORACLES = {
    "fk_audit_orders": """
SELECT 'lineitem.l_orderkey' AS relation,
       CASE WHEN l_orderkey IS NULL THEN 'missing_foreign_key' WHEN o.k IS NULL THEN 'orphan' ELSE 'linked' END AS status,
       CAST(count(*) AS BIGINT) AS n_rows
FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey AS k FROM orders) o ON l_orderkey = o.k GROUP BY 1, 2
UNION ALL
SELECT 'orders.o_custkey',
       CASE WHEN o_custkey IS NULL THEN 'missing_foreign_key' WHEN c.k IS NULL THEN 'orphan' ELSE 'linked' END,
       CAST(count(*) AS BIGINT)
FROM orders LEFT JOIN (SELECT DISTINCT c_custkey AS k FROM customer) c ON o_custkey = c.k GROUP BY 1, 2
""",
}
