import datetime
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.lineage import trace_cases
from plumbline.streaming.cases import trace_stream

DAY0 = datetime.datetime(2024, 1, 1)
CUTOFF = datetime.datetime(2024, 2, 20)
SCHEMA = "user_id long, ts timestamp, event_id long, event_type string"


def made(seed, n):
    rnd = random.Random(seed)
    return [(rnd.randrange(12), DAY0 + datetime.timedelta(seconds=rnd.randrange(50 * 86_400), microseconds=rnd.choice([0, 1, 999_999])), i, rnd.choice(["error", "view", "click", "purchase", "view"])) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 4])
def test_micro_batches_give_the_batch_result(spark, tmp_path, parts):
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = sorted(made(parts, 400), key=lambda r: r[1])
        want = sorted(map(repr, (tuple(r) for r in trace_cases(spark.createDataFrame(rows, SCHEMA), "error", "purchase", str(CUTOFF), 9).collect())))
        assert any("True" in w for w in want) and any("False" in w for w in want)
        size = -(-len(rows) // parts)
        got = []
        for k in range(parts + 1):
            # within a batch and its neighbour events come in any order; the last batch is an event behind all windows
            part = rows[k * size : (k + 1) * size] if k < parts else [(10**6, CUTOFF + datetime.timedelta(days=30), 10**6, "view")]
            random.Random(k).shuffle(part)
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
            found = trace_stream(stream, "error", "purchase", CUTOFF, 9, "0 seconds")
            query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
            query.awaitTermination()
        out = spark.read.parquet(f"{tmp_path}/out")
        got = sorted(map(repr, (tuple(r) for r in out.select("case", "opened_id", "opened_at", "follow_ups", "first_mitigation", "closed_at", "censored").collect())))
        assert got == want
    finally:
        spark.conf.set(store, before)
