"""A stream of delivered rows ends as the same store as the rows at once."""

import datetime as dt

from triloom.operators.deliveries import DeliveryStore, record_identifier
from triloom.runtime import new_table_dir
from triloom.streaming.deliveries import ingest

SCHEMA = "rec_id bigint, run_id string, p double, algo string, loaded_at timestamp_ntz"


def test_stream(spark):
    t = dt.datetime(2026, 1, 1)
    root = new_table_dir(spark, "stream")
    parts = [
        [(1, "a_o01_run1", 0.5, "x", t), (2, "a_o1_run1", 0.5, "X", t), (3, "b_o1_run1", 0.5, "x", t)],
        [(4, "A-o1-run1", 0.5, "x", t + dt.timedelta(days=1)), (5, "b_o1_run1", 0.6, "x", t)],
    ]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        ingest(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), f"{root}/store", record_identifier, f"{root}/checkpoint").awaitTermination()
        store = DeliveryStore(spark, f"{root}/store", record_identifier())
        assert store.state()["version"] == i + 1
    assert sorted(r["rec_id"] for r in store.current().collect()) == [3, 4, 5]
    assert sorted(r["rec_id"] for r in store.dropped().collect()) == [1, 2]
    ingest(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), f"{root}/store", record_identifier, f"{root}/checkpoint").awaitTermination()
    assert store.state()["version"] == 2
