"""The insert-only history over many batches, after a restart, and after a year is closed."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from finrecon.plans.shipping import shipped
from finrecon.streaming import history

SCHEMA = "company_id long, concept string, fy int, value double, seq long, observed_at timestamp"


def put(spark, folder, k, rows):
    """One file for a batch, named so that files are read in order."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")


def run(spark, folder):
    feed = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with history.keyed_state(spark):
        writer = history.first_values(feed).writeStream.option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True)
        query = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")).start()
        query.awaitTermination()
    return sorted((r["company_id"], r["concept"], r["fy"], r["value"], r["seq"]) for r in spark.read.parquet(f"{folder}/out").drop("batch").collect())


def test_history_over_batches_and_a_restart(spark, tmp_path):
    shipped(spark)
    draw, day, held, seq, batch = random.Random(1), datetime(2023, 1, 5), {}, 0, 0
    for part in range(2):
        for _ in range(4):
            rows = []
            for _ in range(25):
                seq += 1
                rows.append((draw.randint(1, 4), draw.choice("ab"), day.year, round(draw.uniform(50, 100), 2), seq, day + timedelta(hours=draw.randint(0, 23))))
            day += timedelta(days=3)
            put(spark, tmp_path, batch, rows)
            for r in sorted(rows, key=lambda r: r[4]):
                held.setdefault(r[:3], (r[3], r[4]))
            batch += 1
        assert run(spark, tmp_path) == sorted((*k, *v) for k, v in held.items())


def test_closed_years_take_no_rows(spark, tmp_path):
    shipped(spark)
    at = lambda y, m, d: datetime(y, m, d)
    put(spark, tmp_path, 0, [(1, "a", 2023, 60.0, 1, at(2023, 12, 30))])
    put(spark, tmp_path, 1, [(1, "a", 2024, 61.0, 2, at(2024, 3, 1)), (2, "a", 2023, 62.0, 3, at(2023, 12, 31))])
    put(spark, tmp_path, 2, [(3, "a", 2023, 63.0, 4, at(2023, 12, 31)), (1, "a", 2024, 64.0, 5, at(2024, 3, 2))])
    assert run(spark, tmp_path) == [(1, "a", 2023, 60.0, 1), (1, "a", 2024, 61.0, 2), (2, "a", 2023, 62.0, 3)]
    # State of 2023 is gone once a later batch has moved the watermark.
    put(spark, tmp_path, 3, [(1, "b", 2024, 65.0, 6, at(2024, 4, 1))])
    assert (1, "b", 2024, 65.0, 6) in run(spark, tmp_path)
    with history.keyed_state(spark):
        state = spark.read.format("statestore").option("stateVarName", "stored").load(f"{tmp_path}/state")
        assert {r["fy"] for r in state.select(F.col("key.fy").alias("fy")).collect()} == {2024}
