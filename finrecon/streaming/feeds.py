"""Streams (S): observation feeds with event time, insert-only history, running pools and yearly roll-ups.

The batch code gives the rules; a stream keeps state only where a rule needs earlier rows. Each query below runs its stream over the given tables to the end of
what is there, with a checkpoint in the shared folder, and returns what the sink holds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from finrecon.functions import periods as pr
from finrecon.operators.filters import added_facts, batch_facts, reason_of
from finrecon.operators.pools import rank_of
from finrecon.plans.registry import query
from finrecon.streaming.history import first_values, high_ones, keyed_state

TTL = "7 days"
#: Files of a micro-batch.
FILES = 100


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; on one machine, as in tests, in a folder of our own if that is unset. A cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of observations."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", FILES).parquet(f"{sf_dir}/event[s].parquet")
    return raw.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("company_id"), F.col("event_type").alias("raw_label"), F.col("ts").cast("timestamp").alias("observed_at"), "value",
        F.when(F.col("event_id") % 3 == 0, "xbrl").when(F.col("event_id") % 3 == 1, "screener").otherwise("yfinance").alias("source"),
    )


def drained(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None] | None = None, name: str = "feed") -> str:
    """Run a stream over all that is there into a parquet folder (or through each) and give the folder."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{out}-state").outputMode(mode).trigger(availableNow=True)
    writer = writer.foreachBatch(each(out) if each else (lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")))
    run = writer.start()
    try:
        run.awaitTermination()
    finally:
        run.stop()
    return out


def fresh_batches(feed: DataFrame, ttl: str = TTL) -> DataFrame:
    """Observations without repeats of a source's company, label and time within the time to live; later than that they count anew."""
    return feed.withWatermark("observed_at", ttl).dropDuplicatesWithinWatermark(["source", "company_id", "raw_label", "observed_at"])


S1_SQL = """with e as (select event_id as seq, user_id as company_id, event_type as raw_label, ts, value, case event_id % 3 when 0 then 'xbrl' when 1 then 'screener' else 'yfinance' end as source from events),
 d as (select source, company_id, raw_label, ts, arg_min(value, seq) as value from e group by 1, 2, 3, 4),
 b as (select source, company_id, cast(ts as date) as day, count(*) as n, sum(abs(value)) as total, bool_or(abs(value) > 1) as big, bool_or(length(regexp_replace(raw_label, '[^A-Za-z]', '', 'g')) > 4) as named from d group by 1, 2, 3)
 select source, company_id, cast(max(day) as varchar) as day, arg_max(n, day) as items from b where n >= 3 and total > 0 and big and named group by 1, 2"""


@query("s1_fresh_batches", S1_SQL)
def s1(spark, sf_dir):
    """The newest sound batch, a day's observations, of each source and company. A micro-batch stores the facts of its part of a day; parts add up, so a day may come in several."""
    keys = ["source", "company_id", "day"]

    def each(out: str):
        def put(df: DataFrame, batch: int) -> None:
            batch_facts(df.withColumn("day", F.to_date("observed_at")), keys).write.mode("overwrite").parquet(f"{out}/batch={batch}")

        return put

    out = drained(fresh_batches(events_stream(spark, sf_dir)), "append", each, "fresh")
    sound = added_facts(spark.read.parquet(out), keys).where(reason_of(3).isNull())
    return sound.groupBy("source", "company_id").agg(F.max_by("n", "day").alias("items"), F.max("day").cast("string").alias("day"))


@query("s2_history_upsert", "select user_id as company_id, event_type as concept, cast(year(ts) as integer) as fy, arg_min(value, event_id) as value from events where value > 50 group by 1, 2, 3")
def s2(spark, sf_dir):
    """Insert-only history in keyed state; each batch writes its new keys into its own folder, so a repeated batch writes the same again."""

    def each(out: str):
        return lambda df, batch: df.drop("seq").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    with keyed_state(spark):
        out = drained(first_values(high_ones(events_stream(spark, sf_dir))), "append", each, "history")
    return spark.read.parquet(out).select("company_id", "concept", "fy", "value")


S3_SQL = "with e as (select event_id as seq, user_id as company_id, event_type as raw_label, value, case event_id % 3 when 0 then 100 when 1 then 60 else 40 end as r from events) select company_id, raw_label, arg_max(value, r::bigint * 1000000000 - seq) as value, count(*) as n from e group by 1, 2"


@query("s3_running_pool", S3_SQL)
def s3(spark, sf_dir):
    """The best value of each cell so far, in update mode; the sink keeps the last row of a cell."""
    feed = events_stream(spark, sf_dir)
    best = feed.groupBy("company_id", "raw_label").agg(F.max_by("value", F.struct(rank_of(F.col("source")), -F.col("seq"))).alias("value"), F.count("*").alias("n"))

    def each(out: str):
        return lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    rows = spark.read.parquet(drained(best, "update", each, "pool"))
    return rows.groupBy("company_id", "raw_label").agg(F.max_by("value", "n").alias("value"), F.max("n").alias("n"))


S4_SQL = "select user_id as company_id, event_type as concept, cast(case when month(ts) >= 4 then year(ts) + 1 else year(ts) end as integer) as fy, cast(sum(cast(value as decimal(18,2))) as double) as value, count(*) as n from events group by 1, 2, 3"


@query("s4_yearly_rollup", S4_SQL)
def s4(spark, sf_dir):
    """Sums by fiscal year in update mode; the year is a key, so late rows correct it."""
    feed = events_stream(spark, sf_dir)
    fy = pr.fiscal_year(F.to_date("observed_at"))
    year = feed.groupBy("company_id", F.col("raw_label").alias("concept"), fy.alias("fy")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"), F.count("*").alias("n"))

    def each(out: str):
        return lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    rows = spark.read.parquet(drained(year, "update", each, "years"))
    return rows.groupBy("company_id", "concept", "fy").agg(F.max_by("value", "n").alias("value"), F.max("n").alias("n"))
