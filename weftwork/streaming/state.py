"""Keyed state of plans: saves and deletes as a stream into a versioned table, one row a plan, that survives restarts.

An operation counts by its time: what is older than a plan's last one changes nothing, so that batches may come again or out of
order. A deleted plan keeps a row without a state until it expires, against saves that are older than the delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..scratch import materialize, release
from ..sources.versioned import current, delete_rows, read_table, replace_table, upsert_table

SCHEMA = "plan_id string, at timestamp, op string, state string"
SAVE, DELETE = "save", "delete"
BUCKETS = 16


def _last(ops: DataFrame) -> DataFrame:
    """The last operation of each plan; of several at one time a delete, else the greatest state. Partial before the shuffle."""
    known = ops.where(F.col("plan_id").isNotNull() & F.col("at").isNotNull() & F.col("op").isin(SAVE, DELETE))
    kept = F.when(F.col("op") == SAVE, F.col("state"))
    newest = known.groupBy("plan_id").agg(F.max(F.struct("at", (F.col("op") == DELETE).alias("gone"), kept.alias("state"))).alias("m"))
    return newest.select("plan_id", "m.at", F.when(F.col("m.gone"), DELETE).otherwise(SAVE).alias("op"), "m.state")


def apply_operations(ops: DataFrame, path: str) -> None:
    """Apply saves and deletes (plan_id, at, op, state) to the states at `path`, which are made if there are none. Rows
    without a plan or time, and other operations, are left out. Applying rows again changes nothing."""
    spark = ops.sparkSession
    if current(spark, path) is None:
        replace_table(spark.createDataFrame([], SCHEMA), path, ["plan_id"], BUCKETS)
    new = materialize(_last(ops.select("plan_id", F.col("at").cast("timestamp").alias("at"), "op", "state")), "ops")
    there = read_table(spark, path).join(new.select("plan_id"), "plan_id", "left_semi")
    changed = _last(there.unionByName(new)).exceptAll(there)
    upsert_table(changed, path)
    release(new)


def states(spark: SparkSession, path: str) -> DataFrame:
    """(plan_id, at, state) of the plans that are saved."""
    found = read_table(spark, path)
    rows = spark.createDataFrame([], SCHEMA) if found is None else found
    return rows.where(F.col("op") == SAVE).select("plan_id", "at", "state")


def load_state(spark: SparkSession, path: str, plan_id: str) -> str | None:
    """The state of a plan; None if it isn't saved."""
    row = states(spark, path).where(F.col("plan_id") == plan_id).first()
    return None if row is None else row["state"]


def expire(spark: SparkSession, path: str, before: Column) -> int:
    """Drop plans whose last operation is before a time; how many rows went."""
    return delete_rows(spark, path, F.col("at") < before)[1]


def state_stream(ops: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of operations batch by batch, then stop."""
    return ops.writeStream.foreachBatch(lambda batch, _: apply_operations(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
