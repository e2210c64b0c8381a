"""The driver's tables as sessions.

``events`` are session logs: one session a user, ordered by event_id; view, click and
purchase are surface events, signup opens and error closes a turn.  ``conversations`` are
legacy logs: one session a conversation, dense in turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.sequence import ranked
from .plans.session_set import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, rank, order, event_id, blob_id, n, type, surface, k, user_id), written once for all that reads it."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), "user_id", F.col("event_id").cast("long").alias("n"), "event_type", F.regexp_extract("props", r'"k": (\d+)', 1).try_cast("long").alias("k"))
    rows = ranked(rows, "n").withColumn("order", F.col("rank").cast("double"))
    kind = F.when(F.col("event_type") == "signup", "turn/start").when(F.col("event_type") == "error", "turn/end").otherwise(F.col("event_type"))
    rows = rows.withColumn("event_id", F.concat(F.lit("evt_"), "session_id", F.lit("_"), F.col("rank").cast("string"))).withColumn("blob_id", F.concat(F.lit("blob_"), F.col("rank").cast("string")))
    return materialize(rows.select("session_id", "rank", "order", "event_id", "blob_id", "n", kind.alias("type"), F.col("event_type").isin("view", "click", "purchase").alias("surface"), "k", "user_id"))


def entries(log: DataFrame) -> DataFrame:
    return log.select("session_id", "order", "event_id", "blob_id")


def references(log: DataFrame) -> DataFrame:
    """Each purchase cites the up to two events before it."""
    to = F.filter(F.array(F.col("rank") - 2, F.col("rank") - 1), lambda r: r >= 0)
    rows = log.filter((F.col("type") == "purchase") & (F.col("rank") > 0))
    return rows.select("session_id", F.col("event_id").alias("from_event_id"), F.lit("sourceEventIds").alias("ref_name"), F.transform(to, lambda r: F.concat(F.lit("evt_"), F.col("session_id"), F.lit("_"), r.cast("string"))).alias("to_event_ids"))


def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as legacy events; an assistant turn cites the one before."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "user/message").when(F.col("role") == "assistant", "assistant/message").otherwise("note")
    msg = F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("id"), F.col("role"), F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))).alias("content"), F.when(F.col("role") == "user", F.struct(F.lit("user").alias("kind"), F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("model"))).otherwise(F.struct(F.lit("model").alias("kind"), F.lit("p").alias("provider"), F.lit("m").alias("model"))).alias("source"))
    data = F.when(F.col("role") == "assistant", F.to_json(F.struct(msg.alias("message")))).otherwise(F.to_json(msg))
    surface = F.col("role").isin("user", "assistant")
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"), F.lit(0).alias("version"), F.col("turn").cast("long").alias("seq"), kind.alias("type"), (F.lit(1700000000000) + F.col("turn")).cast("long").alias("time"), data.alias("data"),
        F.when(surface, "append").alias("surface_op"), F.when((F.col("role") == "assistant") & (F.col("turn") > 0), F.array((F.col("turn") - 1).cast("long"))).alias("source_event_seqs"), F.when(~surface, True).alias("ignorable"),
    )
