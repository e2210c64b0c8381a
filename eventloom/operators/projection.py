"""Incremental projections: a fold over each session with the last folded event as watermark, and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session_set import materialize
from . import sequence


def advance(state: DataFrame | None, entries: DataFrame, value: Column, merge=F.sum) -> DataFrame:
    """(session_id, value, watermark_event_id): fold the entries behind each state's watermark.

    ``merge`` is an associative aggregate, so partial results meet before the shuffle; the
    watermark is the entry of the greatest rank.
    """
    rows = materialize(sequence.ranked(entries).withColumn("_v", value).select("session_id", "event_id", "rank", "_v"))
    if state is None:
        return rows.groupBy("session_id").agg(merge("_v").alias("value"), F.max_by("event_id", "rank").alias("watermark_event_id"))
    known = rows.select("session_id", F.col("event_id").alias("watermark_event_id"), F.col("rank").alias("_w"))
    old = state.join(known, ["session_id", "watermark_event_id"], "left")
    new = rows.join(old.select("session_id", "_w"), "session_id", "left").filter("_w is null or rank > _w")
    parts = new.select("session_id", "_v", "event_id", "rank").union(old.select("session_id", "value", "watermark_event_id", F.coalesce("_w", F.lit(-1))))
    return parts.groupBy("session_id").agg(merge("_v").alias("value"), F.max_by("event_id", "rank").alias("watermark_event_id"))


def ordered_fold(entries: DataFrame, zero: Column, value: Column, step) -> DataFrame:
    """As ``advance`` from nothing, for a fold that depends on the order: ``step(state, value)`` over the ordered values.

    Gathers one session's values in a row; meant for sessions of bounded length.
    """
    rows = sequence.ranked(entries).withColumn("_v", value)
    g = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "_v"))).alias("a"), F.max_by("event_id", "rank").alias("watermark_event_id"))
    return g.select("session_id", F.aggregate("a", zero, lambda s, x: step(s, x["_v"])).alias("value"), "watermark_event_id")


def shadowed(state: DataFrame, compacted: DataFrame) -> DataFrame:
    """state with ``shadowed``: its watermark is among the shadowed ids; a state without watermark is not."""
    gone = compacted.select("session_id", F.explode("shadowed_ids").alias("watermark_event_id")).distinct().withColumn("_s", F.lit(True))
    return state.join(gone, ["session_id", "watermark_event_id"], "left").withColumn("shadowed", F.coalesce("_s", F.lit(False))).drop("_s")


def needs_rebuild(state: DataFrame, compacted: DataFrame, entries: DataFrame) -> DataFrame:
    """state joined with each summary of its session, with ``stale``.

    None without a watermark is stale; a shadowed one is; else the watermark must be live
    and stand before a live checkpoint.
    """
    ranks = materialize(sequence.ranked(entries).select("session_id", "event_id", "rank"))
    gone = compacted.select("session_id", "compaction_id", F.explode("shadowed_ids").alias("watermark_event_id")).distinct().withColumn("_s", F.lit(True))
    rows = state.join(compacted.select("session_id", "compaction_id", "checkpoint_event_id"), "session_id")
    rows = rows.join(gone, ["session_id", "compaction_id", "watermark_event_id"], "left")
    rows = rows.join(ranks.select("session_id", F.col("event_id").alias("watermark_event_id"), F.col("rank").alias("_w")), ["session_id", "watermark_event_id"], "left")
    rows = rows.join(ranks.select("session_id", F.col("event_id").alias("checkpoint_event_id"), F.col("rank").alias("_c")), ["session_id", "checkpoint_event_id"], "left")
    stale = F.when(F.col("watermark_event_id").isNull(), False).when(F.col("_s"), True).when(F.col("_w").isNull() | F.col("_c").isNull(), True)
    return rows.withColumn("stale", stale.otherwise(F.col("_w") >= F.col("_c"))).drop("_w", "_c", "_s")
