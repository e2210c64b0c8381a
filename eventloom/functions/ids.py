"""Identifier grammars: rev-<n>, evt_<session>_<n>, blob_<n>, page_<n>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MAX_SAFE


def _safe(digits: Column) -> Column:
    """A decimal string as a safe integer, else null."""
    n = digits.try_cast("decimal(38,0)")
    return F.when((n >= 0) & (n <= MAX_SAFE), n.cast("long"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revision_number(token: Column | str) -> Column:
    """n of ``rev-<n>``; null for anything else and beyond safe integers."""
    c = _col(token)
    return F.when(c.rlike(r"\Arev-[0-9]+\z"), _safe(F.substring(c, 5, 40)))


def next_revision(token: Column | str) -> Column:
    n = revision_number(token)
    return F.when(n < MAX_SAFE, F.concat(F.lit("rev-"), (n + 1).cast("string")))


def event_id(session_id: Column | str, counter: Column | str) -> Column:
    n = _col(counter)
    return F.when((n >= 0) & (n < MAX_SAFE), F.concat(F.lit("evt_"), _col(session_id), F.lit("_"), n.cast("string")))


def blob_number(blob_id: Column | str) -> Column:
    """n of a canonical ``blob_<n>`` (no leading zeros)."""
    c = _col(blob_id)
    return F.when(c.rlike(r"\Ablob_(0|[1-9][0-9]*)\z"), _safe(F.substring(c, 6, 40)))


def blob_id(number: Column | str) -> Column:
    return F.concat(F.lit("blob_"), _col(number).cast("string"))


def page_number(page_id: Column | str) -> Column:
    c = _col(page_id)
    return F.when(c.rlike(r"\Apage_(0|[1-9][0-9]*)\z"), _safe(F.substring(c, 6, 40)))


def trailing_number(event: Column | str) -> Column:
    """n of a trailing ``_<n>``; null without one, -1 beyond safe integers."""
    c = _col(event)
    digits = F.regexp_extract(c, r"_([0-9]+)\z", 1)
    return F.when(digits != "", F.coalesce(_safe(digits), F.lit(-1).cast("long")))


def own_number(session_id: Column | str, event: Column | str) -> Column:
    """n of ``evt_<session_id>_<n>`` of that session; foreign ids give null."""
    s, c = _col(session_id), _col(event)
    head = F.concat(F.lit("evt_"), s, F.lit("_"))
    rest = F.expr("null").cast("string")
    rest = F.when(c.startswith(head), F.substring(c, F.length(head) + 1, F.length(c)))
    return F.when(rest.rlike(r"\A[0-9]+\z"), _safe(rest))


def high_watermarks(entries: DataFrame, compacted: DataFrame, bindings: DataFrame, blobs: DataFrame) -> DataFrame:
    """session_id, next_event_counter, blob_id_watermark: least values above every id in use, foreign prefixes included."""
    ids = entries.select("session_id", "event_id").unionByName(bindings.select("session_id", "event_id"))
    ids = ids.unionByName(compacted.select("session_id", F.explode("shadowed_ids").alias("event_id")))
    top = ids.groupBy("session_id").agg((F.coalesce(F.max(trailing_number("event_id")), F.lit(-1)) + 1).alias("next_event_counter"), F.min(trailing_number("event_id")).alias("_least"))
    top = top.withColumn("next_event_counter", F.when(F.coalesce(F.col("_least"), F.lit(0)) >= 0, F.col("next_event_counter"))).drop("_least")
    marks = blobs.groupBy("session_id").agg(F.coalesce(F.max(blob_number("blob_id")), F.lit(0)).alias("blob_id_watermark"))
    return top.join(marks, "session_id", "full")
