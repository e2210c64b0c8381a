"""Ordered sequences of many sessions: rank, lookup, append, replace, remove, split, layout.

``entries`` is (session_id, order, event_id, blob_id).  Ranks are dense from 0 in the
order of ``order``.  A session may hold a large part of all entries, so ranks are counted
within order-preserving buckets of one session and the counts of earlier buckets added.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.session_set import materialize
from ..schemas import FANOUT

#: Width of a bucket of order keys.
BUCKET = 65536


def ranked(entries: DataFrame, by: str | tuple[str, ...] = "order", key: str = "session_id", width: int = BUCKET) -> DataFrame:
    """The frame with ``rank``: position in its session by a numeric column, and by further ones where that is equal.

    Every row stays: a null key is a session of its own, and a null in the column gives a null rank.
    """
    by = (by,) if isinstance(by, str) else by
    rows = entries.withColumn("_b", F.floor(F.col(by[0]) / width))
    before = rows.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    counts = F.sum("_n").over(Window.partitionBy("_k").orderBy(F.asc_nulls_last("_c")).rowsBetween(Window.unboundedPreceding, -1))
    before = before.withColumn("_before", F.coalesce(counts, F.lit(0))).drop("_n")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*by)))
    both = rows.join(before, rows[key].eqNullSafe(before["_k"]) & rows["_b"].eqNullSafe(before["_c"]))
    return both.withColumn("rank", F.when(F.col("_b").isNotNull(), F.col("_before") + F.col("_r") - 1).cast("long")).drop("_b", "_r", "_before", "_k", "_c")


def renumber(entries: DataFrame) -> DataFrame:
    """Dense orders 0 .. n-1."""
    return ranked(entries).withColumn("order", F.col("rank").cast("double")).drop("rank")


def size(sessions: DataFrame, entries: DataFrame) -> DataFrame:
    n = entries.groupBy("session_id").agg(F.count("*").alias("size"))
    return sessions.select("session_id").join(n, "session_id", "left").withColumn("size", F.coalesce("size", F.lit(0)))


def rank_of(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (session_id, event_id) with rank; null where absent."""
    return wanted.join(ranked(entries).select("session_id", "event_id", "rank"), ["session_id", "event_id"], "left")


def at(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (session_id, rank) with the entry there; nulls where out of range."""
    return wanted.join(ranked(entries).select("session_id", "rank", "event_id", "blob_id"), ["session_id", "rank"], "left")


def violations(entries: DataFrame) -> DataFrame:
    """(session_id, rule, subject): duplicate ids, orders that are not finite or not strictly increasing (equal)."""
    twice = entries.groupBy("session_id", "event_id").count().filter("count > 1").select("session_id", F.lit("duplicate-event").alias("rule"), F.col("event_id").alias("subject"))
    same = entries.groupBy("session_id", "order").count().filter("count > 1").select("session_id", F.lit("duplicate-order").alias("rule"), F.col("order").cast("string").alias("subject"))
    odd = entries.filter(F.col("order").isNull() | F.isnan("order") | F.col("order").isin(float("inf"), float("-inf"))).select("session_id", F.lit("order-not-finite").alias("rule"), F.col("event_id").alias("subject"))
    return twice.unionByName(same).unionByName(odd)


def insert(entries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with ``new``, violations)."""
    both = entries.unionByName(new.select(entries.columns))
    return both, violations(both)


def append(entries: DataFrame, bindings: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append (session_id, seq, event_id, blob_id) behind the last entry of each session, in order of seq.

    Returns (entries, violations): ids ever bound in the lineage are refused.  Where an order
    would not lie above the one before any more (beyond 2**53, or by rounding), the session
    is renumbered densely, as single appends would leave it.
    """
    n_new = new.groupBy("session_id").agg(F.count("*").alias("_new"))
    last = entries.groupBy("session_id").agg(F.max("order").alias("last"), F.count("*").alias("n")).join(n_new, "session_id")
    last = materialize(last.withColumn("full", (F.col("last") + F.col("_new") > 2.0**53) | (F.col("last") + 1 <= F.col("last"))))
    full = last.filter("full").select("session_id")
    if full.limit(1).count():
        dense = renumber(entries.join(full, "session_id", "left_semi")).select(entries.columns)
        entries = entries.join(full, "session_id", "left_anti").unionByName(dense)
    last = last.select("session_id", F.when(F.col("full"), (F.col("n") - 1).cast("double")).otherwise(F.col("last")).alias("last"))
    more = ranked(new, "seq").join(last, "session_id", "left")
    more = materialize(more.select("session_id", (F.coalesce("last", F.lit(-1.0)) + 1 + F.col("rank")).alias("order"), "event_id", "blob_id"))
    used = more.join(bindings.select("session_id", "event_id"), ["session_id", "event_id"], "left_semi")
    twice = more.groupBy("session_id", "event_id").count().filter("count > 1")
    bad = used.select("session_id", "event_id").unionByName(twice.select("session_id", "event_id")).select("session_id", F.lit("event-reused").alias("rule"), F.col("event_id").alias("subject"))
    return entries.unionByName(more), bad


def minted(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """new (session_id, seq, ..) with event and blob ids minted from each session's counters."""
    rows = ranked(new, "seq").join(sessions.select("session_id", "next_event_counter", "blob_id_watermark"), "session_id")
    rows = rows.withColumn("event_id", ids.event_id("session_id", F.col("next_event_counter") + F.col("rank")))
    return rows.withColumn("blob_id", ids.blob_id(F.col("blob_id_watermark") + 1 + F.col("rank"))).drop("next_event_counter", "blob_id_watermark")


def range_refusals(entries: DataFrame, bounds: DataFrame, new: DataFrame) -> DataFrame:
    """(session_id, rule, subject): why a replacement is refused: inverted bounds, and new ids that live on outside the range or come twice."""
    inverted = bounds.filter("lo > hi or lo < 0").select("session_id", F.lit("range-inverted").alias("rule"), F.concat_ws("-", "lo", "hi").alias("subject"))
    twice = new.groupBy("session_id", "event_id").count().filter("count > 1").select("session_id", F.lit("event-reused").alias("rule"), F.col("event_id").alias("subject"))
    used = new.join(entries.select("session_id", "event_id"), ["session_id", "event_id"], "left_semi").select("session_id", F.lit("event-reused").alias("rule"), F.col("event_id").alias("subject"))
    return inverted.unionByName(twice).unionByName(used).distinct()


def replace_events(entries: DataFrame, bindings: DataFrame, bounds: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``replace_range`` between two events (session_id, first_id, last_id); (entries, refusals).

    Both ids must be live and in order, and no id of the lineage (bindings) may come again.
    Sessions with a refusal stay as they are.
    """
    ranks = materialize(ranked(entries).select("session_id", "event_id", "rank"))
    place = lambda c, to: ranks.select("session_id", F.col("event_id").alias(c), F.col("rank").alias(to))
    at = materialize(bounds.join(place("first_id", "lo"), ["session_id", "first_id"], "left").join(place("last_id", "hi"), ["session_id", "last_id"], "left"))
    unknown = at.select("session_id", F.explode(F.array(F.struct(F.col("first_id").alias("id"), F.col("lo").alias("at")), F.struct(F.col("last_id").alias("id"), F.col("hi").alias("at")))).alias("x")).filter("x.at is null")
    bad = unknown.select("session_id", F.lit("unknown-event").alias("rule"), F.col("x.id").alias("subject"))
    lineage = bindings.select("session_id", "event_id").union(entries.select("session_id", "event_id")).distinct()
    bad = materialize(bad.unionByName(range_refusals(lineage, at.filter("lo is not null and hi is not null"), new)).distinct())
    refused = bad.select("session_id").distinct()
    good = at.join(refused, "session_id", "left_anti").select("session_id", "lo", "hi")
    return replace_range(entries, good, new.join(good.select("session_id"), "session_id", "left_semi")), bad


def replace_range(entries: DataFrame, bounds: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the ranks lo .. hi of each session of ``bounds`` (session_id, lo, hi) by ``new`` (session_id, sub, event_id, blob_id).

    Sessions in ``bounds`` get dense orders; with nothing new the range is deleted.
    """
    rows = materialize(ranked(entries).join(bounds, "session_id", "left"))
    old = rows.filter("lo is not null and (rank < lo or rank > hi)").select("session_id", "event_id", "blob_id", F.col("rank").alias("pos"), F.lit(0).cast("long").alias("sub"))
    put = new.join(bounds, "session_id").select("session_id", "event_id", "blob_id", F.col("lo").cast("long").alias("pos"), (F.col("sub") + 1).cast("long").alias("sub"))
    dense = ranked(old.unionByName(put), ("pos", "sub")).select("session_id", F.col("rank").cast("double").alias("order"), "event_id", "blob_id")
    return dense.unionByName(rows.filter("lo is null").select("session_id", "order", "event_id", "blob_id"))


def remove(entries: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(survivors with their sparse orders, violations: ids that are not there)."""
    unknown = gone.join(entries, ["session_id", "event_id"], "left_anti").select("session_id", F.lit("unknown-event").alias("rule"), F.col("event_id").alias("subject"))
    return entries.join(gone, ["session_id", "event_id"], "left_anti").select(entries.columns), unknown


def split_at_rank(entries: DataFrame, cuts: DataFrame) -> DataFrame:
    """Entries with ``side``: left for the first ``cut`` ranks of (session_id, cut)."""
    rows = ranked(entries).join(cuts, "session_id")
    return rows.withColumn("side", F.when(F.col("rank") < F.col("cut"), "left").otherwise("right")).drop("cut")


def split_at_order(entries: DataFrame, at_order: float) -> tuple[DataFrame, DataFrame]:
    """Entries up to an order, and behind it."""
    if not math.isfinite(at_order):
        raise ValueError("the bound of a split must be finite")
    return entries.filter(F.col("order") <= at_order), entries.filter(F.col("order") > at_order)


def split_at_event(entries: DataFrame, boundaries: DataFrame) -> DataFrame:
    """As ``split_at_rank`` behind the event of (session_id, event_id); unknown ids are an error."""
    ranks = rank_of(entries, boundaries)
    if lost := ranks.filter("rank is null").limit(3).collect():
        raise ValueError("unknown events: " + ", ".join(f"{r.session_id}: {r.event_id}" for r in lost))
    cuts = ranks.select("session_id", (F.col("rank") + 1).alias("cut"))
    return split_at_rank(entries, cuts)


def leaf_layout(entries: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(session_id, level, page_no, n, first_rank, last_rank) of the packed tree; level 0 are leaves.

    Leaves hold ``fanout`` entries, parents as many children; a lone last child joins its left sibling's parent.
    """
    rows = ranked(entries).select("session_id", F.floor(F.col("rank") / fanout).alias("page_no"), "rank")
    level = rows.groupBy("session_id", "page_no").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))
    out = level.withColumn("level", F.lit(0))
    k, most = 0, entries.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    pages = -(-most // fanout)
    while pages > 1:
        k += 1
        total = level.groupBy("session_id").agg(F.count("*").alias("total"))
        up = level.join(total, "session_id").filter("total > 1").withColumn("up", F.floor(F.col("page_no") / fanout))
        lone = (F.col("total") % fanout == 1) & (F.col("total") > fanout) & (F.col("page_no") == F.col("total") - 1)
        up = up.withColumn("up", F.when(lone, F.col("up") - 1).otherwise(F.col("up")))
        level = up.groupBy("session_id", F.col("up").alias("page_no")).agg(F.count("*").alias("n"), F.min("first_rank").alias("first_rank"), F.max("last_rank").alias("last_rank"))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
        pages = -(-pages // fanout)
    return out.select("session_id", "level", F.col("page_no").cast("long").alias("page_no"), "n", "first_rank", "last_rank")
