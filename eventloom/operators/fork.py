"""Fork: an inclusive prefix of a session becomes a child session."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session_set import SessionSet, materialize
from . import sequence
from .envelope import brackets, envelopes, open_stack


def prefix(entries: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Entries up to (session_id, event_id, child_id), under the child's id, with rank."""
    rows = sequence.ranked(entries)
    ends = boundaries.join(rows.select("session_id", "event_id", F.col("rank").alias("end")), ["session_id", "event_id"]).select("session_id", "child_id", "end")
    return rows.join(ends, "session_id").filter(F.col("rank") <= F.col("end"))


def kept_references(references: DataFrame, inherited: DataFrame) -> DataFrame:
    """References whose source and every target are inherited (session_id, event_id)."""
    live = inherited.select("session_id", "event_id")
    rows = references.join(live.withColumnRenamed("event_id", "from_event_id"), ["session_id", "from_event_id"], "left_semi")
    lost = rows.select("session_id", "from_event_id", "ref_name", F.explode("to_event_ids").alias("event_id")).join(live, ["session_id", "event_id"], "left_anti")
    return rows.join(lost.select("session_id", "from_event_id", "ref_name").distinct(), ["session_id", "from_event_id", "ref_name"], "left_anti")


def guards(s: SessionSet, boundaries: DataFrame, env: DataFrame) -> DataFrame:
    """(session_id, rule, subject): why a fork is refused."""
    bad = lambda rows, rule, subject: rows.select("session_id", F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))
    ends = boundaries.join(env.select("session_id", "event_id", "rank"), ["session_id", "event_id"])
    b = brackets(s.compacted, env.select("session_id", "event_id", "rank")).join(ends.select("session_id", "rank"), "session_id")
    claimed = s.compacted.select("session_id", F.explode(F.array("markers.start_event_id", "markers.summary_event_id", "checkpoint_event_id", "markers.end_event_id")).alias("event_id")).distinct()
    upto = env.join(ends.select("session_id", F.col("rank").alias("end")), "session_id").filter("rank <= end")
    # unclaimed: a start counts as open until the next end or end of seed, and a later start takes its place
    marks = env.filter(F.col("type").isin("compaction/start", "compaction/end", "session/end-seed")).join(ends.select("session_id", F.col("rank").alias("end")), "session_id").join(claimed, ["session_id", "event_id"], "left_anti")
    last = marks.filter("rank <= end").groupBy("session_id").agg(F.max_by("type", "rank").alias("type")).filter(F.col("type") == "compaction/start")
    following = marks.filter("rank > end").groupBy("session_id").agg(F.min_by("type", "rank").alias("next")).filter(F.col("next") != "compaction/start")
    cut = last.join(following, "session_id", "left_semi")
    parts = [
        bad(boundaries.filter("child_id = session_id or child_id is null"), "child-id", "child_id"),
        bad(boundaries.join(env, ["session_id", "event_id"], "left_anti"), "unknown-event", "event_id"),
        bad(b.filter("start_rank <= rank and rank < end_rank"), "bracket-cut", "compaction_id"),
        bad(cut, "bracket-cut", "type"),
        bad(open_stack(upto).filter(F.size("open") > 0).withColumn("turn", F.element_at("open", -1)), "open-turn", "turn"),
    ]
    return reduce(DataFrame.union, parts)


def fork(s: SessionSet, boundaries: DataFrame) -> tuple[SessionSet, DataFrame]:
    """(the children, refusals) of (session_id, event_id, child_id), one fork per session and call."""
    refused = materialize(guards(s, boundaries, materialize(envelopes(s.entries, s.blobs))))
    good = boundaries.join(refused.select("session_id").distinct(), "session_id", "left_anti")
    pre = prefix(s.entries, good)
    child = good.select("session_id", "child_id")

    def rename(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.join(child, "session_id").withColumn("session_id", F.col("child_id")).select(columns)

    live = pre.select("session_id", "event_id", "blob_id")
    blobs = s.blobs.join(live.select("session_id", "blob_id").distinct(), ["session_id", "blob_id"], "left_semi")
    marks = s.compacted.select("session_id", "ord", F.explode(F.array("markers.start_event_id", "markers.summary_event_id", "checkpoint_event_id", "markers.end_event_id")).alias("event_id"))
    whole = marks.join(live, ["session_id", "event_id"], "left_semi").groupBy("session_id", "ord").count().filter("count = 4").select("session_id", "ord")
    record = s.sessions.join(good, "session_id").withColumn("parent_session", F.col("session_id")).withColumn("session_id", F.col("child_id"))
    record = record.withColumns({"created_at": F.lit(None).cast("long"), "revision": F.lit(0).cast("long"), "seed_boundary_id": F.col("event_id"), "backups": F.expr("null").cast(s.sessions.schema["backups"].dataType)})
    for page in ("root_page", "blob_map_page", "references_page", "compacted_page"):
        record = record.withColumn(page, F.lit(None).cast("string"))
    entries = pre.withColumn("session_id", F.col("child_id")).select(s.entries.columns)
    return SessionSet(record.select(s.sessions.columns), entries, rename(blobs, s.blobs.columns), rename(kept_references(s.references, live), s.references.columns), entries.select(s.bindings.columns), rename(s.compacted.join(whole, ["session_id", "ord"], "left_semi"), s.compacted.columns)), refused
