"""Physical compaction of many sessions at once.

``requests`` has one row per session to compact: (session_id, compaction_id, shadowed_ids,
start_id, summary_id, checkpoint_id, end_id, start_blob, summary_blob, checkpoint_blob,
end_blob).  Sessions without a request pass unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.session_set import SessionSet, materialize
from . import sequence
from .envelope import brackets, envelopes, turn_cursor

ROLES = ("start", "summary", "checkpoint", "end")


def shadow(requests: DataFrame) -> DataFrame:
    return requests.select("session_id", "checkpoint_id", F.explode("shadowed_ids").alias("event_id"))


def ranges(ranked: DataFrame, gone: DataFrame) -> DataFrame:
    """session_id, first, last (ranks of the first and last shadowed surface event), first_order."""
    hit = ranked.filter("surface").join(gone.select("session_id", "event_id"), ["session_id", "event_id"], "left_semi")
    return hit.groupBy("session_id").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.min("order").alias("first_order"))


def rewrite(entries: DataFrame, gone: DataFrame, spans: DataFrame, marker_rows: DataFrame) -> DataFrame:
    """Survivors before the first shadowed rank, the markers (session_id, sub, event_id, blob_id), the rest; dense orders.

    Events of the range that are not shadowed survive and stand behind the markers.
    """
    spans = spans.select("session_id", F.col("first_order").alias("pos"))
    left = entries.join(spans.drop("pos"), "session_id", "left_semi").join(gone.select("session_id", "event_id"), ["session_id", "event_id"], "left_anti")
    old = left.select("session_id", F.col("order").alias("pos"), F.lit(0).alias("sub"), "event_id", "blob_id")
    put = marker_rows.join(spans, "session_id").select("session_id", "pos", "sub", "event_id", "blob_id")
    # the shadowed event that stood at pos is gone: its order is free for the markers
    return sequence.ranked(materialize(old.union(put)), ("pos", "sub")).select("session_id", F.col("rank").cast("double").alias("order"), "event_id", "blob_id")


def redirect(references: DataFrame, gone: DataFrame) -> DataFrame:
    """Drop references from shadowed events; point shadowed targets to the checkpoint, each target once, in order."""
    dead = gone.select("session_id", F.col("event_id").alias("from_event_id"))
    rows = references.join(dead, ["session_id", "from_event_id"], "left_anti").select("session_id", "from_event_id", "ref_name", F.posexplode("to_event_ids").alias("pos", "event_id"))
    rows = rows.join(gone, ["session_id", "event_id"], "left").withColumn("target", F.coalesce("checkpoint_id", "event_id"))
    rows = rows.groupBy("session_id", "from_event_id", "ref_name", "target").agg(F.min("pos").alias("pos"))
    return rows.groupBy("session_id", "from_event_id", "ref_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"]).alias("to_event_ids"))


def kept_blobs(blobs: DataFrame, entries: DataFrame) -> DataFrame:
    return blobs.join(entries.select("session_id", "blob_id"), ["session_id", "blob_id"], "left_semi").select(blobs.columns)


def fold_summaries(compacted: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """Summaries whose checkpoint is shadowed go and their ids join the new summary's, each once."""
    dead = gone.select("session_id", F.col("event_id").alias("checkpoint_event_id"))
    folded = compacted.join(dead, ["session_id", "checkpoint_event_id"], "left_semi").select("session_id", F.explode("shadowed_ids").alias("id")).groupBy("session_id").agg(F.array_sort(F.collect_set("id")).alias("more"))
    kept = compacted.join(dead, ["session_id", "checkpoint_event_id"], "left_anti").select(compacted.columns)
    last = kept.groupBy("session_id").agg((F.max("ord") + 1).alias("next"))
    put = new.drop("ord").join(last, "session_id", "left").join(folded, "session_id", "left")
    put = put.withColumn("ord", F.coalesce("next", F.lit(0))).withColumn("shadowed_ids", F.array_union("shadowed_ids", F.coalesce("more", F.array().cast("array<string>"))))
    return kept.unionByName(put.select(compacted.columns))


def interval_check(ranked: DataFrame, gone: DataFrame, spans: DataFrame) -> DataFrame:
    """Surface events between first and last that are not shadowed: (session_id, event_id, rank).

    Any event that carries a surface mark counts, of whatever type (column ``marked``, if there is one).
    """
    rows = ranked.filter("marked" if "marked" in ranked.columns else "surface").join(spans, "session_id").filter("rank between first and last")
    return rows.join(gone.select("session_id", "event_id"), ["session_id", "event_id"], "left_anti").select("session_id", "event_id", "rank")


def guards(s: SessionSet, requests: DataFrame, env: DataFrame) -> DataFrame:
    """(session_id, rule, subject): why a request is refused."""
    bad = lambda rows, rule, subject="session_id": rows.select("session_id", F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))
    gone = shadow(requests)
    put = requests.select("session_id", F.explode(F.array(*(F.struct(F.col(f"{r}_id").alias("event_id"), F.col(f"{r}_blob").alias("blob_id")) for r in ROLES))).alias("x")).select("session_id", "x.*")
    used = s.bindings.select("session_id", "event_id").union(s.entries.select("session_id", "event_id"))
    retired = s.compacted.select("session_id", F.explode("shadowed_ids").alias("event_id"))
    shaped = requests.filter("coalesce(length(compaction_id), 0) = 0 or size(shadowed_ids) = 0 or size(shadowed_ids) <> size(array_distinct(shadowed_ids))")
    b = brackets(s.compacted, env.select("session_id", "event_id", "rank"))
    inside = b.select("session_id", "compaction_id", F.explode(F.array("start_id", "summary_id", "checkpoint_id", "end_id")).alias("event_id")).join(gone.select("session_id", "event_id"), ["session_id", "event_id"], "left_semi").groupBy("session_id", "compaction_id").count().filter("count < 4")
    marks = env.filter(F.col("type").startswith("compaction/")).select("session_id", "event_id")
    plain = env.filter("not surface").join(gone.select("session_id", "event_id"), ["session_id", "event_id"], "left_semi").join(marks, ["session_id", "event_id"], "left_anti")
    spans = ranges(env, gone)
    turn = turn_cursor(env).join(spans, "session_id").filter("rank = first")
    parts = [
        bad(shaped, "compaction-shape"),
        bad(gone.join(s.entries, ["session_id", "event_id"], "left_anti"), "shadowed-not-live", "event_id"),
        bad(put.filter(ids.own_number("session_id", "event_id").isNull()), "marker-foreign", "event_id"),
        bad(put.groupBy("session_id", "event_id").count().filter("count > 1"), "marker-repeated", "event_id"),
        bad(put.join(used.union(retired).distinct(), ["session_id", "event_id"], "left_semi"), "marker-used", "event_id"),
        bad(put.join(s.sessions, "session_id").filter(ids.own_number("session_id", "event_id") < F.col("next_event_counter")), "marker-below-counter", "event_id"),
        bad(put.groupBy("session_id", "blob_id").count().filter("count > 1"), "marker-blob-repeated", "blob_id"),
        bad(put.join(s.blobs, ["session_id", "blob_id"], "left_anti"), "marker-blob-missing", "blob_id"),
        bad(put.join(s.entries.select("session_id", "blob_id"), ["session_id", "blob_id"], "left_semi"), "marker-blob-used", "blob_id"),
        bad(plain, "shadowed-not-surface", "event_id"),
        bad(inside, "bracket-cut", "compaction_id"),
        bad(interval_check(env.withColumn("marked", F.array_contains("keys", F.lit("surfaceOp"))), gone, spans), "surface-not-shadowed", "event_id"),
        bad(requests.join(spans, "session_id", "left_anti"), "no-surface-event"),
        bad(turn.join(envelopes_of_start(s, requests), "session_id").filter("not (open_turn <=> start_turn)"), "turn-not-open", "event_id"),
    ]
    return reduce(DataFrame.union, parts)


def envelopes_of_start(s: SessionSet, requests: DataFrame) -> DataFrame:
    """session_id, start_turn: the turn that the start marker's payload names."""
    rows = requests.select("session_id", F.col("start_blob").alias("blob_id")).join(s.blobs, ["session_id", "blob_id"])
    return rows.select("session_id", F.get_json_object(F.try_validate_utf8(F.col("payload").cast("string")), "$.data.turn").alias("start_turn"))


def compact(s: SessionSet, requests: DataFrame, new_summaries: DataFrame) -> tuple[SessionSet, DataFrame]:
    """(the rewritten sessions, refusals).  Sessions with a refusal are left as they are."""
    env = materialize(envelopes(s.entries, s.blobs))
    refused = materialize(guards(s, requests, env))
    requests = requests.join(refused.select("session_id").distinct(), "session_id", "left_anti")
    gone = materialize(shadow(requests))
    spans = materialize(ranges(env, gone))
    put = requests.select("session_id", F.posexplode(F.array(*(F.struct(F.col(f"{r}_id").alias("event_id"), F.col(f"{r}_blob").alias("blob_id")) for r in ROLES))).alias("i", "x")).select("session_id", (F.col("i") + 1).alias("sub"), "x.event_id", "x.blob_id")
    entries = rewrite(s.entries, gone, spans, put).unionByName(s.entries.join(requests, "session_id", "left_anti").select(s.entries.columns))
    dead = gone.select("session_id", F.col("event_id").alias("seed_boundary_id"), F.col("checkpoint_id").alias("_c"))
    top = put.groupBy("session_id").agg((F.max(ids.own_number("session_id", "event_id")) + 1).alias("_n"))
    sessions = s.sessions.join(dead, ["session_id", "seed_boundary_id"], "left").join(top, "session_id", "left")
    sessions = sessions.withColumn("seed_boundary_id", F.coalesce("_c", "seed_boundary_id")).withColumn("next_event_counter", F.greatest("next_event_counter", "_n"))
    for page in ("blob_map_page", "references_page", "compacted_page"):
        sessions = sessions.withColumn(page, F.when(F.col("_n").isNull(), F.col(page)))
    touched = s.references.join(requests.select("session_id"), "session_id", "left_semi")
    refs = redirect(touched, gone).unionByName(s.references.join(requests.select("session_id"), "session_id", "left_anti"))
    bindings = s.bindings.union(entries.select(s.bindings.columns)).distinct()
    new = new_summaries.join(requests.select("session_id"), "session_id", "left_semi")
    return SessionSet(sessions.select(s.sessions.columns), entries, kept_blobs(s.blobs, entries), refs.select(s.references.columns), bindings, fold_summaries(s.compacted, gone, new)), refused


def surface_share(ranked: DataFrame, share: float) -> DataFrame:
    """(session_id, event_id): the first part of each session's surface events, as a maintenance policy would choose them."""
    n = ranked.filter("surface").groupBy("session_id").agg(F.count("*").alias("_c"))
    rows = sequence.ranked(ranked.filter("surface").drop("rank"))
    return rows.join(n, "session_id").filter(F.col("rank") < F.floor(F.lit(share) * F.col("_c"))).select("session_id", "event_id")
