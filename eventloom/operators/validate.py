"""Integrity rules over many sessions: (session_id, rule, subject), one row per violation.

A session is valid if it has none.  Rules are separate frames, so rules on ids never
read payloads, and a caller may run a part.  ``first_violation`` gives the one that a
strict caller raises: the least in the order of RULES.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.codec import is_safe, valid_blocks, valid_usage
from ..plans.session_set import SessionSet, materialize
from ..schemas import FORMAT_VERSION
from . import sequence
from .envelope import brackets, envelopes, get, keys, turn_cursor

RULES = (
    "record", "duplicate-event", "duplicate-order", "order-not-finite", "reference-key", "reference-targets", "dangling-reference",
    "summary-shape", "counter", "missing-blob", "binding-conflict", "marker-shared", "marker-missing", "bracket-overlap",
    "marker-order", "marker-envelope", "checkpoint-envelope", "summary-payload", "command", "turn", "span-boundary",
    "shadowed-live", "transaction", "seed-boundary", "blob-watermark", "blob-changed", "foreign-id", "rebound", "binding-lost", "order-not-increasing",
)
ENVELOPE_KEYS = ("type", "time", "data", "surfaceOp", "sourceEventSeqs", "ignorable")


def _bad(rows: DataFrame, rule: str, subject: Column | str = "session_id") -> DataFrame:
    c = F.col(subject) if isinstance(subject, str) else subject
    return rows.select("session_id", F.lit(rule).alias("rule"), c.cast("string").alias("subject"))


def records(sessions: DataFrame) -> DataFrame:
    """V1: field types and ranges of the control record."""
    c = F.col
    ok = (c("format_version") == FORMAT_VERSION) & c("session_id").isNotNull() & (F.length("session_id") > 0)
    for n in ("next_event_counter", "revision"):
        ok = ok & is_safe(c(n))
    for n in ("created_at", "delegation_depth", "blob_id_watermark"):
        ok = ok & (c(n).isNull() | is_safe(c(n)))
    ok = ok & (c("cwd").isNull() | c("cwd").rlike(r"\A(/|[A-Za-z]:[\\/])")) & (c("origin").isNull() | (c("origin") == "subagent"))
    return _bad(sessions.filter(~F.coalesce(ok, F.lit(False))), "record")


def references(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """V4: unique (source, name), unique targets, both ends live."""
    key = _bad(refs.groupBy("session_id", "from_event_id", "ref_name").count().filter("count > 1"), "reference-key", "from_event_id")
    same = _bad(refs.filter(F.size("to_event_ids") != F.size(F.array_distinct("to_event_ids"))), "reference-targets", "from_event_id")
    ends = refs.select("session_id", F.col("from_event_id").alias("event_id")).union(refs.select("session_id", F.explode("to_event_ids")))
    return key.union(same).union(_bad(ends.distinct().join(entries.select("session_id", "event_id"), ["session_id", "event_id"], "left_anti"), "dangling-reference", "event_id"))


def _blocks(text: Column) -> Column:
    """P10: JSON text of an array of content blocks."""
    blocks = F.transform(F.from_json(text, "array<string>"), lambda b: b)
    return F.coalesce(F.try_parse_json(text).isNotNull() & text.rlike(r"\A\s*\[") & valid_blocks(blocks), F.lit(False))


def summaries(compacted: DataFrame) -> DataFrame:
    """V5: shape of a compaction summary."""
    c = F.col
    ok = (F.length("compaction_id") > 0) & (F.size("shadowed_ids") > 0) & (F.size("shadowed_ids") == F.size(F.array_distinct("shadowed_ids")))
    ok = ok & F.array_contains("shadowed_ids", c("shadowed_range.start_id")) & F.array_contains("shadowed_ids", c("shadowed_range.end_id"))
    ok = ok & (F.size("shadowed_seqs") > 0) & F.forall("shadowed_seqs", is_safe) & (F.get("shadowed_seqs", F.lit(0)) == c("shadowed_seq_range.start")) & (F.element_at("shadowed_seqs", -1) == c("shadowed_seq_range.end"))
    ok = ok & is_safe(c("shadowed_token_count")) & c("provider").isNotNull() & c("model").isNotNull() & (c("source_command_id").isNull() | (F.length("source_command_id") > 0))
    ok = ok & (c("max_tokens").isNull() | is_safe(c("max_tokens"))) & valid_usage(c("usage")) & (c("llm_stream_call").isNull() | (c("llm_stream_call") & c("raw_output").isNotNull()))
    ok = ok & _blocks(c("summary")) & (c("raw_output").isNull() | _blocks(c("raw_output")))
    return _bad(compacted.filter(~F.coalesce(ok, F.lit(False))), "summary-shape", "compaction_id")


def counters(s: SessionSet) -> DataFrame:
    """V6 and V21: the counter is above every own id, the watermark not below any blob."""
    used = s.entries.select("session_id", "event_id").union(s.bindings.select("session_id", "event_id"))
    c = s.compacted
    used = used.union(c.select("session_id", F.explode(F.concat("shadowed_ids", F.array("checkpoint_event_id", "markers.start_event_id", "markers.summary_event_id", "markers.end_event_id", "shadowed_range.start_id", "shadowed_range.end_id")))))
    top = used.groupBy("session_id").agg(F.max(ids.own_number("session_id", "event_id")).alias("top"))
    low = _bad(s.sessions.join(top, "session_id").filter("next_event_counter <= top"), "counter", "top")
    blobs = s.blobs.groupBy("session_id").agg(F.max(ids.blob_number("blob_id")).alias("top"))
    return low.union(_bad(s.sessions.join(blobs, "session_id").filter("blob_id_watermark < top"), "blob-watermark", "top"))


def missing_blobs(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """V7."""
    return _bad(entries.join(blobs.select("session_id", "blob_id"), ["session_id", "blob_id"], "left_anti"), "missing-blob", "blob_id")


def binding_conflicts(entries: DataFrame, bindings: DataFrame) -> DataFrame:
    """V8: a live event is bound to another blob than the table says."""
    b = bindings.select("session_id", "event_id", F.col("blob_id").alias("bound"))
    return _bad(entries.join(b, ["session_id", "event_id"]).filter("blob_id <> bound"), "binding-conflict", "event_id")


def markers(compacted: DataFrame, ranks: DataFrame) -> DataFrame:
    """V9: a marker belongs to one summary, the four are distinct and live.  V11: their order."""
    each = compacted.select("session_id", F.explode(F.array("markers.start_event_id", "markers.summary_event_id", "checkpoint_event_id", "markers.end_event_id")).alias("event_id"))
    shared = _bad(each.groupBy("session_id", "event_id").count().filter("count > 1"), "marker-shared", "event_id")
    missing = _bad(each.distinct().join(ranks, ["session_id", "event_id"], "left_anti"), "marker-missing", "event_id")
    return shared.union(missing).union(marker_order(brackets(compacted, ranks)))


def marker_order(b: DataFrame) -> DataFrame:
    return _bad(b.filter("not (start_rank < summary_rank and summary_rank < checkpoint_rank and checkpoint_rank < end_rank and checkpoint_rank = summary_rank + 1)"), "marker-order", "compaction_id")


def bracket_overlap(b: DataFrame) -> DataFrame:
    """V10: brackets (session_id, compaction_id, start_rank, end_rank) must not nest or interleave."""
    w = Window.partitionBy("session_id").orderBy("start_rank", "end_rank")
    return _bad(b.filter("start_rank is not null and end_rank is not null").withColumn("before", F.lag("end_rank").over(w)).filter("before > start_rank"), "bracket-overlap", "compaction_id")


def bracket_spans(b: DataFrame, boundaries: DataFrame) -> DataFrame:
    """V17: no turn boundary or end of seed (session_id, event_id, rank) strictly inside a bracket.

    A range join would pair every bracket of a session with every boundary.  Brackets do
    not overlap (V10), so the one that could hold a boundary is the last to start before
    it: brackets and boundaries are sorted together and the open end is carried along.
    """
    both = b.filter("start_rank is not null and end_rank is not null").select("session_id", F.lit(None).cast("string").alias("event_id"), F.col("start_rank").alias("rank"), F.col("end_rank").alias("end"))
    both = both.union(boundaries.select("session_id", "event_id", "rank", F.lit(None).cast("long")))
    w = Window.partitionBy("session_id").orderBy("rank", F.col("event_id").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    return _bad(both.withColumn("open", F.max("end").over(w)).filter("event_id is not null and rank < open"), "span-boundary", "event_id")


def _marker_rows(s: SessionSet, env: DataFrame) -> DataFrame:
    """Every claimed marker with its role, its summary and its envelope."""
    c = s.compacted
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.col(x).alias("event_id")) for r, x in (("start", "markers.start_event_id"), ("summary", "markers.summary_event_id"), ("checkpoint", "checkpoint_event_id"), ("end", "markers.end_event_id"))))
    rows = c.select("session_id", F.col("compaction_id").alias("claimed"), "shadowed_seq_range", "shadowed_seqs", F.col("source_command_id").alias("claimed_command"), "summary", "provider", "model", "shadowed_token_count", F.explode(roles).alias("m"))
    return rows.select("*", "m.role", "m.event_id").drop("m").join(env.drop("order", "blob_id"), ["session_id", "event_id"])


def marker_envelopes(s: SessionSet, env: DataFrame) -> DataFrame:
    """V12 to V16: envelopes, roles, checkpoint, payload, command and turn of claimed markers."""
    rows = _marker_rows(s, turn_cursor(env))
    c, log = F.col, F.col("role") != "checkpoint"
    shape = (F.size(F.array_except("keys", F.array(*map(F.lit, ENVELOPE_KEYS)))) == 0) & is_safe(c("time")) & (~F.array_contains("keys", F.lit("ignorable")) | (get(c("doc"), "ignorable") == "true"))
    shape = shape & (c("compaction_id") == c("claimed")) & (c("type") == F.when(c("role") == "checkpoint", F.lit("user/message")).otherwise(F.concat(F.lit("compaction/"), c("role"))))
    shape = shape & (~log | ~(F.array_contains("keys", F.lit("surfaceOp")) | F.array_contains("keys", F.lit("sourceEventSeqs"))))
    shape = shape & ((c("role") != "end") | ~F.array_contains(keys(c("data")), F.lit("error"))) & (~c("role").isin("start", "end") | c("has_turn") & (c("turn").isNull() | c("turn").try_cast("double").isNotNull()))
    out = _bad(rows.filter(~F.coalesce(shape, F.lit(False))), "marker-envelope", "event_id")
    seqs = F.from_json(get(c("doc"), "sourceEventSeqs"), "array<long>")
    op = c("surface_op")
    point = (F.length(get(c("data"), "id")) > 0) & (get(c("data"), "role") == "user") & (get(c("data"), "source.kind") == "plugin") & (get(c("data"), "source.plugin") == "compact")
    point = point & (F.size(keys(op)) == 3) & (get(op, "op") == "replace") & (get(op, "start").try_cast("long") == c("shadowed_seq_range.start")) & (get(op, "end").try_cast("long") == c("shadowed_seq_range.end"))
    point = point & (F.size(seqs) == F.size(F.array_distinct(seqs))) & (F.size(F.array_except("shadowed_seqs", seqs)) == 0)
    out = out.union(_bad(rows.filter((c("role") == "checkpoint") & ~F.coalesce(point, F.lit(False))), "checkpoint-envelope", "event_id"))
    same = lambda a, b: F.to_json(F.try_parse_json(a)).eqNullSafe(F.to_json(F.try_parse_json(b)))
    payload = same(get(c("data"), "summary"), c("summary")) & F.from_json(get(c("data"), "shadowedSeqs"), "array<long>").eqNullSafe(c("shadowed_seqs"))
    payload = payload & (get(c("data"), "provider") == c("provider")) & (get(c("data"), "model") == c("model")) & (get(c("data"), "shadowedTokenCount").try_cast("long") == c("shadowed_token_count"))
    out = out.union(_bad(rows.filter((c("role") == "summary") & ~F.coalesce(payload, F.lit(False))), "summary-payload", "event_id"))
    out = out.union(_bad(rows.filter(~c("command").eqNullSafe(c("claimed_command"))), "command", "event_id"))
    turns = rows.groupBy("session_id", "claimed").agg(*(F.max(F.when(c("role") == r, F.struct(c("turn").try_cast("double").alias("turn")))).alias(r) for r in ("start", "end")), F.max(F.when(c("role") == "start", F.struct(c("open_turn").try_cast("double").alias("turn")))).alias("open"))
    return out.union(_bad(turns.filter("not (start.turn <=> end.turn) or not (start.turn <=> open.turn)"), "turn", "claimed"))


def shadowed_live(compacted: DataFrame, entries: DataFrame) -> DataFrame:
    """V18."""
    gone = compacted.select("session_id", F.explode("shadowed_ids").alias("event_id")).distinct()
    return _bad(gone.join(entries, ["session_id", "event_id"], "left_semi"), "shadowed-live", "event_id")


def seed_boundary(sessions: DataFrame, entries: DataFrame) -> DataFrame:
    """V20."""
    seeds = sessions.filter("seed_boundary_id is not null").select("session_id", F.col("seed_boundary_id").alias("event_id"))
    return _bad(seeds.join(entries, ["session_id", "event_id"], "left_anti"), "seed-boundary", "event_id")


_TXN_PA = pa.schema([("session_id", pa.string()), ("rule", pa.string()), ("subject", pa.string())])


def transactions(rows: DataFrame) -> DataFrame:
    """V19: unclaimed markers as a state machine.

    rows (session_id, rank, event_id, type, compaction_id, turn, has_turn, command, has_error,
    is_checkpoint).  What a marker may do depends on all before, so a session is one
    ordered pass that streams and keeps one open transaction.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = cursor = txn = None
        inside = -1  # the end of the claimed bracket that is open
        for batch in batches:
            bad = []
            for r in batch.to_pylist():
                if r["session_id"] != session:
                    session, cursor, txn, inside = r["session_id"], None, None, -1
                kind, cid, ok = r["type"], r["compaction_id"], True
                if kind == "claimed":
                    ok, inside = txn is None, r["until"]
                elif kind in ("turn/start", "turn/end"):
                    ok = txn is None
                    cursor = r["turn"] if kind == "turn/start" else None
                elif kind == "compaction/start":
                    ok = txn is None and r["rank"] > inside and bool(cid) and r["has_turn"] and r["turn"] == cursor
                    txn = {"id": cid, "turn": r["turn"], "command": r["command"], "done": False}
                elif kind == "compaction/summary":
                    ok = txn is not None and cid == txn["id"] and not txn["done"] and r["command"] == txn["command"]
                    if txn is not None:
                        txn["done"] = True
                elif kind == "compaction/end":
                    ok = txn is not None and cid == txn["id"] and r["turn"] == txn["turn"] and r["command"] == txn["command"] and (txn["done"] or r["has_error"])
                    txn = None
                elif kind == "session/end-seed":
                    txn = None
                elif r["is_checkpoint"]:
                    ok = txn is not None and cid == txn["id"] and r["command"] == txn["command"]
                if not ok:
                    bad.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([r["session_id"] for r in bad], pa.string()), pa.array(["transaction"] * len(bad), pa.string()), pa.array([r["event_id"] for r in bad], pa.string())], schema=_TXN_PA)

    rows = rows if "until" in rows.columns else rows.withColumn("until", F.lit(None).cast("long"))
    wanted = F.col("type").isin("claimed", "turn/start", "turn/end", "compaction/start", "compaction/summary", "compaction/end", "session/end-seed") | F.col("is_checkpoint")
    return rows.filter(wanted).repartition("session_id").sortWithinPartitions("session_id", "rank").mapInArrow(run, "session_id string, rule string, subject string")


def _claimed_spans(b: DataFrame) -> DataFrame:
    """Claimed brackets as rows of ``transactions``: an unclaimed transaction must not be open at one nor start inside."""
    return b.filter("start_rank is not null and end_rank is not null").select("session_id", F.col("start_rank").alias("rank"), F.col("start_id").alias("event_id"), F.lit("claimed").alias("type"), F.col("end_rank").alias("until"), F.lit(False).alias("is_checkpoint"))


def transaction_rows(env: DataFrame) -> DataFrame:
    data = F.col("data")
    point = (F.col("type") == "user/message") & (get(F.col("surface_op"), "op") == "replace") & (get(data, "source.kind") == "plugin") & (get(data, "source.plugin") == "compact")
    return env.select("session_id", "rank", "event_id", "type", "compaction_id", "turn", "has_turn", "command", F.array_contains(keys(data), F.lit("error")).alias("has_error"), F.coalesce(point, F.lit(False)).alias("is_checkpoint"))


def commit_changes(before: SessionSet, after: SessionSet, backups: DataFrame | None = None) -> DataFrame:
    """V22 and V23 between two generations: blobs never change, kept ids keep their blob, new ids carry the own prefix; the binding table only grows."""
    old = before.blobs if backups is None else before.blobs.union(backups.select(before.blobs.columns))
    changed = after.blobs.join(old.select("session_id", "blob_id", F.col("payload").alias("prior")), ["session_id", "blob_id"]).filter("payload <> prior")
    kept = before.bindings.union(before.entries.select(before.bindings.columns)).distinct()
    moved = after.entries.join(kept.select("session_id", "event_id", F.col("blob_id").alias("prior")), ["session_id", "event_id"]).filter("blob_id <> prior")
    held = before.bindings.join(after.sessions.select("session_id"), "session_id", "left_semi").select("session_id", "event_id", F.col("blob_id").alias("prior"))
    now = after.bindings.groupBy("session_id", "event_id").agg(F.min("blob_id").alias("low"), F.max("blob_id").alias("high"))
    table = held.join(now, ["session_id", "event_id"], "left")
    new = after.entries.join(kept, ["session_id", "event_id"], "left_anti").filter(ids.own_number("session_id", "event_id").isNull())
    lower = after.sessions.join(before.sessions.select("session_id", F.col("next_event_counter").alias("prior")), "session_id").filter("next_event_counter < prior")
    return _bad(changed, "blob-changed", "blob_id").distinct().union(_bad(moved.select("session_id", "event_id").union(table.filter("low <> prior or high <> prior").select("session_id", "event_id")).distinct(), "rebound", "event_id")).union(_bad(table.filter("low is null"), "binding-lost", "event_id")).union(_bad(new, "foreign-id", "event_id")).union(_bad(lower, "counter", "next_event_counter"))


def violations(s: SessionSet) -> DataFrame:
    """All rules on one generation of many sessions; payloads are parsed once and the parsed view is written for all rules."""
    env = materialize(envelopes(s.entries, s.blobs))
    ranks = env.select("session_id", "event_id", "rank")
    b = materialize(brackets(s.compacted, ranks))
    claimed = s.compacted.select("session_id", F.explode(F.array("markers.start_event_id", "markers.summary_event_id", "checkpoint_event_id", "markers.end_event_id")).alias("event_id")).distinct()
    edges = env.filter(F.col("type").isin("turn/start", "turn/end", "session/end-seed"))
    parts = [
        records(s.sessions), sequence.violations(s.entries), references(s.references, s.entries), summaries(s.compacted), counters(s),
        missing_blobs(s.entries, s.blobs), binding_conflicts(s.entries, s.bindings), markers(s.compacted, ranks), bracket_overlap(b),
        bracket_spans(b, edges), marker_envelopes(s, env), shadowed_live(s.compacted, s.entries), seed_boundary(s.sessions, s.entries),
        transactions(transaction_rows(env.join(claimed, ["session_id", "event_id"], "left_anti")).unionByName(_claimed_spans(b), allowMissingColumns=True)),
    ]
    return reduce(DataFrame.union, parts)


def first_violation(found: DataFrame) -> DataFrame:
    """Per session the violation that comes first in RULES."""
    order = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    return found.groupBy("session_id").agg(F.min(F.struct(order.alias("o"), "rule", "subject")).alias("x")).select("session_id", "x.rule", "x.subject")
