"""Parsed view of event payloads, surface flags, turn cursors and bracket ids.

A payload is any bytes; only valid UTF-8 that is a JSON object has an envelope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SURFACE_TYPES
from .sequence import ranked


def get(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, f"$.{path}")


def keys(doc: Column) -> Column:
    return F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>"))


def envelopes(entries: DataFrame, blobs: DataFrame, surface_types: tuple[str, ...] = SURFACE_TYPES) -> DataFrame:
    """entries with rank, doc (JSON text or null), type, time, keys, data, surface (flag), turn and compaction ids."""
    rows = ranked(entries).join(blobs, ["session_id", "blob_id"], "left")
    text = F.try_validate_utf8(F.col("payload").cast("string"))
    rows = rows.withColumn("doc", F.when(F.try_parse_json(text).isNotNull() & text.rlike(r"\A\s*\{"), text)).drop("payload")
    doc = F.col("doc")
    rows = rows.withColumns({"type": get(doc, "type"), "time": get(doc, "time").try_cast("long"), "keys": keys(doc), "data": get(doc, "data"), "surface_op": get(doc, "surfaceOp")})
    rows = rows.withColumn("surface", F.coalesce(F.col("surface_op").isNotNull() & F.col("type").isin(*surface_types), F.lit(False)))
    return rows.withColumns({"turn": get(F.col("data"), "turn"), "has_turn": F.array_contains(keys(F.col("data")), "turn"), "compaction_id": F.coalesce(get(F.col("data"), "compactionId"), get(F.col("data"), "source.compactionId")), "command": F.coalesce(get(F.col("data"), "sourceCommandId"), get(F.col("data"), "source.sourceCommandId"))})


def turn_cursor(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """rows (session, rank, type, turn) with ``open_turn``: the turn that is open before each event.

    Single cursor: a start sets it, any end clears it.  The last boundary before an event
    is found within buckets of ranks first and carried over between buckets, so that a
    long session is no single task.
    """
    edge = F.when(F.col("type") == "turn/start", F.struct(F.col("turn").alias("t"))).when(F.col("type") == "turn/end", F.struct(F.lit(None).cast("string").alias("t")))
    rows = rows.withColumn("_e", edge).withColumn("_b", F.floor(F.col("rank") / 65536))
    within = Window.partitionBy(key, "_b").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter("_e is not null").groupBy(key, "_b").agg(F.max_by("_e", "rank").alias("_l"))
    blocks = rows.select(key, "_b").distinct().join(last, [key, "_b"], "left")
    blocks = blocks.withColumn("_carry", F.last("_l", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_l")
    out = rows.withColumn("_w", F.last("_e", ignorenulls=True).over(within)).join(blocks, [key, "_b"])
    return out.withColumn("open_turn", F.coalesce(F.col("_w"), F.col("_carry"))["t"]).drop("_e", "_b", "_w", "_carry")


def open_stack(rows: DataFrame) -> DataFrame:
    """(session_id, open): turns left open, with stack rules: an end closes only the turn on top.

    The stack depends on all before, so a session is one ordered pass that streams.
    """
    import pyarrow as pa

    schema = pa.schema([("session_id", pa.string()), ("open", pa.list_(pa.string()))])

    def run(batches):
        session, stack = None, []
        for batch in batches:
            out = []
            for s, kind, turn in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != session:
                    if session is not None:
                        out.append((session, stack))
                    session, stack = s, []
                if kind == "turn/start":
                    if turn is not None:  # a start without a number opens nothing
                        stack.append(turn)
                elif stack and stack[-1] == turn:
                    stack.pop()
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], schema.field(1).type)], schema=schema)
        if session is not None:
            yield pa.RecordBatch.from_arrays([pa.array([session]), pa.array([stack], schema.field(1).type)], schema=schema)

    edges = rows.filter(F.col("type").isin("turn/start", "turn/end")).select("session_id", "type", "turn", "rank")
    return edges.repartition("session_id").sortWithinPartitions("session_id", "rank").select("session_id", "type", "turn").mapInArrow(run, "session_id string, open array<string>")


def brackets(compacted: DataFrame, ranks: DataFrame) -> DataFrame:
    """Each summary with the ranks of its four markers (null where one is not live)."""
    out = compacted.select("session_id", "compaction_id", F.col("markers.start_event_id").alias("start_id"), F.col("markers.summary_event_id").alias("summary_id"), F.col("checkpoint_event_id").alias("checkpoint_id"), F.col("markers.end_event_id").alias("end_id"))
    for x in ("start", "summary", "checkpoint", "end"):
        out = out.join(ranks.select("session_id", F.col("event_id").alias(f"{x}_id"), F.col("rank").alias(f"{x}_rank")), ["session_id", f"{x}_id"], "left")
    return out
