"""Migration of legacy logs with dense sequence numbers to ordered entries, blobs and references.

``events`` is (session_id, version, seq, type, time, data (JSON text), surface_op,
source_event_seqs array<long>, ignorable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import is_safe
from ..schemas import KNOWN_TYPES, SURFACE_TYPES
from .envelope import get

#: Legacy types that are never accepted (fixed values).
REFUSED_TYPES = ("request/header-delta", "mode/set")


def _payload_ok() -> Column:
    """What a known type must carry to be restored."""
    t, data = F.col("type"), F.col("data")
    msg = F.when(t == "user/message", data).otherwise(get(data, "message"))
    text = lambda path: F.coalesce(F.length(get(msg, path)) > 0, F.lit(False))
    base = text("id") & (get(msg, "role") == F.when(t == "assistant/message", "assistant").otherwise("user")) & text("source.kind") & F.coalesce(get(msg, "content").startswith("["), F.lit(False))
    model = (get(msg, "source.kind") == "model") & text("source.provider") & text("source.model")
    one = (F.json_array_length(get(msg, "content")) == 1) & (get(msg, "content[0].type") == "tool-result") & get(msg, "content[0].content").startswith("[")
    tool = (get(msg, "source.kind") == "tool") & text("source.callId") & one & (get(msg, "content[0].toolCallId") == get(msg, "source.callId"))
    header = (F.length(get(data, "header.config.provider")) > 0) & (F.length(get(data, "header.config.model")) > 0) & F.coalesce(get(data, "reason") != "fallback", F.lit(True))
    ok = F.when(t.isin("turn/start", "turn/end"), get(data, "turn").try_cast("long").isNotNull()).when(t == "request/header", header)
    return F.coalesce(ok.when(t == "user/message", base).when(t == "assistant/message", base & model).when(t == "tool/result", base & tool).otherwise(True), F.lit(False))


def rejects(events: DataFrame, surface_types: tuple[str, ...] = SURFACE_TYPES, known: tuple[str, ...] = KNOWN_TYPES) -> DataFrame:
    """(session_id, seq, rule) of every breach."""
    t, seqs = F.col("type"), F.col("source_event_seqs")
    surface = t.isin(*surface_types)
    rules = {
        "version": F.col("version") != 0,
        "type": F.coalesce(F.length(t) == 0, F.lit(True)),
        "refused-type": t.isin(*REFUSED_TYPES),
        "ignorable": F.col("ignorable").isNotNull() & ~F.col("ignorable"),
        "surface-op": F.col("surface_op").isNotNull() & (F.col("surface_op") != "append"),
        "surface-missing": surface & F.col("surface_op").isNull(),
        "log-only-surface": ~surface & F.col("surface_op").isNotNull(),
        "log-only-sources": ~surface & seqs.isNotNull(),
        "sources-empty": (F.size(seqs) == 0) & (t != "assistant/message"),
        "sources-range": F.exists(seqs, lambda x: ~is_safe(x)),
        "sources-repeat": F.size(F.array_distinct(seqs)) < F.size(seqs),
        "sources-later": F.exists(seqs, lambda x: x >= F.col("seq")),
        "unknown-type": ~t.isin(*known) & ~F.coalesce(F.col("ignorable"), F.lit(False)),
        "time": ~is_safe(F.col("time")),
        "data": F.col("data").isNull() | F.try_parse_json("data").isNull() | F.coalesce(F.col("data").rlike(r"(?:^|[\[:,\s])-0(?:\.0*)?(?:[\],}\s]|$)"), F.lit(False)),
        "payload": ~_payload_ok(),
    }
    each = events.select("session_id", "seq", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())))).alias("rule"))
    # contiguous from 0: distinct, none negative, and as many as the greatest and one
    gaps = events.groupBy("session_id").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("d"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).filter("n <> d or lo <> 0 or hi <> n - 1")
    return each.union(gaps.select("session_id", F.lit(None).cast("long"), F.lit("contiguous")))


def entries(events: DataFrame) -> DataFrame:
    s, q = F.col("session_id"), F.col("seq").cast("string")
    return events.select("session_id", F.col("seq").cast("double").alias("order"), F.concat(F.lit("evt_"), s, F.lit("_"), q).alias("event_id"), F.concat(F.lit("blob_"), q).alias("blob_id"))


def blobs(events: DataFrame) -> DataFrame:
    """Envelopes as compact JSON; absent fields stay absent."""
    field = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f',"{name}":'), c)).otherwise("")
    quote = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30)
    inner = lambda c: F.regexp_replace(quote(c), r"\]\z", "")
    doc = F.concat(F.lit('{"type":'), inner(F.col("type")), field("time", F.col("time").cast("string")), field("data", F.col("data")), field("surfaceOp", F.when(F.col("surface_op").isNotNull(), inner(F.col("surface_op")))), field("sourceEventSeqs", F.to_json("source_event_seqs")), field("ignorable", F.col("ignorable").cast("string")), F.lit("}"))
    return events.select("session_id", F.concat(F.lit("blob_"), F.col("seq").cast("string")).alias("blob_id"), doc.cast("binary").alias("payload"))


def references(events: DataFrame) -> DataFrame:
    head = F.concat(F.lit("evt_"), F.col("session_id"), F.lit("_"))
    rows = events.filter(F.size("source_event_seqs") > 0)
    return rows.select("session_id", F.concat(head, F.col("seq").cast("string")).alias("from_event_id"), F.lit("sourceEventIds").alias("ref_name"), F.transform("source_event_seqs", lambda x: F.concat(head, x.cast("string"))).alias("to_event_ids"))


def migrate(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entries, blobs, references, rejects); sessions with a reject are left out."""
    bad = rejects(events)
    good = events.join(bad.select("session_id").distinct(), "session_id", "left_anti")
    return entries(good), blobs(good), references(good), bad
