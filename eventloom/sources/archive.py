"""Session archives: one JSON document a session, with base64 blobs; export, import, page trees and delta chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import encode_pages, fnv1a_sql, is_base64
from ..operators import sequence, validate
from ..plans.session_set import SessionSet
from ..schemas import COMPACTED, SESSIONS

MARKER, VERSION = "session-archive", 1
_ENTRY = "array<struct<order: double, eventId: string, blobId: string>>"
_REF = "array<struct<fromEventId: string, refName: string, toEventIds: array<string>>>"
_DOC = f"format string, version int, session string, entries {_ENTRY}, blobs map<string, struct<base64: string>>, references {_REF}, compacted string, bindings map<string, string>"


def export(s: SessionSet, marker: str = MARKER) -> DataFrame:
    """(session_id, archive): the whole of each session as a JSON text; one session is one value and must fit a row."""
    by = lambda rows, col, name: rows.groupBy("session_id").agg(F.array_sort(F.collect_list(col)).alias(name))
    entries = by(s.entries, F.struct(F.col("order"), F.col("event_id").alias("eventId"), F.col("blob_id").alias("blobId")), "entries")
    blobs = s.blobs.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("blob_id", F.struct(F.replace(F.replace(F.base64("payload"), F.lit("\r")), F.lit("\n")).alias("base64")))))).alias("blobs"))
    refs = by(s.references, F.struct(F.col("from_event_id").alias("fromEventId"), F.col("ref_name").alias("refName"), F.col("to_event_ids").alias("toEventIds")), "references")
    bound = s.bindings.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_id", "blob_id")))).alias("bindings"))
    done = by(s.compacted, F.struct("ord", F.struct(*[c for c in s.compacted.columns if c != "session_id"]).alias("x")), "compacted")
    rows = s.sessions.select("session_id", F.to_json(F.struct(*s.sessions.columns)).alias("session"))
    for more in (entries, blobs, refs, bound, done):
        rows = rows.join(more, "session_id", "left")
    doc = F.struct(F.lit(marker).alias("format"), F.lit(VERSION).alias("version"), "session", "entries", "blobs", "references", F.to_json(F.transform("compacted", lambda c: c["x"])).alias("compacted"), "bindings")
    return rows.select("session_id", F.to_json(doc).alias("archive"))


def parse(archives: DataFrame, marker: str = MARKER) -> tuple[SessionSet, DataFrame]:
    """(sessions, violations) of a frame with a column ``archive``; malformed documents are violations."""
    rows = archives.select(F.from_json("archive", _DOC).alias("d"), "archive").select("d.*", "archive")
    rows = rows.withColumn("s", F.from_json("session", SESSIONS)).withColumn("session_id", F.col("s.session_id"))
    ok = (F.col("format") == marker) & (F.col("version") == VERSION) & F.col("session_id").isNotNull()
    bad = rows.filter(~F.coalesce(ok, F.lit(False))).select("session_id", F.lit("archive").alias("rule"), F.substring("archive", 1, 80).alias("subject"))
    rows = rows.filter(F.coalesce(ok, F.lit(False)))
    blobs = rows.select("session_id", F.explode("blobs").alias("blob_id", "v")).select("session_id", "blob_id", F.col("v.base64").alias("b"))
    wrong = blobs.filter(~is_base64("b", padded=True)).select("session_id", F.lit("base64").alias("rule"), F.col("blob_id").alias("subject"))
    entries = rows.select("session_id", F.explode("entries").alias("e")).select("session_id", F.col("e.order").alias("order"), F.col("e.eventId").alias("event_id"), F.col("e.blobId").alias("blob_id"))
    refs = rows.select("session_id", F.explode("references").alias("r")).select("session_id", F.col("r.fromEventId").alias("from_event_id"), F.col("r.refName").alias("ref_name"), F.col("r.toEventIds").alias("to_event_ids"))
    bound = rows.select("session_id", F.explode("bindings").alias("event_id", "blob_id"))
    kind = "array<struct<" + COMPACTED.split(", ", 1)[1] + ">>"
    done = rows.select("session_id", F.explode(F.from_json("compacted", kind)).alias("c")).select("session_id", "c.*")
    out = SessionSet(rows.select("s.*"), entries, blobs.select("session_id", "blob_id", F.try_to_binary("b", F.lit("base64")).alias("payload")), refs, bound, done)
    return out, bad.union(wrong)


def read(spark: SparkSession, path: str, marker: str = MARKER, strict: bool = True) -> tuple[SessionSet, DataFrame]:
    """Archives from files, one document a line; lines that are not UTF-8 are violations, blank ones are passed over."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    raw = lines.select(F.coalesce(F.try_validate_utf8("value"), F.lit("")).alias("archive"))
    s, bad = parse(raw, marker)
    return s, bad.union(validate.violations(s)) if strict else bad


def write(s: SessionSet, path: str, marker: str = MARKER) -> None:
    """One line a session, through Spark's committer, partition files published as a whole."""
    export(s, marker).select("archive").write.text(path)


# -- page trees and chains -----------------------------------------------------------
def tree_pages(entries: DataFrame, fanout: int = 64) -> DataFrame:
    """(page_id, page_no, kind, payload, checksum): the pages of each session's packed tree, named page_<session>_<level>_<n>."""
    layout = sequence.leaf_layout(entries, fanout)
    name = lambda level, n: F.concat(F.lit("page_"), F.col("session_id"), F.lit("_"), level.cast("string"), F.lit("_"), n.cast("string"))
    rows = sequence.ranked(entries).withColumn("page_no", F.floor(F.col("rank") / fanout))
    leaves = rows.groupBy("session_id", "page_no").agg(F.array_sort(F.collect_list(F.struct(F.col("order"), F.col("event_id").alias("eventId"), F.col("blob_id").alias("blobId")))).alias("entries"))
    leaves = leaves.select(name(F.lit(0), F.col("page_no")).alias("page_id"), "page_no", F.lit("leaf").alias("kind"), F.to_json(F.struct(F.lit("leaf").alias("kind"), "entries")).alias("doc"))
    top = layout.filter("level > 0").alias("p").join(layout.alias("c"), (F.col("p.session_id") == F.col("c.session_id")) & (F.col("c.level") == F.col("p.level") - 1) & F.col("c.first_rank").between(F.col("p.first_rank"), F.col("p.last_rank")))
    top = top.select(F.col("p.session_id").alias("session_id"), F.col("p.level").alias("level"), F.col("p.page_no").alias("page_no"), F.struct(F.col("c.page_no").alias("child"), F.col("c.first_rank").alias("rank")).alias("c"))
    top = top.join(rows.select("session_id", F.col("rank").alias("_r"), "order"), (top["session_id"] == rows["session_id"]) & (F.col("c.rank") == F.col("_r"))).select(top["*"], "order")
    inner = top.groupBy("session_id", "level", "page_no").agg(F.array_sort(F.collect_list(F.struct("c.child", "order"))).alias("kids"))
    inner = inner.select(name(F.col("level"), F.col("page_no")).alias("page_id"), "page_no", F.lit("internal").alias("kind"), F.to_json(F.struct(F.lit("internal").alias("kind"), F.transform(F.slice("kids", 2, F.size("kids")), lambda k: k["order"]).alias("keys"), F.transform("kids", lambda k: name(F.col("level") - 1, k["child"])).alias("children"))).alias("doc"))
    rows = leaves.union(inner)
    return rows.select("page_id", "page_no", "kind", F.col("doc").cast("binary").alias("payload"), fnv1a_sql(F.concat(F.col("page_id"), F.col("doc")).cast("binary")).alias("checksum"))


def encoded_pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", encode_pages("page_id", "payload").alias("container"))


def merge_deltas(deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blobs, conflicts) of delta rows (session_id, blob_id, payload): an id keeps one payload, differing ones are a conflict."""
    g = deltas.groupBy("session_id", "blob_id").agg(F.min("payload").alias("payload"), F.max("payload").alias("_other"))
    return g.filter("payload = _other").drop("_other"), g.filter("payload <> _other").select("session_id", "blob_id")


def recovered(lines: DataFrame) -> DataFrame:
    """(file, seq, line) up to the last complete JSON line of each file: what a torn tail leaves."""
    good = lines.filter(F.try_parse_json("line").isNotNull())
    last = good.groupBy("file").agg(F.max("seq").alias("last"))
    return good.join(last, "file").filter("seq <= last").drop("last")
