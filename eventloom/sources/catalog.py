"""Versioned storage of a set of sessions: immutable Parquet parts, manifests and one pointer.

A commit writes one part, which holds only what it adds, and then publishes a manifest of
all parts by renaming a whole file to ``refs/<n>``, which must not exist yet; of two
committers who expect the same generation only one can publish it, also on another
machine.  Pointers are never deleted or rewritten by commits, so a revision can't come
back (ABA), a reader never sees half of one, and a failed commit leaves nothing but an
unreferenced folder, which ``vacuum`` removes.

Rows carry the number of their part.  Of a session's records the one of the newest part
counts.  An append adds a record and its new rows; a commit that replaces a session sets
the record's ``_since`` to its own part, and rows of that session in earlier parts are
dead.  Bytes written thus follow what is committed and not the size of the store; ``merge``
rewrites the parts as one when they have become many.

Within a generation each session carries its own revision; ``commit`` replaces the
sessions that it is given and returns those that were stale.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, gc, sequence, validate
from ..operators import fork as forking
from ..operators.projection import needs_rebuild
from ..plans.session_set import SessionSet, empty, materialize
from ..schemas import KEEP_BACKUPS, TABLES

#: Columns of the stored records beside their own: part, first part with live rows, greatest order.
_KEPT = {"_part": "long", "_since": "long", "_last": "double"}


class Storage(Protocol):
    """What a backend must offer."""

    def load(self, version: int | None = None) -> SessionSet: ...
    def publish(self, sessions: SessionSet, expected: int) -> int | None: ...
    def extend(self, rows: Callable[[int], SessionSet], expected: int, replaces: bool) -> int | None: ...
    def head(self) -> int: ...


class InvalidSessions(ValueError):
    """Raised with the first violation of each session in strict mode."""


@dataclass
class Catalog:
    spark: SparkSession
    root: str

    # -- files, through Hadoop's API, so that any shared store works -----------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return [x.getPath().getName() for x in self._fs().listStatus(p)] if self._fs().exists(p) else []

    def head(self) -> int:
        """The newest generation; 0: none."""
        return max((int(n) for n in self._names("refs") if n.isdigit()), default=0)

    def _manifest(self, version: int) -> list[dict]:
        """Parts of a generation: {no, name, tables}."""
        if not version:
            return []
        stream = self._fs().open(self._path("refs", str(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["parts"]
        finally:
            stream.close()

    def _read(self, table: str, parts: list[dict]) -> DataFrame:
        folders = [f"{self.root.rstrip('/')}/data/{p['name']}/{table}" for p in parts if table in p["tables"]]
        schema = TABLES[table] + (", _part long" if table != "sessions" else "".join(f", {c} {t}" for c, t in _KEPT.items()))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def records(self, version: int | None = None) -> DataFrame:
        """The newest record of each session, with the columns that the store keeps."""
        parts = self._manifest(self.head() if version is None else version)
        rows = self._read("sessions", parts)
        if sum("sessions" in p["tables"] for p in parts) < 2:
            return rows
        return rows.groupBy("session_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "session_id")), "_part").alias("_x")).select("session_id", "_x.*").select(rows.columns)

    def load(self, version: int | None = None) -> SessionSet:
        version = self.head() if version is None else version
        parts = self._manifest(version)
        records = self.records(version)
        out = {"sessions": records.drop(*_KEPT)}
        replaced = any(p["replaces"] for p in parts)
        since = records.select("session_id", "_since").filter("_since > 0")
        for t in TABLES:
            if t != "sessions":
                rows = self._read(t, parts)
                if replaced:
                    rows = rows.join(since, "session_id", "left").filter("_since is null or _part >= _since").drop("_since")
                out[t] = rows.select(empty(self.spark, t).columns)
        return SessionSet(**out)

    def _point(self, parts: list[dict], expected: int) -> int | None:
        """Publish a manifest as generation ``expected`` + 1, or None if another has."""
        hadoop, jvm = self.spark._jsc.hadoopConfiguration(), self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), hadoop)
        self._fs().mkdirs(self._path("refs"))
        temp, target = self._path("refs", f"_{uuid.uuid4().hex}"), self._path("refs", str(expected + 1))
        out = self._fs().create(temp, False)
        out.write(json.dumps({"parts": parts}).encode())
        out.hsync()
        out.close()
        q = lambda p: files.makeQualified(p)
        try:  # a rename that doesn't overwrite decides; what it publishes is whole
            files.rename(q(temp), q(target), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs().delete(temp, False)
            if "AlreadyExists" in str(e) or self._fs().exists(target):
                return None
            raise
        return expected + 1

    def _write(self, rows: SessionSet, no: int, replaces: bool) -> dict:
        """Write a part; tables without rows are left out."""
        name, tables = uuid.uuid4().hex, []
        for table, frame in rows.frames().items():
            if frame.limit(1).count():
                frame = frame if table == "sessions" else frame.withColumn("_part", F.lit(no).cast("long"))
                frame.write.parquet(f"{self.root.rstrip('/')}/data/{name}/{table}")
                tables.append(table)
        return {"no": no, "name": name, "tables": tables, "replaces": replaces}

    def _stored(self, s: SessionSet, no: int, since: int) -> SessionSet:
        last = s.entries.groupBy("session_id").agg(F.max("order").alias("_last"))
        return s.with_(sessions=s.sessions.join(last, "session_id", "left").select(*s.sessions.columns, F.lit(no).cast("long").alias("_part"), F.lit(since).cast("long").alias("_since"), "_last"))

    def publish(self, sessions: SessionSet, expected: int) -> int | None:
        """A generation of just these sessions, in one part, or None if ``expected`` is not the newest any more."""
        if self.head() != expected:
            return None
        no = 1 + max((p["no"] for p in self._manifest(expected)), default=0)
        return self._point([self._write(self._stored(sessions, no, 0), no, False)], expected)

    def extend(self, rows: Callable[[int], SessionSet], expected: int, replaces: bool) -> int | None:
        """Add a part: ``rows`` gets its number; sessions have the columns that the store keeps."""
        parts = self._manifest(expected)
        if self.head() != expected:
            return None
        no = 1 + max((p["no"] for p in parts), default=0)
        return self._point([*parts, self._write(rows(no), no, replaces)], expected)

    def merge(self) -> int | None:
        """Rewrite all parts as one; readers of older generations are not disturbed."""
        version = self.head()
        return self.publish(self.load(version), version)

    def vacuum(self, keep: int = KEEP_BACKUPS + 1) -> list[str]:
        """Delete folders that none of the newest generations names; older pointers stay as the record of used revisions."""
        live = {p["name"] for v in range(max(1, self.head() - keep + 1), self.head() + 1) for p in self._manifest(v)}
        gone = [n for n in self._names("data") if n not in live]
        for n in gone:
            self._fs().delete(self._path("data", n), True)
        return gone

    def faults(self) -> DataFrame:
        """(subject, rule) of what a store that is opened again must not have.

        Foreign names and gaps among the pointers, a manifest that can't be read, parts that
        are gone, a session twice in one part, and a revision that was used before.  Names
        with an underscore are what interrupted commits leave.
        """
        names = [n for n in self._names("refs") if not n.startswith(("_", "."))]
        head, found = self.head(), [(n, "foreign-file") for n in names if not n.isdigit()]
        found += [(str(n), "pointer-missing") for n in sorted({*range(1, head + 1)} - {int(n) for n in names if n.isdigit()})]
        parts: list[dict] = []
        try:
            parts = self._manifest(head)
            parts = [p | {"tables": list(p["tables"]), "no": int(p["no"])} for p in parts]
        except (ValueError, KeyError, TypeError, Py4JJavaError):  # the last: a file system that finds a bad checksum
            found.append((str(head), "manifest-unreadable"))
        gone = [p for p in parts if not all(self._fs().exists(self._path("data", p["name"], t)) for t in p["tables"])]
        found += [(p["name"], "part-missing") for p in gone]
        rows = self._read("sessions", [p for p in parts if p not in gone])
        twice = rows.groupBy("session_id", "_part").count().filter("count > 1").select(F.col("session_id").alias("subject"), F.lit("duplicate-record").alias("rule"))
        again = rows.groupBy("session_id", "revision").agg(F.count_distinct("_part").alias("n")).filter("n > 1").select("session_id", F.lit("revision-reused"))
        return self.spark.createDataFrame(found, "subject string, rule string").union(twice.distinct()).union(again)

    # -- commits ---------------------------------------------------------------------
    def register(self, new: SessionSet, strict: bool = True) -> DataFrame:
        """Create sessions; returns ids that exist already (nothing is written for those)."""
        return self._update(lambda old: (new, new.sessions.join(old.sessions.select("session_id"), "session_id", "left_semi").select("session_id")), strict)

    def commit(self, new: SessionSet, expected: DataFrame, strict: bool = True) -> DataFrame:
        """Replace sessions if their stored revision equals ``expected`` (session_id, revision); returns the stale ids.

        Unknown sessions, revisions that do not advance and lower counters are stale or
        refused as a whole; blobs, bindings and prefixes are checked against the old state.
        """

        def change(old: SessionSet):
            at = old.sessions.select("session_id", F.col("revision").alias("_have"), F.col("next_event_counter").alias("_counter"))
            rows = new.sessions.select("session_id", "revision", "next_event_counter").join(at, "session_id", "left").join(expected.select("session_id", F.col("revision").alias("_want")), "session_id", "left")
            ok = (F.col("_have") == F.col("_want")) & (F.col("revision") > F.col("_have")) & (F.col("next_event_counter") >= F.col("_counter"))
            return new, rows.filter(~F.coalesce(ok, F.lit(False))).select("session_id")

        return self._update(change, strict, True)

    def _update(self, change: Callable, strict: bool, again: bool = False) -> DataFrame:
        while True:
            version = self.head()
            old = self.load(version)
            new, stale = change(old)
            stale = materialize(stale.distinct())
            # checks and the write both read the new state: it is computed once
            good = SessionSet(**{t: materialize(f) for t, f in _without(new, stale).frames().items()})
            if not good.sessions.limit(1).count():
                return stale
            if strict:
                found = validate.violations(good)
                if again:
                    ids = good.sessions.select("session_id")
                    found = found.union(validate.commit_changes(_only(old, ids), good))
                first = validate.first_violation(found).limit(20).collect()
                if first:
                    raise InvalidSessions("; ".join(f"{r.session_id}: {r.rule} ({r.subject})" for r in first))
            put = _backed_up(old, good)
            if self.extend(lambda no: self._stored(put, no, no if again else 0), version, again):  # noqa: B023
                return stale

    # -- reads -----------------------------------------------------------------------
    def record(self, session_id: str) -> DataFrame:
        return self.records().drop(*_KEPT).filter(F.col("session_id") == session_id)

    def has_session(self, session_id: str) -> bool:
        return bool(self.record(session_id).limit(1).count())


def _without(s: SessionSet, ids: DataFrame) -> SessionSet:
    return SessionSet(**{t: f.join(ids.select("session_id"), "session_id", "left_anti").select(f.columns) for t, f in s.frames().items()})


def _only(s: SessionSet, ids: DataFrame) -> SessionSet:
    return SessionSet(**{t: f.join(ids.select("session_id"), "session_id", "left_semi").select(f.columns) for t, f in s.frames().items()})


_POINTERS = ("root_page", "references_page", "blob_map_page", "compacted_page", "seed_boundary_id")


def _next_backups(sessions: DataFrame, old: DataFrame) -> DataFrame:
    """Records with the generation before in front of the backups, trimmed to the cap."""
    kind = old.schema["backups"].dataType
    none = F.array().cast(kind)
    prior = old.select("session_id", F.slice(F.concat(F.array(F.struct(*_POINTERS)), F.coalesce("backups", none)), 1, KEEP_BACKUPS).alias("_b"))
    rows = sessions.join(prior, "session_id", "left")
    return rows.withColumn("backups", F.coalesce("_b", F.slice(F.coalesce("backups", none), 1, KEEP_BACKUPS))).select(sessions.columns)


def _backed_up(old: SessionSet, new: SessionSet) -> SessionSet:
    return new.with_(sessions=_next_backups(new.sessions, old.sessions))


@dataclass
class SessionRepository:
    """Public API over many sessions: mints ids and revisions and publishes through a catalog."""

    catalog: Catalog

    def create(self, new: SessionSet) -> DataFrame:
        return self.catalog.register(new)

    def load(self, session_id: str | None = None) -> SessionSet:
        """All sessions, or one, which is validated as a whole."""
        s = self.catalog.load()
        if session_id is None:
            return s
        one = SessionSet(**{t: f.filter(F.col("session_id") == session_id) for t, f in s.frames().items()})
        if first := validate.first_violation(validate.violations(one)).limit(1).collect():
            raise InvalidSessions(f"{session_id}: {first[0].rule} ({first[0].subject})")
        return one

    def append(self, events: DataFrame) -> DataFrame:
        """Append (session_id, seq, payload) to their sessions, in order of seq, in one commit; returns unknown ids.

        Ids are minted above the counters of the records, so they are new to the lineage and
        nothing but the records is read; only the new rows are written.  Where the new events
        hold boundaries or markers, or orders would pass the safe integers, the touched
        sessions are rewritten and validated as a whole.
        """
        doc = F.try_validate_utf8(F.col("payload").cast("string"))
        kind = F.when(F.try_parse_json(doc).isNotNull(), F.get_json_object(doc, "$.type"))
        point = F.coalesce(F.get_json_object(doc, "$.data.source.plugin") == "compact", F.lit(False))
        events = materialize(events)
        bound = events.filter(F.coalesce(kind.rlike("^(compaction|turn|session)/"), F.lit(False)) | point)
        whole = bool(bound.limit(1).count())
        while True:
            version = self.catalog.head()
            records = self.catalog.records(version)
            rows = materialize(sequence.minted(records, events).select("session_id", "seq", "payload", "event_id", "blob_id"))
            n = rows.groupBy("session_id").agg(F.count("*").alias("_n"))
            mine = materialize(records.join(n, "session_id"))
            if whole or mine.filter(F.col("_last") + F.col("_n") > 2.0**53).limit(1).count():
                return self._append_whole(rows, version)
            last = mine.select("session_id", F.coalesce("_last", F.lit(-1.0)).alias("_last"))
            new = sequence.ranked(rows, "seq").join(last, "session_id").withColumn("order", F.col("_last") + 1 + F.col("rank"))
            put = materialize(new.select("session_id", "order", "event_id", "blob_id", "payload"))
            sessions = mine.withColumn("_last", F.coalesce("_last", F.lit(-1.0)) + F.col("_n"))
            for c, by in (("next_event_counter", F.col("_n")), ("blob_id_watermark", F.col("_n")), ("revision", F.lit(1))):
                sessions = sessions.withColumn(c, F.col(c) + by)
            sessions = _next_backups(sessions, mine)
            blank = {t: empty(self.catalog.spark, t) for t in ("references", "compacted")}
            kept = [*empty(self.catalog.spark, "sessions").columns]
            part = lambda no: SessionSet(sessions=sessions.select(*kept, F.lit(no).cast("long").alias("_part"), "_since", "_last"), entries=put.drop("payload"), blobs=put.select("session_id", "blob_id", "payload"), bindings=put.select("session_id", "event_id", "blob_id"), **blank)  # noqa: B023, E731
            if not mine.limit(1).count() or self.catalog.extend(part, version, False):
                return events.select("session_id").distinct().join(mine.select("session_id"), "session_id", "left_anti")

    def _append_whole(self, rows: DataFrame, version: int) -> DataFrame:
        old = self.catalog.load(version)
        entries, bad = sequence.append(old.entries.join(rows.select("session_id").distinct(), "session_id", "left_semi"), old.bindings, rows.select("session_id", "seq", "event_id", "blob_id"))
        if bad.limit(1).count():
            raise InvalidSessions("an event id was used before")
        n = rows.groupBy("session_id").agg(F.count("*").alias("_n"))
        mine = _only(old, n.select("session_id"))
        sessions = mine.sessions.join(n, "session_id")
        for c, by in (("next_event_counter", F.col("_n")), ("blob_id_watermark", F.col("_n")), ("revision", F.lit(1))):
            sessions = sessions.withColumn(c, F.col(c) + by)
        put = rows.select("session_id", "event_id", "blob_id")
        new = mine.with_(sessions=sessions.select(old.sessions.columns), entries=entries.select(old.entries.columns), blobs=mine.blobs.union(rows.select("session_id", "blob_id", "payload")), bindings=mine.bindings.union(put))
        return self.catalog.commit(new, mine.sessions.select("session_id", "revision"))

    def compact(self, requests: DataFrame, summaries: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(stale ids, refusals) of requests as of ``compaction``, with the payloads (session_id, blob_id, payload) of their markers."""
        old = _only(self.catalog.load(), requests.select("session_id"))
        clash = payloads.join(old.blobs.select("session_id", "blob_id"), ["session_id", "blob_id"], "left_semi")
        bad = clash.select("session_id", F.lit("marker-blob-used").alias("rule"), F.col("blob_id").alias("subject"))
        requests = requests.join(bad.select("session_id").distinct(), "session_id", "left_anti")
        new, refused = compaction.compact(old.with_(blobs=old.blobs.unionByName(payloads)), requests, summaries)
        top = payloads.groupBy("session_id").agg(F.max(F.substring("blob_id", 6, 40).try_cast("long")).alias("_m"))
        sessions = new.sessions.join(top, "session_id", "left").withColumn("blob_id_watermark", F.greatest("blob_id_watermark", "_m")).withColumn("revision", F.col("revision") + 1)
        refused = materialize(refused.union(bad))
        good = _without(new.with_(sessions=sessions.select(old.sessions.columns)), refused.select("session_id").distinct())
        return self.catalog.commit(good, old.sessions.select("session_id", "revision")), refused

    def fork(self, boundaries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(ids that exist already, refusals) of (session_id, event_id, child_id)."""
        children, refused = forking.fork(_only(self.catalog.load(), boundaries.select("session_id")), boundaries)
        return self.catalog.register(children), refused

    def projection_needs_rebuild(self, state: DataFrame) -> DataFrame:
        s = self.catalog.load()
        return needs_rebuild(state, s.compacted, s.entries)

    def gc(self, pages: DataFrame) -> DataFrame:
        """Pages that records or backups lead to; faulty reachable pages stop the sweep."""
        kept, faults = gc.sweep(pages, gc.session_roots(self.catalog.records()))
        if first := faults.limit(5).collect():
            raise InvalidSessions("; ".join(f"page {r.page_id}: {r.reason}" for r in first))
        return kept
