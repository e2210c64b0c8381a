"""The engine's operators on small fixtures, with brute-force versions where order matters."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from eventloom.functions import codec, ids
from eventloom.operators import compaction, envelope, fork, gc, migrate, projection, sequence, validate
from eventloom.plans.session_set import SessionSet, empty
from eventloom.schemas import BLOBS, COMPACTED, ENTRIES, MAX_SAFE, REFERENCES, SESSIONS
from eventloom.sources import archive
from eventloom.sources.catalog import Catalog, InvalidSessions, SessionRepository

SID = "s"


def entries(spark, rows):
    return spark.createDataFrame([(s, float(o), e, f"blob_{e.rsplit('_', 1)[-1]}") for s, o, e in rows], ENTRIES)


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.session_id, r.order)):
        out.setdefault(r.session_id, []).append(r.event_id)
    return out


def ten(spark):
    return entries(spark, [(SID, i, f"evt_s_{i}") for i in range(10)])


def event(kind, data, **more):
    return json.dumps({"type": kind, "time": 1, "data": data} | more).encode()


def session_set(spark, payloads, counter=200, **record):
    """One session whose event i has payloads[i]."""
    fields = {"session_id": SID, "format_version": 1, "revision": 1, "next_event_counter": counter, "blob_id_watermark": 300} | record
    s = empty(spark, "sessions").unionByName(spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} {'int' if k == 'format_version' else 'string' if isinstance(v, str) else 'long'}" for k, v in fields.items())), allowMissingColumns=True)
    e = spark.createDataFrame([(SID, float(i), f"evt_s_{n}", f"blob_{n}") for i, n in enumerate(payloads)], ENTRIES)
    b = spark.createDataFrame([(SID, f"blob_{n}", p) for n, p in payloads.items()], BLOBS)
    return SessionSet(s, e, b, empty(spark, "references"), e.drop("order"), empty(spark, "compacted"))


def surface(n):
    return event("user/message", {"text": str(n)}, surfaceOp="append")


def marker_payloads(turn=None, seqs=(1, 2)):
    src = {"kind": "plugin", "plugin": "compact", "compactionId": "c1"}
    span = {"start": seqs[0], "end": seqs[-1]}
    return {
        101: event("compaction/start", {"compactionId": "c1", "turn": turn}),
        102: event("compaction/summary", {"compactionId": "c1", "summary": [], "shadowedRange": span, "shadowedSeqs": list(seqs), "shadowedTokenCount": 3, "provider": "p", "model": "m"}),
        100: event("user/message", {"id": "m", "role": "user", "content": [], "source": src}, surfaceOp={"op": "replace", **span}, sourceEventSeqs=list(seqs)),
        103: event("compaction/end", {"compactionId": "c1", "turn": turn}),
    }


def summary(spark, shadowed, seqs=(1, 2)):
    rows = [(SID, 0, "c1", "evt_s_100", ("evt_s_101", "evt_s_102", "evt_s_103"), (shadowed[0], shadowed[-1]), shadowed, (seqs[0], seqs[-1]), list(seqs), "[]", 3, "p", "m", None, None, None, None, None)]
    return spark.createDataFrame(rows, COMPACTED)


def request(spark, shadowed):
    n = (101, 102, 100, 103)
    return spark.createDataFrame([(SID, "c1", shadowed, *(f"evt_s_{i}" for i in n), *(f"blob_{i}" for i in n))], "session_id string, compaction_id string, shadowed_ids array<string>, start_id string, summary_id string, checkpoint_id string, end_id string, start_blob string, summary_blob string, checkpoint_blob string, end_blob string")


# -- sequences ---------------------------------------------------------------------
def test_ranks_over_sparse_orders(spark, monkeypatch):
    monkeypatch.setattr(sequence, "BUCKET", 4)
    e, _ = sequence.remove(entries(spark, [(SID, i - 5, f"evt_s_{i}") for i in range(30)]), spark.createDataFrame([(SID, "evt_s_3"), (SID, "evt_s_20")], "session_id string, event_id string"))
    ranks = {r.event_id: r.rank for r in sequence.ranked(e, width=4).collect()}
    assert len(ranks) == 28 and ranks["evt_s_4"] == 3 and ranks["evt_s_29"] == 27
    sides = sequence.split_at_event(e, spark.createDataFrame([(SID, "evt_s_15")], "session_id string, event_id string"))
    assert sides.filter("side = 'left'").agg(F.max("rank")).first()[0] == 14
    assert sorted(r.order for r in sequence.renumber(e).collect()) == list(range(28))


def test_replace_range(spark):
    bounds = spark.createDataFrame([(SID, 2, 5)], "session_id string, lo int, hi int")
    new = spark.createDataFrame([(SID, 0, "n0", "b")], "session_id string, sub int, event_id string, blob_id string")
    out = listed(sequence.replace_range(ten(spark), bounds, new))[SID]
    assert out == ["evt_s_0", "evt_s_1", "n0", "evt_s_6", "evt_s_7", "evt_s_8", "evt_s_9"]
    assert len(listed(sequence.replace_range(ten(spark), bounds, new.filter("false")))[SID]) == 6


def test_append_refuses_used_ids_and_renumbers(spark):
    e = entries(spark, [(SID, 0, "evt_s_0"), (SID, 2.0**53, "evt_s_1")])
    new = spark.createDataFrame([(SID, 7, "evt_s_2", "b2"), (SID, 9, "evt_s_0", "b3")], "session_id string, seq long, event_id string, blob_id string")
    out, bad = sequence.append(e, e.drop("order"), new)
    assert [r.subject for r in bad.collect()] == ["evt_s_0"]
    assert sorted(r.order for r in out.collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("n", [0, 1, 64, 65, 4096, 4097, 4160])
def test_leaf_layout(spark, n):
    e = spark.range(n).select(F.lit(SID).alias("session_id"), F.col("id").cast("double").alias("order"), F.col("id").cast("string").alias("event_id"), F.lit("b").alias("blob_id"))
    levels, width = {}, n
    while width > 1 or not levels and width:
        pages = [64] * (width // 64) + ([width % 64] if width % 64 else [])
        if levels and len(pages) > 1 and pages[-1] == 1:
            pages = [*pages[:-2], 65]
        levels[len(levels)] = pages
        width = len(pages)
    got = {}
    for r in sorted(sequence.leaf_layout(e).collect(), key=lambda r: (r.level, r.page_no)):
        got.setdefault(r.level, []).append(r.n)
    assert got == levels


def test_sequence_violations(spark):
    e = entries(spark, [(SID, 0, "a_1"), (SID, 0, "b_1"), (SID, 1, "a_1"), (SID, float("inf"), "c_1")])
    assert {(r.rule, r.subject) for r in sequence.violations(e).collect()} == {("duplicate-event", "a_1"), ("duplicate-order", "0.0"), ("order-not-finite", "c_1")}


# -- ids and codecs -----------------------------------------------------------------
def test_ids(spark):
    row = spark.createDataFrame([("rev-7", "rev-07x", f"rev-{MAX_SAFE}", "evt_a\nb_5", "evt_a\nb_5\n", "blob_08", "blob_8")], "a string, b string, c string, e string, f string, g string, h string").select(
        ids.revision_number("a"), ids.revision_number("b"), ids.next_revision("c"), ids.own_number(F.lit("a\nb"), "e"), ids.trailing_number("f"), ids.blob_number("g"), ids.blob_number("h"), ids.next_revision("a"))
    assert list(row.first()) == [7, None, None, 5, None, None, 8, "rev-8"]


def test_pages(spark):
    raw = codec.encode_page("page_1", b"payload")
    assert codec.decode_page(raw) == ("page_1", b"payload")
    for bad in (raw[:10], raw[:-1], raw + b"x", b"\0" + raw[1:], raw[:-1] + b"?", raw[:4] + b"\0\2" + raw[6:]):
        with pytest.raises(ValueError):
            codec.decode_page(bad)
    assert codec.fnv1a(b"") == 0x811C9DC5 and codec.fnv1a(b"a") == 0xE40C292C
    rows = spark.createDataFrame([("",), ("a",), ("foobar",)], "t string").select(codec.fnv1a_sql(F.col("t").cast("binary")))
    assert [r[0] for r in rows.collect()] == [codec.fnv1a(x) for x in (b"", b"a", b"foobar")]


def test_base64(spark):
    cases = {"": (True, True), "YQ==": (True, True), "YQ": (True, False), "YR==": (False, False), "Y": (False, False), "Y=Q=": (False, False), "YWJj": (True, True)}
    for text, want in cases.items():
        row = spark.createDataFrame([(text,)], "t string").select(codec.is_base64("t"), codec.is_base64("t", padded=True)).first()
        assert tuple(row) == want, text


def test_segments(spark):
    rows = [("a", i, n) for i, n in enumerate([4, 5, 2, 11, 9, 1, 1])]
    out = sorted(codec.pack_segments(spark.createDataFrame(rows, "store string, seq long, size long"), 10).collect(), key=lambda r: r.seq)
    assert [(r.segment, r.offset) for r in out] == [(0, 0), (0, 4), (1, 0), (None, None), (2, 0), (2, 9), (3, 0)]


# -- validation ----------------------------------------------------------------------
def test_turn_models_differ(spark):
    kinds = [("turn/start", "1"), ("turn/start", "2"), ("turn/end", "2"), ("x", None), ("turn/end", "9"), ("x", None)]
    rows = spark.createDataFrame([(SID, i, f"e{i}", k, t) for i, (k, t) in enumerate(kinds)], "session_id string, rank long, event_id string, type string, turn string")
    cursor = {r.rank: r.open_turn for r in envelope.turn_cursor(rows).collect()}
    assert [cursor[i] for i in range(6)] == [None, "1", "2", None, None, None]
    assert envelope.open_stack(rows).first().open == ["1"]


def test_valid_and_broken_sessions(spark):
    payloads = marker_payloads() | {1: b"event-0"}
    good = session_set(spark, payloads).with_(compacted=summary(spark, ["evt_s_50", "evt_s_51"]))
    assert validate.violations(good).collect() == []
    first = lambda s: {r.rule for r in validate.first_violation(validate.violations(s)).collect()}
    every = lambda s: {r.rule for r in validate.violations(s).collect()}
    assert "counter" in every(session_set(spark, payloads, counter=50).with_(compacted=good.compacted))
    assert "missing-blob" in every(good.with_(blobs=good.blobs.filter("blob_id <> 'blob_1'")))
    assert "shadowed-live" in every(good.with_(compacted=summary(spark, ["evt_s_1", "evt_s_51"])))
    assert "turn" in every(session_set(spark, marker_payloads(turn=4)).with_(compacted=good.compacted))
    assert "checkpoint-envelope" in every(session_set(spark, payloads | {100: surface(1)}).with_(compacted=good.compacted))
    assert "summary-payload" in every(good.with_(compacted=good.compacted.withColumn("model", F.lit("other"))))
    assert "marker-missing" in every(good.with_(compacted=good.compacted.withColumn("checkpoint_event_id", F.lit("evt_s_99"))))
    assert first(session_set(spark, payloads, cwd="relative").with_(compacted=good.compacted)) == {"record"}
    refs = spark.createDataFrame([(SID, "evt_s_1", "r", ["evt_s_100", "evt_s_100", "evt_s_7"])], REFERENCES)
    assert {"reference-targets", "dangling-reference"} <= every(good.with_(references=refs))


# -- compaction, fork, migration ------------------------------------------------------
def compactable(spark):
    payloads = {n: surface(n) if n in (2, 4, 5) else event("assistant/chunk", {}) if n == 3 else f"event-{n}".encode() for n in range(10)}
    s = session_set(spark, payloads, counter=10)
    extra = spark.createDataFrame([(SID, f"blob_{n}", p) for n, p in marker_payloads().items()], BLOBS)
    refs = spark.createDataFrame([(SID, "evt_s_9", "r", ["evt_s_4", "evt_s_1", "evt_s_2"]), (SID, "evt_s_4", "r", ["evt_s_1"])], REFERENCES)
    return s.with_(blobs=s.blobs.union(extra), references=refs)


def test_compaction(spark):
    gone = ["evt_s_2", "evt_s_4", "evt_s_5"]
    out, refused = compaction.compact(compactable(spark), request(spark, gone), summary(spark, gone))
    assert refused.collect() == []
    assert listed(out.entries)[SID] == [f"evt_s_{i}" for i in (0, 1, 101, 102, 100, 103, 3, 6, 7, 8, 9)]
    assert [tuple(r)[1:] for r in out.references.collect()] == [("evt_s_9", "r", ["evt_s_100", "evt_s_1"])]
    assert {r.blob_id for r in out.blobs.collect()} == {f"blob_{i}" for i in (0, 1, 3, 6, 7, 8, 9, 100, 101, 102, 103)}
    assert out.sessions.first().next_event_counter == 104 and out.compacted.count() == 1
    assert {r.event_id for r in out.bindings.collect()} >= set(gone)


def test_compaction_refusals(spark):
    rules = lambda gone: {r.rule for r in compaction.compact(compactable(spark), request(spark, gone), summary(spark, gone))[1].collect()}
    assert rules(["evt_s_2", "evt_s_5"]) == {"surface-not-shadowed"}
    assert "shadowed-not-surface" in rules(["evt_s_2", "evt_s_3", "evt_s_4", "evt_s_5"])
    assert "shadowed-not-live" in rules(["evt_s_2", "evt_s_77"])


def test_fork(spark):
    s = compactable(spark)
    at = lambda e, c="child": spark.createDataFrame([(SID, e, c)], "session_id string, event_id string, child_id string")
    child, refused = fork.fork(s, at("evt_s_5"))
    assert refused.collect() == [] and listed(child.entries) == {"child": [f"evt_s_{i}" for i in range(6)]}
    assert [tuple(r) for r in child.references.collect()] == [("child", "evt_s_4", "r", ["evt_s_1"])]
    assert child.sessions.first().seed_boundary_id == "evt_s_5" and child.blobs.count() == 6
    assert {r.rule for r in fork.fork(s, at("nope"))[1].collect()} == {"unknown-event"}
    assert {r.rule for r in fork.fork(s, at("evt_s_1", SID))[1].collect()} == {"child-id"}
    marked = session_set(spark, marker_payloads()).with_(compacted=summary(spark, ["evt_s_50"]))
    assert "bracket-cut" in {r.rule for r in fork.fork(marked, at("evt_s_102"))[1].collect()}
    turns = session_set(spark, {0: event("turn/start", {"turn": 1}), 1: surface(1), 2: event("turn/end", {"turn": 1})})
    assert {r.rule for r in fork.fork(turns, at("evt_s_1"))[1].collect()} == {"open-turn"}
    assert fork.fork(turns, at("evt_s_2"))[1].collect() == []


def test_migration(spark):
    msg = json.dumps({"id": "m", "role": "user", "content": [], "source": {"kind": "user"}})
    ok = [("a", 0, 0, "user/message", 1, msg, "append", None, None), ("a", 0, 1, "note", 1, "{}", None, None, True), ("a", 0, 2, "user/message", 1, msg, "append", [0], None)]
    bad = [("b", 0, 0, "user/message", 1, msg, None, None, None), ("c", 0, 0, "odd", 1, "{}", None, None, None), ("d", 0, 1, "turn/start", 1, "{}", None, None, None), ("e", 0, 0, "note", 1, '{"x":-0}', None, None, True), ("f", 1, 0, "note", 1, "{}", None, None, True)]
    rows = spark.createDataFrame(ok + bad, "session_id string, version int, seq long, type string, time long, data string, surface_op string, source_event_seqs array<long>, ignorable boolean")
    e, b, r, rejects = migrate.migrate(rows)
    assert listed(e) == {"a": ["evt_a_0", "evt_a_1", "evt_a_2"]}
    assert [tuple(x)[1:] for x in r.collect()] == [("evt_a_2", "sourceEventIds", ["evt_a_0"])]
    docs = {x.blob_id: json.loads(bytes(x.payload)) for x in b.collect()}
    assert docs["blob_1"] == {"type": "note", "time": 1, "data": {}, "ignorable": True} and docs["blob_2"]["sourceEventSeqs"] == [0]
    assert {(x.session_id, x.rule) for x in rejects.collect()} == {("b", "surface-missing"), ("c", "unknown-type"), ("d", "payload"), ("d", "contiguous"), ("e", "data"), ("f", "version")}


# -- projections, pages, archives, catalog ---------------------------------------------
def test_staleness_table(spark):
    e = ten(spark)
    done = spark.createDataFrame([(SID, "c", "evt_s_5", ["x_1"])], "session_id string, compaction_id string, checkpoint_event_id string, shadowed_ids array<string>")
    stale = lambda w, live=e: projection.needs_rebuild(spark.createDataFrame([(SID, w)], "session_id string, watermark_event_id string"), done, live).first().stale
    assert [stale(w) for w in (None, "x_1", "evt_s_4", "evt_s_5", "evt_s_7", "gone")] == [False, True, False, True, True, True]
    assert stale("evt_s_4", e.filter("event_id <> 'evt_s_5'")) is True


def test_projection_in_parts(spark):
    e = ten(spark)
    half = projection.advance(None, e.filter("order < 4"), F.col("order"))
    both = projection.advance(half, e, F.col("order")).first()
    assert (both.value, both.watermark_event_id) == (45.0, "evt_s_9")
    text = projection.ordered_fold(e, F.lit(""), F.substring("event_id", 7, 5), lambda s, v: F.concat(s, v)).first()
    assert text.value == "0123456789"


def test_reachability(spark):
    rnd = random.Random(3)
    docs = {f"p{i}": {"kind": "blob-appends", "prev": f"p{i - 1}"} for i in range(1, 60)} | {"p0": {"kind": "leaf"}, "loop": {"kind": "blob-appends", "prev": "loop"}}
    docs |= {f"t{i}": {"kind": "internal", "children": [f"t{c}" for c in (3 * i + 1, 3 * i + 2, 3 * i + 3) if c < 60] + ([f"p{rnd.randrange(60)}"] if i % 9 == 0 else [])} for i in range(60)}
    pages = spark.createDataFrame([(k, json.dumps(v).encode()) for k, v in docs.items()] + [("bad", b"\xff"), ("odd", b'{"kind":"other"}')], "page_id string, payload binary")
    for roots in (["t1"], ["p30", "loop"], ["t0"]):
        seen, todo = set(), list(roots)
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo += docs[p].get("children", []) + ([docs[p]["prev"]] if "prev" in docs[p] else [])
        kept, damaged = gc.sweep(pages, spark.createDataFrame([(r,) for r in roots], "page_id string"))
        assert {r.page_id for r in kept.collect()} == seen and not damaged.count()
    assert {r.page_id for r in gc.page_links(pages)[1].collect()} == {"bad", "odd"}


def test_archive_round_trip(spark, tmp_path):
    s = compactable(spark).with_(compacted=summary(spark, ["evt_s_77"]))
    back, bad = archive.parse(archive.export(s).select("archive"))
    assert bad.collect() == []
    for name, frame in s.frames().items():
        order = lambda f: sorted(map(repr, f.collect()))
        assert order(getattr(back, name).select(frame.columns)) == order(frame), name
    doc = json.loads(archive.export(s).first().archive)
    assert base64.b64decode(doc["blobs"]["blob_0"]["base64"]) == b"event-0"
    broken = spark.createDataFrame([(json.dumps(doc | {"version": 2}),), (json.dumps(doc | {"blobs": {"blob_0": {"base64": "YQ"}}}),)], "archive string")
    assert {r.rule for r in archive.parse(broken)[1].collect()} == {"archive", "base64"}


def test_delta_conflicts_and_torn_tails(spark):
    rows = spark.createDataFrame([(SID, "b1", b"x"), (SID, "b1", b"x"), (SID, "b2", b"x"), (SID, "b2", b"y")], BLOBS)
    good, bad = archive.merge_deltas(rows)
    assert [r.blob_id for r in good.collect()] == ["b1"] and [r.blob_id for r in bad.collect()] == ["b2"]
    lines = spark.createDataFrame([("f", 0, "{}"), ("f", 1, "{}"), ("f", 2, '{"a')], "file string, seq int, line string")
    assert sorted(r.seq for r in archive.recovered(lines).collect()) == [0, 1]


def test_catalog_commits(spark, tmp_path):
    repo = SessionRepository(Catalog(spark, str(tmp_path / "store")))
    s = session_set(spark, {0: surface(0), 1: surface(1)}, counter=2)
    assert repo.create(s).collect() == [] and [r.session_id for r in repo.create(s).collect()] == [SID]
    new = spark.createDataFrame([(SID, 5, surface(5)), (SID, 6, surface(6))], "session_id string, seq long, payload binary")
    assert repo.append(new).collect() == []
    now = repo.load(SID)
    assert listed(now.entries)[SID] == ["evt_s_0", "evt_s_1", "evt_s_2", "evt_s_3"]
    record = now.sessions.first()
    assert (record.revision, record.next_event_counter, record.blob_id_watermark, len(record.backups)) == (2, 4, 302, 1)
    stale = repo.catalog.commit(now, spark.createDataFrame([(SID, 1)], "session_id string, revision long"))
    assert [r.session_id for r in stale.collect()] == [SID] and repo.catalog.head() == 2
    assert repo.catalog.publish(now, 1) is None
    with pytest.raises(InvalidSessions):
        repo.catalog.commit(now.with_(sessions=now.sessions.withColumn("revision", F.lit(9).cast("long")), blobs=now.blobs.withColumn("payload", F.lit(b"changed"))), spark.createDataFrame([(SID, 2)], "session_id string, revision long"))
    repo.fork(spark.createDataFrame([(SID, "evt_s_1", "kid")], "session_id string, event_id string, child_id string"))
    assert repo.catalog.vacuum(1) == [] and repo.catalog.merge() == 4  # parts are shared by generations until they are merged
    assert repo.catalog.has_session("kid") and len(repo.catalog.vacuum(1)) >= 1 and repo.load("kid").entries.count() == 2


# -- losses -------------------------------------------------------------------------
def test_ranks_keep_every_row(spark):
    e = spark.createDataFrame([(SID, 1.0, "a", "b"), (SID, None, "c", "b"), (None, 0.0, "d", "b")], ENTRIES)
    assert {r.event_id: r.rank for r in sequence.ranked(e).collect()} == {"a": 0, "c": None, "d": 0}


@pytest.mark.parametrize("last, count, dense", [(2.0**53 - 6, 11, True), (2.0**53 - 6, 3, False), (-(2.0**60), 2, True), (2.5, 2, False)])
def test_batch_append_equals_single_appends(spark, last, count, dense):
    e = entries(spark, [(SID, last, "evt_s_0")])
    new = spark.createDataFrame([(SID, i, f"evt_s_{i + 1}", "b") for i in range(count)], "session_id string, seq long, event_id string, blob_id string")
    out, bad = sequence.append(e, e.drop("order"), new)
    orders = sorted(r.order for r in out.collect())
    assert not bad.count() and orders == ([float(i) for i in range(count + 1)] if dense else [last + i for i in range(count + 1)])
    assert not sequence.violations(out).count()


def test_replace_between_events(spark):
    bounds = lambda a, b: spark.createDataFrame([(SID, a, b)], "session_id string, first_id string, last_id string")
    new = lambda x: spark.createDataFrame([(SID, 0, x, "b")], "session_id string, sub int, event_id string, blob_id string")
    e = ten(spark)
    run = lambda a, b, x: sequence.replace_events(e, e.drop("order"), bounds(a, b), new(x))
    out, bad = run("evt_s_2", "evt_s_5", "n0")
    assert not bad.count() and listed(out)[SID] == ["evt_s_0", "evt_s_1", "n0", "evt_s_6", "evt_s_7", "evt_s_8", "evt_s_9"]
    for args, rule in ((("evt_s_5", "evt_s_2", "n0"), "range-inverted"), (("evt_s_5", "gone", "n0"), "unknown-event"), (("evt_s_2", "evt_s_5", "evt_s_3"), "event-reused")):
        out, bad = run(*args)
        assert {r.rule for r in bad.collect()} == {rule} and out.count() == 10


def test_split_refuses(spark):
    with pytest.raises(ValueError):
        sequence.split_at_order(ten(spark), float("inf"))
    with pytest.raises(ValueError):
        sequence.split_at_event(ten(spark), spark.createDataFrame([(SID, "gone")], "session_id string, event_id string"))


def test_sweep_stops_at_missing_pages(spark):
    pages = spark.createDataFrame([("a", b'{"kind":"internal","children":["b"]}'), ("x", b'{"kind":"leaf"}')], "page_id string, payload binary")
    kept, faults = gc.sweep(pages, spark.createDataFrame([("a",)], "page_id string"))
    assert kept.count() == 2 and [(r.page_id, r.reason) for r in faults.collect()] == [("b", "missing")]


def test_archive_files_of_many_sessions(spark, tmp_path):
    one = session_set(spark, {0: surface(0), 1: surface(1)}, counter=2)
    other = lambda f: f.unionByName(f.withColumn("session_id", F.lit("t"))).unionByName(f.withColumn("session_id", F.lit("u")))
    s = SessionSet(**{k: other(f) for k, f in one.frames().items()})
    archive.write(s.with_(sessions=s.sessions.coalesce(1)), str(tmp_path / "a"))
    back, bad = archive.read(spark, str(tmp_path / "a"), strict=False)
    assert not bad.count() and {r.session_id for r in back.sessions.collect()} == {SID, "t", "u"}
    for name, frame in s.frames().items():
        assert sorted(map(repr, getattr(back, name).select(frame.columns).collect())) == sorted(map(repr, frame.collect())), name


def test_bindings_only_grow(spark):
    s = session_set(spark, {0: surface(0), 1: surface(1)}, counter=2)
    lost = validate.commit_changes(s, s.with_(bindings=s.bindings.filter("event_id <> 'evt_s_0'")))
    assert [(r.rule, r.subject) for r in lost.collect()] == [("binding-lost", "evt_s_0")]
    moved = validate.commit_changes(s, s.with_(bindings=s.bindings.withColumn("blob_id", F.lit("blob_9"))))
    assert {r.rule for r in moved.collect()} == {"rebound"}


def test_unclaimed_start_inside_a_claimed_bracket(spark):
    row = lambda rank, kind, until=None: (SID, rank, f"e{rank}", kind, "c", None, True, None, False, False, until)
    names = "session_id string, rank long, event_id string, type string, compaction_id string, turn string, has_turn boolean, command string, has_error boolean, is_checkpoint boolean, until long"
    bad = lambda *rows: [r.subject for r in validate.transactions(spark.createDataFrame(list(rows), names)).collect()]
    assert bad(row(0, "claimed", 4), row(2, "compaction/start")) == ["e2"]
    assert bad(row(0, "claimed", 4), row(5, "compaction/start")) == []
    assert bad(row(0, "compaction/start"), row(1, "claimed", 3)) == ["e1"]


def test_appends_write_what_they_add(spark, tmp_path):
    repo = SessionRepository(Catalog(spark, str(tmp_path / "store")))
    one = session_set(spark, {0: surface(0), 1: surface(1)}, counter=2)
    many = lambda f: f.crossJoin(spark.range(50)).withColumn("session_id", F.concat(F.lit("s"), F.col("id").cast("string"))).drop("id")
    s = SessionSet(**{k: many(f) for k, f in one.frames().items()})
    ids_ = s.sessions.select("session_id")
    rename = lambda f: f.withColumn("event_id", F.concat(F.lit("evt_"), "session_id", F.lit("_"), F.regexp_extract("event_id", "[0-9]+$", 0)))
    repo.create(s.with_(entries=rename(s.entries), bindings=rename(s.bindings)))
    assert ids_.count() == 50
    for k in range(2):
        lost = repo.append(spark.createDataFrame([("s7", 1, surface(5)), ("nobody", 1, surface(5))], "session_id string, seq long, payload binary"))
        assert [r.session_id for r in lost.collect()] == ["nobody"]
    parts = repo.catalog._manifest(repo.catalog.head())
    assert len(parts) == 3 and parts[-1]["tables"] == ["sessions", "entries", "blobs", "bindings"]
    rows = {t: spark.read.parquet(str(tmp_path / "store" / "data" / parts[-1]["name"] / t)).count() for t in parts[-1]["tables"]}
    assert set(rows.values()) == {1}
    now = repo.load("s7")
    assert listed(now.entries)["s7"] == [f"evt_s7_{i}" for i in range(4)] and now.sessions.first().revision == 3
    assert not validate.violations(now).count() and repo.load().entries.count() == 102
