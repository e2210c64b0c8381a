"""Trees and chains read back, snapshots, stores of pages and blobs."""

import json

import pytest
from pyspark.sql import functions as F

from eventloom.schemas import ENTRIES
from eventloom.sources import archive, pages
from eventloom.sources.catalog import Catalog, InvalidSessions


def tree(spark, docs, root="r"):
    rows = spark.createDataFrame([(k, (json.dumps(v) if isinstance(v, dict) else v).encode()) for k, v in docs.items()], "page_id string, payload binary")
    got, bad = pages.load_trees(rows, spark.createDataFrame([("s", root)], "session_id string, page_id string"), 4)
    return [(r.order, r.event_id) for r in sorted(got.collect(), key=lambda r: r.order)], sorted({r.rule for r in bad.collect()})


def leaf(*orders):
    return {"kind": "leaf", "entries": [{"order": o, "eventId": f"e{o}", "blobId": f"b{o}"} for o in orders]}


def inner(keys, *children):
    return {"kind": "internal", "keys": list(keys), "children": list(children)}


def test_saved_trees_load(spark):
    rows = [(s, float(2 * i), f"{s}{i}", f"b{i}") for s, n in (("a", 1), ("b", 17), ("c", 130)) for i in range(n)]
    entries = spark.createDataFrame(rows, ENTRIES)
    saved = archive.tree_pages(entries, 4)
    top = saved.select("page_id", F.split("page_id", "_").alias("x")).select("page_id", F.col("x")[1].alias("session_id"), F.col("x")[2].cast("int").alias("level"))
    roots = top.groupBy("session_id").agg(F.max_by("page_id", "level").alias("page_id"))
    got, bad = pages.load_trees(saved, roots, 4)
    assert not bad.count() and sorted(map(tuple, got.collect())) == sorted(rows)


@pytest.mark.parametrize(
    ("docs", "rules"),
    [
        ({"r": leaf()}, []),
        ({"r": leaf(1, 2.5, 3)}, []),
        ({"r": inner([3], "a", "b"), "a": leaf(1), "b": leaf(3, 4)}, []),
        ({"r": inner([3], "a", "b"), "a": leaf(1)}, ["page-missing"]),
        ({"r": "[1]"}, ["not-a-tree-page"]),
        ({"r": b"\xff".decode("latin1")}, ["not-a-tree-page"]),
        ({"r": {"kind": "leaf", "entries": [{"order": "1", "eventId": "e", "blobId": "b"}]}}, ["leaf-entries"]),
        ({"r": {"kind": "leaf", "entries": [{"order": 1, "eventId": 7, "blobId": "b"}]}}, ["leaf-entries"]),
        ({"r": {"kind": "leaf", "entries": [{"order": 1, "eventId": "e"}]}}, ["leaf-entries"]),
        ({"r": {"kind": "leaf"}}, ["leaf-entries"]),
        ({"r": {"kind": "internal", "keys": ["3"], "children": ["a", "b"]}}, ["internal-shape"]),
        ({"r": leaf(1, 2, 3, 4, 5)}, ["leaf-fanout"]),
        ({"r": leaf(2, 1)}, ["orders-not-rising"]),
        ({"r": inner([], "a"), "a": leaf(1)}, ["internal-fanout"]),
        ({"r": inner([3], "a", "b"), "a": leaf(1), "b": leaf()}, ["empty-child"]),
        ({"r": inner([2], "a", "b"), "a": leaf(1), "b": leaf(3)}, ["key-not-first-order"]),
        ({"r": inner([3], "a", "b"), "a": leaf(1, 5), "b": leaf(3)}, ["orders-not-rising"]),
        ({"r": inner([3], "a", "b"), "a": inner([2], "c", "d"), "b": leaf(3), "c": leaf(1), "d": leaf(2)}, ["unequal-depth"]),
    ],
)
def test_trees_are_checked(spark, docs, rules):
    got, bad = tree(spark, docs)
    assert bad == rules
    assert (got == []) if rules else (len(got) == sum(len(d["entries"]) for d in docs.values() if d["kind"] == "leaf"))


def test_cycles_and_second_references(spark):
    assert "page-repeated" in tree(spark, {"r": inner([1], "a", "a"), "a": leaf(1)})[1]
    assert "page-repeated" in tree(spark, {"r": inner([1], "r", "a"), "a": leaf(1)})[1]


def chain(spark, docs, head):
    rows = spark.createDataFrame([(k, json.dumps(v).encode()) for k, v in docs.items()], "page_id string, payload binary")
    got, bad = pages.load_chains(rows, spark.createDataFrame([("s", head)], "session_id string, page_id string"))
    return {r.blob_id: bytes(r.payload) for r in got.collect()}, sorted({r.rule for r in bad.collect()})


def test_chains(spark):
    page = lambda prev, **blobs: {"kind": "blob-appends", "blobs": {k: {"base64": v} for k, v in blobs.items()}} | ({"prev": prev} if prev else {})
    docs = {f"p{i}": page(f"p{i - 1}" if i else None, **{f"b{i}": "YQ=="}) for i in range(9)}
    assert chain(spark, docs, "p8") == ({f"b{i}": b"a" for i in range(9)}, [])
    assert chain(spark, docs, "p2")[0].keys() == {"b0", "b1", "b2"}
    assert chain(spark, docs | {"p0": {"blobs": {"z": {"base64": ""}}}}, "p1") == ({"b1": b"a", "z": b""}, [])
    assert chain(spark, docs | {"p0": page("p5", b0="YQ==")}, "p3")[1] == ["page-repeated"]
    assert chain(spark, docs | {"p0": page("gone")}, "p3")[1] == ["page-missing"]
    assert chain(spark, docs | {"p0": page(None, b3="Yg==")}, "p4")[1] == ["payloads-differ"]
    assert chain(spark, docs | {"p0": page(None, x="Y")}, "p4")[1] == ["base64"]
    assert chain(spark, docs | {"p0": {"kind": "leaf", "blobs": {}}}, "p4")[1] == ["unknown-kind"]
    assert chain(spark, docs | {"p0": {"kind": "blob-appends", "blobs": {}, "prev": 3}}, "p4")[1] == ["prev"]
    assert chain(spark, docs | {"p0": {"kind": "blob-appends", "blobs": []}}, "p4")[1] == ["blob-page"]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "state")
    for payload in (b"one", b""):
        pages.write_snapshot(spark, path, payload)
        assert pages.read_snapshot(spark, path) == payload
    assert (tmp_path / "state").stat().st_mode & 0o777 == 0o600
    with pytest.raises(ValueError, match="snapshot"):
        pages.decode_snapshot(pages.encode_page("page_1", b"x"))


def test_page_store(spark, tmp_path):
    store = pages.PageStore(spark, str(tmp_path / "store"))
    put = lambda *xs: sorted(r.page_id for r in store.write(spark.createDataFrame(list(enumerate(xs)), "seq long, payload binary")).collect())
    some = lambda *ids: spark.createDataFrame([(i,) for i in ids], "page_id string")
    assert put(b"a", b"b") == ["page_0", "page_1"] and put(b"c") == ["page_2"]
    got, bad = store.read(some("page_2", "page_9"))
    assert [(r.page_id, bytes(r.payload)) for r in got.collect()] == [("page_2", b"c")] and [tuple(r) for r in bad.collect()] == [("page_9", "missing")]
    assert store.retain(some("page_0")) == 2 and store.size() == 1 and store.has("page_0") and not store.has("page_2")
    assert put(b"d") == ["page_3"]  # freed numbers stay used
    assert store.delete(some("page_0")) == 1 and [r.page_id for r in store.page_ids().collect()] == ["page_3"]
    (tmp_path / "store" / "data" / "residue" / "rows").mkdir(parents=True)
    again = pages.PageStore(spark, str(tmp_path / "store"))
    again.check()
    assert again.size() == 1 and "residue" in again.vacuum()
    name = again._now()[1][-1]["name"]
    raw = spark.createDataFrame([("page_3", pages.encode_page("page_4", b"d"))], "page_id string, container binary")
    raw.write.mode("overwrite").parquet(str(tmp_path / "store" / "data" / name / "rows"))
    assert [r.reason for r in again.read()[1].collect()] == ["page id mismatch"]
    raw.limit(0).write.mode("overwrite").parquet(str(tmp_path / "store" / "data" / name / "rows"))
    with pytest.raises(InvalidSessions, match="lost"):
        again.check()


def test_blob_store(spark, tmp_path):
    store = pages.BlobStore(spark, str(tmp_path / "blobs"))
    put = lambda *xs: [tuple(r) for r in store.write(spark.createDataFrame([(i, b"x" * x) for i, x in enumerate(xs)], "seq long, payload binary")).orderBy("seq").collect()]
    some = lambda *ids: spark.createDataFrame([(i,) for i in ids], "blob_id string")
    mb = 1 << 20
    assert store.segment_count() == 0
    assert put(mb, 2 * mb, 5) == [(0, "blob_seg_0", 0, 0, mb), (1, "blob_seg_1", 1, 0, 2 * mb), (2, "blob_seg_2", 2, 0, 5)]
    assert put(7) == [(0, "blob_seg_3", 2, 5, 7)] and store.segment_count() == 3
    store.delete(some("blob_seg_2"))
    got, missing = store.read(some("blob_seg_2", "blob_seg_3"))
    assert [(r.blob_id, len(r.payload)) for r in got.collect()] == [("blob_seg_3", 7)] and [r.blob_id for r in missing.collect()] == ["blob_seg_2"]
    assert store.size() == 3 and put(1)[0][1:4] == ("blob_seg_4", 2, 12)
    with pytest.raises(InvalidSessions):
        put(2 * mb + 1)
    assert Catalog(spark, str(tmp_path / "blobs")).head() == 4


def test_reopened_catalog_is_checked(spark, tmp_path):
    from test_engine import SID, session_set, surface

    from eventloom.sources.catalog import SessionRepository

    repo = SessionRepository(Catalog(spark, str(tmp_path / "store")))
    repo.create(session_set(spark, {0: surface(0)}, counter=1))
    repo.append(spark.createDataFrame([(SID, 1, surface(5))], "session_id string, seq long, payload binary"))
    found = lambda: sorted(tuple(r) for r in repo.catalog.faults().collect())
    assert found() == [] and repo.load(SID).entries.count() == 2
    (tmp_path / "store" / "refs" / "_left").write_text("")
    assert found() == []
    (tmp_path / "store" / "refs" / "notes.txt").write_text("")
    assert found() == [("notes.txt", "foreign-file")]
    (tmp_path / "store" / "refs" / "notes.txt").unlink()
    parts = repo.catalog._manifest(2)
    twice = str(tmp_path / "store" / "data" / parts[0]["name"] / "sessions")
    spark.createDataFrame(spark.read.parquet(twice).collect(), spark.read.parquet(twice).schema).withColumn("revision", F.lit(2).cast("long")).write.mode("append").parquet(twice)
    assert found() == [(SID, "duplicate-record"), (SID, "revision-reused")]
    lost = tmp_path / "store" / "data" / parts[1]["name"] / "entries"
    lost.rename(tmp_path / "away")
    assert (parts[1]["name"], "part-missing") in found()
    (tmp_path / "store" / "refs" / "2").write_text("{")
    assert ("2", "manifest-unreadable") in found()


def test_loading_one_session_validates_it(spark, tmp_path):
    from test_engine import SID, session_set, surface

    from eventloom.sources.catalog import SessionRepository

    repo = SessionRepository(Catalog(spark, str(tmp_path / "store")))
    s = session_set(spark, {0: surface(0)}, counter=1)
    repo.catalog.register(s.with_(blobs=s.blobs.filter("false")), strict=False)
    with pytest.raises(InvalidSessions):
        repo.load(SID)
