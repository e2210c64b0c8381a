"""Pages read back: trees and blob chains with all their checks, snapshots, and stores of pages and blobs.

Loaders return what is sound and a frame (session_id, rule, subject) of what isn't; a
session with any violation gives no rows.  Trees are followed level by level and chains
by pointer doubling, so the number of rounds is the depth of a tree and the logarithm of
the longest chain, for all sessions at once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import decode_page, decode_pages, encode_page, encode_pages, is_base64, pack_segments
from ..operators import sequence
from ..plans.session_set import materialize
from ..schemas import FANOUT, MAX_SAFE
from .catalog import Catalog, InvalidSessions

#: Page id of a snapshot, prefixes of page and blob ids.
SNAPSHOT_ID = "snapshot"
PAGE_PREFIX, BLOB_PREFIX = "page_", "blob_seg_"
_NUMBER = r"(BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"
_ENTRY = "array<struct<order: double, eventId: string, blobId: string>>"


def _rule(rows: DataFrame, rule: str | Column, subject: str | Column = "page_id") -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    return rows.select("session_id", (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), subject.alias("subject"))


def _shape(name: str, pattern: str) -> Column:
    """Whether a member of the document is an array of just one kind of element; an empty one is."""
    kind = F.schema_of_variant(F.variant_get("v", f"$.{name}", "variant"))
    return F.coalesce(kind.rlike(rf"\AARRAY<({pattern}|VOID)>\z"), F.lit(False))


def _nodes(pages: DataFrame) -> DataFrame:
    """page_id, kind, children, keys, entries, why (a page alone is no tree node)."""
    rows = pages.select("page_id", F.try_validate_utf8(F.col("payload").cast("string")).alias("doc")).withColumn("v", F.try_parse_json("doc"))
    get = lambda k: F.get_json_object("doc", f"$.{k}")
    rows = rows.withColumn("kind", F.try_variant_get("v", "$.kind", "string")).withColumn("children", F.from_json(get("children"), "array<string>")).withColumn("keys", F.from_json(get("keys"), "array<double>")).withColumn("entries", F.from_json(get("entries"), _ENTRY))
    entry = rf"OBJECT<(\w+: [^:]*, )*blobId: STRING, (\w+: [^:]*, )*eventId: STRING, (\w+: [^:]*, )*order: {_NUMBER}(, \w+: [^:]*)*>"
    whole = F.forall("entries", lambda e: e["order"].isNotNull() & e["eventId"].isNotNull() & e["blobId"].isNotNull())
    # from_json leaves gaps only where the document has them, so a fault in one entry shows as a null
    why = F.when(~F.coalesce(F.col("kind").isin("leaf", "internal"), F.lit(False)), "not-a-tree-page")
    why = why.when((F.col("kind") == "leaf") & ~(_shape("entries", entry) & F.coalesce(whole, F.lit(False))), "leaf-entries")
    why = why.when((F.col("kind") == "internal") & ~(_shape("children", "STRING") & _shape("keys", _NUMBER)), "internal-shape")
    return rows.withColumn("why", why).drop("doc", "v")


def _rising(values: str) -> Column:
    return F.forall(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1))), lambda i: (i >= F.size(values)) | (F.get(values, i) > F.get(values, i - 1)))


def load_trees(pages: DataFrame, roots: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(entries, violations) of the trees at roots (session_id, page_id) over pages (page_id, payload).

    Refused: missing and malformed pages, a page met twice or in a cycle, nodes beyond the
    fanout (a parent may have one child more) or with a single child, empty leaves below a
    root, children of unequal depth, keys that aren't the first orders of the children,
    orders that don't rise over the whole tree, and ids that come twice.
    """
    nodes = materialize(_nodes(pages))
    start = roots.select("session_id", "page_id").withColumn("parent", F.lit(None).cast("string")).withColumn("slot", F.lit(0)).withColumn("level", F.lit(0))
    level, met, seen = materialize(start), [], None
    while level.limit(1).count():
        met.append(level)
        here = level.select("session_id", "page_id").distinct()
        # a page is followed once; a second visit, as in a cycle, is only noted
        fresh = here if seen is None else here.join(seen, ["session_id", "page_id"], "left_anti")
        seen = here if seen is None else materialize(seen.union(fresh))
        up = fresh.join(nodes.filter("kind = 'internal' and why is null").filter(F.size("children") <= fanout + 1), "page_id")
        level = materialize(up.select("session_id", F.col("page_id").alias("parent"), F.posexplode("children").alias("slot", "page_id"), F.lit(len(met)).alias("level")).select(level.columns))
    visits = met[0] if met else level
    for more in met[1:]:
        visits = visits.union(more)
    visits = materialize(visits)
    tree = materialize(visits.join(nodes, "page_id", "left"))
    n, k = F.size("children"), F.size("keys")
    own = F.when(F.col("kind").isNull() & F.col("why").isNull(), "page-missing").when(F.col("why").isNotNull(), F.col("why"))
    own = own.when((F.col("kind") == "internal") & ((n < 2) | (n > fanout + 1) | (k != n - 1)), "internal-fanout").when((F.col("kind") == "internal") & ~_rising("keys"), "keys-not-rising")
    own = own.when((F.col("kind") == "leaf") & (F.size("entries") > fanout), "leaf-fanout").when((F.col("kind") == "leaf") & (F.size("entries") == 0) & (F.col("level") > 0), "empty-child")
    bad = [_rule(tree.withColumn("rule", own).filter("rule is not null").distinct(), F.col("rule"))]
    bad.append(_rule(visits.groupBy("session_id", "page_id").count().filter("count > 1"), "page-repeated"))
    leaves = tree.filter("kind = 'leaf' and why is null")
    depth = leaves.groupBy("session_id").agg(F.min("level").alias("a"), F.max("level").alias("b")).filter("a < b")
    bad.append(_rule(depth, "unequal-depth", F.concat_ws("-", "a", "b")))
    rows = materialize(leaves.select("session_id", "page_id", F.posexplode("entries").alias("i", "e")).select("session_id", "page_id", "i", "e.order", F.col("e.eventId").alias("event_id"), F.col("e.blobId").alias("blob_id")))
    # first and last order below each node, from the leaves up
    prev = F.lag("order").over(Window.partitionBy("session_id", "page_id").orderBy("i"))
    bad.append(_rule(rows.withColumn("prev", prev).filter("order <= prev"), "orders-not-rising", "event_id"))
    bad.append(_rule(rows.groupBy("session_id", "event_id").count().filter("count > 1"), "duplicate-event", "event_id"))
    spans = rows.groupBy("session_id", "page_id").agg(F.min_by("order", "i").alias("first"), F.max_by("order", "i").alias("last"))
    for depth_now in range(len(met) - 1, 0, -1):
        below = materialize(met[depth_now].join(spans, ["session_id", "page_id"]).select("session_id", F.col("parent").alias("page_id"), "slot", "first", "last"))
        keys = below.filter("slot > 0").join(nodes.select("page_id", "keys"), "page_id")
        bad.append(_rule(keys.filter(~F.coalesce(F.get("keys", F.col("slot") - 1) == F.col("first"), F.lit(False))), "key-not-first-order"))
        after = F.lead("first").over(Window.partitionBy("session_id", "page_id").orderBy("slot"))
        bad.append(_rule(below.withColumn("next", after).filter("next <= last"), "orders-not-rising"))
        spans = spans.unionByName(below.groupBy("session_id", "page_id").agg(F.min_by("first", "slot").alias("first"), F.max_by("last", "slot").alias("last")))
    found = bad[0]
    for more in bad[1:]:
        found = found.union(more)
    found = materialize(found.distinct())
    sound = rows.join(found.select("session_id").distinct(), "session_id", "left_anti")
    return sound.select("session_id", "order", "event_id", "blob_id"), found


def load_chains(pages: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blobs, violations) of the chains of delta pages at heads (session_id, page_id).

    A page of kind blob-appends leads to ``prev``; one without a kind ends its chain.  An id
    has one payload in a chain, so the order of pages doesn't matter.
    """
    text = F.try_validate_utf8(F.col("payload").cast("string"))
    rows = pages.select("page_id", text.alias("doc")).withColumn("v", F.try_parse_json("doc"))
    names = F.coalesce(F.json_object_keys("doc"), F.array().cast("array<string>"))
    kind_of = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get("v", p, "variant")), F.lit("VOID"))
    rows = rows.withColumn("kind", F.try_variant_get("v", "$.kind", "string")).withColumn("blobs", F.from_json(F.get_json_object("doc", "$.blobs"), "map<string, struct<base64: string>>"))
    why = F.when(~kind_of("$.blobs").startswith("OBJECT<") | F.col("blobs").isNull(), "blob-page")
    why = why.when(F.array_contains(names, "kind") & ~F.coalesce(F.col("kind") == "blob-appends", F.lit(False)), "unknown-kind")
    why = why.when((F.col("kind") == "blob-appends") & F.array_contains(names, "prev") & (kind_of("$.prev") != "STRING"), "prev")
    nodes = materialize(rows.withColumn("why", why).withColumn("prev", F.when((F.col("kind") == "blob-appends") & F.col("why").isNull(), F.try_variant_get("v", "$.prev", "string"))).drop("doc", "v"))
    jump = nodes.filter("prev is not null").select("page_id", F.col("prev").alias("to"))
    reach = materialize(heads.select("session_id", "page_id").distinct())
    while True:
        more = materialize(reach.join(jump, "page_id").select("session_id", F.col("to").alias("page_id")).join(reach, ["session_id", "page_id"], "left_anti").distinct())
        if not more.limit(1).count():
            break
        reach = materialize(reach.union(more))
        jump = materialize(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.page_id")).select("a.page_id", "b.to"))
    met = materialize(reach.join(nodes.withColumn("there", F.lit(True)), "page_id", "left"))
    bad = _rule(met.filter("there is null"), "page-missing").union(_rule(met.filter("why is not null"), F.col("why")))
    # a chain without an end (no page without prev, none missing) runs in a circle
    ends = met.groupBy("session_id").agg(F.bool_or(F.col("prev").isNull()).alias("ends"), F.min("page_id").alias("page_id"))
    bad = bad.union(_rule(ends.filter("not ends"), "page-repeated"))
    blobs = met.filter("why is null and there").select("session_id", F.explode("blobs").alias("blob_id", "b")).select("session_id", "blob_id", F.col("b.base64").alias("b"))
    bad = bad.union(_rule(blobs.filter(~is_base64("b", padded=True) | F.col("b").isNull()), "base64", "blob_id"))
    one = blobs.withColumn("payload", F.try_to_binary("b", F.lit("base64"))).groupBy("session_id", "blob_id").agg(F.min("payload").alias("payload"), F.max("payload").alias("other"))
    bad = materialize(bad.union(_rule(one.filter("payload <> other"), "payloads-differ", "blob_id")).distinct())
    return one.drop("other").join(bad.select("session_id").distinct(), "session_id", "left_anti"), bad


# -- snapshots -----------------------------------------------------------------------
def encode_snapshot(payload: bytes) -> bytes:
    return encode_page(SNAPSHOT_ID, payload)


def decode_snapshot(raw: bytes) -> bytes:
    name, payload = decode_page(raw)
    if name != SNAPSHOT_ID:
        raise ValueError("not a snapshot page")
    return payload


def write_snapshot(spark: SparkSession, path: str, payload: bytes) -> None:
    """Write aside, sync, and rename over what was there; readable by its owner only."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    target, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}._{uuid.uuid4().hex}")
    fs = target.getFileSystem(hadoop)
    out = fs.create(temp, False)
    out.write(encode_snapshot(payload))
    out.hsync()
    out.close()
    fs.setPermission(temp, jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), hadoop)
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(files.makeQualified(temp), files.makeQualified(target), over)


def read_snapshot(spark: SparkSession, path: str) -> bytes:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return decode_snapshot(bytes(stream.readAllBytes()))
    finally:
        stream.close()


# -- stores --------------------------------------------------------------------------
@dataclass
class _Parts:
    """Parquet parts named by manifests, whose rename is the flush: a part that none names is residue of a crash."""

    spark: SparkSession
    root: str

    @property
    def catalog(self) -> Catalog:
        return Catalog(self.spark, self.root)

    def _now(self) -> tuple[int, list[dict]]:
        c = self.catalog
        version = c.head()
        return version, c._manifest(version)

    def _put(self, rows: DataFrame, **more) -> dict:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root.rstrip('/')}/data/{name}/rows")
        return {"no": 0, "name": name, "tables": ["rows"], "replaces": False} | more

    def _rows(self, parts: list[dict], schema: str) -> DataFrame:
        folders = [f"{self.root.rstrip('/')}/data/{p['name']}/rows" for p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _mint(self, parts: list[dict], n: int) -> int:
        """The next number; numbers are never used again, whatever has been deleted."""
        first = max((p["until"] for p in parts), default=0)
        if first + n > MAX_SAFE:
            raise ValueError("ids would exceed the safe integers")
        return first

    def vacuum(self) -> list[str]:
        """Delete the parts that the newest manifest doesn't name."""
        return self.catalog.vacuum(1)


_PAGE = "page_id string, container binary"


@dataclass
class PageStore(_Parts):
    """Immutable pages with numbers that are never reused, verified on every read."""

    def write(self, payloads: DataFrame) -> DataFrame:
        """(seq, page_id) of payloads (seq long, payload), numbered in order of seq and published together."""
        rows = materialize(sequence.ranked(payloads.select(F.lit("").alias("session_id"), "seq", "payload"), "seq"))
        n = rows.count()
        while True:
            version, parts = self._now()
            first = self._mint(parts, n)
            ids = materialize(rows.select("seq", F.concat(F.lit(PAGE_PREFIX), (F.col("rank") + first).cast("string")).alias("page_id"), "payload"))
            part = self._put(ids.select("page_id", encode_pages("page_id", "payload").alias("container")), until=first + n, n=n)
            if self.catalog._point([*parts, part], version):
                return ids.select("seq", "page_id")

    def _containers(self) -> DataFrame:
        return self._rows(self._now()[1], _PAGE)

    def read(self, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(pages (page_id, payload), faults (page_id, reason)): of all pages, or of those wanted (page_id)."""
        rows = self._containers()
        if wanted is not None:
            rows = wanted.select("page_id").distinct().join(rows, "page_id", "left")
        rows = materialize(rows.select("page_id", F.col("container").isNull().alias("lost"), decode_pages(F.coalesce("container", F.lit(b""))).alias("x")))
        why = F.when(F.col("lost"), "missing").when(F.col("x.error").isNotNull(), F.col("x.error")).when(F.col("x.page_id") != F.col("page_id"), "page id mismatch")
        rows = rows.select("page_id", "x.payload", why.alias("reason"))
        return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").select("page_id", "reason")

    def page_ids(self) -> DataFrame:
        return self._containers().select("page_id")

    def has(self, page_id: str) -> bool:
        return bool(self.page_ids().filter(F.col("page_id") == page_id).limit(1).count())

    def size(self) -> int:
        return sum(p["n"] for p in self._now()[1])

    def retain(self, keep: DataFrame) -> int:
        """Drop all pages but these (page_id); returns how many went.  Their numbers stay used."""
        return self._rewrite(lambda rows: rows.join(keep.select("page_id").distinct(), "page_id", "left_semi"))

    def delete(self, gone: DataFrame) -> int:
        return self._rewrite(lambda rows: rows.join(gone.select("page_id").distinct(), "page_id", "left_anti"))

    def _rewrite(self, change) -> int:
        while True:
            version, parts = self._now()
            part = self._put(change(self._rows(parts, _PAGE)), until=self._mint(parts, 0))
            part["n"] = self._rows([part], _PAGE).count()
            if self.catalog._point([part], version):
                return sum(p["n"] for p in parts) - part["n"]

    def check(self) -> None:
        """Fail if a published part is gone or has lost rows; parts that were never published don't count."""
        for p in self._now()[1]:
            there = self.catalog._fs().exists(self.catalog._path("data", p["name"], "rows"))
            if not there or self._rows([p], _PAGE).count() < p["n"]:
                raise InvalidSessions(f"part {p['name']}: page data is lost")


_BLOB = "blob_id string, segment long, offset long, size long, payload binary, gone boolean"


@dataclass
class BlobStore(_Parts):
    """Blobs in segments of a fixed size: each goes behind the last one or opens a segment; deletes are logical."""

    def write(self, payloads: DataFrame) -> DataFrame:
        """(seq, blob_id, segment, offset, size) of payloads (seq long, payload); one larger than a segment refuses all."""
        rows = materialize(sequence.ranked(payloads.select(F.lit("").alias("session_id"), "seq", "payload"), "seq"))
        n = rows.count()
        while True:
            version, parts = self._now()
            first = self._mint(parts, n)
            segment, used = parts[-1]["end"] if parts else (0, 0)
            sizes = rows.select(F.lit("").alias("store"), F.col("rank").alias("seq"), F.octet_length("payload").alias("size"))
            at = materialize(pack_segments(sizes, start=(segment, used)))
            if at.filter("segment is null").limit(1).count():
                raise InvalidSessions("a blob exceeds the segment size")
            placed = rows.join(at.select(F.col("seq").alias("rank"), "segment", "offset", "size"), "rank")
            placed = materialize(placed.select("seq", F.concat(F.lit(BLOB_PREFIX), (F.col("rank") + first).cast("string")).alias("blob_id"), "segment", "offset", "size", "payload"))
            end = placed.agg(F.max(F.struct("segment", (F.col("offset") + F.col("size")).alias("used"))).alias("x")).first().x
            part = self._put(placed.select("blob_id", "segment", "offset", "size", "payload", F.lit(False).alias("gone")), until=first + n, end=[end.segment, end.used] if end else [segment, used])
            if self.catalog._point([*parts, part], version):
                return placed.drop("payload")

    def delete(self, gone: DataFrame) -> None:
        """Blobs (blob_id) that are not to be found any more; their space and their ids stay used."""
        gone = materialize(gone.select("blob_id").distinct())
        while True:
            version, parts = self._now()
            none = [F.lit(None).cast(t).alias(c) for c, t in (("segment", "long"), ("offset", "long"), ("size", "long"), ("payload", "binary"))]
            part = self._put(gone.select("blob_id", *none, F.lit(True).alias("gone")), until=self._mint(parts, 0), end=parts[-1]["end"] if parts else [0, 0])
            if self.catalog._point([*parts, part], version):
                return

    def blobs(self) -> DataFrame:
        rows = self._rows(self._now()[1], _BLOB)
        return rows.filter("not gone").drop("gone").join(rows.filter("gone").select("blob_id").distinct(), "blob_id", "left_anti")

    def read(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(blobs (blob_id, payload), missing (blob_id))."""
        wanted, live = wanted.select("blob_id").distinct(), self.blobs().select("blob_id", "payload")
        return wanted.join(live, "blob_id"), wanted.join(live, "blob_id", "left_anti")

    def size(self) -> int:
        return self.blobs().count()

    def segment_count(self) -> int:
        return 1 + (self._rows(self._now()[1], _BLOB).agg(F.max("segment")).first()[0] or 0) if self._now()[1] else 0
