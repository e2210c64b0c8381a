"""Reachability over pages, retention and sweeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session_set import materialize
from ..schemas import KEEP_BACKUPS


def page_links(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links (page_id, child), damaged (page_id, reason)) of pages (page_id, payload)."""
    text = F.try_validate_utf8(F.col("payload").cast("string"))
    rows = pages.select("page_id", text.alias("doc")).withColumn("ok", F.try_parse_json("doc").isNotNull() & F.col("doc").rlike(r"\A\s*[{\[]"))
    get = lambda k: F.get_json_object("doc", f"$.{k}")
    has = lambda k: F.array_contains(F.coalesce(F.json_object_keys("doc"), F.array().cast("array<string>")), k)
    kind, children, prev = get("kind"), F.from_json(get("children"), "array<string>"), get("prev")
    strings = F.coalesce(get("children").rlike(r'\A\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]\z'), F.lit(False))
    why = F.when(~F.coalesce("ok", F.lit(False)), "not JSON").when(has("kind") & ~F.coalesce(kind.isin("internal", "leaf", "blob-appends"), F.lit(False)), "unknown kind")
    why = why.when((kind == "internal") & ~strings, "children").when((F.coalesce(kind, F.lit("leaf")) == "leaf") & has("children"), "children on a leaf")
    why = why.when((kind == "blob-appends") & has("prev") & (prev.isNull() | prev.rlike(r"\A[\[{]|\A-?[0-9.]+\z|\A(true|false)\z")), "prev")
    rows = rows.withColumn("reason", why).withColumn("kids", F.when(kind == "internal", children).when((kind == "blob-appends") & prev.isNotNull(), F.array(prev)))
    return rows.filter("reason is null").select("page_id", F.explode("kids").alias("child")), rows.filter("reason is not null").select("page_id", "reason")


def reachable(links: DataFrame, roots: DataFrame) -> DataFrame:
    """page_id of all pages that roots (page_id) lead to.

    Chains grow with the number of appends, trees only in depth.  Pages with one child are
    doubled (each jump halves the rounds left); a frontier follows pages with several.
    """
    n = links.groupBy("page_id").count()
    single = materialize(links.join(n.filter("count = 1"), "page_id").select("page_id", "child"))
    multi = links.join(n.filter("count > 1"), "page_id").select("page_id", "child")
    seen = materialize(roots.select("page_id").distinct())
    frontier, have = seen, seen.count()
    while True:
        jump, reach = single, frontier
        while True:  # closure of the frontier over single links, by pointer doubling
            more = materialize(reach.join(jump, "page_id").select(F.col("child").alias("page_id")).join(reach, "page_id", "left_anti").distinct())
            if not more.limit(1).count():
                break
            reach = reach.union(more)
            jump = materialize(jump.alias("a").join(jump.alias("b"), F.col("a.child") == F.col("b.page_id")).select("a.page_id", "b.child"))
        nxt = reach.join(multi, "page_id").select(F.col("child").alias("page_id")).union(reach)
        new = materialize(nxt.distinct().join(seen, "page_id", "left_anti"))
        if not new.limit(1).count():
            return seen
        seen = materialize(seen.union(new))
        now = seen.count()
        if now == have:
            return seen
        frontier, have = new, now


def sweep(pages: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages to keep, faults (page_id, reason)): reachable pages that are damaged or missing.

    What a faulty page leads to is unknown, so with any fault every page is kept.
    """
    links, damaged = page_links(pages)
    live = materialize(reachable(links, roots))
    missing = live.join(pages, "page_id", "left_anti").select("page_id", F.lit("missing").alias("reason"))
    faults = materialize(damaged.join(live, "page_id", "left_semi").unionByName(missing))
    return pages if faults.limit(1).count() else pages.join(live, "page_id", "left_semi"), faults


def session_roots(sessions: DataFrame) -> DataFrame:
    """All page pointers of the records and of their backups."""
    four = lambda p: F.array(*(F.col(p + c) for c in ("root_page", "blob_map_page", "references_page", "compacted_page")))
    own = sessions.select(F.explode(four("")).alias("page_id"))
    old = sessions.select(F.explode("backups").alias("b")).select(F.explode(four("b.")).alias("page_id"))
    return own.union(old).filter("page_id is not null").distinct()


def retained(versions: DataFrame, keep: int = KEEP_BACKUPS) -> DataFrame:
    """The newest ``keep`` rows of each session of (session_id, revision, ..)."""
    w = Window.partitionBy("session_id").orderBy(F.desc("revision"))
    return versions.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
