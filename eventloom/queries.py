"""Registry of the engine's queries over the driver's tables, each with DuckDB SQL of the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .functions import codec, ids
from .operators import compaction, envelope, fork, gc, migrate, projection, sequence, validate
from .plans.session_set import SessionSet, empty, materialize, shared_folder
from .sources import archive, pages

_Q: dict[str, Callable] = {}
_O: dict[str, str] = {}

#: The adapters in DuckDB: event log e, references r, shadowed events sh, ranges sp, compacted entries ce.
_E = """
WITH RECURSIVE e0 AS (SELECT 'u' || user_id AS session_id, user_id, event_id AS n, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rank,
  regexp_extract(props, '"k": (\\d+)', 1)::BIGINT AS k FROM events),
e AS (SELECT session_id, user_id, n, rank::BIGINT AS rank, k, 'evt_' || session_id || '_' || rank AS event_id, 'blob_' || rank AS blob_id,
  CASE event_type WHEN 'signup' THEN 'turn/start' WHEN 'error' THEN 'turn/end' ELSE event_type END AS type, event_type IN ('view', 'click', 'purchase') AS surface FROM e0),
sz AS (SELECT session_id, count(*) AS n FROM e GROUP BY session_id),
r AS (SELECT session_id, event_id AS from_event_id, p - 1 AS pos, 'evt_' || session_id || '_' || (rank - 3 + p) AS target FROM e, (SELECT unnest([1, 2]) AS p) WHERE type = 'purchase' AND rank - 3 + p >= 0),
sf AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS c FROM e WHERE surface),
sh AS (SELECT session_id, event_id, rank FROM sf WHERE i < floor(0.4 * c)),
sp AS (SELECT session_id, min(rank) AS first, max(rank) AS last FROM sh GROUP BY session_id),
cm AS (SELECT session_id, first AS pos, x AS sub, 'evt_' || session_id || '_' || (sz.n + x - 1) AS event_id, 'blob_' || (sz.n + x - 1) AS blob_id FROM sp JOIN sz USING (session_id), (SELECT unnest([1, 2, 3, 4]) AS x)),
cs AS (SELECT session_id, rank AS pos, 0 AS sub, event_id, blob_id FROM e WHERE NOT EXISTS (SELECT 1 FROM sh WHERE sh.session_id = e.session_id AND sh.event_id = e.event_id) AND session_id IN (SELECT session_id FROM sp)),
ce AS (SELECT session_id, event_id, blob_id, (row_number() OVER (PARTITION BY session_id ORDER BY pos, sub) - 1)::BIGINT AS rank FROM (SELECT * FROM cs UNION ALL SELECT * FROM cm))
"""


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _Q[name or f.__name__] = f
        if sql:
            _O[name or f.__name__] = sql
        return f

    return add


def _shadow(log: DataFrame) -> DataFrame:
    return compaction.surface_share(log, 0.4)


def _requests(log: DataFrame) -> DataFrame:
    """Compaction requests: the first two fifths of each session's surface events, new ids behind the session's counter."""
    n = log.groupBy("session_id").agg(F.count("*").alias("n"))
    rows = _shadow(log).groupBy("session_id").agg(F.array_sort(F.collect_list("event_id")).alias("shadowed_ids")).join(n, "session_id").withColumn("compaction_id", F.lit("c1"))
    for i, role in enumerate(compaction.ROLES):
        rows = rows.withColumn(f"{role}_id", ids.event_id("session_id", F.col("n") + i)).withColumn(f"{role}_blob", ids.blob_id(F.col("n") + i))
    return rows


def _gone(log: DataFrame) -> DataFrame:
    n = log.groupBy("session_id").agg(F.count("*").alias("n"))
    return _shadow(log).join(n, "session_id").select("session_id", "event_id", ids.event_id("session_id", F.col("n") + 2).alias("checkpoint_id"))


def _compacted(log: DataFrame) -> DataFrame:
    gone = materialize(_gone(log))
    n = log.groupBy("session_id").agg(F.count("*").alias("n"))
    put = n.select("session_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("sub"), "n").select("session_id", "sub", ids.event_id("session_id", F.col("n") + F.col("sub") - 1).alias("event_id"), ids.blob_id(F.col("n") + F.col("sub") - 1).alias("blob_id"))
    return compaction.rewrite(A.entries(log), gone, compaction.ranges(log, gone), put)


# -- sequence ------------------------------------------------------------------------
@query(_E + "SELECT session_id, rank, event_id, blob_id FROM e")
def seq_entries_dense(spark, d):
    return sequence.ranked(sequence.renumber(A.entries(A.event_log(spark, d)))).select("session_id", "rank", "event_id", "blob_id")


@query(_E + "SELECT w.session_id AS session_id, w.event_id AS event_id, e.rank AS rank FROM (SELECT session_id, 'evt_' || session_id || '_' || (n - 1 + x) AS event_id FROM sz, (SELECT unnest([0, 5]) AS x)) w LEFT JOIN e ON e.session_id = w.session_id AND e.event_id = w.event_id")
def seq_rank_lookup(spark, d):
    e = A.entries(A.event_log(spark, d))
    wanted = e.groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.explode(F.array(F.lit(0), F.lit(5))).alias("x"), "n")
    return sequence.rank_of(e, wanted.select("session_id", F.concat(F.lit("evt_"), "session_id", F.lit("_"), (F.col("n") - 1 + F.col("x")).cast("string")).alias("event_id"))).select("session_id", "event_id", "rank")


@query(_E + "SELECT w.session_id AS session_id, w.rank AS rank, e.event_id AS event_id, e.blob_id AS blob_id FROM (SELECT session_id, x::BIGINT AS rank FROM sz, (SELECT unnest([-1, 0, 3, 1000000000]) AS x)) w LEFT JOIN e ON e.session_id = w.session_id AND e.rank = w.rank")
def seq_at_rank(spark, d):
    e = A.entries(A.event_log(spark, d))
    wanted = e.select("session_id").distinct().select("session_id", F.explode(F.array(*(F.lit(x).cast("long") for x in (-1, 0, 3, 1000000000)))).alias("rank"))
    return sequence.at(e, wanted).select("session_id", "rank", "event_id", "blob_id")


@query(_E + ", a AS (SELECT 'u' || c_custkey AS session_id FROM customer) SELECT a.session_id AS session_id, coalesce(sz.n, 0)::BIGINT AS size FROM a LEFT JOIN sz ON sz.session_id = a.session_id")
def seq_size(spark, d):
    sessions = A.table(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("session_id"))
    return sequence.size(sessions, A.entries(A.event_log(spark, d)))


@query(_E + "SELECT e.session_id AS session_id, (sz.n + rank)::BIGINT AS rank, 'evt_' || e.session_id || '_' || (sz.n + rank) AS event_id, 'blob_' || (sz.n + rank) AS blob_id FROM e JOIN sz USING (session_id) UNION ALL SELECT session_id, rank, event_id, blob_id FROM e")
def seq_append_minted(spark, d):
    log = A.event_log(spark, d)
    sessions = log.groupBy("session_id").agg(F.count("*").alias("next_event_counter"), (F.count("*") - 1).alias("blob_id_watermark"))
    new = sequence.minted(sessions, log.select("session_id", F.col("n").alias("seq"))).select("session_id", "seq", "event_id", "blob_id")
    both, _ = sequence.append(A.entries(log), A.entries(log).drop("order"), new)
    return sequence.ranked(both).select("session_id", "rank", "event_id", "blob_id")


@query(_E + """, b AS (SELECT session_id, 2 AS lo, least(5, n - 1) AS hi FROM sz WHERE n > 2),
x AS (SELECT session_id, rank AS pos, 0 AS sub, event_id, blob_id FROM e LEFT JOIN b USING (session_id) WHERE b.lo IS NULL OR rank < lo OR rank > hi
      UNION ALL SELECT session_id, lo, 1, 'new_' || session_id, 'blob_new' FROM b)
SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY pos, sub) - 1)::BIGINT AS rank, event_id, blob_id FROM x""")
def seq_replace_range(spark, d):
    e = A.entries(A.event_log(spark, d))
    b = e.groupBy("session_id").agg(F.count("*").alias("n")).filter("n > 2").select("session_id", F.lit(2).alias("lo"), F.least(F.lit(5), F.col("n") - 1).alias("hi"))
    new = b.select("session_id", F.lit(0).alias("sub"), F.concat(F.lit("new_"), "session_id").alias("event_id"), F.lit("blob_new").alias("blob_id"))
    return sequence.ranked(sequence.replace_range(e, b, new)).select("session_id", "rank", "event_id", "blob_id")


@query(_E + "SELECT session_id, rank::DOUBLE AS ord, (row_number() OVER (PARTITION BY session_id ORDER BY rank) - 1)::BIGINT AS rank, event_id FROM e WHERE n % 7 <> 0")
def seq_remove_ids(spark, d):
    log = A.event_log(spark, d)
    left, _ = sequence.remove(A.entries(log), log.filter("n % 7 = 0").select("session_id", "event_id"))
    return sequence.ranked(left).select("session_id", F.col("order").alias("ord"), "rank", "event_id")


def _split(spark, d):
    log = A.event_log(spark, d)
    at = log.groupBy("session_id").agg(F.count("*").alias("n")).select("session_id", F.concat(F.lit("evt_"), "session_id", F.lit("_"), F.floor(F.col("n") / 2).cast("string")).alias("event_id"))
    return sequence.split_at_event(A.entries(log), at)


@query(_E + "SELECT e.session_id AS session_id, event_id, rank FROM e JOIN sz USING (session_id) WHERE rank <= sz.n // 2")
def seq_split_prefix(spark, d):
    return _split(spark, d).filter("side = 'left'").select("session_id", "event_id", "rank")


@query(_E + "SELECT e.session_id AS session_id, event_id, rank FROM e JOIN sz USING (session_id) WHERE rank > sz.n // 2")
def seq_split_suffix(spark, d):
    return _split(spark, d).filter("side = 'right'").select("session_id", "event_id", "rank")


@query(_E + """, l0 AS (SELECT session_id, 0 AS level, rank // 64 AS page_no, count(*) AS n, min(rank) AS first_rank, max(rank) AS last_rank FROM e GROUP BY ALL),
t0 AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS total FROM l0),
l1 AS (SELECT session_id, 1 AS level, page_no // 64 - CASE WHEN total % 64 = 1 AND total > 64 AND page_no = total - 1 THEN 1 ELSE 0 END AS page_no, count(*) AS n, min(first_rank) AS first_rank, max(last_rank) AS last_rank FROM t0 WHERE total > 1 GROUP BY ALL),
t1 AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS total FROM l1),
l2 AS (SELECT session_id, 2 AS level, page_no // 64 - CASE WHEN total % 64 = 1 AND total > 64 AND page_no = total - 1 THEN 1 ELSE 0 END AS page_no, count(*) AS n, min(first_rank) AS first_rank, max(last_rank) AS last_rank FROM t1 WHERE total > 1 GROUP BY ALL)
SELECT session_id, level, page_no, n, first_rank, last_rank FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)""")
def btree_leaf_layout(spark, d):
    return sequence.leaf_layout(A.entries(A.event_log(spark, d)))


@query(_E + """, x AS (SELECT session_id, rank, event_id FROM e UNION ALL SELECT session_id, rank, event_id FROM e WHERE n % 101 = 0)
SELECT session_id, 'duplicate-event' AS rule, event_id AS subject FROM x GROUP BY session_id, event_id HAVING count(*) > 1
UNION ALL SELECT session_id, 'duplicate-order', rank || '.0' FROM x GROUP BY session_id, rank HAVING count(*) > 1""")
def dup_entries_guard(spark, d):
    log = A.event_log(spark, d)
    return sequence.insert(A.entries(log), A.entries(log.filter("n % 101 = 0")))[1]


# -- codecs, ids, blobs --------------------------------------------------------------
@query("SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(p_name) + 1), lambda i: ascii(p_name[i])::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS checksum FROM part")
def page_checksum_fnv1a(spark, d):
    return A.table(spark, d, "part").select("p_partkey", codec.fnv1a_sql(F.col("p_name").cast("binary")).alias("checksum"))


@query("SELECT doc_id, length(to_base64(encode(text)))::BIGINT AS b64_chars, md5(to_base64(encode(text))) AS b64_md5, true AS valid, true AS same FROM documents WHERE text IS NOT NULL")
def blob_base64_roundtrip(spark, d):
    b = F.replace(F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r")), F.lit("\n"))
    rows = A.table(spark, d, "documents").filter("text is not null").withColumn("b", b)
    return rows.select("doc_id", F.length("b").cast("long").alias("b64_chars"), F.md5(F.col("b").cast("binary")).alias("b64_md5"), codec.is_base64("b", padded=True).alias("valid"), (F.try_to_binary("b", F.lit("base64")) == F.col("text").cast("binary")).alias("same"))


@query("SELECT md5(text) AS blob_id, count(*)::BIGINT AS copies, min(doc_id) AS first_doc, max(length(text))::BIGINT AS chars FROM documents WHERE text IS NOT NULL GROUP BY md5(text)")
def blob_dedup_merge(spark, d):
    rows = A.table(spark, d, "documents").filter("text is not null").withColumn("blob_id", F.md5(F.col("text").cast("binary")))
    rows = rows.select(F.lit("docs").alias("session_id"), "blob_id", F.col("text").cast("binary").alias("payload"), "doc_id")
    merged, _ = archive.merge_deltas(rows)
    n = rows.groupBy("blob_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return merged.join(n, "blob_id").select("blob_id", "copies", "first_doc", F.length(F.col("payload").cast("string")).cast("long").alias("chars"))


@query()
def blob_segment_packing(spark, d):
    rows = A.table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("store"), F.col("doc_id").alias("seq"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    return codec.pack_segments(rows)


@query(_E + "SELECT session_id, (max(rank) + 1)::BIGINT AS next_event_counter, max(rank)::BIGINT AS blob_id_watermark FROM e GROUP BY session_id")
def high_watermark(spark, d):
    e = A.entries(A.event_log(spark, d))
    return ids.high_watermarks(e.filter("order % 2 = 0"), empty(spark, "compacted"), e, e.select("session_id", "blob_id"))


# -- validation ----------------------------------------------------------------------
@query(_E + "SELECT session_id, 'binding-conflict' AS rule, event_id AS subject FROM e WHERE n % 97 = 0")
def binding_conflicts(spark, d):
    log = A.event_log(spark, d)
    return validate.binding_conflicts(A.entries(log), log.select("session_id", "event_id", F.when(F.col("n") % 97 == 0, "other").otherwise(F.col("blob_id")).alias("blob_id")))


@query("SELECT source AS session_id, 'blob-changed' AS rule, 'blob_' || doc_id AS subject FROM documents WHERE text IS NOT NULL AND n_chars % 50 = 0")
def blob_immutability_diff(spark, d):
    rows = A.table(spark, d, "documents").filter("text is not null").select(F.col("source").alias("session_id"), ids.blob_id("doc_id").alias("blob_id"), F.col("text").cast("binary").alias("payload"), "n_chars")
    none = {t: empty(spark, t) for t in ("sessions", "entries", "references", "bindings", "compacted")}
    later = rows.withColumn("payload", F.when(F.col("n_chars") % 50 == 0, F.concat("payload", F.lit("x").cast("binary"))).otherwise(F.col("payload")))
    return validate.commit_changes(SessionSet(blobs=rows.drop("n_chars"), **none), SessionSet(blobs=later.drop("n_chars"), **none))


@query(_E + "SELECT DISTINCT session_id, 'dangling-reference' AS rule, x AS subject FROM (SELECT session_id, target AS x FROM r UNION ALL SELECT session_id, from_event_id FROM r) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.session_id = session_id AND e.event_id = x AND e.n % 5 <> 0)")
def dangling_refs(spark, d):
    log = A.event_log(spark, d)
    return validate.references(A.references(log), A.entries(log.filter("n % 5 <> 0")))


@query(_E + "SELECT session_id, 'missing-blob' AS rule, blob_id AS subject FROM e WHERE n % 11 = 0")
def missing_blobs(spark, d):
    log = A.event_log(spark, d)
    return validate.missing_blobs(A.entries(log), log.filter("n % 11 <> 0"))


@query(_E + """, t AS (SELECT *, CASE type WHEN 'turn/start' THEN event_id WHEN 'turn/end' THEN '' END AS edge FROM e)
SELECT session_id, event_id, nullif(last_value(edge IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS open_turn FROM t""")
def turn_cursor(spark, d):
    log = A.event_log(spark, d).withColumn("turn", F.col("event_id"))
    return envelope.turn_cursor(log).select("session_id", "event_id", "open_turn")


#: Brackets over the event log: every fifth event by rank opens one of 3 to 7 events.
_B = ", b AS (SELECT session_id, 'c' || rank AS compaction_id, rank AS start_rank, rank + 2 + n % 5 AS end_rank FROM e WHERE rank % 5 = 0)"


def _brackets(log: DataFrame) -> DataFrame:
    return log.filter("rank % 5 = 0").select("session_id", F.concat(F.lit("c"), F.col("rank").cast("string")).alias("compaction_id"), F.col("rank").alias("start_rank"), (F.col("rank") + 2 + F.col("n") % 5).alias("end_rank"))


@query(_E + _B + "SELECT session_id, 'bracket-overlap' AS rule, compaction_id AS subject FROM (SELECT *, lag(end_rank) OVER (PARTITION BY session_id ORDER BY start_rank, end_rank) AS before FROM b) WHERE before > start_rank")
def bracket_overlap(spark, d):
    return validate.bracket_overlap(_brackets(A.event_log(spark, d)))


@query(_E + _B + "SELECT DISTINCT e.session_id AS session_id, 'span-boundary' AS rule, event_id AS subject FROM e JOIN b ON b.session_id = e.session_id AND rank > start_rank AND rank < end_rank WHERE type IN ('turn/start', 'turn/end')")
def bracket_span_violations(spark, d):
    log = A.event_log(spark, d)
    return validate.bracket_spans(_brackets(log), log.filter(F.col("type").isin("turn/start", "turn/end")))


@query(_E + "SELECT session_id, 'marker-order' AS rule, 'c' || rank AS subject FROM e WHERE n % 4 IN (1, 3) OR n % 3 = 0")
def marker_order(spark, d):
    r = F.col("rank")
    b = A.event_log(spark, d).select("session_id", F.concat(F.lit("c"), r.cast("string")).alias("compaction_id"), r.alias("start_rank"), (r + 1 + F.col("n") % 2).alias("summary_rank"), (r + 2).alias("checkpoint_rank"), (r + F.when(F.col("n") % 3 == 0, 2).otherwise(4)).alias("end_rank"))
    return validate.marker_order(b)


@query(_E + """, m AS (SELECT session_id, n % 6 AS k FROM sz), x AS (SELECT session_id, k FROM m)
SELECT session_id, 'transaction' AS rule, CASE k WHEN 1 THEN 's2' WHEN 2 THEN 'e' WHEN 3 THEN 'y2' WHEN 4 THEN 't' WHEN 5 THEN 'e' END AS subject FROM x WHERE k > 0""")
def unclaimed_txn_state(spark, d):
    """Six small marker scripts, one per session by its size: whole, second start, end without summary, second summary, turn inside, other id at the end."""
    n = A.event_log(spark, d).groupBy("session_id").agg((F.count("*") % 6).alias("k"))
    step = lambda i, e, t, cid="c": F.struct(F.lit(i).alias("rank"), F.lit(e).alias("event_id"), F.lit(t).alias("type"), F.lit(cid).alias("compaction_id"))
    s, y, e = step(1, "s", "compaction/start"), step(3, "y", "compaction/summary"), step(6, "e", "compaction/end")
    more = {1: step(2, "s2", "compaction/start"), 3: step(4, "y2", "compaction/summary"), 4: step(5, "t", "turn/end")}
    k = F.col("k")
    script = F.when(k == 2, F.array(s, e)).when(k == 5, F.array(s, y, step(6, "e", "compaction/end", "x")))
    for i, m in more.items():
        script = script.when(k == i, F.array(s, y, e, m))
    rows = n.select("session_id", F.explode(script.otherwise(F.array(s, y, e))).alias("x")).select("session_id", "x.*")
    rows = rows.withColumns({"turn": F.lit(None).cast("string"), "has_turn": F.lit(True), "command": F.lit(None).cast("string"), "has_error": F.lit(False), "is_checkpoint": F.lit(False)})
    return validate.transactions(rows)


# -- compaction ----------------------------------------------------------------------
@query(_E + "SELECT session_id, rank, event_id, blob_id FROM ce")
def compact_entries(spark, d):
    return _compacted(A.event_log(spark, d)).select("session_id", F.col("order").cast("long").alias("rank"), "event_id", "blob_id")


@query(_E + """, x AS (SELECT r.session_id AS session_id, from_event_id, coalesce(c.event_id, r.target) AS target, min(r.pos) AS pos
  FROM r LEFT JOIN sh ON sh.session_id = r.session_id AND sh.event_id = r.target LEFT JOIN cm c ON c.session_id = sh.session_id AND c.sub = 3
  WHERE NOT EXISTS (SELECT 1 FROM sh s2 WHERE s2.session_id = r.session_id AND s2.event_id = r.from_event_id) GROUP BY ALL)
SELECT session_id, from_event_id, 'sourceEventIds' AS ref_name, string_agg(target, ',' ORDER BY pos) AS targets FROM x GROUP BY ALL""")
def compact_refs_redirect(spark, d):
    log = A.event_log(spark, d)
    return compaction.redirect(A.references(log), _gone(log)).select("session_id", "from_event_id", "ref_name", F.array_join("to_event_ids", ",").alias("targets"))


@query(_E + "SELECT e.session_id AS session_id, e.blob_id AS blob_id FROM e WHERE EXISTS (SELECT 1 FROM ce WHERE ce.session_id = e.session_id AND ce.blob_id = e.blob_id)")
def compact_blobs_kept(spark, d):
    log = A.event_log(spark, d)
    return compaction.kept_blobs(log.select("session_id", "blob_id"), _compacted(log))


@query(_E + "SELECT e.session_id AS session_id, event_id, rank FROM e JOIN sp USING (session_id) WHERE surface AND rank BETWEEN first AND last + 10 AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.session_id = e.session_id AND sh.event_id = e.event_id)")
def compact_interval_check(spark, d):
    log = A.event_log(spark, d)
    gone = _gone(log)
    return compaction.interval_check(log, gone, compaction.ranges(log, gone).withColumn("last", F.col("last") + 10))


@query(_E + """, old AS (SELECT session_id, event_id AS checkpoint FROM sh WHERE rank = (SELECT min(rank) FROM sh s WHERE s.session_id = sh.session_id))
SELECT sh.session_id AS session_id, 1::BIGINT AS n_summaries, count(*)::BIGINT + 2 AS n_shadowed FROM sh JOIN old USING (session_id) GROUP BY sh.session_id""")
def compact_summary(spark, d):
    """An older summary whose checkpoint is shadowed folds its two ids into the new one."""
    log = A.event_log(spark, d)
    gone = _gone(log)
    first = log.join(gone.select("session_id", "event_id"), ["session_id", "event_id"], "left_semi").groupBy("session_id").agg(F.min_by("event_id", "rank").alias("checkpoint_event_id"))
    cols = empty(spark, "compacted")
    old = first.withColumns({"ord": F.lit(0), "shadowed_ids": F.array(F.lit("old_1"), F.lit("old_2"))})
    new = gone.groupBy("session_id").agg(F.collect_list("event_id").alias("shadowed_ids")).withColumns({"ord": F.lit(0), "checkpoint_event_id": F.lit("new")})
    fill = lambda rows: cols.unionByName(rows, allowMissingColumns=True)
    out = compaction.fold_summaries(fill(old), gone, fill(new))
    return out.groupBy("session_id").agg(F.count("*").alias("n_summaries"), F.sum(F.size("shadowed_ids")).alias("n_shadowed"))


# -- fork, migration -----------------------------------------------------------------
def _boundaries(log: DataFrame) -> DataFrame:
    n = log.groupBy("session_id").agg(F.count("*").alias("n"))
    at = F.floor(F.col("n") * 3 / 5)
    return n.select("session_id", F.concat(F.lit("evt_"), "session_id", F.lit("_"), F.least(at, F.col("n") - 1).cast("string")).alias("event_id"), F.concat("session_id", F.lit("_f")).alias("child_id"))


_F = ", f AS (SELECT e.session_id AS session_id, e.session_id || '_f' AS child_id, event_id, blob_id, rank, type FROM e JOIN sz USING (session_id) WHERE rank <= least((sz.n * 3) // 5, sz.n - 1))"


@query(_E + _F + "SELECT child_id, event_id, blob_id, rank FROM f")
def fork_prefix(spark, d):
    log = A.event_log(spark, d)
    return fork.prefix(A.entries(log), _boundaries(log)).select("child_id", "event_id", "blob_id", "rank")


@query(_E + _F + ", g AS (SELECT r.session_id, from_event_id, string_agg(target, ',' ORDER BY pos) AS targets, count(*) AS n, count(f.event_id) AS kept FROM r LEFT JOIN f ON f.session_id = r.session_id AND f.event_id = r.target GROUP BY ALL) SELECT g.session_id AS session_id, from_event_id, targets FROM g JOIN f ON f.session_id = g.session_id AND f.event_id = from_event_id WHERE n = kept")
def fork_refs_kept(spark, d):
    log = A.event_log(spark, d)
    kept = fork.kept_references(A.references(log), fork.prefix(A.entries(log), _boundaries(log)))
    return kept.select("session_id", "from_event_id", F.array_join("to_event_ids", ",").alias("targets"))


@query(_E + _F + """, t AS (SELECT session_id, type, rank, sum(CASE type WHEN 'turn/start' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY rank) AS turn FROM f WHERE type IN ('turn/start', 'turn/end')),
o AS (SELECT session_id, turn FROM t GROUP BY ALL HAVING turn > 0 AND count(*) FILTER (WHERE type = 'turn/end') = 0)
SELECT session_id, count(*)::BIGINT AS n_open FROM o GROUP BY session_id""")
def fork_open_turn(spark, d):
    """Turn k starts with the k-th start; an end names the newest turn."""
    log = A.event_log(spark, d)
    pre = fork.prefix(A.entries(log), _boundaries(log)).select("session_id", "event_id")
    rows = log.join(pre, ["session_id", "event_id"], "left_semi").filter(F.col("type").isin("turn/start", "turn/end"))
    starts = sequence.ranked(rows.filter("type = 'turn/start'").select("session_id", "order", "event_id")).select("session_id", "event_id", (F.col("rank") + 1).cast("string").alias("own"))
    rows = rows.join(starts, ["session_id", "event_id"], "left").withColumn("turn", F.col("own"))
    from pyspark.sql import Window

    rows = rows.withColumn("turn", F.last("own", ignorenulls=True).over(Window.partitionBy("session_id").orderBy("rank")))
    return envelope.open_stack(rows).filter(F.size("open") > 0).select("session_id", F.size("open").cast("long").alias("n_open"))


_C = "WITH c AS (SELECT conv_id::VARCHAR AS session_id, turn AS seq, role FROM conversations) "


@query(_C + "SELECT session_id, seq::DOUBLE AS ord, 'evt_' || session_id || '_' || seq AS event_id, 'blob_' || seq AS blob_id FROM c")
def migrate_entries(spark, d):
    return migrate.migrate(A.legacy(spark, d))[0].withColumnRenamed("order", "ord")


@query(_C + "SELECT session_id, 'evt_' || session_id || '_' || seq AS from_event_id, 'sourceEventIds' AS ref_name, 'evt_' || session_id || '_' || (seq - 1) AS targets FROM c WHERE role = 'assistant' AND seq > 0")
def migrate_refs(spark, d):
    return migrate.migrate(A.legacy(spark, d))[2].select("session_id", "from_event_id", "ref_name", F.array_join("to_event_ids", ",").alias("targets"))


@query(_C + """, x AS (SELECT *, (session_id::BIGINT * 31 + seq) % 17 AS k FROM c)
SELECT session_id, seq, 'time' AS rule FROM x WHERE k = 1
UNION ALL SELECT session_id, seq, 'surface-op' FROM x WHERE k = 2
UNION ALL SELECT session_id, seq, 'log-only-surface' FROM x WHERE k = 2 AND role = 'system'
UNION ALL SELECT session_id, seq, 'unknown-type' FROM x WHERE k = 3 AND role = 'system'
UNION ALL SELECT session_id, seq, 'data' FROM x WHERE k = 4
UNION ALL SELECT session_id, seq, 'payload' FROM x WHERE k = 4 AND role <> 'system'
UNION ALL SELECT session_id, NULL, 'contiguous' FROM x GROUP BY session_id HAVING count(*) FILTER (WHERE k = 5 AND seq = 0) > 0""")
def migrate_rejects(spark, d):
    k = (F.col("session_id").cast("long") * 31 + F.col("seq")) % 17
    rows = A.legacy(spark, d).withColumn("k", k)
    rows = rows.withColumn("time", F.when(F.col("k") == 1, -1).otherwise(F.col("time"))).withColumn("surface_op", F.when(F.col("k") == 2, "replace").otherwise(F.col("surface_op")))
    rows = rows.withColumn("ignorable", F.when(F.col("k") != 3, F.col("ignorable"))).withColumn("data", F.when(F.col("k") != 4, F.col("data")))
    return migrate.rejects(rows.withColumn("seq", F.when((F.col("k") == 5) & (F.col("seq") == 0), -1).otherwise(F.col("seq")))).withColumn("seq", F.when(F.col("seq") < 0, 0).otherwise(F.col("seq")))


# -- versions ------------------------------------------------------------------------
_V = ", v AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY rank) AS revision, event_id FROM e WHERE type = 'purchase')"


def _versions(log: DataFrame) -> DataFrame:
    """Every purchase commits a revision."""
    rows = sequence.ranked(log.filter("type = 'purchase'").select("session_id", "order", "event_id"))
    return rows.select("session_id", (F.col("rank") + 1).alias("revision"), "event_id")


@query(_E + _V + "SELECT session_id, 'rev-' || max(revision) AS head, 'rev-' || (max(revision) + 1) AS next, arg_max(event_id, revision) AS event_id FROM v GROUP BY session_id")
def commit_cas_latest(spark, d):
    top = _versions(A.event_log(spark, d)).groupBy("session_id").agg(F.max(F.struct("revision", "event_id")).alias("x"))
    head = F.concat(F.lit("rev-"), F.col("x.revision").cast("string"))
    return top.select("session_id", head.alias("head"), ids.next_revision(head).alias("next"), "x.event_id")


@query(_E + _V + "SELECT session_id, revision, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY revision DESC) AS rank FROM v) WHERE rank <= 3")
def backup_topk(spark, d):
    return gc.retained(_versions(A.event_log(spark, d))).select("session_id", "revision", "event_id", F.col("rank").cast("long").alias("rank"))


# -- pages ---------------------------------------------------------------------------
@query(_E + """, p AS (SELECT 'page_' || n AS page_id, 'page_' || lag(n) OVER (PARTITION BY session_id ORDER BY rank) AS prev, user_id, row_number() OVER (PARTITION BY session_id ORDER BY rank DESC) AS b FROM e),
w AS (SELECT page_id FROM p WHERE b = 1 AND user_id % 2 = 0 UNION SELECT p.prev FROM w JOIN p USING (page_id) WHERE p.prev IS NOT NULL)
SELECT page_id FROM w""")
def gc_reachable(spark, d):
    """Each session is a chain of delta pages; the newest pages of even users are roots."""
    log = A.event_log(spark, d)
    prev = log.select("session_id", (F.col("rank") + 1).alias("rank"), F.col("n").alias("p"))
    page = F.concat(F.lit("page_"), F.col("n").cast("string"))
    rows = log.join(prev, ["session_id", "rank"], "left")
    doc = F.to_json(F.struct(F.lit("blob-appends").alias("kind"), F.concat(F.lit("page_"), F.col("p").cast("string")).alias("prev")))
    pages = rows.select(page.alias("page_id"), doc.cast("binary").alias("payload"))
    roots = log.filter("user_id % 2 = 0").groupBy("session_id").agg(F.max("n").alias("n")).select(page.alias("page_id"))
    kept, _ = gc.sweep(pages, roots)
    return kept.select("page_id")


@query(_E + "SELECT count(*)::BIGINT AS pages, sum(CASE WHEN rank % 64 = 0 THEN 1 ELSE 0 END)::BIGINT AS leaves FROM (SELECT rank FROM e WHERE rank % 64 = 0 UNION ALL SELECT 1 FROM sz WHERE n > 64)")
def tree_page_count(spark, d):
    pages = archive.tree_pages(A.entries(A.event_log(spark, d)))
    checked = archive.encoded_pages(pages).select(codec.decode_pages("container").alias("x"))
    return checked.filter("x.error is null").agg(F.count("*").alias("pages"), F.sum(F.col("x.payload").cast("string").contains('"kind":"leaf"').cast("long")).alias("leaves"))


def _saved_trees(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, roots) of every session's tree, with four children a page."""
    saved = archive.tree_pages(A.entries(log), 4)
    top = saved.select("page_id", F.split("page_id", "_").alias("x")).select("page_id", F.col("x")[1].alias("session_id"), F.col("x")[2].cast("int").alias("level"))
    return saved, materialize(top.groupBy("session_id").agg(F.max_by("page_id", "level").alias("page_id")))


def _torn(saved: DataFrame) -> DataFrame:
    """Without the first leaf of every fifth user."""
    user = F.regexp_extract("page_id", "^page_u([0-9]+)_0_0$", 1).try_cast("long")
    return saved.filter(~(user % 5).eqNullSafe(F.lit(0)))


@query(_E + "SELECT session_id, rank AS order_, event_id, blob_id FROM e WHERE user_id % 5 <> 0")
def tree_pages_load(spark, d):
    """Trees saved as pages and loaded again; every fifth user's tree has lost its first leaf."""
    log = A.event_log(spark, d)
    saved, roots = _saved_trees(log)
    got, _ = pages.load_trees(_torn(saved), roots, 4)
    return got.select("session_id", F.col("order").cast("long").alias("order_"), "event_id", "blob_id")


@query(_E + "SELECT session_id, 'page-missing' AS rule, 'page_' || session_id || '_0_0' AS subject FROM e WHERE user_id % 5 = 0 GROUP BY session_id")
def tree_page_faults(spark, d):
    saved, roots = _saved_trees(A.event_log(spark, d))
    _, bad = pages.load_trees(_torn(saved), roots, 4)
    return bad


@query(_E + "SELECT session_id, blob_id, 'event-' || n AS payload FROM e WHERE user_id % 10 <> 0")
def blob_chain_load(spark, d):
    """One delta page an event; every tenth user's chain runs in a circle."""
    log = A.event_log(spark, d)
    prev = log.select("session_id", (F.col("rank") + 1).alias("rank"), F.col("n").alias("p"))
    rows = log.join(prev, ["session_id", "rank"], "left").join(log.groupBy("session_id").agg(F.max("n").alias("head")), "session_id")
    page = lambda n: F.concat(F.lit("page_"), n.cast("string"))
    to = F.when(F.col("p").isNotNull(), F.col("p")).when(F.col("user_id") % 10 == 0, F.col("head"))
    body = F.create_map("blob_id", F.struct(F.base64(F.concat(F.lit("event-"), F.col("n").cast("string")).cast("binary")).alias("base64")))
    doc = F.to_json(F.struct(F.lit("blob-appends").alias("kind"), body.alias("blobs"), page(to).alias("prev")))
    saved = rows.select(page(F.col("n")).alias("page_id"), doc.cast("binary").alias("payload"))
    got, _ = pages.load_chains(saved, rows.select("session_id", page(F.col("head")).alias("page_id")).distinct())
    return got.select("session_id", "blob_id", F.col("payload").cast("string").alias("payload"))


def _store(kind, spark):
    import uuid

    return kind(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex[:12]}")


def _events(log: DataFrame) -> DataFrame:
    return log.select(F.col("n").alias("seq"), F.concat(F.lit("event-"), F.col("n").cast("string")).cast("binary").alias("payload"))


@query(_E + """, p AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i FROM e)
SELECT 'page_' || i AS page_id, 'event-' || n AS payload FROM p WHERE i % 3 = 0
UNION ALL SELECT 'page_' || (row_number() OVER (ORDER BY n) - 1 + (SELECT count(*) FROM e)), 'event-' || n FROM e WHERE user_id % 2 = 0""")
def page_store_retain(spark, d):
    """A page an event; two thirds are dropped, and pages written later get numbers of their own."""
    log, store = A.event_log(spark, d), _store(pages.PageStore, spark)
    store.write(_events(log))
    store.retain(store.page_ids().filter(F.substring("page_id", 6, 20).cast("long") % 3 == 0))
    store.write(_events(log.filter("user_id % 2 = 0")))
    return store.read()[0].select("page_id", F.col("payload").cast("string").alias("payload"))


@query(_E + "SELECT 'blob_seg_' || i AS blob_id, 0::BIGINT AS segment, (sum(length('event-' || n)) OVER (ORDER BY n) - length('event-' || n))::BIGINT AS offset_, 'event-' || n AS payload FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i FROM e) QUALIFY i % 4 <> 0")
def blob_store_read(spark, d):
    """A blob an event, of which every fourth is deleted; offsets still count them."""
    log, store = A.event_log(spark, d), _store(pages.BlobStore, spark)
    put = store.write(_events(log))
    store.delete(put.filter(F.substring("blob_id", 10, 20).cast("long") % 4 == 0))
    return store.blobs().select("blob_id", "segment", F.col("offset").alias("offset_"), F.col("payload").cast("string").alias("payload"))


# -- projections, streams, archives --------------------------------------------------
@query(_E + "SELECT session_id, sum(k)::BIGINT AS value, arg_max(event_id, rank) AS watermark_event_id FROM e GROUP BY session_id")
def projection_fold(spark, d):
    """Folded in two steps: the first half of each session, then the rest behind the watermark."""
    log = A.event_log(spark, d)
    cols = log.select("session_id", "order", "event_id", "k")
    half = cols.groupBy("session_id").agg((F.count("*") / 2).alias("half"))
    first = cols.join(half, "session_id").filter("order < half").drop("half")
    return projection.advance(projection.advance(None, first, F.col("k")), cols, F.col("k"))


@query(_E + """, st AS (SELECT session_id, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'evt_' || session_id || '_' || (n // 5) WHEN 2 THEN 'evt_' || session_id || '_' || (n * 4 // 5) ELSE 'gone' END AS w FROM sz JOIN (SELECT DISTINCT session_id, user_id FROM e) USING (session_id)),
x AS (SELECT st.session_id, w, s2.rank IS NOT NULL AS shadowed, cw.rank AS wr, cc.rank AS cr FROM st JOIN cm ON cm.session_id = st.session_id AND cm.sub = 3
  LEFT JOIN sh s2 ON s2.session_id = st.session_id AND s2.event_id = w LEFT JOIN ce cw ON cw.session_id = st.session_id AND cw.event_id = w LEFT JOIN ce cc ON cc.session_id = st.session_id AND cc.event_id = cm.event_id)
SELECT session_id, w AS watermark_event_id, CASE WHEN w IS NULL THEN false WHEN shadowed THEN true WHEN wr IS NULL OR cr IS NULL THEN true ELSE wr >= cr END AS stale FROM x""")
def projection_stale(spark, d):
    log = A.event_log(spark, d)
    n = log.groupBy("session_id", "user_id").agg(F.count("*").alias("n"))
    at = lambda c: F.concat(F.lit("evt_"), "session_id", F.lit("_"), F.floor(c).cast("string"))
    u = F.col("user_id") % 4
    state = n.select("session_id", F.when(u == 1, at(F.col("n") / 5)).when(u == 2, at(F.col("n") * 4 / 5)).when(u == 3, F.lit("gone")).alias("watermark_event_id"))
    done = _requests(log).select("session_id", "compaction_id", F.col("checkpoint_id").alias("checkpoint_event_id"), "shadowed_ids")
    return projection.needs_rebuild(state, done, _compacted(log)).select("session_id", "watermark_event_id", "stale")


@query(_E + "SELECT session_id, n AS seq, event_id, blob_id FROM e")
def stream_append_ids(spark, d):
    import uuid

    from .streaming import append

    schema = A.table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("seq"))
    return append.run_once(append.mint_ids(rows), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}")


@query(_E + "SELECT session_id, count(*)::BIGINT AS n_entries, max(event_id) AS last_id, (SELECT count(DISTINCT from_event_id) FROM r WHERE r.session_id = e.session_id)::BIGINT AS n_refs FROM e GROUP BY session_id")
def archive_roundtrip(spark, d):
    log = A.event_log(spark, d)
    none = empty(spark, "sessions")
    n = log.groupBy("session_id").agg(F.count("*").alias("next_event_counter"))
    sessions = none.unionByName(n.withColumns({"format_version": F.lit(1), "revision": F.lit(1).cast("long"), "blob_id_watermark": F.col("next_event_counter")}), allowMissingColumns=True)
    blobs = log.select("session_id", "blob_id", F.concat(F.lit("event-"), F.col("n").cast("string")).cast("binary").alias("payload"))
    s = SessionSet(sessions, A.entries(log), blobs, A.references(log), log.select("session_id", "event_id", "blob_id"), empty(spark, "compacted"))
    back, _ = archive.parse(archive.export(s).select("archive"))
    same = back.blobs.join(blobs, ["session_id", "blob_id", "payload"], "left_semi").groupBy("session_id").count()
    refs = back.references.groupBy("session_id").agg(F.count("*").alias("n_refs"))
    out = back.entries.groupBy("session_id").agg(F.count("*").alias("n_entries"), F.max("event_id").alias("last_id")).join(same, "session_id").filter("count = n_entries")
    return out.join(refs, "session_id", "left").select("session_id", "n_entries", "last_id", F.coalesce("n_refs", F.lit(0)).alias("n_refs"))


@query(_E + "SELECT session_id AS file, rank AS seq FROM e JOIN sz USING (session_id) WHERE rank < sz.n - 1 - user_id % 3 OR user_id % 3 = 0 AND rank < sz.n - 1")
def torn_tail_recovery(spark, d):
    """One log file a session; its last lines are cut in the middle."""
    log = A.event_log(spark, d)
    n = log.groupBy("session_id").agg(F.count("*").alias("c"))
    doc = F.to_json(F.struct("event_id", "type"))
    rows = log.join(n, "session_id").select(F.col("session_id").alias("file"), F.col("rank").alias("seq"), F.when(F.col("rank") < F.col("c") - 1 - F.col("user_id") % 3, doc).otherwise(F.substring(doc, 1, 12)).alias("line"))
    return archive.recovered(rows).select("file", "seq")


# -- more of sequences and rules, over whole sets of sessions ---------------------------
@query(_E + "SELECT session_id, event_id, CASE WHEN rank <= 5 THEN 'left' ELSE 'right' END AS side FROM e")
def seq_split_order(spark, d):
    left, right = sequence.split_at_order(A.entries(A.event_log(spark, d)), 5.5)
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right"))).select("session_id", "event_id", "side")


@query(_E + """, b AS (SELECT session_id, 2 AS lo, least(5, sz.n - 1) AS hi, sz.n AS n FROM sz WHERE sz.n > 2 AND (SELECT min(user_id) FROM e WHERE e.session_id = sz.session_id) % 5 <> 0),
x AS (SELECT session_id, rank AS pos, 0 AS sub, event_id, blob_id FROM e LEFT JOIN b USING (session_id) WHERE b.lo IS NULL OR rank < lo OR rank > hi
      UNION ALL SELECT session_id, lo, y, 'evt_' || session_id || '_' || (n + y), 'blob_new' FROM b, (SELECT unnest([0, 1]) AS y))
SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY pos, sub) - 1)::BIGINT AS rank, event_id, blob_id FROM x""")
def seq_replace_events(spark, d):
    """Between two event ids; a fifth of the sessions name an id that isn't there and stay as they are."""
    log = A.event_log(spark, d)
    e = A.entries(log)
    n = log.groupBy("session_id", "user_id").agg(F.count("*").alias("n")).filter("n > 2")
    last = F.when(F.col("user_id") % 5 == 0, F.lit("gone")).otherwise(ids.event_id("session_id", F.least(F.lit(5), F.col("n") - 1)))
    bounds = n.select("session_id", ids.event_id("session_id", F.lit(2)).alias("first_id"), last.alias("last_id"))
    new = n.select("session_id", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("sub")).select("session_id", "sub", ids.event_id("session_id", F.col("n") + F.col("sub")).alias("event_id"), F.lit("blob_new").alias("blob_id"))
    out, _ = sequence.replace_events(e, e.drop("order"), bounds, new)
    return sequence.ranked(out).select("session_id", "rank", "event_id", "blob_id")


def _records(log: DataFrame, **fields) -> DataFrame:
    """One control record a session, valid but for ``fields`` (of user_id and n)."""
    n = log.groupBy("session_id", "user_id").agg(F.count("*").alias("n"))
    base = {"format_version": F.lit(1), "revision": F.lit(1).cast("long"), "next_event_counter": F.col("n"), "blob_id_watermark": F.col("n") - 1} | fields
    return empty(log.sparkSession, "sessions").unionByName(n.withColumns(base).drop("user_id", "n"), allowMissingColumns=True)


_U = ", u AS (SELECT session_id, min(user_id) AS u, count(*) AS n FROM e GROUP BY session_id)"


@query(_E + _U + "SELECT session_id, 'record' AS rule, session_id AS subject FROM u WHERE u % 7 NOT IN (0, 6)")
def record_rules(spark, d):
    """Version, counter, folder, origin and time broken in turn; a record without a blob watermark is valid."""
    k = F.col("user_id") % 7
    rows = _records(A.event_log(spark, d), format_version=F.when(k == 1, 2).otherwise(1), next_event_counter=F.when(k == 2, -1).otherwise(F.col("n")).cast("long"), cwd=F.when(k == 3, "a/b").otherwise("/a"), origin=F.when(k == 4, "other"), created_at=F.when(k == 5, 2**53).otherwise(1).cast("long"), blob_id_watermark=F.when(k != 6, F.col("n")))
    return validate.records(rows)


def _summary(log: DataFrame, **fields) -> DataFrame:
    """A valid summary of each session's first event, but for ``fields``."""
    n = log.groupBy("session_id", "user_id").agg(F.count("*").alias("n"))
    e = lambda i: ids.event_id("session_id", F.lit(i))
    base = {
        "ord": F.lit(0), "compaction_id": F.lit("c1"), "checkpoint_event_id": e(2), "markers": F.struct(e(0).alias("start_event_id"), e(1).alias("summary_event_id"), e(4).alias("end_event_id")),
        "shadowed_range": F.struct(e(8).alias("start_id"), e(9).alias("end_id")), "shadowed_ids": F.array(e(8), e(9)), "shadowed_seq_range": F.struct(F.lit(1).cast("long").alias("start"), F.lit(2).cast("long").alias("end")), "shadowed_seqs": F.array(F.lit(1), F.lit(2)).cast("array<long>"),
        "summary": F.lit('[{"type":"text","text":"t"}]'), "shadowed_token_count": F.lit(3).cast("long"), "provider": F.lit("p"), "model": F.lit("m"),
    } | fields
    return empty(log.sparkSession, "compacted").unionByName(n.withColumns(base).drop("user_id", "n"), allowMissingColumns=True)


@query(_E + _U + "SELECT session_id, 'summary-shape' AS rule, 'c1' AS subject FROM u WHERE u % 7 BETWEEN 1 AND 5")
def summary_shape_rules(spark, d):
    """Ids, range, seqs, count and content blocks broken in turn; an empty provider is valid."""
    k, e = F.col("user_id") % 7, ids.event_id("session_id", F.lit(8))
    rows = _summary(
        A.event_log(spark, d), shadowed_ids=F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(e)).otherwise(F.array(e, ids.event_id("session_id", F.lit(9)))), shadowed_seqs=F.when(k == 3, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2))).cast("array<long>"),
        shadowed_token_count=F.when(k == 4, -1).otherwise(3).cast("long"), summary=F.when(k == 5, '[{"type":"text"}]').otherwise('[{"type":"text","text":"t"}]'), provider=F.when(k == 6, "").otherwise("p"),
    )
    return validate.summaries(rows)


@query(_E + _U + "SELECT session_id, 'counter' AS rule, (n - 1)::VARCHAR AS subject FROM u WHERE u % 2 = 1 UNION ALL SELECT session_id, 'blob-watermark', (n - 1)::VARCHAR FROM u WHERE u % 3 = 0")
def counter_rules(spark, d):
    log = A.event_log(spark, d)
    s = _records(log, next_event_counter=F.col("n") - F.col("user_id") % 2, blob_id_watermark=F.col("n") - 1 - F.when(F.col("user_id") % 3 == 0, 1).otherwise(0))
    none = {t: empty(spark, t) for t in ("references", "bindings", "compacted")}
    return validate.counters(SessionSet(sessions=s, entries=A.entries(log), blobs=log.select("session_id", "blob_id", F.lit(b"").alias("payload")), **none))


@query(_E + _U + """, g AS (SELECT * FROM u WHERE n > 4)
SELECT session_id, 'marker-shared' AS rule, 'evt_' || session_id || '_0' AS subject FROM g WHERE u % 3 = 1 UNION ALL SELECT session_id, 'marker-order', 'c1' FROM g WHERE u % 3 = 1
UNION ALL SELECT session_id, 'marker-missing', 'gone' FROM g WHERE u % 3 = 2""")
def marker_rules(spark, d):
    log = A.event_log(spark, d)
    k, e = F.col("user_id") % 3, lambda i: ids.event_id("session_id", F.lit(i))
    long = log.groupBy("session_id").count().filter("count > 4")
    rows = _summary(log, markers=F.struct(e(0).alias("start_event_id"), e(1).alias("summary_event_id"), F.when(k == 1, e(0)).when(k == 2, "gone").otherwise(e(4)).alias("end_event_id")))
    return validate.markers(rows.join(long, "session_id", "left_semi"), log.select("session_id", "event_id", "rank"))


@query(_E + "SELECT sh.session_id AS session_id, 'shadowed-live' AS rule, sh.event_id AS subject FROM sh JOIN e ON e.session_id = sh.session_id AND e.event_id = sh.event_id WHERE e.n % 3 = 0")
def shadowed_live_rules(spark, d):
    """Of the shadowed events a third is still in the tree."""
    log = A.event_log(spark, d)
    gone = _shadow(log).groupBy("session_id").agg(F.collect_list("event_id").alias("shadowed_ids"))
    return validate.shadowed_live(gone, A.entries(log.filter("n % 3 = 0")))


@query(_E + _U + "SELECT session_id, 'seed-boundary' AS rule, 'evt_' || session_id || '_' || (n + 7) AS subject FROM u WHERE u % 2 = 1")
def seed_boundary_rules(spark, d):
    log = A.event_log(spark, d)
    return validate.seed_boundary(_records(log, seed_boundary_id=ids.event_id("session_id", F.when(F.col("user_id") % 2 == 1, F.col("n") + 7).otherwise(F.lit(0)))), A.entries(log))


@query(_E + _U + """SELECT session_id, 'binding-lost' AS rule, event_id AS subject FROM e WHERE n % 13 = 0 UNION ALL SELECT session_id, 'rebound', event_id FROM e WHERE n % 17 = 0 AND n % 13 <> 0
UNION ALL SELECT session_id, 'foreign-id', 'x_' || session_id FROM u WHERE u % 2 = 0""")
def commit_binding_rules(spark, d):
    """A commit that loses bindings, rebinds others and brings ids of another session."""
    log = A.event_log(spark, d)
    none = {t: empty(spark, t) for t in ("blobs", "references", "compacted")}
    held = log.select("session_id", "event_id", "blob_id")
    now = log.filter("n % 13 <> 0").select("session_id", "event_id", F.when(F.col("n") % 17 == 0, "other").otherwise(F.col("blob_id")).alias("blob_id"))
    foreign = log.filter("rank = 0 and user_id % 2 = 0").select("session_id", F.lit(1e6).alias("order"), F.concat(F.lit("x_"), "session_id").alias("event_id"), "blob_id")
    before = SessionSet(sessions=_records(log), entries=A.entries(log), bindings=held, **none)
    return validate.commit_changes(before, SessionSet(sessions=_records(log), entries=A.entries(log).unionByName(foreign), bindings=now, **none))


def _marker_payloads(k: int) -> list[str]:
    """Start, summary, checkpoint and end of one compaction as JSON; k breaks one rule (0: none)."""
    import json

    turn = 4 if k == 5 else None
    src = {"kind": "plugin", "plugin": "compact", "compactionId": "c1"}
    more = {"sourceCommandId": "x"} if k == 4 else {}
    return [
        json.dumps({"type": "compaction/other" if k == 1 else "compaction/start", "time": 1, "data": {"compactionId": "c1", "turn": turn}}),
        json.dumps({"type": "compaction/summary", "time": 1, "data": {"compactionId": "c1", "summary": [{"type": "text", "text": "t"}], "shadowedRange": {"start": 1, "end": 2}, "shadowedSeqs": [1, 2], "shadowedTokenCount": 3, "provider": "q" if k == 3 else "p", "model": "m"} | more}),
        json.dumps({"type": "user/message", "time": 1, "data": {"id": "m", "role": "assistant" if k == 2 else "user", "content": [], "source": src}, "surfaceOp": {"op": "replace", "start": 1, "end": 2}, "sourceEventSeqs": [1, 2]}),
        json.dumps({"type": "compaction/end", "time": 1, "data": {"compactionId": "c1", "turn": turn}}),
    ]


@query(_E + _U + """SELECT session_id, CASE u % 6 WHEN 1 THEN 'marker-envelope' WHEN 2 THEN 'checkpoint-envelope' WHEN 3 THEN 'summary-payload' WHEN 4 THEN 'command' ELSE 'turn' END AS rule,
  CASE u % 6 WHEN 1 THEN 'evt_' || session_id || '_0' WHEN 2 THEN 'evt_' || session_id || '_2' WHEN 3 THEN 'evt_' || session_id || '_1' WHEN 4 THEN 'evt_' || session_id || '_1' ELSE 'c1' END AS subject FROM u WHERE u % 6 > 0""")
def marker_envelope_rules(spark, d):
    """Four marker events a session, whose payloads break one rule by user."""
    log = A.event_log(spark, d)
    scripts = spark.createDataFrame([(k, i, p) for k in range(6) for i, p in enumerate(_marker_payloads(k))], "k long, i int, doc string")
    users = log.select("session_id", "user_id").distinct().withColumn("k", F.col("user_id") % 6)
    at = F.when(F.col("i") == 3, 4).otherwise(F.col("i"))
    rows = users.join(F.broadcast(scripts), "k").select("session_id", at.cast("double").alias("order"), ids.event_id("session_id", at).alias("event_id"), ids.blob_id(at).alias("blob_id"), F.col("doc").cast("binary").alias("payload"))
    entries, blobs = rows.drop("payload"), rows.select("session_id", "blob_id", "payload")
    s = SessionSet(sessions=_records(log), entries=entries, blobs=blobs, references=empty(spark, "references"), bindings=entries.drop("order"), compacted=_summary(log))
    return validate.marker_envelopes(s, materialize(envelope.envelopes(entries, blobs)))


# -- whole transactions ----------------------------------------------------------------
def _plain_sessions(log: DataFrame, **fields) -> SessionSet:
    """The event log with payloads: surface events are messages, the others plain notes."""
    spark = log.sparkSession
    doc = F.to_json(F.struct(F.when(F.col("surface"), "user/message").otherwise("note").alias("type"), F.lit(1).alias("time"), F.struct(F.col("n").alias("text")).alias("data"), F.when(F.col("surface"), "append").alias("surfaceOp")))
    blobs = log.select("session_id", "blob_id", doc.cast("binary").alias("payload"))
    return SessionSet(_records(log, **fields), A.entries(log), blobs, A.references(log), log.select("session_id", "event_id", "blob_id"), empty(spark, "compacted"))


@query(_E + "SELECT session_id, rank, event_id, blob_id FROM ce UNION ALL SELECT session_id, rank, event_id, blob_id FROM e WHERE session_id NOT IN (SELECT session_id FROM sp)")
def compact_sessions(spark, d):
    """The whole transaction with its guards: sessions without a request stay."""
    log = A.event_log(spark, d)
    s, requests = _plain_sessions(log), materialize(_requests(log))
    put = requests.select("session_id", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"{r}_blob").alias("blob_id")) for i, r in enumerate(compaction.ROLES)))).alias("x")).select("session_id", "x.*")
    docs = spark.createDataFrame(list(enumerate(_marker_payloads(0))), "i int, doc string")
    more = put.join(F.broadcast(docs), "i").select("session_id", "blob_id", F.col("doc").cast("binary").alias("payload"))
    out, _ = compaction.compact(s.with_(blobs=s.blobs.unionByName(more)), requests, _summary(log))
    return sequence.ranked(out.entries).select("session_id", "rank", "event_id", "blob_id")


@query(_E + _F + "SELECT child_id AS session_id, event_id, blob_id, rank FROM f")
def fork_sessions(spark, d):
    log = A.event_log(spark, d)
    child, _ = fork.fork(_plain_sessions(log), _boundaries(log))
    return sequence.ranked(child.entries).select("session_id", "event_id", "blob_id", "rank")


@query(_E + "SELECT session_id, count(*)::BIGINT AS n_entries, md5(string_agg(event_id || ':' || blob_id, ',' ORDER BY rank)) AS entries_md5 FROM e GROUP BY session_id")
def archive_files(spark, d):
    """Written to files of many sessions each and read back."""
    import uuid

    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex[:12]}"
    archive.write(_plain_sessions(A.event_log(spark, d)), folder)
    back, _ = archive.read(spark, folder, strict=False)
    pairs = F.array_sort(F.collect_list(F.struct("order", F.concat("event_id", F.lit(":"), "blob_id").alias("x"))))
    return back.entries.groupBy("session_id").agg(F.count("*").alias("n_entries"), F.md5(F.array_join(F.transform(pairs, lambda p: p["x"]), ",").cast("binary")).alias("entries_md5"))


def _repository(spark):
    import uuid

    from .sources.catalog import Catalog, SessionRepository

    return SessionRepository(Catalog(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex[:12]}"))


@query(_E + "SELECT session_id, 2::BIGINT AS revision, rank, event_id, blob_id FROM e WHERE (SELECT n FROM sz WHERE sz.session_id = e.session_id) > 1 UNION ALL SELECT session_id, 1, rank, event_id, blob_id FROM e WHERE (SELECT n FROM sz WHERE sz.session_id = e.session_id) = 1")
def commit_append(spark, d):
    """The first half of each session is registered, the rest appended in one incremental commit."""
    log = A.event_log(spark, d)
    n = log.groupBy("session_id").agg(F.ceil(F.count("*") / 2).alias("half"))
    log = materialize(log.join(n, "session_id"))
    first = log.filter("rank < half")
    repo = _repository(spark)
    repo.create(_plain_sessions(first).with_(references=empty(spark, "references")))
    repo.append(log.filter("rank >= half").select("session_id", F.col("n").alias("seq"), F.concat(F.lit("event-"), F.col("n").cast("string")).cast("binary").alias("payload")))
    now = repo.load()
    return sequence.ranked(now.entries).join(now.sessions.select("session_id", "revision"), "session_id").select("session_id", "revision", "rank", "event_id", "blob_id")


@query(_E + _U + "SELECT session_id, CASE WHEN u % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS revision, u % 2 = 1 AS stale FROM u")
def commit_compare_and_swap(spark, d):
    """Every session is committed again; the odd users' committers expect a revision that isn't stored."""
    log = A.event_log(spark, d)
    s, repo = _plain_sessions(log), _repository(spark)
    repo.create(s)
    expected = log.select("session_id", "user_id").distinct().select("session_id", (F.col("user_id") % 2 + 1).cast("long").alias("revision"))
    stale = repo.catalog.commit(s.with_(sessions=_records(log, revision=F.lit(2).cast("long"))), expected)
    return repo.load().sessions.select("session_id", "revision").join(stale.withColumn("stale", F.lit(True)), "session_id", "left").select("session_id", "revision", F.coalesce("stale", F.lit(False)).alias("stale"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_O)
