"""Benchmark decontamination by winnowing, in DataFrame functions only.

Fingerprints are hashes of ``GRAM`` words; of every ``WINDOW - GRAM + 1`` neighbouring
hashes the least is kept, so that any ``WINDOW`` words that a document shares with an
item share a fingerprint.  Fingerprints of documents and items are joined; around each
hit the windows that hold it are compared word by word with the item's windows.  Items
of fewer than ``WINDOW`` words are one window of their own length; with fewer words than
GRAM + 1 their only hash has the item's length.  Each length that occurs (fewer than
WINDOW of them) has fingerprints of its own.

Texts are tokenised and hashed inside one projection, a document's fingerprints are
distinct before they are shuffled, and windows exist only around hits.

Defined results: a null text has no words and is clean; an item without words, or with a
null item_id, is no item; rows with a null doc_id are left out; of rows with one doc_id
the greatest text counts; repeated item rows count once per item_id; an empty table gives
no rows (documents) or clean documents (items); other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, pin, sized

WINDOW = 10
GRAM = 5
#: Rows of the item side up to which it is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), where value is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _seq(n: Column) -> Column:
    """1 .. n, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def hashes(w: Column, k: int) -> Column:
    """Hash of each run of k words."""
    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(_seq(F.size(h) - (k - 1)), lambda i: F.xxhash64(F.slice(h, i, k))))


def winnowed(w: Column, window: int) -> Column:
    """Distinct fingerprints that guarantee every shared run of ``window`` words."""
    k = min(GRAM, window)
    span = window - k + 1
    return let(hashes(w, k), lambda g: F.array_distinct(F.transform(_seq(F.size(g) - (span - 1)), lambda i: F.array_min(F.slice(g, i, span)))))


def windows(w: Column, size: int) -> Column:
    return F.transform(_seq(F.size(w) - (size - 1)), lambda i: F.array_join(F.slice(w, i, size), " "))


def _tagged(prints: Column, size: int) -> Column:
    return F.transform(prints, lambda x: F.struct(F.lit(size).alias("size"), x.alias("fp")))


def _around(w: Column, found: Column, size: int) -> Column:
    """Starts of the windows of ``size`` words that hold a matched hash: up to size - k words before it."""
    k = min(GRAM, size)
    mine = F.transform(F.filter(found, lambda x: x["size"] == size), lambda x: x["fp"])
    at = let(mine, lambda m: let(hashes(w, k), lambda g: F.filter(_seq(F.size(g)), lambda i: F.array_contains(m, F.get(g, i - 1)))))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(F.lit(1), i - (size - k)), i))))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (array of (start, size, item_ids)): where windows of items stand in documents; null spans: clean."""
    texts = keyed(docs)
    tokens = texts.select("doc_id", words(F.col("text")).alias("w"))
    bench = pin(items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).filter("item_id is not null and size(w) > 0").distinct().withColumn("size", F.least(F.size("w"), F.lit(WINDOW))), "items")
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect())  # at most WINDOW values
    if not sizes:
        return tokens.select("doc_id", F.size("w").cast("long").alias("n_words"), F.expr("cast(null as array<struct<start: int, size: int, item_ids: array<string>>>)").alias("spans"))
    prints, item_windows, wanted = None, None, None
    for s in sizes:
        mine = bench.filter(F.col("size") == s)
        fp = mine.select(F.lit(s).alias("size"), F.explode(winnowed(F.col("w"), s)).alias("fp")).distinct()
        win = mine.select("item_id", F.lit(s).alias("size"), F.explode(windows(F.col("w"), s)).alias("window")).groupBy("size", "window").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
        of = _tagged(winnowed(F.col("w"), s), s)
        prints, item_windows = (fp, win) if prints is None else (prints.unionByName(fp), item_windows.unionByName(win))
        wanted = of if wanted is None else F.concat(wanted, of)
    prints, item_windows = pin(prints, "prints"), pin(item_windows, "windows")
    # one pass over the texts: fingerprints that items have, and (as size 0) the number of words
    words_row = F.array(F.struct(F.lit(0).alias("size"), F.size("w").cast("long").alias("fp")))
    rows = tokens.select("doc_id", F.explode(F.concat(wanted, words_row)).alias("x")).select("doc_id", "x.size", "x.fp")
    rows = rows.join(sized(prints, BROADCAST_ROWS).withColumn("hit", F.lit(True)), ["size", "fp"], "left").filter("hit or size = 0")
    found = pin(rows.groupBy("doc_id").agg(F.max(F.when(F.col("size") == 0, F.col("fp"))).alias("n_words"), F.collect_set(F.when(F.col("hit"), F.struct("size", "fp"))).alias("found")), "found")
    some = found.filter("size(found) > 0").select("doc_id", "found")
    if some.agg(F.coalesce(F.sum(F.size("found") + 1), F.lit(0))).first()[0] <= 4 * BROADCAST_ROWS:
        some = F.broadcast(some)  # the texts then stay where they are
    near = pin(texts.join(some, "doc_id").select("doc_id", words(F.col("text")).alias("w"), "found"), "near")
    starts = None
    for s in sizes:
        some = near.select("doc_id", "w", F.explode(_around(F.col("w"), F.col("found"), s)).alias("start"))
        some = some.filter(F.col("start") + (s - 1) <= F.size("w")).select("doc_id", "start", F.lit(s).alias("size"), F.array_join(F.slice("w", F.col("start"), s), " ").alias("window"))
        starts = some if starts is None else starts.unionByName(some)
    hits = starts.join(sized(item_windows, BROADCAST_ROWS), ["size", "window"])
    spans = hits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "size", "item_ids"))).alias("spans"))
    return found.select("doc_id", "n_words").join(spans, "doc_id", "left")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    end = lambda x: x["start"] + x["size"]
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], end(x)).alias("end"), (s["n"] + F.greatest(F.lit(0), end(x) - F.greatest(s["end"], x["start"]))).alias("n"))
    hit = F.coalesce(F.aggregate("spans", start, step, lambda s: s["n"]), F.lit(0)).cast("long")
    ids = F.coalesce(F.sort_array(F.array_distinct(F.flatten(F.transform("spans", lambda x: x["item_ids"])))), F.array().cast("array<string>"))
    out = contamination(docs, items).select("doc_id", "n_words", hit.alias("n_hit"), ids.alias("ids"))
    return out.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
