"""Substring dedup against indexed reference blocks, in place of a Relative Lempel-Ziv parse.

No greedy longest match is sought: factors are read off window hits, which the index gives
by grouping on keys.  The reference is the corpus itself in doc_id order, cut into blocks:
the 50-word windows whose least 10-word hash is the same anchor and that stand in one
row form a block.  Equal windows have equal anchors, so a window can only repeat in
blocks of its own anchor, and every window belongs to exactly one block.

1. every document is factored into blocks (anchor, 128-bit content id, position);
2. the index keeps each anchor that stands in two documents and, per distinct block
   content, the first document that has it;
3. a block whose anchor has one content only is resolved as a whole; where contents
   differ the windows of one representative of each content are indexed one by one,
   which also settles windows at the boundaries of factors;
4. factors are the maximal rows of windows with a source in an earlier document; each
   spans at least ``window`` words and its words are removed.

Copies of a passage collapse to one content before windows are made, minima are
aggregated before the shuffle, and no pair of documents is ever emitted.

Defined results: a null or short text has no windows and loses nothing; rows with a null
doc_id are left out; of rows with one doc_id the greatest text counts; a repetition
inside one document only is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow, grams, keyed, pin, slices, sliding_min

WINDOW = 50
GRAM = 10


def _texts(part: pa.RecordBatch) -> list[bytes | None]:
    return part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


_BLOCK_PA = pa.schema([("anchor", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("len", pa.int32())])
_BLOCK = "anchor long, hi long, lo long, doc_id long, start int, len int"


def _content(h: np.ndarray, which: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of words [start, start + size): the sizes differ, so it is made from hashes of windows and lengths."""
    from .common import _HASHES, _pow, mix

    _, p, inv = _HASHES[which]
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * _pow(p, len(h)), out=sums[1:])
    return mix((sums[start + size] - sums[start]) * _pow(inv, len(h) + 1)[start] + size.astype(np.uint64))


def _blocks(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(_texts(part))
                h, g = w.hashes(0), w.hashes(1)
                least = sliding_min(grams(h, gram), window - gram + 1)  # the anchor of each window
                if not len(least):
                    continue
                doc = np.repeat(np.arange(len(w.n)), w.n)[: len(least)]
                inside = np.arange(len(least)) + window <= w.first[1:][doc]
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
                start = np.flatnonzero(new)
                size = np.diff(np.append(start, len(least)))
                start, size = start[inside[start]], size[inside[start]]
                ids = np.asarray(part.column(0), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(least[start].view(np.int64)),
                        pa.array(_content(h, 0, start, size + window - 1).view(np.int64)),
                        pa.array(_content(g, 1, start, size + window - 1).view(np.int64)),
                        pa.array(ids[doc[start]]),
                        pa.array((start - w.first[doc[start]]).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                    ],
                    schema=_BLOCK_PA,
                )

    return run


_WINDOW_PA = pa.schema([("a", pa.int64()), ("b", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64())])
_WINDOW = "a long, b int, hi long, lo long, at int, doc_id long"


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = Words(_texts(part))
                a, b = grams(w.hashes(0), window, 0), grams(w.hashes(1), window, 1)
                ids = np.asarray(part.column(0), dtype=np.int64)
                blocks = part.column(part.schema.get_field_index("blocks"))
                n = np.diff(np.asarray(blocks.offsets))
                flat = blocks.flatten()
                start, size, hi, lo = (np.asarray(flat.field(k)).astype(np.int64) for k in ("start", "len", "hi", "lo"))
                doc = np.repeat(np.arange(len(n)), n)
                ends = np.cumsum(size)
                at = np.arange(int(size.sum())) - np.repeat(ends - size, size)
                pos = np.repeat(w.first[doc] + start, size) + at
                yield pa.RecordBatch.from_arrays([pa.array(a[pos].view(np.int64)), pa.array((b[pos] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(np.repeat(hi, size)), pa.array(np.repeat(lo, size)), pa.array(at.astype(np.int32)), pa.array(ids[np.repeat(doc, size)])], schema=_WINDOW_PA)

    return run


def repeated_windows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, spans: per document the (start, len) of window starts whose words also start a window of an earlier document."""
    blocks = pin(arrow(rows, _blocks(window, gram), _BLOCK), "blocks")
    index = blocks.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("hi").alias("h1"), F.max("hi").alias("h2"), F.min("lo").alias("l1"), F.max("lo").alias("l2"))
    index = index.filter("first < last").select("anchor", "first", F.expr("h1 <> h2 or l1 <> l2").alias("several"))
    found = pin(blocks.join(index, "anchor"), "found")
    whole = found.filter("not several and doc_id > first").select("doc_id", "start", "len")
    several = found.filter("several")
    contents = several.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "start", "len")).alias("x"))
    wanted = contents.select("x.doc_id", "x.start", "x.len", "hi", "lo").groupBy("doc_id").agg(F.collect_list(F.struct("start", "len", "hi", "lo")).alias("blocks"))
    windows = pin(arrow(rows.join(wanted, "doc_id").select("doc_id", "text", "blocks"), _windows(window), _WINDOW), "windows")
    # Of a content the representative is its first document, so its windows carry the first document of that content.
    low = windows.groupBy("a", "b").agg(F.min("doc_id").alias("source"))
    sources = windows.join(low, ["a", "b"]).groupBy("hi", "lo").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]).alias("sources"))
    one = several.join(sources, ["hi", "lo"]).select("doc_id", F.posexplode(F.transform("sources", lambda s: s < F.col("doc_id"))).alias("at", "hit"), "start")
    one = one.filter("hit").select("doc_id", (F.col("start") + F.col("at")).cast("int").alias("start"), F.lit(1).alias("len"))
    return whole.unionByName(one).groupBy("doc_id").agg(F.collect_list(F.struct("start", "len")).alias("spans"))


def _cover(n: int, spans, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts within a span."""
    step = np.zeros(n + 1, np.int32)
    if len(spans[0]):
        np.add.at(step, spans[0], 1)
        np.add.at(step, np.minimum(spans[0] + spans[1] + window - 1, n), -1)
    return np.cumsum(step)[:n] > 0


def _parse(window: int, finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = _texts(part)
                spans = part.column(part.schema.get_field_index("spans"))
                offsets, flat = np.asarray(spans.offsets), spans.values
                start, size = np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("len")).astype(np.int64)
                out = []
                for k, t in enumerate(texts):
                    words = (t or b"").split()
                    a, b = offsets[k], offsets[k + 1]
                    out.append((words, _cover(len(words), (start[a:b], size[a:b]), window) if spans[k].is_valid and b > a else None))
                yield finish(np.asarray(part.column(0), dtype=np.int64), out)

    return run


_DIGEST_PA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_FACTOR_PA = pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("factors", pa.list_(pa.list_(pa.int32())))])


def _digest(ids, out):
    kept = [w if c is None else [x for x, gone in zip(w, c.tolist(), strict=True) if not gone] for w, c in out]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([len(w) for w, _ in out], pa.int64()), pa.array([len(w) - len(k) for (w, _), k in zip(out, kept, strict=True)], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept], pa.string())], schema=_DIGEST_PA)


def _factors(ids, out):
    kept, spans = [], []
    for w, c in out:
        kept.append(b" ".join(w if c is None else [x for x, gone in zip(w, c.tolist(), strict=True) if not gone]).decode())
        edge = np.flatnonzero(np.diff(c.astype(np.int8), prepend=0, append=0)).reshape(-1, 2) if c is not None else np.empty((0, 2), int)
        spans.append(edge.tolist())
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(kept), pa.array(spans, pa.list_(pa.list_(pa.int32())))], schema=_FACTOR_PA)


def _run(docs: DataFrame, window: int, finish, schema: str) -> DataFrame:
    rows = keyed(docs)
    spans = repeated_windows(rows, window, min(GRAM, window))
    return arrow(rows.join(spans, "doc_id", "left").select("doc_id", "text", "spans"), _parse(window, finish), schema)


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each whole document."""
    return _run(docs, window, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, kept (words left, joined by blanks), factors (the removed [start, end) word spans)."""
    return _run(docs, window, _factors, "doc_id long, kept string, factors array<array<int>>")
