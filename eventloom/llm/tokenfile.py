"""Token ids in patched frame-of-reference blocks.

File format: a folder of Parquet files, one record per run of whole documents
(ascending doc_id, at least one document, about ``RECORD_IDS`` ids), whose payload is
opaque to Parquet:

* ``doc_ids`` and ``doc_lens``: which documents the ids belong to;
* ``payload``: blocks of ``BLOCK`` ids.  A block stores its minimum, a bit width chosen
  so that ``WIDTH_PERCENT`` of the differences to the minimum fit, the low bits of all
  differences packed at that width, and the positions and high bits of the others in an
  exception list;
* ``block_starts``: byte position of each block in the payload, for random access;
* ``shard`` and ``first``: the range partition and the position of its first id in it.

A second table holds the number of ids of every shard; start positions in the whole
corpus are prefix sums over it.  Files are written by Spark's committer, so a lost
executor repeats its shard and nothing else.

Defined results: a null text is the empty text (the end id alone); rows with a null
doc_id are left out; of rows with one doc_id the greatest text counts; an empty table
gives an empty file set and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode_texts, encoder, tokenizer_path
from .common import arrow, keyed, scratch, slices

BLOCK = 512
WIDTH_PERCENT = 90
RECORD_IDS = 1 << 20
END_ID = 1
#: Words that a worker keeps the ids of, at most: it encodes them in passing.
CACHE_WORDS = 1_000_000
SCHEMA = "shard int, record int, first long, n_ids long, doc_ids binary, doc_lens binary, block_starts binary, payload binary"
_SCHEMA_PA = pa.schema([("shard", pa.int32()), ("record", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), *((x, pa.binary()) for x in ("doc_ids", "doc_lens", "block_starts", "payload"))])


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed for each non-negative value."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) + 1, 0)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(payload, block starts) of ids below 2**32.

    Block: n u2, width u1, pad u1, minimum u4, exceptions u2, pad u2; then packed low
    bits, exception positions (u2 each) and exception high parts (u4 each).
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return b"", np.empty(0, np.uint32)
    full = np.full(blocks * BLOCK, ids[-1], np.int64)
    full[:n] = ids
    m = full.reshape(blocks, BLOCK)
    low = m.min(1)
    rest = m - low[:, None]
    k = -(-BLOCK * WIDTH_PERCENT // 100) - 1
    width = _bits(np.partition(rest, k, 1)[:, k])
    out: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        r = rest[mine]
        if w:
            lowbits = (r & ((1 << w) - 1)).astype("<u4")
            b = np.unpackbits(lowbits.view(np.uint8).reshape(len(mine), BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(b.reshape(len(mine), BLOCK * w), axis=1, bitorder="little")
        high = r >> w
        for j, k in enumerate(mine.tolist()):
            count = min(BLOCK, n - k * BLOCK)
            at = np.flatnonzero(high[j, :count])
            head = np.array([count, w], "<u2").tobytes() + np.array([low[k]], "<u4").tobytes() + np.array([len(at), 0], "<u2").tobytes()
            out[k] = head + (packed[j].tobytes() if w else b"") + at.astype("<u2").tobytes() + high[j, at].astype("<u4").tobytes()
    starts = np.concatenate([[0], np.cumsum([len(x) for x in out])[:-1]]).astype("<u4")
    return b"".join(out), starts


def unpack_blocks(payload: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of a payload; give some of the starts for some of the blocks."""
    if not len(starts):
        return np.empty(0, np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    starts = np.asarray(starts, np.int64)
    head = raw[starts[:, None] + np.arange(12)]
    count, width = head[:, 0:2].copy().view("<u2").ravel().astype(np.int64), head[:, 2].astype(np.int64)
    low, odd = head[:, 4:8].copy().view("<u4").ravel().astype(np.int64), head[:, 8:10].copy().view("<u2").ravel().astype(np.int64)
    m = np.zeros((len(starts), BLOCK), np.int64)
    for w in np.unique(width).tolist():
        if w:
            mine = np.flatnonzero(width == w)
            b = np.unpackbits(raw[starts[mine, None] + 12 + np.arange(BLOCK * w // 8)], axis=1, bitorder="little").reshape(len(mine), BLOCK, w)
            wide = np.zeros((len(mine), BLOCK, 32), np.uint8)
            wide[:, :, :w] = b
            m[mine] = np.packbits(wide, axis=2, bitorder="little").view("<u4").reshape(len(mine), BLOCK)
    for k in np.flatnonzero(odd).tolist():
        at = starts[k] + 12 + BLOCK * width[k] // 8
        e = odd[k]
        pos = raw[at : at + 2 * e].copy().view("<u2")
        m[k, pos] |= raw[at + 2 * e : at + 6 * e].copy().view("<u4").astype(np.int64) << width[k]
    m += low[:, None]
    return m.astype("<u4")[np.arange(BLOCK)[None, :] < count[:, None]]


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, record, first = TaskContext.get().partitionId(), 0, 0
        enc = encoder(path, CACHE_WORDS)
        docs, lens, ids = [], [], []

        def flush():
            nonlocal record, first
            flat = np.concatenate(ids)
            payload, starts = pack_blocks(flat)
            row = [[shard], [record], [first], [len(flat)], [np.concatenate(docs).astype("<i8").tobytes()], [np.concatenate(lens).astype("<u4").tobytes()], [starts.tobytes()], [payload]]
            record, first = record + 1, first + len(flat)
            docs.clear(), lens.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(row, _SCHEMA_PA, strict=True)], schema=_SCHEMA_PA)

        for batch in batches:
            for part in slices(batch, limit=8 << 20):
                n, flat = encode_texts(part.column(1), enc)
                ends = np.cumsum(n)
                out = np.insert(flat, ends, END_ID)
                docs.append(np.asarray(part.column(0), dtype=np.int64))
                lens.append(n + 1)
                ids.append(out)
                if sum(map(len, ids)) >= RECORD_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Encode whole texts with the tokenizers library (per blank-separated word, which
    gives the ids of the whole text) and write them in ascending doc_id order."""
    rows = keyed(docs)
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(_write(path or tokenizer_path()), SCHEMA).write.parquet(folder + "/records")
    shards = docs.sparkSession.read.schema(SCHEMA).parquet(folder + "/records").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    shards.withColumn("before", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).select("shard", "before").write.parquet(folder + "/shards")


_DOC_PA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = unpack_blocks(r["payload"], np.frombuffer(r["block_starts"], "<u4")).tobytes()
            lens = np.frombuffer(r["doc_lens"], "<u4").astype(np.int64)
            ends = np.cumsum(lens)
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["doc_ids"], "<i8")), pa.array(ends - lens + r["first"]), pa.array(lens), pa.array(crc, pa.int64())], schema=_DOC_PA)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone.

    The table of shards has one short row per written partition and is joined by broadcast.
    """
    shards = spark.read.schema("shard int, before long").parquet(folder + "/shards")
    rows = spark.read.schema(SCHEMA).parquet(folder + "/records")
    rows = rows.join(F.broadcast(shards), "shard").withColumn("first", F.col("first") + F.col("before"))
    return arrow(rows.select("first", "doc_ids", "doc_lens", "block_starts", "payload"), _read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file(docs: DataFrame, path: str | None = None, folder: str | None = None) -> DataFrame:
    folder = folder or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path)
    return read_documents(docs.sparkSession, folder)
