"""Page container, FNV-1a checksum, canonical base64, JSON predicates and segment packing."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import MAX_SAFE, SEGMENT_BYTES

# Page header (fixed values): magic, version; FNV-1a offset and prime.
MAGIC, VERSION = 0x44534850, 1
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFF
    return h


def fnv1a_sql(text: Column | str) -> Column:
    """FNV-1a over the bytes of an ASCII string or of a binary, inside the JVM; empty gives the offset."""
    raw = F.hex(F.col(text) if isinstance(text, str) else text)
    pairs = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw), F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substr(raw, i, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(pairs, F.lit(FNV_OFFSET).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def encode_page(page_id: str, payload: bytes) -> bytes:
    name = page_id.encode()
    if len(name) > 65535:
        raise ValueError("page id too long")
    return struct.pack(">IHH", MAGIC, VERSION, len(name)) + name + struct.pack(">II", len(payload), fnv1a(name + payload)) + payload


def decode_page(raw: bytes) -> tuple[str, bytes]:
    if len(raw) < 16:
        raise ValueError("page too short")
    magic, version, n = struct.unpack(">IHH", raw[:8])
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a page of this version")
    if len(raw) < 16 + n:
        raise ValueError("page too short")
    size, check = struct.unpack(">II", raw[8 + n : 16 + n])
    if len(raw) != 16 + n + size:
        raise ValueError("page length")
    name, payload = raw[8 : 8 + n], raw[16 + n :]
    if fnv1a(name + payload) != check:
        raise ValueError("page checksum")
    return name.decode("utf-8"), payload


@F.pandas_udf(T.BinaryType())
def encode_pages(ids: pd.Series, payloads: pd.Series) -> pd.Series:
    return pd.Series([encode_page(i, bytes(p)) for i, p in zip(ids, payloads, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("page_id", T.StringType()), T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())]))
def decode_pages(raws: pd.Series) -> pd.DataFrame:
    out = []
    for raw in raws:
        try:
            out.append((*decode_page(bytes(raw)), None))
        except ValueError as e:
            out.append((None, None, str(e)))
    return pd.DataFrame(out, columns=["page_id", "payload", "error"])


def is_base64(text: Column | str, padded: bool = False) -> Column:
    """Canonical base64; without ``padded`` a missing padding is accepted."""
    c = F.col(text) if isinstance(text, str) else text
    full = c if padded else F.concat(c, F.when(F.length(c) % 4 == 2, F.lit("==")).when(F.length(c) % 4 == 3, F.lit("=")).otherwise(F.lit("")))
    whole = F.replace(F.replace(F.base64(F.try_to_binary(full, F.lit("base64"))), F.lit("\r\n")), F.lit("\n"))
    return F.coalesce(c.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & (whole == full), F.lit(False))


def is_safe(n: Column) -> Column:
    return F.coalesce((n >= 0) & (n <= MAX_SAFE), F.lit(False))


def valid_blocks(blocks: Column) -> Column:
    """Each content block (JSON text) has what its type needs."""
    get = lambda b, k: F.get_json_object(b, f"$.{k}")

    def one(b):
        kind = get(b, "type")
        return F.when(kind.isin("text", "reasoning"), get(b, "text").isNotNull()).when(kind == "tool-call", get(b, "id").isNotNull() & get(b, "name").isNotNull() & get(b, "arguments").isNotNull()).otherwise(kind.isNotNull())

    return F.forall(blocks, one)


def valid_usage(usage: Column) -> Column:
    names = ("inputTokens", "outputTokens", "totalTokens", "cacheReadTokens", "cacheWriteTokens", "reasoningTokens")
    ok = is_safe(usage[names[0]]) & is_safe(usage[names[1]])
    for x in names[2:]:
        ok = ok & (usage[x].isNull() | is_safe(usage[x]))
    return usage.isNull() | ok


_PACK_PA = pa.schema([("store", pa.string()), ("seq", pa.int64()), ("size", pa.int64()), ("segment", pa.int64()), ("offset", pa.int64())])


def pack_segments(blobs: DataFrame, limit: int = SEGMENT_BYTES, start: tuple[int, int] = (0, 0)) -> DataFrame:
    """(store, seq, size) with segment and offset: a blob goes behind the last one or opens a segment, from ``start`` on.

    Where a segment ends depends on all before, so each store is one ordered pass; it
    streams and keeps two numbers.  A blob larger than a segment has neither (rejected).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, segment, used = None, 0, 0
        for batch in batches:
            seg, off = [], []
            for s, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if s != store:
                    store, (segment, used) = s, start
                if size > limit:
                    seg.append(None)
                    off.append(None)
                    continue
                if used + size > limit:
                    segment, used = segment + 1, 0
                seg.append(segment)
                off.append(used)
                used += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seg, pa.int64()), pa.array(off, pa.int64())], schema=_PACK_PA)

    rows = blobs.select(F.col("store").cast("string").alias("store"), F.col("seq").cast("long").alias("seq"), F.col("size").cast("long").alias("size"))
    return rows.repartition("store").sortWithinPartitions("store", "seq").mapInArrow(run, "store string, seq long, size long, segment long, offset long")
