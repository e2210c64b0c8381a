"""Shared pieces of the training-data operators: scratch tables, checked
broadcasts, vectorised word hashing and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python worker; bounds its memory.
SLICE_BYTES = 1 << 20
#: The ``Scratch`` objects in force, in this thread only.
_owners: ContextVar[tuple[Scratch, ...]] = ContextVar("owners", default=())


class Scratch:
    """Owns the scratch tables made while it is in force (``with``); ``free`` deletes them, and them only.

    Tables made outside of any stay in the folder of the cluster, whose owner clears it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        _owners.set((*_owners.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _owners.set(tuple(x for x in _owners.get() if x is not self))

    def free(self) -> None:
        while self.paths:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder only for a local master without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="eventloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    path = f"{shared_folder(spark)}/eventloom-{uuid.uuid4().hex[:12]}-{name}"
    if owners := _owners.get():
        owners[-1].paths.append(path)
    return path


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Mark a pinned frame for broadcast if it has at most ``rows`` rows; beyond that a shuffle join serves."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tidy(run):
    """A function over record batches that gives memory back to the system when its task ends, as workers live on."""

    def tidied(*batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(*batches)
        trim()

    return tidied


def trim() -> None:
    import ctypes
    import gc

    _powers.clear()
    gc.collect()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` of a tidy function."""
    return df.mapInArrow(tidy(run), schema)


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The (key, text) columns with one row per non-null key.

    Rows without a key are left out.  Of rows with the same key the greatest text
    stands for all (null is least).  Whether there are any is seen from the ids
    alone, so that texts are only shuffled when it is needed.
    """
    out = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    if out.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        out = out.groupBy("doc_id").agg(F.max("text").alias("text"))
    return out


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about ``limit`` bytes of text, or one row."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    lens = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    bins = np.cumsum(lens) // limit
    cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


# -- hashing of words and word runs ------------------------------------------------
_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _tables(seed: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.default_rng(seed)
    p = int(rng.integers(1 << 62, dtype=np.uint64)) * 8 + 3
    p &= (1 << 64) - 1
    return rng.integers(0, 1 << 64, 256, dtype=np.uint64), p, pow(p, -1, 1 << 64)


_HASHES = [_tables(0x5EED), _tables(0xF00D)]
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        x = np.full(size, np.uint64(base))
        x[0] = 1
        _powers[base] = have = np.multiply.accumulate(x)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs stay equal, close ones spread."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a list of texts (bytes, or None), found and hashed with array operations.

    ``first[d]`` is the index of the first word of text d; ``start`` and ``end`` are
    byte positions in ``buf``.  A word is a run of bytes other than ASCII white space.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        buf = b"\n".join(t or b"" for t in texts) + b"\n"
        self.buf = buf.lower() if lower else buf
        self.a = np.frombuffer(self.buf, np.uint8)
        space = _SPACE[self.a]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        self.first = np.searchsorted(self.start, np.concatenate([[0], ends]))
        self.n = np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        table, p, inv = _HASHES[which]
        sums = np.empty(len(self.a) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[self.a] * _pow(p, len(self.a)), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * _pow(inv, len(self.a) + 1)[self.start])

    def texts_of(self, i: int, j: int) -> list[bytes]:
        return [self.buf[a:b] for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True)]


def grams(word: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of k words (index: its first word); runs may cross texts, callers mask those."""
    if len(word) < k:
        return np.empty(0, np.uint64)
    _, p, inv = _HASHES[which]
    sums = np.empty(len(word) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(word * _pow(p, len(word)), out=sums[1:])
    n = len(word) - k + 1
    return mix((sums[k:] - sums[:n]) * _pow(inv, n) + np.uint64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])


# -- connected components ----------------------------------------------------------
#: Edges that a task contracts at once.
_CHUNK_EDGES = 1 << 20
_EDGE_PA = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("own", pa.bool_())])
_EDGE = "u long, v long, own boolean"


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node that each reaches) of a list of edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while len(a):
        x, y = low[a], low[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nxt := low[low], low):
            low = nxt
    return nodes, nodes[low]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as stars; ``own`` marks nodes that are a ``u`` of the task.  Where rows are sorted, a chunk ends where ``u`` changes."""

    def done(u, v):
        nodes, low = forest(u, v)
        moved = nodes != low
        nodes, low = nodes[moved], low[moved]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(low), pa.array(np.isin(nodes, u))], schema=_EDGE_PA)

    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        u, v = (np.concatenate([x, np.asarray(batch.column(i), dtype=np.int64)]) for i, x in enumerate((u, v)))
        if len(u) >= 4 * _CHUNK_EDGES and len(new := np.flatnonzero(np.diff(u))):
            cut = int(new[-1]) + 1
            yield done(u[:cut], v[:cut])
            u, v = u[cut:], v[cut:]
    if len(u):
        yield done(u, v)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of an undirected edge list (a, b): comp is the least node that it reaches.

    Tasks of about ``_CHUNK_EDGES`` edges contract what they read to stars; a list that fits
    one of them is done.  Else rounds follow: edges meet at their greater node, where a task
    links all roots that a node was given, and each root is replaced by its own root through
    a join.  A node has at most one edge from every task of the round before, so no hub
    gathers its neighbours in one task; the join on roots is an equi-join that adaptive
    execution may split.  Rounds end when no task links two roots and no root has another.
    Each step is written to the shared folder.
    """
    edges = pin(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "edges")
    n = max(1, -(-edges.count() // _CHUNK_EDGES))
    now = pin(arrow(edges.coalesce(n), _contract, _EDGE), "cc")
    while n > 1:
        stars = pin(arrow(now.select("u", "v").repartition(n, "u").sortWithinPartitions("u"), _contract, _EDGE), "stars")
        roots = stars.filter("own").select(F.col("u").alias("v"), F.col("v").alias("w"))
        now = pin(stars.join(roots, "v", "left").select("u", F.coalesce("w", "v").alias("v"), (F.col("own") & F.col("w").isNull()).alias("own")), "cc")
        if not now.filter("not own").limit(1).count():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
