"""Exact top-k inner-product search by ball trees.

Rows are dealt to shards of about ``SHARD_ROWS`` vectors; each shard's ball tree is built
once and stored.  Queries come in blocks, which travel to the trees.  A block meets the
shards in waves of 1, 2, 4, ... shards; in a shard, nodes are taken in the order of their
upper bound q.c + |q| r and skipped when the bound is below the query's current k-th
score, which is carried from leaf to leaf and, by a join, from wave to wave.

A wave moves a tree once for every ``ROUND`` blocks that meet it and holds one tree and
one block of a task in memory.  Every block meets every shard, so the work is queries
times shards, whatever share of it the bounds save.

Vectors are made integers, floor(256 x); scores are exact (double arithmetic below 2**53,
Python integers beyond, limited to the range of a long).

Defined results: vectors that are null or hold a null or non-finite component take no
part; only vectors of the query's length are candidates; ties go to the smaller vec_id;
of rows with one vec_id the greatest vector counts; rows with a null vec_id are left out;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, pin

SHARD_ROWS = 8192
BLOCK_ROWS = 512
#: Blocks for which a tree is sent once in a wave.
ROUND = 64
LEAF = 64
SCALE = 256
_EXACT = 2.0**53
_LONG = 2**63 - 1


def valid_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    out = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    out = out.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if out.groupBy("vec_id").count().filter("count > 1").limit(1).count():
        out = out.groupBy("vec_id").agg(F.max("v").alias("v"))
    return out.withColumn("dim", F.size("v"))


class BallTree:
    """Nodes in arrays; children of node i are left[i] and right[i], leaves hold rows start[i]:end[i]."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.arange(len(ids))
        self.start, self.end, self.left, self.right, centers, radii = [], [], [], [], [], []

        def build(a: int, b: int) -> int:
            me, y = len(self.start), x[order[a:b]]
            c = y.mean(0)
            dist = np.sqrt(((y - c) ** 2).sum(1))
            for to, v in ((self.start, a), (self.end, b), (self.left, -1), (self.right, -1), (centers, c), (radii, float(dist.max()))):
                to.append(v)
            if b - a > LEAF:
                far = y[int(dist.argmax())]
                other = y[int(((y - far) ** 2).sum(1).argmax())]
                side = np.argsort(y @ (other - far), kind="stable")
                order[a:b] = order[a:b][side]
                mid = (a + b) // 2
                self.left[me] = build(a, mid)
                self.right[me] = build(mid, b)
            return me

        build(0, len(ids))
        self.ids, self.x, self.c, self.r = ids[order], x[order], np.array(centers), np.array(radii)

    def dump(self) -> tuple[bytes, bytes, bytes, bytes]:
        """(ids, vectors, node links, centres with radii), as stored."""
        links = np.array([self.start, self.end, self.left, self.right], "<i4")
        return self.ids.astype("<i8").tobytes(), self.x.astype("<f8").tobytes(), links.tobytes(), np.column_stack([self.c, self.r]).astype("<f8").tobytes()

    @classmethod
    def load(cls, dim: int, ids: bytes, x: bytes, links: bytes, balls: bytes) -> BallTree:
        tree = cls.__new__(cls)
        tree.ids = np.frombuffer(ids, "<i8")
        tree.x = np.frombuffer(x, "<f8").reshape(len(tree.ids), dim)
        tree.start, tree.end, tree.left, tree.right = np.frombuffer(links, "<i4").reshape(4, -1).tolist()
        ball = np.frombuffer(balls, "<f8").reshape(-1, dim + 1)
        tree.c, tree.r = ball[:, :dim], ball[:, dim]
        return tree


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if q.shape[1] and float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] >= _EXACT:
        big = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
        return np.clip(big, -_LONG - 1, _LONG).astype(np.int64)
    return (q @ x.T).astype(np.int64)


def search(tree: BallTree, qid: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of up to k rows per query that score at least kth; unused places have the largest long as id."""
    m = len(qid)
    best = np.full((m, k), -_LONG - 1, np.int64)
    who = np.full((m, k), _LONG, np.int64)
    kth = kth.astype(np.float64).copy()
    norm = np.sqrt((q * q).sum(1))

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        b = q[rows] @ tree.c[node] + norm[rows] * tree.r[node]
        return b + 1e-9 * (np.abs(b) + norm[rows] * (tree.r[node] + np.sqrt((tree.c[node] ** 2).sum()))) + 1e-6

    everyone = np.arange(m)
    heap = [(-math.inf, 0, everyone, bound(0, everyone))]
    while heap:
        _, node, rows, b = heapq.heappop(heap)
        live = b >= kth[rows]
        rows, b = rows[live], b[live]
        if not len(rows):
            continue
        if tree.left[node] >= 0:
            for child in (tree.left[node], tree.right[node]):
                cb = bound(child, rows)
                go = cb >= kth[rows]
                if go.any():
                    heapq.heappush(heap, (-float(cb[go].max()), child, rows[go], cb[go]))
            continue
        a, e = tree.start[node], tree.end[node]
        s = _scores(q[rows], tree.x[a:e])
        ids = np.broadcast_to(tree.ids[a:e], s.shape)
        own = ids == qid[rows][:, None]
        s = np.concatenate([best[rows], np.where(own, -_LONG - 1, s)], 1)
        ids = np.concatenate([who[rows], np.where(own, _LONG, ids)], 1)
        top = np.lexsort((ids, ~s), axis=-1)[:, :k]  # ~s turns the order round without overflow
        best[rows], who[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(ids, top, 1)
        full = who[rows, k - 1] != _LONG
        kth[rows[full]] = np.maximum(kth[rows[full]], best[rows[full], k - 1])
    return best, who


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)).flatten()).reshape(batch.num_rows, dim)


_PACK_PA = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("ids", pa.binary()), ("x", pa.binary()), ("links", pa.binary()), ("balls", pa.binary())])
_PACK = "dim int, part long, ids binary, x binary, links binary, balls binary"


def _pack(trees: bool):
    """Rows with one (dim, part) stand together; each group becomes one row, in the order of its ball tree if ``trees``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, xs = None, [], []

        def done():
            i, x = np.concatenate(ids), np.concatenate(xs)
            row = BallTree(i, x).dump() if trees else (i.astype("<i8").tobytes(), x.astype("<f8").tobytes(), None, None)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, *row), _PACK_PA, strict=True)], schema=_PACK_PA)

        for batch in batches:
            dim, part = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            cuts = [0, *(np.flatnonzero((np.diff(dim) != 0) | (np.diff(part) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b == a:
                    continue
                if key != (dim[a], part[a]):
                    if key is not None:
                        yield done()
                    key, ids, xs = (dim[a], part[a]), [], []
                piece = batch.slice(a, b - a)
                ids.append(np.asarray(piece.column(0)))
                xs.append(np.floor(SCALE * _matrix(piece, "v", int(dim[a]))))
        if key is not None:
            yield done()

    return run


def _packed(rows: DataFrame, size: int, name: str, trees: bool) -> DataFrame:
    """(dim, part, ids, x, links, balls): rows dealt by a hash to parts of about ``size``; parts of one length are numbered from 0."""
    n = rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias("parts"))
    rows = rows.join(F.broadcast(n), "dim").select("vec_id", "v", "dim", F.expr("pmod(xxhash64(vec_id), parts)").alias("part"))
    to = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pin(arrow(rows.repartition(to, "dim", "part").sortWithinPartitions("dim", "part", "vec_id"), _pack(trees), _PACK), name)


def _search(k: int):
    """Each tree stands before the blocks that meet it; one tree and one block are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                d = r["dim"]
                if r["links"] is not None:
                    held, tree = (d, r["part"]), BallTree.load(d, r["ids"], r["x"], r["links"], r["balls"])
                    continue
                if held != (d, r["part"]):
                    raise RuntimeError("a block without its tree")
                qid = np.frombuffer(r["ids"], "<i8")
                known = dict(zip(r["kq"] or [], r["ks"] or [], strict=True))
                kth = np.array([known.get(i, -_LONG - 1) for i in qid.tolist()], np.float64)
                s, w = search(tree, qid, np.frombuffer(r["x"], "<f8").reshape(len(qid), d), kth, k)
                row, col = np.nonzero(w != _LONG)
                yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(w[row, col]), pa.array(s[row, col])], names=["query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query; both frames as of ``valid_vectors``."""
    shards = _packed(rows, SHARD_ROWS, "shards", True)
    blocks = _packed(queries, BLOCK_ROWS, "blocks", False).withColumnRenamed("part", "block")
    of = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    n_shards = shards.groupBy("dim").agg(F.count("*").alias("n"))
    most = n_shards.agg(F.max("n")).first()[0] or 0
    to = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best, first, width = None, 0, 1
    while first < most or best is None:
        # a block starts at a shard of its own, so that a wave spreads over all shards
        met = blocks.join(F.broadcast(n_shards), "dim").filter(F.col("n") > first).withColumn("i", F.explode(F.expr(f"sequence({first}L, least({first + width}L, n) - 1)")))
        met = met.withColumn("part", F.expr("pmod(block + i, n)")).drop("i", "n")
        if best is not None:
            kth = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "score")
            kth = queries.join(kth, "vec_id").join(F.broadcast(queries.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_ROWS)).cast("long").alias("parts"))), "dim")
            kth = kth.groupBy("dim", F.expr("pmod(xxhash64(vec_id), parts)").alias("block")).agg(F.collect_list(F.struct("vec_id", "score")).alias("x"))
            met = met.join(kth.select("dim", "block", F.col("x.vec_id").alias("kq"), F.col("x.score").alias("ks")), ["dim", "block"], "left")
        else:
            met = met.withColumn("kq", F.expr("cast(null as array<long>)")).withColumn("ks", F.expr("cast(null as array<long>)"))
        met = pin(met.withColumn("round", F.expr(f"block div {ROUND}")), "met")
        sent = shards.join(met.select("dim", "part", "round").distinct(), ["dim", "part"]).withColumn("block", F.lit(-1).cast("long"))
        both = met.unionByName(sent, allowMissingColumns=True).repartition(to, "dim", "part", "round").sortWithinPartitions("dim", "part", "round", "block")
        got = arrow(both, _search(k), "query_id long, vec_id long, score long")
        if best is not None:
            got = got.unionByName(best.drop("rank"))
        best = pin(got.withColumn("rank", F.row_number().over(of)).filter(F.col("rank") <= k), "best")
        first, width = first + width, width * 2
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
