"""MinHash near-dedup as a chosen-path set similarity join.

A document is the set of its distinct shingles (runs of five words, lower case).
Documents with equal sets are one class from the start.  The rest is a recursion:

* a tree sends every class down a path of minwise tokens, one more at each level; the
  classes on one path form a node.  A node of at most ``NODE`` classes is closed and
  compared exhaustively on sketches; a larger one is branched again;
* ``TREES`` independent trees, with minwise tokens of their own, repeat this.  A pair of
  similarity s stays together to depth d of a tree with probability s**d; at s = 0.75 and
  depth 4, the deepest, sixteen trees miss it with probability 0.0023, at depth 1 with 2e-10;
* candidates are confirmed on full shingle sets and linked components are contracted.

Nodes of the first level that fit a task (``TASK_NODE`` classes) meet there in one
exchange, sorted by path, and the task does the rest of the recursion; larger ones go to
depth 4 by their path of four tokens and are counted again.

To keep a group of thousands of near copies linear, ``STARS`` trees first propose only
stars around the least class of each node of depth 4; what they connect is never compared
again.  Then all trees propose every pair of classes in different components.  A node that
is still large at depth 4 and holds several components is finished exactly: every class
outside its main component is compared with every other of the node, block by block, on
sketches and then on full sets.  Blocks carry the full sets, so that no pair but a link
leaves them; the work is (classes outside the main component) x (classes of the node).

Defined results: a text without words, or a null one, has the empty set and links with
nothing; fewer than five words are one shingle; rows with a null doc_id are left out; of
rows with one doc_id the greatest text counts; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow, components, grams, keyed, mix, pin, sized, slices

SHINGLE = 5
PERCENT = 75
TREES = 16
SLOTS = 4
NODE = 32
#: Trees that propose stars.
STARS = 4
#: Classes of a node whose recursion one task does.
TASK_NODE = 4096
#: Ids of documents up to which a list of them is broadcast; a longer one is shuffled with the texts.
BROADCAST_IDS = 500_000
#: A large node is finished in blocks of about so many classes, and so many shingles.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Of 64 sketch values at least so many must agree: at similarity 0.75 fewer do with probability 1e-8.
#: Nodes carry the low byte of each value only: equal values agree as before, and one in 256
#: of the others, which the full sets then refuse.
AGREE = 28

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 64, TREES * SLOTS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, TREES * SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    h = w.hashes()
    g = grams(h, k)
    out = []
    for a, n in zip(w.first[:-1].tolist(), w.n.tolist(), strict=True):
        if n >= k:
            x = np.sort(g[a : a + n - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(grams(h[a : a + n], n) if n else np.empty(0, np.uint64))
    return out


_SET_PA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sig", pa.binary()), ("low", pa.binary())])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist())
            n = np.array([len(x) for x in sets], np.int64)
            flat = np.concatenate([x if len(x) else np.zeros(1, np.uint64) for x in sets])
            at = np.cumsum(np.maximum(n, 1)) - np.maximum(n, 1)
            sig = np.empty((len(sets), TREES * SLOTS), np.int32)
            for j in range(TREES * SLOTS):
                x = (flat ^ _XOR[j]) * _MUL[j]
                sig[:, j] = (np.minimum.reduceat(x, at) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            hi = np.add.reduceat(mix(flat), at) + n.astype(np.uint64)
            lo = np.add.reduceat(mix(flat ^ np.uint64(0x9E3779B97F4A7C15)), at)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())], schema=_SET_PA)


_FULL_PA = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(part.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], schema=_FULL_PA)


_PAIR_PA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR_PA)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


_FOUND_PA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("t", pa.int32())])


def _recurse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, path, doc_id, comp, n, low, t, deep), sorted by key and path, as candidate pairs (a, b).

    Members of nodes that are large at the last depth leave as (a, null, deep, t); deep names that node.
    """

    def node(t: pa.Table, out):
        doc, comp, n = (np.asarray(t[c]) for c in ("doc_id", "comp", "n"))
        path = _bytes(t["path"], 4 * SLOTS).view("<u4")
        low = _bytes(t["low"], TREES * SLOTS)
        todo = [(0, len(doc), 1)]
        while todo:
            a, b, depth = todo.pop()
            if (comp[a:b] == comp[a]).all():
                continue
            if b - a <= NODE:
                near = (low[a:b, None, :] == low[None, a:b, :]).sum(2) >= AGREE
                near &= 100 * np.minimum(n[a:b, None], n[a:b]) >= PERCENT * np.maximum(n[a:b, None], n[a:b])
                near &= comp[a:b, None] != comp[a:b]
                i, j = np.nonzero(np.triu(near, 1))
                out.append((np.minimum(doc[a + i], doc[a + j]), np.maximum(doc[a + i], doc[a + j]), None, 0))
            elif depth < SLOTS:
                cuts = [a, *(a + 1 + np.flatnonzero(path[a + 1 : b, depth] != path[a : b - 1, depth])).tolist(), b]
                todo += [(x, y, depth + 1) for x, y in zip(cuts, cuts[1:], strict=False) if y - x > 1]
            else:
                out.append((doc[a:b], None, np.full(b - a, t["deep"][a].as_py()), t["t"][a].as_py()))

    def found(out):
        cols = [[], [], [], []]
        for a, b, key, t in out:
            for col, x, kind in zip(cols, (a, b, key, None if key is None else np.full(len(a), t)), _FOUND_PA.types, strict=True):
                col.append(pa.nulls(len(a), kind) if x is None else pa.array(x, kind))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) if c else pa.array([], k) for c, k in zip(cols, _FOUND_PA.types, strict=True)], schema=_FOUND_PA)

    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = (t if rest is None else pa.concat_tables([rest, t])).combine_chunks()
        if not t.num_rows:
            continue
        key = np.asarray(t["key"])
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist()]
        rest, out = t.slice(cuts[-1]), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            node(t.slice(a, b - a), out)
        yield found(out)
    if rest is not None:
        node(rest, out := [])
        yield found(out)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):  # one pair of sets at a time is copied
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], schema=_PAIR_PA)


def _shared(x: list[np.ndarray], y: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Numbers of common elements of x[i] and y[j], pair by pair or by matrix products, whichever is less work."""
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(e) for e in s])) for s in (x, y)]
    both = np.intersect1d(sides[0][0], sides[1][0])
    if not len(both):
        return np.zeros(len(i), np.int64)
    mean = (len(sides[0][0]) + len(sides[1][0])) / (len(x) + len(y))
    if len(i) * (1e5 + 400 * mean) <= len(x) * len(y) * len(both):
        return np.array([len(np.intersect1d(x[a], y[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    found = []
    for flat, row in sides:
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        found.append((at[hit], row[hit]))
    total = np.zeros((len(x), len(y)), np.float32)  # exact below 2**24
    for a in range(0, len(both), 4096):
        some = []
        for (at, row), m in zip(found, (len(x), len(y)), strict=True):
            of = (at >= a) & (at < a + 4096)
            some.append(np.zeros((m, min(4096, len(both) - a)), np.float32))
            some[-1][row[of], at[of] - a] = 1
        total += some[0] @ some[1].T
    return total[i, j].astype(np.int64)


def _finish(t: pa.Table) -> pa.Table:
    """Links between classes outside the main component (left) and a block of their node, as few as connect the same."""
    t = t.combine_chunks()
    left = np.asarray(t["left"])
    side = [np.flatnonzero(left), np.flatnonzero(~left)]
    if not len(side[0]) or not len(side[1]):
        return pa.Table.from_batches([_pairs([], [])])
    doc, comp, n, rest = (np.asarray(t[c]) for c in ("doc_id", "comp", "n", "rest"))
    x, y = side
    near = comp[x][:, None] != comp[y][None, :]
    near &= 100 * np.minimum(n[x][:, None], n[y]) >= PERCENT * np.maximum(n[x][:, None], n[y])
    near &= ~rest[y] | (doc[x][:, None] < doc[y])  # two such classes meet in both roles
    sig = _bytes(t["sig"], 4 * TREES * SLOTS).view("<u4")
    agree = np.zeros(near.shape, np.uint8)
    for tree in range(TREES):
        path = np.ones(near.shape, bool)
        for k in range(tree * SLOTS, tree * SLOTS + SLOTS):
            same = sig[x, k][:, None] == sig[y, k]
            agree += same
            path &= same
        if tree < t["t"][0].as_py():  # a pair is compared in the first tree that holds it together
            near &= ~path
    i, j = np.nonzero(near & (agree >= AGREE))
    if not len(i):
        return pa.Table.from_batches([_pairs([], [])])
    ux, i = np.unique(i, return_inverse=True)
    uy, j = np.unique(j, return_inverse=True)
    x, y = x[ux], y[uy]
    held = t["shingles"]
    sets = [[np.frombuffer(held[k].as_py(), np.uint64) for k in s.tolist()] for s in (x, y)]
    both = _shared(*sets, i, j)
    good = 100 * both >= PERCENT * (n[x][i] + n[y][j] - both)
    i, j = x[i[good]], y[j[good]]
    _, one = np.unique(np.stack([comp[i], comp[j]]), axis=1, return_index=True)
    top: dict[int, int] = {}
    a, b = [], []
    for u, v in zip(i[one].tolist(), j[one].tolist(), strict=True):
        p, q = int(comp[u]), int(comp[v])
        while p in top:
            p = top[p]
        while q in top:
            q = top[q]
        if p != q:
            top[max(p, q)] = min(p, q)
            a.append(int(min(doc[u], doc[v])))
            b.append(int(max(doc[u], doc[v])))
    return pa.Table.from_batches([_pairs(a, b)])


def _token_path(depth: int) -> Column:
    """Name of the node of tree ``t`` at a depth."""
    return F.xxhash64("t", F.lit(depth), F.substring("sig", F.col("t") * (4 * SLOTS) + 1, F.lit(4 * depth)))


def _trees(classes: DataFrame, trees: int) -> DataFrame:
    return classes.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))


def _stars(classes: DataFrame) -> DataFrame:
    """Pairs (a, b): the least class of each node of depth SLOTS of the first trees with each other one."""
    rows = _trees(classes, STARS).select(_token_path(SLOTS).alias("key"), "doc_id")
    lead = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("doc_id").alias("a")).filter("c > 1").drop("c")
    return rows.join(lead, "key").filter("a < doc_id").select("a", F.col("doc_id").alias("b"))


def _mixed(rows: DataFrame, name: str) -> DataFrame:
    """Rows (key, comp, ..) of nodes with several components, with the size of their node."""
    size = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 < c2").select("key", "size")
    return pin(rows.join(size, "key"), name)


def _propose(classes: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs (a, b), members (key, t, doc_id) of nodes still large at the last depth), between different components only."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = _mixed(_trees(classes.join(comp, "doc_id", "left"), TREES).select(_token_path(1).alias("key"), "t", "doc_id", F.coalesce("comp", "doc_id").alias("comp")), "level1")
    nodes, large = top.filter(F.col("size") <= TASK_NODE), None
    big = top.filter(F.col("size") > TASK_NODE)
    if big.limit(1).count():
        deep = _mixed(big.join(classes.select("doc_id", "sig"), "doc_id").select(_token_path(SLOTS).alias("key"), "t", "doc_id", "comp"), "deep")
        nodes = nodes.unionByName(deep.filter(F.col("size") <= TASK_NODE))
        large = deep.filter(F.col("size") > TASK_NODE).select("key", "t", "doc_id")
    path = F.substring("sig", F.col("t") * (4 * SLOTS) + 1, F.lit(4 * SLOTS)).alias("path")
    nodes = nodes.drop("size").join(classes.select("doc_id", "n", "sig", "low"), "doc_id").select("key", path, "doc_id", "comp", "n", "low", "t", _token_path(SLOTS).alias("deep"))
    nodes = nodes.repartition(n, "key").sortWithinPartitions("key", "path")
    found = pin(arrow(nodes, _recurse, "a long, b long, key long, t int"), "found")
    members = found.filter("b is null").select("key", "t", F.col("a").alias("doc_id"))
    return found.filter("b is not null").select("a", "b"), members if large is None else members.unionByName(large)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_links (confirmed links of the document's class that were needed)."""
    rows = keyed(docs)
    sets = pin(arrow(rows, _sketches, "doc_id long, n long, hi long, lo long, sig binary, low binary"), "sketches")
    classes = pin(sets.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("low").alias("low")), "classes")
    links: DataFrame | None = None

    def load(ids: DataFrame, most: int) -> DataFrame:
        """Full sets of these documents; a list of few ids is broadcast and the texts are not shuffled."""
        ids = F.broadcast(ids) if most <= BROADCAST_IDS else ids.distinct()
        return pin(arrow(rows.join(ids, "doc_id", "left_semi"), _full, "doc_id long, shingles binary"), "full")

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = pin(pairs.distinct(), "pairs")
        full = load(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), 2 * pairs.count())
        x, y = (full.select(F.col("doc_id").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
        return pin(arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), _confirm, "a long, b long"), "links")

    def merged(comp: DataFrame | None, more: DataFrame) -> DataFrame:
        """Components after some more links; earlier ones count as stars."""
        nonlocal links
        links = more if links is None else links.unionByName(more)
        edges = more if comp is None else more.unionByName(comp.select(F.col("comp").alias("a"), F.col("doc_id").alias("b")))
        return sized(components(edges).withColumnRenamed("node", "doc_id"), BROADCAST_IDS)

    comp = merged(None, confirm(_stars(classes)))
    pairs, large = _propose(classes, comp)
    comp = merged(comp, confirm(pairs))
    if large.limit(1).count():
        now = large.join(comp, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
        now = pin(now.join(classes.select("doc_id", "n"), "doc_id"), "large")
        main = now.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max(F.struct("c", "comp", "s")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s")).filter("c > m.c")
        blocks = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / BLOCK_SHINGLES)).cast("int")
        main = main.select("key", "main", blocks(F.col("c"), F.col("s")).alias("nb"), blocks(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("nr"))
        now = pin(now.join(main, "key").withColumn("rest", F.col("comp") != F.col("main")), "rest")
        full = load(now.select("doc_id"), now.count())
        b, r = (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.col(k)).cast("int") for k in ("nb", "nr"))
        as_right = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda x: F.struct(F.lit(False).alias("left"), x.alias("r"), b.alias("b")))
        as_left = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.struct(F.lit(True).alias("left"), r.alias("r"), x.alias("b")))
        roles = F.explode(F.when(F.col("rest"), F.concat(as_right, as_left)).otherwise(as_right)).alias("role")
        now = now.select("key", "t", "doc_id", "comp", "n", "rest", roles).select("key", "t", "doc_id", "comp", "n", "rest", "role.*")
        now = now.join(classes.select("doc_id", "sig"), "doc_id").join(full, "doc_id")
        comp = merged(comp, pin(now.groupBy("key", "r", "b").applyInArrow(_finish, "a long, b long"), "links"))
    degree = links.select(F.col("a").alias("doc_id")).union(links.select("b")).groupBy("doc_id").agg(F.count("*").alias("n_links"))
    of = classes.select("hi", "lo", "n", "doc_id").join(comp, "doc_id", "left").join(degree, "doc_id", "left")
    of = of.select("hi", "lo", "n", F.coalesce("comp", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sets.select("doc_id", "hi", "lo", "n").join(of, ["hi", "lo", "n"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
