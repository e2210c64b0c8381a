"""Line dedup with a suffix array over line-id sequences.

A document is the sequence of its non-blank lines, each named by a 128-bit digest.  The
suffix array over all sequences is made by distributed prefix doubling: round d ranks the
runs of 2**d lines by the pair of ranks of their halves.  Ranks are given to distinct
pairs only, in sorted order, by range-partitioned tasks, so a line that fills a third of
the corpus is one pair.  A run that occurs once leaves the rounds; its suffix has its
place.  Runs never cross documents.

Descending the rounds again extends each suffix to its longest repeated prefix, i.e. to
the longest-common-prefix interval that holds it; these are the maximal repeated runs.

A line is deleted if a run of ``min_lines`` lines over it also starts at an earlier place
(smaller doc_id, then line).  Every later copy of a maximal repeated run of that many
lines thus goes and the first stays.  In the tree of intervals those that decide are the
outermost of at least ``min_lines`` lines: an interval inside one of them is a longer run
whose places the outer one has judged already.  Their places are what round
log2(``min_lines``) ranks alike.  Blank lines have no id, are kept and do not end a run.

Defined results: a null text has no lines and stays null; a text without line ends is one
line; rows with a null doc_id are left out; of rows with one doc_id the greatest text
counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import arrow, keyed, pin, slices

MIN_LINES = 1
#: Places of deleted lines up to which their table is broadcast; beyond, the texts are shuffled to meet it.
BROADCAST_PLACES = 1_000_000
_LINE_PA = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            docs, counts, digests = part.column(0), [], []
            for t in part.column(1).cast(pa.binary()).to_pylist():
                new = [hashlib.blake2b(x, digest_size=16).digest() for x in (t or b"").split(b"\n") if x.strip()]
                counts.append(len(new))
                digests += new
            n = np.array(counts, np.int64)
            ids = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            at = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(docs, dtype=np.int64), n)), pa.array(at.astype(np.int32)), pa.array(ids[:, 0]), pa.array(ids[:, 1])], schema=_LINE_PA)


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Ranks, in the order of the keys, of the distinct keys that occur twice at least."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    several = rows.groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    return pin(several.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), name)


def suffix_ranks(lines: DataFrame, most: int | None = None) -> list[DataFrame]:
    """Round d: (doc_id, at, rank) of the runs of 2**d lines that occur twice at least; all rounds, or the first ``most``."""
    rounds = [pin(lines.join(_ranked(lines, ["hi", "lo"], "lines"), ["hi", "lo"]).select("doc_id", "at", "rank"), "round0")]
    while len(rounds) != most:
        step = 1 << (len(rounds) - 1)
        now = rounds[-1]
        pairs = now.withColumnRenamed("rank", "r1").join(now.select("doc_id", (F.col("at") - step).alias("at"), F.col("rank").alias("r2")), ["doc_id", "at"])
        nxt = pin(pairs.join(_ranked(pairs, ["r1", "r2"], "ranks"), ["r1", "r2"]).select("doc_id", "at", "rank"), f"round{len(rounds)}")
        if not nxt.limit(1).count():
            break
        rounds.append(nxt)
    return rounds


def repeated_runs(rounds: list[DataFrame]) -> DataFrame:
    """(doc_id, at, len, rank): the longest repeated run that starts at each place; equal (len, rank) are equal runs."""
    top = len(rounds) - 1
    runs = rounds[top].select("doc_id", "at", F.lit(1 << top).alias("len"), "rank")
    for d in range(top - 1, -1, -1):
        nxt = rounds[d].select("doc_id", F.col("at").alias("next"), F.col("rank").alias("r2"))
        more = runs.join(nxt, (runs["doc_id"] == nxt["doc_id"]) & (runs["at"] + runs["len"] == nxt["next"])).select(runs["doc_id"], "at", F.col("len").alias("l0"), F.col("rank").alias("r1"), "r2")
        longer = more.join(_ranked(more, ["l0", "r1", "r2"], "longer"), ["l0", "r1", "r2"]).select("doc_id", "at", (F.col("l0") + (1 << d)).alias("len2"), F.col("rank").alias("rank2"))
        runs = runs.join(longer, ["doc_id", "at"], "left").select("doc_id", "at", F.coalesce("len2", "len").alias("len"), F.coalesce("rank2", "rank").alias("rank"))
        new = rounds[d].join(rounds[d + 1], ["doc_id", "at"], "left_anti").select("doc_id", "at", F.lit(1 << d).alias("len"), "rank")
        runs = pin(runs.unionByName(new), f"runs{d}")
    return runs


def later_copies(rounds: list[DataFrame], min_lines: int) -> DataFrame:
    """(doc_id, at): starts of runs of ``min_lines`` lines that also start at an earlier place."""
    d = min_lines.bit_length() - 1
    if d >= len(rounds):
        return rounds[0].select("doc_id", "at").filter("false")
    rows = rounds[d]
    if shift := min_lines - (1 << d):
        rows = rows.withColumnRenamed("rank", "r1").join(rounds[d].select("doc_id", (F.col("at") - shift).alias("at"), F.col("rank").alias("r2")), ["doc_id", "at"])
    keys = ["r1", "r2"] if shift else ["rank"]
    first = rows.groupBy(*keys).agg(F.min(F.struct("doc_id", "at")).alias("first"))
    return rows.join(first, keys).filter(F.struct("doc_id", "at") > F.col("first")).select("doc_id", "at")


def _apply(min_lines: int, drop_emptied: bool):
    """Rows (id, text, starts, longest, ..): the text without the lines of runs at ``starts``, n_lines, n_removed and longest_run follow the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[1]):
                n_lines, removed, kept = [], [], []
                for text, starts in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    gone = {i for s in starts or () for i in range(s, s + min_lines)}
                    out, at = [], 0
                    for line in text.split(b"\n") if text is not None else ():
                        blank = not line.strip()
                        if blank or at not in gone:
                            out.append(line)
                        at += not blank
                    n_lines.append(at)
                    removed.append(len(gone))
                    kept.append(b"\n".join(out) if text is not None else None)
                longest = pc.fill_null(part.column(3), 0)
                done = [part.column(0), pa.array(kept, pa.binary()).cast(pa.string()), *(part.column(i) for i in range(4, part.num_columns)), pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64()), longest]
                done = pa.RecordBatch.from_arrays(done, names=[f"c{i}" for i in range(len(done))])
                yield done.filter(pc.greater(done.column(len(done.schema) - 3), done.column(len(done.schema) - 2))) if drop_emptied else done

    return run


def marked(rows: DataFrame, min_lines: int = MIN_LINES, longest: bool = True) -> DataFrame:
    """doc_id, starts (of later copies of ``min_lines`` lines), longest (lines of the longest repeated run), for documents that have any.

    Without ``longest``, which is null then, the rounds end with the one that decides what goes.
    """
    rounds = suffix_ranks(pin(arrow(rows, _lines, "doc_id long, at int, hi long, lo long"), "ids"), None if longest else min_lines.bit_length())
    gone = pin(later_copies(rounds, min_lines), "gone")
    out = gone.groupBy("doc_id").agg(F.collect_list("at").alias("starts"))
    if longest:
        out = repeated_runs(rounds).groupBy("doc_id").agg(F.max("len").cast("long").alias("longest")).join(out, "doc_id", "left")
    else:
        out = out.withColumn("longest", F.lit(None).cast("long"))
    out = pin(out.select("doc_id", "starts", "longest"), "marked")
    return F.broadcast(out) if out.count() + gone.count() <= BROADCAST_PLACES else out


def without_copies(docs: DataFrame, min_lines: int = MIN_LINES, drop_emptied: bool = False, longest: bool = True) -> DataFrame:
    """Documents, one row per doc_id, with later copies of lines taken out of text; n_lines, n_removed and, if asked for, longest_run come last.

    Other columns stay as they are, whatever their names.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)))
    made = plain.join(marked(plain.select("doc_id", "text"), min_lines, longest), "doc_id", "left").select("doc_id", "text", "starts", "longest", *plain.columns[2:])
    schema = StructType([*plain.schema.fields, *(StructField(x, LongType()) for x in ("n_lines", "n_removed", "longest_run"))])
    out = arrow(made, _apply(min_lines, drop_emptied), schema)
    return out if longest else out.drop("longest_run")


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines (non-blank), n_removed, longest_run (lines of the longest repeated run that starts in it, 0: none), kept (text)."""
    return without_copies(keyed(docs), min_lines).select("doc_id", "n_lines", "n_removed", "longest_run", F.col("text").alias("kept"))


def digests(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """As ``line_dedup``, with the SHA-256 of the kept text (null: of the empty text) in its place."""
    return line_dedup(docs, min_lines).select("doc_id", "n_lines", "n_removed", "longest_run", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
