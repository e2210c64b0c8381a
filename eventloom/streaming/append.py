"""Live appends: ids minted per session by a stateful stream, and running projections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MINTED = "session_id string, seq long, event_id string, blob_id string"


def mint_ids(events: DataFrame) -> DataFrame:
    """A stream (session_id, seq, ..) with event and blob ids, numbered per session in order of seq within a batch.

    State is one counter a session; a batch is bounded by the source's rate limits.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        k = range(n, n + len(rows))
        state.update((n + len(rows),))
        yield pd.DataFrame({"session_id": key[0], "seq": rows["seq"].to_numpy(), "event_id": [f"evt_{key[0]}_{i}" for i in k], "blob_id": [f"blob_{i}" for i in k]})

    rows = events.select(F.col("session_id"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("session_id").applyInPandasWithState(step, MINTED, "n long", "append", GroupStateTimeout.NoTimeout)


def running_projection(events: DataFrame, value) -> DataFrame:
    """A stream of (session_id, value, last_seq): an update of each session's fold and its watermark per batch."""
    return events.groupBy("session_id").agg(F.sum(value).alias("value"), F.max("seq").alias("last_seq"))


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what the source has now and return the result; offsets and state are kept below ``folder``."""
    spark = stream.sparkSession
    out = f"{folder.rstrip('/')}/out"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
