"""Streams of writes: suppression, counters and retention as keyed state.

All inputs of a node share one key, so one stateful operator folds them; what it holds is an input's
last value and the node's counters, of fixed size a node. Results equal the batch operators'.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
STATE = "srcs array<string>, vals array<int>, out int, last long"
OUT = "sub long, seq long, out int"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files below ``path`` as a stream of events."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def retained_meet(writes: DataFrame, n_deps: int) -> DataFrame:
    """(sub, seq, out) after every write that changes an input: a gated meet of ``n_deps`` inputs a node.

    ``writes`` (seq, sub, src, val) may repeat rows or come late: a seq at or below the last one seen
    of its node is dropped, as a log's replays are.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        srcs, vals, out, last = state.get if state.exists else ([], [], -1, -1)
        seen = dict(zip(srcs, vals, strict=True))
        rows = pd.concat(list(batches)).sort_values("seq")
        done = []
        for seq, src, val in zip(rows["seq"].tolist(), rows["src"].tolist(), rows["val"].tolist(), strict=True):
            if seq <= last:
                continue
            last = seq
            if seen.get(src, -1) == val:
                continue
            seen[src] = val
            values = list(seen.values())
            if 0 in values:
                out = 0
            elif len(values) == n_deps and -1 not in values:
                out = 1
            done.append((key[0], seq, out))
        state.update((list(seen), list(seen.values()), out, last))
        yield pd.DataFrame(done, columns=["sub", "seq", "out"])

    return writes.groupBy("sub").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is there into Parquet below ``path``; a rerun goes on from the checkpoint."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
