"""Streams of listings and events into tables that can be run again without harm.

What a stream has seen is keyed state of Spark's own (the hashes or the last row of each key, dealt over the tasks and kept in
the checkpoint folder), so a batch costs as much as the batch: the target is only ever appended to.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auctionlake.operators.merge import content_addressed


def first_contents(stream: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The rows whose key and content hash (added as ``content_hash``) the stream has not had before. Nulls equal nulls."""
    return content_addressed(stream, payload).dropDuplicates([*keys, "content_hash"])


def changed_rows(stream: DataFrame, keys: Sequence[str], order: Sequence[str], watched: Sequence[str]) -> DataFrame:
    """The rows in which a watched column differs from the row before of their key, batches before included; first rows count.

    A batch's rows of a key go by ``order``; the state of a key is its last row's watched values. Nulls equal nulls.
    """
    schema = stream.schema
    state = T.StructType([T.StructField(f"w{k}_", schema[c].dataType) for k, c in enumerate(watched)])

    def run(_: tuple, parts: Iterator[pd.DataFrame], known: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(list(order), kind="stable", na_position="first")
        values = rows[list(watched)].astype(object)
        values = values.where(values.notna(), None)
        last = known.get if known.exists else None
        keep = []
        for row in values.itertuples(index=False, name=None):
            keep.append(row != last)
            last = row
        known.update(last)
        yield rows[keep]

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def append_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to the Parquet table at ``path`` everything that is there now and was not there in an earlier run with this checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(events: DataFrame, time_col: str, keys: Sequence[str], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by window and key of events that are at most ``late`` late; works on tables and streams."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width), *keys).agg(F.count("*").alias("n"))
