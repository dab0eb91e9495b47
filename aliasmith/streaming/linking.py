"""Linking of a stream of queries: no state, a join with the static alias table in each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import segment
from ..plans.linking import link


def link_stream(queries: DataFrame, best: DataFrame, path: str, checkpoint: str, threshold: float, **trigger: object) -> StreamingQuery:
    """Write the links of a stream (query_id, text) to parquet files in `path`.

    The alias table is read afresh in each batch, the length of its longest alias once. The grouping of matches by query is
    within a batch, so no state is kept; a batch that is run again writes the same rows under its own number.
    """
    longest = segment.longest_alias(best)

    def write(batch: DataFrame, number: int) -> None:
        link(batch, best, threshold, longest=longest).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
