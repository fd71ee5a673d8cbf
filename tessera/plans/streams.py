"""Stateful operators over the events table read as a stream, all of it in one run."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.scratch import root
from ..streaming import states
from .registry import Facts, query


def drained(source, operator, folder: str):
    """Rows that the operator has given once the stream holds no more; a second run lets the last watermark close what it closes."""
    for _ in range(2):
        operator(source).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return f"{folder}/out"


@query("stream_presence", """WITH p AS (SELECT DISTINCT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d, (user_id % 97)::VARCHAR AS a, event_type AS b FROM events), m AS (SELECT floor((epoch_ms(max(ts)) - 2 * 86400000) / 86400000) AS mark FROM events),
k AS (SELECT *, d - row_number() OVER (PARTITION BY a, b ORDER BY d) AS g FROM p), r AS (SELECT a, b, min(d)::BIGINT AS opened, max(d)::BIGINT AS closed, count(*)::BIGINT AS units FROM k GROUP BY a, b, g)
SELECT r.* FROM r, m WHERE closed + 1 < mark""")
def stream_presence(f):
    """Closed intervals of each pair; those that a later event could still lengthen are not out yet."""
    events = f.events
    source = f.spark.readStream.schema(events.schema).parquet(f"{f.sf_dir}/events.parque[t]")
    pairs = source.select((F.col("user_id") % 97).cast("string").alias("a"), F.col("event_type").alias("b"), F.col("ts").cast("timestamp").alias("ts"))
    out = drained(pairs, states.presence, f"{root(f.spark)}/streams/presence-{uuid.uuid4().hex}")
    return f.spark.read.schema(states.INTERVALS).parquet(out)
