"""Arrow batches of bounded bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of a batch that a Python worker gets; a longer row is a batch of its own.
BATCH_BYTES = 8_000_000


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow with batches of at most BATCH_BYTES; the bound is a setting of the session, and a smaller one of the user's stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)
