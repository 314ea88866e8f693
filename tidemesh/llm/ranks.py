"""Running sums within a key without a window over all its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets whose sums are run up in one window.
CHUNK = 4096


def before(sums: DataFrame, key: str, bucket: str, values: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    """key, bucket and, for each column of ``values``, the sum of it over the key's smaller buckets under the name given there.

    ``sums`` has one row for each key and bucket (a number from 0). Buckets are summed in chunks of ``chunk``, and the chunks'
    totals on their own, so that a window holds ``chunk`` rows, or a key's chunks.
    """
    part = F.expr(f"{bucket} div {chunk}")
    rows = sums.withColumn("_chunk", part)
    up_to = Window.partitionBy(key, "_chunk").orderBy(bucket)
    above = Window.partitionBy(key).orderBy("_chunk")

    def ahead(column: str, w) -> Column:
        return F.sum(column).over(w) - F.col(column)

    totals = rows.groupBy(key, "_chunk").agg(*(F.sum(v).alias(v) for v in values))
    totals = totals.select(key, "_chunk", *(ahead(v, above).alias(f"_{v}") for v in values))
    within = rows.select(key, bucket, "_chunk", *(ahead(v, up_to).alias(v) for v in values))
    return within.join(totals, [key, "_chunk"]).select(key, bucket, *((F.col(v) + F.col(f"_{v}")).alias(name) for v, name in values.items()))
